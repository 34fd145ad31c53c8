"""Chunk builders: web pages, plain text, markdown, PDF blocks. All yield the chunk schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import BLANK, heading_slug, is_blank, pieces, strip
from loomspark.operators import blocks as pdf
from loomspark.operators import html as walks
from loomspark.operators.structure import book_heading_kind, book_item_kind, heading_kind, markdown_kind

CHUNK = ("source_id", "chunk_ord", "text", "source", "position", "source_type", "metadata", "prefilter_kind")
BOOK_CHARS = 30


def _meta(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def dispatch(location: Column, content_type: Column | None = None, body: Column | None = None, is_text: Column | None = None) -> Column:
    """Which reader a source takes: manual, pdf, html, epub, file; null if none fits."""
    lowered = F.lower(location)
    web = location.rlike("^https?://")
    as_pdf = F.lit(False)
    if content_type is not None:
        as_pdf = as_pdf | F.coalesce(content_type == "application/pdf", F.lit(False))
    if body is not None:
        as_pdf = as_pdf | F.coalesce(F.substring(body.cast("binary"), 1, 5) == F.lit("%PDF-").cast("binary"), F.lit(False))
    kind = F.when(web & as_pdf, "pdf").when(web, "html").when(lowered.endswith(".pdf"), "pdf").when(lowered.endswith(".epub"), "epub").when(lowered.endswith(".txt") | lowered.endswith(".md"), "file")
    return kind if is_text is None else F.when(is_text, "manual").otherwise(kind)


def from_pages(pages: DataFrame) -> DataFrame:
    """Chunks of pages (source_id, url, html): a paragraph each, flagged by the heading above it."""
    rows = pages.select("source_id", "url", F.posexplode(walks.paragraphs(F.col("html"))).alias("chunk_ord", "p"))
    anchor = F.coalesce("p.anchor", F.lit(""))
    return rows.select(
        "source_id", "chunk_ord", F.col("p.text").alias("text"), F.col("url").alias("source"),
        F.when(anchor != "", F.concat(F.lit("#"), anchor)).otherwise("").alias("position"), F.lit("url").alias("source_type"),
        _meta(url=F.col("url"), anchor=anchor).alias("metadata"), heading_kind(F.col("p.section_title")).alias("prefilter_kind"),
    )


def from_text(texts: DataFrame) -> DataFrame:
    """Chunks of texts (source_id, label, text): parts between blank lines. A blank label becomes `manual <today>`."""
    label = F.when(is_blank(F.col("label")), F.concat(F.lit("manual "), F.current_date().cast("string"))).otherwise(strip(F.col("label")))
    rows = texts.select("source_id", label.alias("label"), F.posexplode(pieces(F.col("text"), rf"\n[{BLANK}]*\n")).alias("chunk_ord", "text"))
    return rows.select(
        "source_id", "chunk_ord", "text", F.col("label").alias("source"), F.lit("").alias("position"),
        F.lit("manual").alias("source_type"), _meta(label=F.col("label")).alias("metadata"), markdown_kind(F.col("text")).alias("prefilter_kind"),
    )


def markdown_sections(body: Column) -> Column:
    """Array of (head, text) sections at second- and third-level headings; the first has no head.

    The lookahead split keeps every heading with what follows it.
    """
    plain = F.regexp_replace(body, rf"(?s)\A---[{BLANK}]*\n.*?\n---[{BLANK}]*\n", "")
    parts = F.split(plain, rf"(?m)(?=^#{{2,3}}[{BLANK}]+[^\n]*$)")
    starts = lambda p: p.rlike(rf"\A#{{2,3}}[{BLANK}]+")
    head = lambda p: F.when(starts(p), F.regexp_extract(p, r"\A([^\n]*)", 1)).otherwise("")
    rest = lambda p: F.when(starts(p), F.regexp_replace(p, r"\A[^\n]*", "")).otherwise(p)
    made = F.transform(parts, lambda p: F.struct(strip(head(p)).alias("head"), strip(F.concat(strip(head(p)), F.lit("\n\n"), strip(rest(p)))).alias("text")))
    return F.filter(made, lambda s: s["text"] != "")


def from_markdown(files: DataFrame) -> DataFrame:
    """Chunks of markdown files (source_id, label, text); position is the heading's slug."""
    rows = files.select("source_id", "label", F.posexplode(markdown_sections(F.col("text"))).alias("chunk_ord", "s"))
    slug = heading_slug(F.col("s.head"))
    return rows.select(
        "source_id", "chunk_ord", F.col("s.text").alias("text"), F.col("label").alias("source"),
        F.when(slug != "", F.concat(F.lit("#"), slug)).otherwise("").alias("position"), F.lit("manual").alias("source_type"),
        _meta(label=F.col("label"), anchor=slug).alias("metadata"), markdown_kind(F.col("s.text")).alias("prefilter_kind"),
    )


def from_pdf_blocks(blocks: DataFrame) -> DataFrame:
    """Chunks of PDF text blocks (source_id, filename, page, block_ord, text, block_type)."""
    names = blocks.groupBy("source_id").agg(F.first("filename").alias("filename"))
    rows = pdf.flagged(blocks).join(names, "source_id")
    return rows.select(
        "source_id", F.col("block_ord").cast("int").alias("chunk_ord"), "text", F.col("filename").alias("source"),
        F.concat(F.lit("page "), F.col("page").cast("string")).alias("position"), F.lit("pdf").alias("source_type"),
        _meta(filename=F.col("filename"), page=F.col("page")).alias("metadata"), "prefilter_kind",
    )


def from_book_items(items: DataFrame) -> DataFrame:
    """Chunks of e-book items (source_id, title, filename, ord, href, properties, xhtml), in spine order."""
    rows = items.withColumn("item_kind", book_item_kind(F.col("href"), F.col("properties")))
    rows = rows.select("source_id", "title", "filename", "ord", "href", "item_kind", F.posexplode(walks.paragraphs(F.col("xhtml"), book=True)).alias("i", "p"))
    kind = F.coalesce("item_kind", "p.type_kind", F.when(F.col("p.is_caption"), "figure-caption"), book_heading_kind(F.col("p.section_title")))
    rows = rows.withColumn("prefilter_kind", kind).filter(F.col("prefilter_kind").isNotNull() | (F.length("p.text") >= BOOK_CHARS))
    source = F.coalesce("title", "filename")
    anchor = F.when(F.coalesce(F.col("p.anchor"), F.lit("")) != "", F.concat(F.lit("#"), F.col("p.anchor"))).otherwise("")
    return rows.select(
        "source_id", (F.shiftleft(F.col("ord").cast("bigint"), 32) + F.col("i")).alias("chunk_ord"), F.col("p.text").alias("text"), source.alias("source"),
        F.concat("href", anchor).alias("position"), F.lit("epub").alias("source_type"),
        _meta(title=source, filename=F.col("filename"), spine_item=F.col("href"), anchor=anchor).alias("metadata"), "prefilter_kind",
    )


def extraction_errors(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources that yielded no chunk."""
    return sources.join(chunks.select("source_id").distinct(), "source_id", "left_anti").select("source_id", F.lit("no content extracted").alias("error"))
