"""The engine's queries over the shared tables, and the same in SQL.

Tables that lack a marker which an operator needs get it from a fixed expression of
their keys, on both sides alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import blocks as B
from loomspark.operators import citation, classify, ledger, models, prefilter, review, routing, structure, tagging
from loomspark.plans import ingest as runs
from loomspark.schema import DEFAULT_CONVENTIONS, SOURCE_TYPES, ConfigError, TagRules
from loomspark.session import scratch, ship
from loomspark.sources import chunks as build
from loomspark.sources import epub, readers, sinks
from loomspark.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TITLES = ("Function", "References", "Cited by", "See also", "Notes", "Contents", "Author information")
TITLE_KINDS = (None, "references", "cited-by", "further-reading", "references", "table-of-contents", "author-info")
REASONS = (
    "extractor: pre-filtered references", "exceeds_budget: Back is 300 chars, limit 200", "no_shape_fit", "Passage is a bibliography entry",
    "Table of Contents of the book", "multiple distinct facts", "llm_error: TimeoutError", "purely transitional text",
    "a long story about refractive index", "journal citation with authors", "invalid_response: not JSON", "Boilerplate notice",
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _sql_list(values) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return "[" + ", ".join(quoted) + "]"


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + ")"


# Pages.

_SKIPPED = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("nav", "header", "footer", "aside", "script", "style", "form"):
    _SKIPPED = f"regexp_replace({_SKIPPED}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(x, '(?is)^.*<p(\\s[^>]*)?>', ''), '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]\\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_e}', '{_c}')"
_PARAGRAPHS = f"""
paragraphs AS (
  SELECT page_id, url, unnest(ps) AS text, unnest(range(len(ps)))::INT AS chunk_ord FROM (
    SELECT page_id, url, [y FOR y IN [regexp_replace({_CLEAN}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') FOR x IN parts[:-2] IF regexp_matches(x, '(?i)<p[\\s>]')] IF y <> ''] AS ps
    FROM (SELECT page_id, url, string_split_regex({_SKIPPED}, '(?i)</p\\s*>') AS parts FROM pages)))"""
_TITLED = f"titled AS (SELECT *, {_sql_list(TITLE_KINDS)}[1 + (page_id + chunk_ord) % 7] AS kind FROM paragraphs)"


def _page_chunks(spark, sf_dir) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url", "html")
    return build.from_pages(pages).withColumn("page_id", F.col("source_id").cast("bigint"))


def _titled_chunks(spark, sf_dir) -> DataFrame:
    title = _pick(TITLES, (F.col("page_id") + F.col("chunk_ord")) % len(TITLES))
    return _page_chunks(spark, sf_dir).withColumn("prefilter_kind", structure.heading_kind(F.lower(title)))


@query(f"WITH {_PARAGRAPHS} SELECT page_id, chunk_ord, text, url AS source, '' AS position FROM paragraphs")
def url_paragraph_chunks(spark, sf_dir):
    return _page_chunks(spark, sf_dir).select("page_id", "chunk_ord", "text", "source", "position")


@query(f"WITH {_PARAGRAPHS} SELECT page_id, chunk_ord, text FROM paragraphs")
def url_paragraphs_jvm(spark, sf_dir):
    from loomspark.operators.html import paragraphs_sql

    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(paragraphs_sql(F.col("html"))).alias("chunk_ord", "text"))


@query(f"WITH {_PARAGRAPHS}, {_TITLED} SELECT page_id, chunk_ord, kind AS prefilter_kind FROM titled")
def url_section_kinds(spark, sf_dir):
    return _titled_chunks(spark, sf_dir).select("page_id", "chunk_ord", "prefilter_kind")


@query(f"""WITH {_PARAGRAPHS}, {_TITLED}
SELECT CASE WHEN kind IS NULL THEN 'qa' ELSE 'trimmed' END AS bucket, kind, count(*) AS n FROM titled GROUP BY ALL""")
def flagship_lane_counts(spark, sf_dir):
    ask, flagged = prefilter.split(_titled_chunks(spark, sf_dir))
    unfit = ask.withColumns({"reason": F.lit("no_shape_fit"), "llm_bucket": F.lit(None).cast("string")})
    routed = routing.route(flagged.unionByName(unfit))
    return routed.groupBy(F.col("decision.bucket").alias("bucket"), F.col("prefilter_kind").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PARAGRAPHS}, {_TITLED} SELECT count(*) AS chunk_count, count(*) FILTER (kind IS NULL) AS dispatched,
coalesce(sum(length(text) + {len(classify.PROMPT.replace("{shapes}", classify.shapes_block(classify.DEFAULT_SHAPES)).replace("{passage}", ""))}) FILTER (kind IS NULL), 0)::BIGINT AS prompt_chars FROM titled""")
def prompt_cost(spark, sf_dir):
    ask = ~prefilter.is_flagged(F.coalesce("prefilter_kind", F.lit("")))
    size = F.when(ask, F.length(classify.prompt(F.col("text"))))
    return _titled_chunks(spark, sf_dir).agg(F.count("*").alias("chunk_count"), F.count_if(ask).alias("dispatched"), F.coalesce(F.sum(size), F.lit(0)).alias("prompt_chars"))


@query("""SELECT page_id, substr(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(url, '^[a-zA-Z]+://', ''), '/')), '[?#].*$', ''), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) AS slug FROM pages""")
def make_slug(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.source_slug(F.col("url"), F.lit("url")).alias("slug"))


@query("SELECT source, trim(regexp_replace(lower(regexp_replace(source, '\\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n FROM documents GROUP BY ALL")
def pdf_slug(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", X.source_slug(F.col("source"), F.lit("pdf")).alias("slug"), "n")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' WHEN 3 THEN 'epub' WHEN 4 THEN 'file' ELSE 'pdf' END AS reader FROM pages""")
def source_dispatch(spark, sf_dir):
    k = F.col("page_id") % 6
    place = F.when(k == 2, "a/B.PDF").when(k == 3, "x.epub").when(k == 4, "notes.MD").otherwise(F.col("url"))
    kind = F.when(k == 0, "application/pdf").otherwise("text/html")
    body = F.when(k == 5, "%PDF-1.7 x").otherwise(F.col("html")).cast("binary")
    return _table(spark, sf_dir, "pages").select("page_id", build.dispatch(place, kind, body).alias("reader"))


# Documents as text and markdown.


def _docs(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _texts(spark, sf_dir, text=None) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("label"), (F.col("text") if text is None else text).alias("text"))


def _by_doc(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.col("source_id").cast("bigint").alias("doc_id"), *cols)


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # X.BLANK for the SQL side


@query(f"""SELECT doc_id, unnest(range(len(ps)))::INT AS chunk_ord, unnest(ps) AS text FROM (
SELECT doc_id, [y FOR y IN [{_TRIM.format("x")} FOR x IN string_split_regex(coalesce(text, ''), '\\n\\s*\\n')] IF y <> ''] AS ps FROM documents)""")
def manual_paragraphs(spark, sf_dir):
    return _by_doc(build.from_text(_texts(spark, sf_dir)), "chunk_ord", "text")


_LINES = """lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) + 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


@query(f"WITH {_LINES} SELECT doc_id, ord, length({_TRIM.format('line')}) AS n FROM lines WHERE length({_TRIM.format('line')}) >= 30")
def manual_lines_min30(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).cast("bigint").alias("ord"), F.length(X.strip(F.col("line"))).cast("bigint").alias("n")).filter("n >= 30")


@query(f"""SELECT doc_id, 0 AS chunk_ord, 'Intro ' || doc_id AS text, '' AS position FROM documents
UNION ALL SELECT doc_id, 1, '## Part ' || doc_id || ': X!' || chr(10) || chr(10) || {_TRIM.format("text")}, '#part-' || doc_id || '-x' FROM documents
UNION ALL SELECT doc_id, 2, '### Tail' || chr(10) || chr(10) || 'End', '#tail' FROM documents""")
def md_heading_sections(spark, sf_dir):
    body = F.concat(F.lit("---\nk: v\n---\nIntro "), F.col("doc_id"), F.lit("\n## Part "), F.col("doc_id"), F.lit(": X!\n"), F.col("text"), F.lit("\n### Tail\n\nEnd\n"))
    return _by_doc(build.from_markdown(_texts(spark, sf_dir, body)), "chunk_ord", "text", "position")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'front-matter' WHEN 2 THEN 'link-list' WHEN 3 THEN 'table-of-contents' END AS kind FROM documents""")
def md_prefilter_kind(spark, sf_dir):
    k = F.col("doc_id") % 6
    text = F.when(k == 0, "# H\n\n## I").when(k == 1, "# H\n**Scope:** x\n**Date:** y").when(k == 2, "- [a](b)\n* see http://x").when(k == 3, "# Contents\n1. [a](b)\n2. https://y").when(k == 4, "- [a](b)\nprose").otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", structure.markdown_kind(text).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN contains(text, '@') THEN 1 ELSE 0 END AS n FROM documents")
def affiliation_markers(spark, sf_dir):
    k = F.col("doc_id") % 3
    head = F.when(k == 0, "Department of X, UNIVERSITY OF Y. ").when(k == 1, "Faculty of Z. ").otherwise("")
    return _docs(spark, sf_dir).select("doc_id", structure.affiliation_markers(F.concat(head, "text")).alias("n"))


@query("""SELECT href, CASE i WHEN 0 THEN 'table-of-contents' WHEN 1 THEN 'title-page' WHEN 2 THEN 'copyright' WHEN 3 THEN 'endnotes' WHEN 4 THEN NULL WHEN 5 THEN 'preface' WHEN 6 THEN 'author-info' ELSE NULL END AS kind, count(*) AS n
FROM (SELECT doc_id % 8 AS i, ['text/toc.xhtml', 'half-titlepage.xhtml', 'x/Uncopyright.xhtml', 'endnotes-2.xhtml', 'xhtml/index.xhtml', 'translators-preface.xhtml', 'about-the-author.xhtml', 'chapter-1.xhtml'][1 + doc_id % 8] AS href FROM documents) GROUP BY ALL""")
def book_item_kinds(spark, sf_dir):
    names = ("text/toc.xhtml", "half-titlepage.xhtml", "x/Uncopyright.xhtml", "endnotes-2.xhtml", "xhtml/index.xhtml", "translators-preface.xhtml", "about-the-author.xhtml", "chapter-1.xhtml")
    rows = _docs(spark, sf_dir).select(_pick(names, F.col("doc_id") % 8).alias("href")).groupBy("href").agg(F.count("*").alias("n"))
    return rows.select("href", structure.file_stem_kind(F.col("href")).alias("kind"), "n")


# Lines of documents as PDF blocks, five a page.

_BLOCK_TEXT = """CASE WHEN (doc_id + ord) % 11 = 4 THEN 'References' WHEN (doc_id + ord) % 23 = 9 THEN 'ACKNOWLEDGEMENTS' WHEN (doc_id + ord) % 11 IN (5, 6, 8) THEN line || ' et al. (1999)'
WHEN ord % 5 = 1 THEN 'Journal of Things ' || ord || ' running head' WHEN ord = 2 AND doc_id % 4 = 0 THEN 'Department of A, University of B, Place C' ELSE line END"""
_BLOCKS = f"{_LINES}, blocks AS (SELECT doc_id, ord, (ord - 1) // 5 + 1 AS page, {_TRIM.format(f'({_BLOCK_TEXT})')} AS text FROM lines)"
_KEYED = f"""{_BLOCKS}, keyed AS (SELECT *, substr(lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '\\s+', ' ', 'g'))), 1, 80) AS key FROM blocks),
running AS (SELECT doc_id, key FROM keyed WHERE length(text) BETWEEN 1 AND 150 AND key <> '' GROUP BY ALL HAVING count(DISTINCT page) >= 2)"""


def _blocks(spark, sf_dir) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("ord", F.col("i") + 1)
    n = F.col("doc_id") + F.col("ord")
    text = (
        F.when(n % 11 == 4, "References").when(n % 23 == 9, "ACKNOWLEDGEMENTS").when((n % 11).isin(5, 6, 8), F.concat("line", F.lit(" et al. (1999)")))
        .when(F.col("ord") % 5 == 1, F.concat(F.lit("Journal of Things "), "ord", F.lit(" running head")))
        .when((F.col("ord") == 2) & (F.col("doc_id") % 4 == 0), "Department of A, University of B, Place C").otherwise(F.col("line"))
    )
    return lines.select(F.col("doc_id").cast("string").alias("source_id"), F.concat("doc_id", F.lit(".pdf")).alias("filename"), (F.floor((F.col("ord") - 1) / 5) + 1).cast("int").alias("page"), F.col("ord").alias("block_ord"), text.alias("text"), F.lit(0).alias("block_type"))


@query(f"WITH {_KEYED} SELECT doc_id, key FROM running")
def running_blocks(spark, sf_dir):
    return _by_doc(B.running_keys(_blocks(spark, sf_dir).withColumn("text", X.strip(F.col("text")))), "key")


_STATES = f"""{_KEYED}, marked AS (
  SELECT k.*, r.key IS NOT NULL AS run, r.key IS NULL AND regexp_matches(text, '(?i)^\\s*(references|bibliography|works cited|literature cited|notes and references)\\b') AS refs,
    r.key IS NULL AND regexp_matches(text, '(?i)^\\s*acknowledge?ments\\b') AS thanks, length(text) >= 30 AS long,
    regexp_matches(text, '(?i)\\([0-9]{{4}}\\)|\\b[0-9]{{1,4}}:[0-9]{{1,4}}[–-][0-9]{{1,4}}\\b|\\bet al\\.?|\\bpp?\\.\\s*[0-9]') AS cites
  FROM keyed k LEFT JOIN running r USING (doc_id, key)),
placed AS (SELECT *, max(ord) FILTER (refs) OVER upto AS opened, max(ord) FILTER (thanks OR (NOT run AND long AND NOT refs AND NOT cites)) OVER before AS closed,
    max(ord) FILTER (thanks) OVER upto AS thanked FROM marked
  WINDOW upto AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kinds AS (SELECT *, opened IS NOT NULL AND (closed IS NULL OR closed < opened) AND NOT thanks AS inside, (thanked - 1) // 5 + 1 AS thanked_page,
    {" + ".join(f"contains(lower(text), '{m}')::INT" for m in structure.AFFILIATIONS)} AS marks FROM placed)
SELECT doc_id, ord::INT AS block_ord, CASE WHEN run THEN 'running-header' WHEN refs THEN 'bibliography' WHEN thanks THEN 'acknowledgments' WHEN inside AND cites THEN 'bibliography'
  WHEN NOT inside AND page = 1 AND marks >= 2 THEN 'author-affiliations' WHEN thanked_page = page AND (opened IS NULL OR opened < thanked) THEN 'acknowledgments' END AS kind
FROM kinds WHERE long"""


@query(f"WITH {_STATES}")
def pdf_block_kinds(spark, sf_dir):
    return _by_doc(B.flagged(_blocks(spark, sf_dir)), "block_ord", F.col("prefilter_kind").alias("kind"))


@query(f"SELECT kind, count(*) AS n FROM (WITH {_STATES}) GROUP BY ALL")
def pdf_kind_counts(spark, sf_dir):
    return build.from_pdf_blocks(_blocks(spark, sf_dir)).groupBy(F.col("prefilter_kind").alias("kind")).agg(F.count("*").alias("n"))


# Routing.

_MECHANICAL = "regexp_matches(reason, '^(exceeds_budget:|invalid_response:|llm_error:|no_shape_fit)')"
_ROUTED = f"""reasons AS (SELECT d.doc_id, d.lang, d.text, d.source, {_sql_list(REASONS)}[1 + d.doc_id % 12] AS reason, CASE quality WHEN 1 THEN 'qa' WHEN 0 THEN 'trimmed' END AS said
  FROM documents d LEFT JOIN labels l USING (doc_id)),
routed AS (SELECT *, CASE WHEN starts_with(reason, 'extractor:') THEN 'trimmed' WHEN {_MECHANICAL} THEN 'qa' WHEN said = 'qa' AND {_any("reason", routing.STRONG_CHAFF)} THEN 'trimmed' WHEN said IS NOT NULL THEN said
    WHEN {_any("reason", routing.CHAFF)} THEN 'trimmed' ELSE 'qa' END AS bucket,
  CASE WHEN NOT starts_with(reason, 'extractor:') THEN said END AS llm_bucket,
  NOT starts_with(reason, 'extractor:') AND NOT {_MECHANICAL} AND said IS NOT NULL AND said = 'qa' AND {_any("reason", routing.STRONG_CHAFF)} AS downgraded,
  CASE WHEN starts_with(reason, 'extractor:') OR {_MECHANICAL} THEN NULL WHEN said = 'qa' AND {_any("reason", routing.STRONG_CHAFF)} THEN 'qa_with_chaff' WHEN said = 'trimmed' AND NOT {_any("reason", routing.CHAFF)} THEN 'trimmed_without_chaff' END AS disagreement
  FROM reasons)"""


def _routed(spark, sf_dir) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = _docs(spark, sf_dir).join(labels, "doc_id", "left")
    rows = rows.withColumns({"source_id": F.lpad(F.col("doc_id").cast("string"), 20, "0"), "chunk_ord": F.lit(0), "position": F.lit(""), "reason": _pick(REASONS, F.col("doc_id") % len(REASONS)), "llm_bucket": F.when(F.col("quality") == 1, "qa").when(F.col("quality") == 0, "trimmed")})
    return routing.route(rows)


_STAGE = f"""CASE WHEN starts_with(reason, 'extractor:') THEN 'extractor (structural pre-filter, no LLM call)' WHEN {_MECHANICAL} THEN 'classifier (mechanical: budget/shape/parse)'
WHEN downgraded THEN 'LLM → backstop downgrade (chaff signal)' ELSE 'LLM (content judgment)' END"""


@query(f"WITH {_ROUTED} SELECT doc_id, bucket, llm_bucket, downgraded, disagreement, {_STAGE} AS stage FROM routed")
def routing_decision(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "decision.bucket", "decision.llm_bucket", "decision.downgraded", "decision.disagreement", "stage")


@query(f"WITH {_ROUTED} SELECT lang, count(*) FILTER (disagreement = 'qa_with_chaff') AS qa_with_chaff, count(*) FILTER (disagreement = 'trimmed_without_chaff') AS trimmed_without_chaff FROM routed GROUP BY lang")
def drift_counts(spark, sf_dir):
    return routing.drift(_routed(spark, sf_dir), "lang")


@query(f"WITH {_ROUTED} SELECT lang, count(*) FILTER (bucket = 'qa') AS qa, count(*) FILTER (bucket = 'trimmed') AS trimmed FROM routed GROUP BY lang")
def routing_pivot(spark, sf_dir):
    return routing.lane_counts(_routed(spark, sf_dir), "lang")


@query(f"WITH {_ROUTED} SELECT doc_id, bucket, row_number() OVER (PARTITION BY source, bucket ORDER BY doc_id)::INT AS item_no FROM routed")
def overflow_numbering(spark, sf_dir):
    return routing.numbered(_routed(spark, sf_dir), "source").select("doc_id", "decision.bucket", "item_no")


@query(f"""WITH {_ROUTED}, items AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY doc_id) AS n FROM routed),
body AS (SELECT source, string_agg('## ' || n || '. From ' || source || chr(10) || chr(10) || '_Stage: ' || {_STAGE} || '_  ' || chr(10) || '_Reason: ' || reason || '_' || chr(10) || chr(10) || regexp_replace(text, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') || chr(10), chr(10) ORDER BY n) FILTER (bucket = 'trimmed') AS b,
  count(*) FILTER (disagreement = 'qa_with_chaff') AS q, count(*) FILTER (disagreement = 'trimmed_without_chaff') AS t FROM items GROUP BY source)
SELECT source, '# Trimmed — s (2026-01-02)' || chr(10) || chr(10) || coalesce(chr(10) || b, 'This ingestion has no overflow here.' || chr(10)) || chr(10) || '---' || chr(10) || chr(10) || '_Routing drift (LLM bucket vs pattern): ' || q || ' qa→trimmed override(s) on strong chaff signal; ' || t || ' llm-trimmed chunk(s) with no pattern signal._' || chr(10) AS body FROM body""")
def overflow_render(spark, sf_dir):
    routed = _routed(spark, sf_dir)
    return review.rendered_overflow(routing.numbered(routed, "source"), "trimmed", "Trimmed", "s", "2026-01-02", routing.drift(routed, "source"), ("source",))


@query("SELECT doc_id % 4 <> 1 AS flagged, count(*) AS n, count(DISTINCT CASE WHEN doc_id % 4 <> 1 THEN doc_id % 4 END) AS reasons FROM documents GROUP BY ALL")
def prefilter_partition(spark, sf_dir):
    kind = _pick(("references", None, "heading", "link-list"), F.col("doc_id") % 4)
    ask, flagged = prefilter.split(_texts(spark, sf_dir).join(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), kind.alias("prefilter_kind")), "source_id"))
    both = ask.select(F.lit(False).alias("flagged"), F.lit(None).cast("string").alias("reason")).unionAll(flagged.select(F.lit(True), "reason"))
    return both.groupBy("flagged").agg(F.count("*").alias("n"), F.countDistinct("reason").alias("reasons"))


# Classification, from replies built out of the tables.


def _replied(rows: DataFrame, raw, key="doc_id") -> DataFrame:
    return rows.select(F.col(key), F.col(key).cast("string").alias("source_id"), F.lit(0).alias("chunk_ord"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit("").alias("position"), F.lit("manual").alias("source_type"), raw.alias("raw"), F.lit(None).cast("string").alias("llm_error"))


_LADDER = ("{0}", "not json", "[1, 2]", '{"choice": "overflow", "reason": "a bibliography", "bucket": "trimmed"}', '{"choice": "overflow", "bucket": "nowhere"}', '{"choice": "Nope"}', '{"choice": "Basic", "fields": [1]}', '{"choice": "Basic", "fields": {"back": "B", "FRONT": true}}', '{"choice": "Table", "rows": []}')


@query("""SELECT event_id, ['invalid_response: missing ''choice''', 'invalid_response: not JSON', 'invalid_response: got array (expected single object)', 'a bibliography', 'no_shape_fit', 'invalid_response: unknown note type ''Nope''',
'invalid_response: missing or non-dict ''fields''', NULL, 'invalid_response: missing or empty ''rows'''][1 + event_id % 9] AS reason, CASE event_id % 9 WHEN 3 THEN 'trimmed' END AS llm_bucket, CASE event_id % 9 WHEN 7 THEN 'True|B' END AS made FROM events""")
def json_ladder(spark, sf_dir):
    k = F.col("event_id") % len(_LADDER)
    raw = F.when(k == 0, F.col("props")).otherwise(_pick(_LADDER, k))
    done = classify.classified(_replied(_table(spark, sf_dir, "events"), raw, "event_id"))
    card = F.get("cards", F.lit(0))
    return done.select("event_id", "reason", "llm_bucket", F.when(card.isNotNull(), F.concat_ws("|", card["Front"], card["Back"])).alias("made"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN 'exceeds_budget: Back is ' || length(text) || ' chars, limit 200' END AS reason FROM documents")
def back_budget(spark, sf_dir):
    raw = F.to_json(F.struct(F.lit("Basic").alias("choice"), F.struct(F.lit("f").alias("Front"), F.col("text").alias("back")).alias("fields")))
    return classify.classified(_replied(_docs(spark, sf_dir), raw)).select("doc_id", "reason")


def _list_budget(rows: DataFrame) -> DataFrame:
    steps = F.array_join(F.transform(F.sequence(F.lit(1), F.col("doc_id") % 9 + 1), lambda i: F.concat(i.cast("string"), F.lit(". go"))), "  ")
    even = F.col("doc_id") % 2 == 0
    back = F.when(even, F.col("text")).otherwise(steps)
    raw = F.to_json(F.struct(F.when(even, "List").otherwise("Steps").alias("choice"), F.struct(F.lit("f").alias("Front"), back.alias("Back")).alias("fields")))
    return classify.classified(_replied(rows, raw)).select("doc_id", "reason")


_MARKED = f"""greatest(1, len(regexp_extract_all(text, '(?:^|[{_BLANK}])\\p{{Nd}}+\\.[{_BLANK}]')), len(regexp_extract_all(text, '(?:^|[{_BLANK}])[•\\-*][{_BLANK}]')))"""


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN m > 7 THEN 'exceeds_budget: Back has ' || m || ' items, limit 7' END ELSE CASE WHEN doc_id % 9 + 1 > 5 THEN 'exceeds_budget: Back has ' || (doc_id % 9 + 1) || ' steps, limit 5' END END AS reason
FROM (SELECT doc_id, CASE WHEN n > 1 THEN n ELSE {_MARKED} END AS m FROM (SELECT doc_id, text, len([x FOR x IN string_split_regex(text, '\\r\\n|[\\n\\x{{0b}}\\x{{0c}}\\r\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') IF regexp_replace(x, '[{_BLANK}]+', '', 'g') <> '']) AS n FROM documents))""")
def list_budget(spark, sf_dir):
    return _list_budget(_docs(spark, sf_dir))


# Cloze replies out of whole texts: a deletion for each run of words, and the last six words of every other text as one more.

_RUNS_IN = f"""(SELECT *, [array_to_string(w[i * step + 1:(i + 1) * step], ' ') FOR i IN range((n + step - 1) // step)] || CASE WHEN doc_id % 2 = 0 AND n > 5 THEN [array_to_string(w[n - 5:n], ' ')] ELSE [] END AS runs
  FROM (SELECT *, len(w) AS n FROM (SELECT doc_id, doc_id % 5 + 1 AS step, [x FOR x IN string_split(regexp_replace(coalesce(text, ''), '[{{}}{_BLANK}]+', ' ', 'g'), ' ') IF x <> ''] AS w FROM documents)))"""


def _whole_cloze(spark, sf_dir) -> DataFrame:
    step = (F.col("doc_id") % 5 + 1).cast("int")
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{{}}{X.BLANK}]+", " "), " "), lambda x: x != "")

    def runs(w):
        part = lambda i: F.array_join(F.slice(w, i * step + 1, step), " ")
        each = F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / step).cast("int") - 1), part)).otherwise(F.array().cast("array<string>"))
        last = F.when((F.col("doc_id") % 2 == 0) & (F.size(w) > 5), F.array(F.array_join(F.slice(w, F.size(w) - 5, 6), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(each, last)

    def deletion(r, i):
        k = (F.col("doc_id") + i) % 4
        return F.concat(F.when(k % 2 == 0, "{c").otherwise("{{c"), i + 1, F.lit("::"), r, F.when((k == 1) | (k == 2), "}").otherwise("}}"))

    made = F.transform(classify.let(words, runs), deletion)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.concat(made, F.array(F.lit("{{c0::z}}"))), " and ").alias("cloze"))


@query(f"SELECT doc_id, array_to_string(['{{{{c' || i || '::' || runs[i] || '}}}}' FOR i IN range(1, len(runs) + 1)] || ['{{{{c0::z}}}}'], ' and ') AS cloze FROM {_RUNS_IN}")
def cloze_repair(spark, sf_dir):
    return _whole_cloze(spark, sf_dir).select("doc_id", classify.cloze_repaired(F.col("cloze")).alias("cloze"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n > 5 THEN 'exceeds_budget: cloze deletion ' || CASE WHEN contains(d, '''') AND NOT contains(d, '"') THEN '"' || replace(d, '\\', '\\\\') || '"' ELSE '''' || replace(replace(d, '\\', '\\\\'), '''', '\\''') || '''' END || ' has 6 words, limit 5' END AS reason
FROM (SELECT *, '{{{{c' || len(runs) || '::' || runs[len(runs)] || '}}}}' AS d FROM {_RUNS_IN})""")
def cloze_budget(spark, sf_dir):
    raw = F.to_json(F.struct(F.lit("Cloze").alias("choice"), F.struct(F.col("cloze").alias("text")).alias("fields")))
    return classify.classified(_replied(_whole_cloze(spark, sf_dir), raw)).select("doc_id", "reason")


@query("""SELECT p_partkey, r::INT AS row_ord, CASE r WHEN 0 THEN p_name ELSE 'again' END AS key, CASE r WHEN 0 THEN 'type' ELSE 'brand' END AS name1, CASE r WHEN 0 THEN p_type ELSE p_brand END AS value1, CASE r WHEN 0 THEN 'size' ELSE '' END AS name2, CASE r WHEN 0 THEN p_size::VARCHAR ELSE '' END AS value2
FROM part, range(2) t(r) WHERE p_partkey % 5 <> 0""")
def term_table_explode(spark, sf_dir):
    attr = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    first = F.struct(F.concat(F.lit(" "), F.col("p_name")).alias("key"), F.array(attr("type", F.col("p_type")), attr("size", F.col("p_size"))).alias("attrs"))
    second = F.struct(F.when(F.col("p_partkey") % 5 == 0, " ").otherwise("again").alias("key"), F.array(attr("brand", F.col("p_brand"))).alias("attrs"))
    raw = F.to_json(F.struct(F.lit("Table").alias("choice"), F.array(first, second).alias("rows")))
    made = classify.cards(classify.classified(_replied(_table(spark, sf_dir, "part"), raw, "p_partkey")))
    return made.select("p_partkey", "row_ord", *[F.col("fields")[k].alias(a) for k, a in (("Key", "key"), ("Attr1Name", "name1"), ("Attr1Value", "value1"), ("Attr2Name", "name2"), ("Attr2Value", "value2"))])


def _table_faults(parts: DataFrame) -> DataFrame:
    value = F.when(F.col("p_partkey") % 2 == 1, F.repeat(F.lit("x"), 81)).otherwise("ok")
    row = F.struct(F.lit("k").alias("key"), F.array(F.struct(F.lit("n").alias("name"), value.alias("value"))).alias("attrs"))
    raw = F.to_json(F.struct(F.lit("Table").alias("choice"), F.array(row, F.struct(F.lit("").alias("key"), F.array(F.struct(F.lit("n").alias("name"), F.lit("v").alias("value"))).alias("attrs"))).alias("rows")))
    return classify.classified(_replied(parts, raw, "p_partkey")).select("p_partkey", "reason")


@query("SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'invalid_response: row 2 missing ''key''' ELSE 'exceeds_budget: row 1 attr 1 value is 81 chars, limit 80' END AS reason FROM part")
def term_table_faults(spark, sf_dir):
    return _table_faults(_table(spark, sf_dir, "part"))


def _reply(prompt: str) -> str:
    passage = prompt.split("Passage:\n", 1)[1].rstrip("\n")
    return '{"choice": "overflow", "reason": "length %d", "bucket": "qa"}' % len(passage)


@query("SELECT doc_id, 'length ' || length(rtrim(text, chr(10))) AS reason, 'qa' AS bucket FROM documents")
def llm_udf(spark, sf_dir):
    found = _texts(spark, sf_dir).withColumns({"chunk_ord": F.lit(0), "source": F.col("label"), "position": F.lit(""), "source_type": F.lit("manual"), "prefilter_kind": F.lit(None).cast("string")})
    _, over = classify.classify_chunks(found, lambda ask: classify.call_model(ask, _reply))
    return _by_doc(routing.route(over), "reason", "decision.bucket")


@query("SELECT doc_id, 'kept ' || lang AS reason FROM documents")
def llm_replay(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = _texts(spark, sf_dir, F.concat("lang", F.lit(" "), "text")).withColumns({"chunk_ord": F.lit(0), "source": F.col("label"), "position": F.lit(""), "source_type": F.lit("manual"), "prefilter_kind": F.lit(None).cast("string")})
    text = F.concat("lang", F.lit(" "), "text")
    recorded = docs.select(X.reply_key(text).alias("text_sha1"), F.concat(F.lit('{"choice": "overflow", "reason": "kept '), "lang", F.lit('"}')).alias("raw")).distinct()
    _, over = classify.classify_chunks(found, lambda ask: classify.replay(ask, recorded))
    return _by_doc(over, "reason")


# Tags.

_TAG = "CASE WHEN len(ls) > 0 THEN array_to_string(ls[1:2], '::') END"


@query(f"""SELECT p_partkey, {_TAG} AS tag FROM (SELECT p_partkey, [x FOR x IN string_split(regexp_replace(replace(lower(trim(p_type || '::' || p_brand || '::x ')), ' ', '-'), '[^a-z0-9:-]+', '', 'g'), '::') IF x <> ''] AS ls FROM part)""")
def tag_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", X.tag(F.concat("p_type", F.lit("::"), "p_brand", F.lit("::x "))).alias("tag"))


_VOCABULARY = "SELECT CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN 'Cloze' WHEN 2 THEN 'run::2024-01-05' WHEN 3 THEN 'agent-x' ELSE p_type || '::' || p_name END AS tag FROM part"
_SEEDED = f"SELECT tag FROM ({_VOCABULARY}) WHERE contains(tag, '::') AND NOT regexp_matches(tag, '\\d{{4}}-\\d{{2}}-\\d{{2}}')"


def _vocabulary(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 6
    tag = F.when(k == 0, F.col("p_type")).when(k == 1, "Cloze").when(k == 2, "run::2024-01-05").when(k == 3, "agent-x").otherwise(F.concat("p_type", F.lit("::"), "p_name"))
    return _table(spark, sf_dir, "part").select(tag.alias("tag"))


@query(f"SELECT tag, count(*) AS n FROM ({_SEEDED}) GROUP BY ALL")
def seed_filter(spark, sf_dir):
    return tagging.seed(_vocabulary(spark, sf_dir), TagRules()).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"SELECT tag, count(*) AS n FROM ({_VOCABULARY}) WHERE lower(tag) <> 'cloze' AND tag <> 'agent-x' AND NOT regexp_matches(tag, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND NOT regexp_matches(lower(tag), '^e') GROUP BY ALL")
def seed_filter_rules(spark, sf_dir):
    rules = TagRules(include_bare_leaves=True, extra_deny_patterns=("^e", "["))
    agents = spark.createDataFrame([("Agent-X",)], "name string")
    return tagging.seed(_vocabulary(spark, sf_dir), rules, agents).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT tag FROM ({_SEEDED}) ORDER BY tag LIMIT 200")
def tag_vocab_top200(spark, sf_dir):
    return tagging.shown(tagging.seed(_vocabulary(spark, sf_dir)))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'batch-7' WHEN 1 THEN array_to_string(list_concat([lower(p_type)], CASE WHEN lower(p_type) = 'x-y' THEN [] ELSE ['x-y'] END), ',') || ',batch-7' ELSE 'a,b,c,batch-7' END AS tags FROM part""")
def generate_tags(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, "oops").when(k == 1, F.to_json(F.struct(F.array(F.col("p_type"), F.lit(" X y"), F.lit("x-y"), F.lit("!!")).alias("tags")))).otherwise('{"tags": ["a", 5, "b", "a", "c", "d"]}')
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(tagging.tags_of(raw, F.lit(" batch-7 ")), ",").alias("tags"))


# Ledger.

_KEY = "substr(sha256(source || chr(0) || text), 1, 16)"


def _sourced(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "source", "text")


def _ledger(spark, sf_dir, held: str = "doc_id % 3 = 0") -> DataFrame:
    rows = _sourced(spark, sf_dir).filter(held).withColumns({"stable_guid": F.concat(F.lit("g"), "doc_id"), "deck": F.lit("D")})
    return ledger.entries(rows.withColumn("line_no", F.col("doc_id")), "2026-01-01T00:00:00+00:00").join(ledger.keyed(rows).select("key", "stable_guid", F.col("doc_id").alias("line_no")), ["key", "stable_guid"])


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def ledger_key(spark, sf_dir):
    return ledger.keyed(_sourced(spark, sf_dir)).select("doc_id", "key")


@query(f"SELECT doc_id FROM documents WHERE {_KEY} IN (SELECT {_KEY} FROM documents WHERE doc_id % 3 = 0)")
def ledger_seen(spark, sf_dir):
    return ledger.seen(_sourced(spark, sf_dir), _ledger(spark, sf_dir)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_KEY} NOT IN (SELECT {_KEY} FROM documents WHERE doc_id % 3 = 0)")
def ledger_new(spark, sf_dir):
    return ledger.unseen(_sourced(spark, sf_dir), _ledger(spark, sf_dir)).select("doc_id")


@query(f"SELECT {_KEY} AS key, 'g' || max(doc_id) AS stable_guid FROM documents GROUP BY ALL")
def ledger_latest(spark, sf_dir):
    return ledger.latest(_ledger(spark, sf_dir, "true")).select("key", "stable_guid")


@query(f"SELECT d.doc_id, l.guid AS stable_guid FROM (SELECT doc_id, {_KEY} AS key FROM documents) d LEFT JOIN (SELECT {_KEY} AS key, 'g' || max(doc_id) AS guid FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) l USING (key)")
def ledger_lookup(spark, sf_dir):
    return ledger.lookup(_sourced(spark, sf_dir), _ledger(spark, sf_dir)).select("doc_id", "stable_guid")


@query(f"SELECT count(DISTINCT {_KEY}) AS entries FROM documents")
def ledger_size(spark, sf_dir):
    return ledger.size(_ledger(spark, sf_dir, "true"))


@query(f"WITH {_LINES}, held AS (SELECT line, min(doc_id) AS first FROM lines GROUP BY line) SELECT DISTINCT doc_id FROM lines JOIN held USING (line) WHERE line <> '' AND first < doc_id")
def repeated_lines_seen(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.lit("line").alias("source"), F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    entries = ledger.keyed(lines).select("key", F.col("doc_id").alias("stable_guid"), F.lit("D").alias("deck"), F.lit("").alias("ingested_at"), (-F.col("doc_id")).alias("line_no"))
    return ledger.lookup(lines, entries).filter("stable_guid < doc_id").select("doc_id").distinct()


@query(f"SELECT {_KEY} AS key, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'new' ELSE 'old' END AS stable_guid FROM documents GROUP BY ALL")
def ledger_roundtrip(spark, sf_dir):
    """A large batch of entries, then a smaller one with some of the same keys, read back from the files."""
    folder = f"{scratch(spark)}/ledger"
    rows = lambda guid: _sourced(spark, sf_dir).withColumns({"stable_guid": F.lit(guid), "deck": F.lit("D")})
    ledger.record(rows("old"), folder)
    ledger.record(rows("new").filter("doc_id % 3 = 0"), folder)
    return ledger.latest(readers.read_ledger(spark, folder)).select("key", "stable_guid")


# Citation, scalars.


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN source WHEN 3 THEN source WHEN 4 THEN source || ', 2nd' WHEN 5 THEN source END AS cite_source,
CASE doc_id % 7 WHEN 0 THEN '#a' WHEN 1 THEN '' WHEN 2 THEN 'page ' || doc_id WHEN 3 THEN 'x.html#a' WHEN 4 THEN 'ch. 1, p. ' || doc_id WHEN 5 THEN '' END AS cite_position,
CASE doc_id % 7 WHEN 6 THEN 'missing metadata: url' END AS cite_error FROM documents""")
def cite_templates(spark, sf_dir):
    k = F.col("doc_id") % 7
    meta = lambda **v: F.create_map(*[x for a, b in v.items() for x in (F.lit(a), (F.lit(b) if isinstance(b, str) else b).cast("string"))])
    s, n = F.col("source"), F.col("doc_id")
    given = (
        F.when(k == 0, meta(url=s, anchor="#a")).when(k == 1, meta(doi=s)).when(k == 2, meta(filename=s, page=n)).when(k == 3, meta(title=s, spine_item="x.html", anchor="#a"))
        .when(k == 4, meta(title=s, edition="2nd", chapter="1", page=n)).when(k == 5, meta(label=s, x="1")).otherwise(meta(url=" "))
    )
    rows = _docs(spark, sf_dir).select("doc_id", _pick(("url", "doi", "pdf", "epub", "book", "manual", "url"), k).alias("source_type"), given.alias("metadata"))
    return citation.cited(rows, DEFAULT_CONVENTIONS).select("doc_id", "cite_source", "cite_position", "cite_error")


@query(f"""SELECT doc_id, substr(lower(trim(regexp_replace(regexp_replace(text, '\\p{{Nd}}+', '', 'g'), '[{_BLANK}]+', ' ', 'g'))), 1, 80) AS key, sha1(text) AS reply,
regexp_replace(regexp_replace(text, '\\r?\\n', ' ', 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS line FROM documents""")
def scalar_keys(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.repeat_key(c).alias("key"), X.reply_key(c).alias("reply"), X.inline(c).alias("line"))


@query(f"""SELECT conv_id, turn, unnest(range(len(ps)))::INT AS chunk_ord, 'conv:' || conv_id AS source, unnest(ps) AS text FROM (
SELECT conv_id, turn, [y FOR y IN [regexp_replace(x, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') FOR x IN string_split_regex(text, '\\n[{_BLANK}]*\\n')] IF y <> ''] AS ps FROM conversations)""")
def transcript_chunks(spark, sf_dir):
    texts = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("source_id"), F.concat(F.lit("conv:"), "conv_id").alias("label"), "text")
    key = F.split("source_id", "/")
    return build.from_text(texts).select(F.get(key, F.lit(0)).cast("bigint").alias("conv_id"), F.get(key, F.lit(1)).cast("bigint").alias("turn"), "chunk_ord", "source", "text")


# Review files and commits.


def _cards(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "part")
    fields = F.create_map(F.lit("Back"), F.concat("p_type", F.lit("\n"), "p_brand"), F.lit("Front"), F.col("p_name"), F.lit("Note"), F.lit(" n "))
    return rows.select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("source_id"), F.lit(0).alias("chunk_ord"), F.lit(0).alias("row_ord"), F.lit("term-def").alias("shape"), F.lit("Basic").alias("note_type"), fields.alias("fields"), F.array(F.lit("Back"), F.lit("Front"), F.lit("Note")).alias("field_order"), F.array(F.lower("p_type"), F.lit("b")).alias("tags"), F.col("p_brand").alias("source"), F.lit("p. 1").alias("position"), "p_partkey", "p_brand")


_BLOCK = """'## Card ' || n || ' — term-def' || chr(10) || '**Front:** ' || p_name || chr(10) || '**Back:** ' || p_type || ' ' || p_brand || chr(10) || '**Note:** n' || chr(10) || '**Source:** ' || p_brand || chr(10) || '**Position:** p. 1' || chr(10) || '**Deck:** D' || chr(10) || '**Model:** Basic' || chr(10) || '**Tags:** ' || lower(p_type) || ', b' || chr(10) || '---' || chr(10)"""


@query(f"SELECT p_brand, string_agg({_BLOCK}, chr(10) ORDER BY n) AS body FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) GROUP BY p_brand")
def queue_render(spark, sf_dir):
    return review.rendered_queue(_cards(spark, sf_dir), "D", ("p_brand",))


@query("SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS block, p_name AS front, p_type || ' ' || p_brand AS back, 'D' AS deck, 'Basic' AS model, lower(p_type) || '|b' AS tags FROM part")
def queue_parse_roundtrip(spark, sf_dir):
    files = review.rendered_queue(_cards(spark, sf_dir), "D", ("p_brand",)).withColumnRenamed("p_brand", "file")
    return review.parsed_blocks(files).select("file", "block", F.col("fields")["Front"].alias("front"), F.col("fields")["Back"].alias("back"), "deck", "model", F.array_join("tags", "|").alias("tags"))


def _blocks_to_commit(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(F.lit("f").alias("file"), n.cast("int").alias("block"), F.create_map(F.lit("Front"), F.concat(F.lit("q"), (n % 50).cast("string"))).alias("fields"), F.array(F.lit("Front")).alias("field_order"), F.concat(F.lit("d"), (n % 7).cast("string")).alias("deck"), F.lit("Basic").alias("model"), F.lit(None).cast("string").alias("error"))


_COMMIT = "SELECT p_partkey::INT AS block, 'd' || (p_partkey % 7) AS deck, substr(sha256('Basic' || chr(0) || 'd' || (p_partkey % 7) || chr(0) || 'q' || (p_partkey % 50)), 1, 16) AS guid FROM part"


@query(f"""WITH b AS ({_COMMIT}), store AS (SELECT guid FROM b WHERE block <= 40 AND deck <> 'd3')
SELECT block, CASE WHEN deck = 'd3' THEN 'failed' WHEN guid IN (SELECT guid FROM store) OR row_number() OVER (PARTITION BY guid ORDER BY block) > 1 THEN 'updated' ELSE 'created' END AS outcome,
CASE WHEN deck = 'd3' THEN 'deck setup failed for ''d3'': denied' END AS error FROM b""")
def commit_upsert(spark, sf_dir):
    blocks = _blocks_to_commit(spark, sf_dir)
    errors = spark.createDataFrame([("d3", "denied")], "deck string, deck_error string")
    store = review.merged(blocks.filter("block <= 40"), spark.createDataFrame([], "stable_guid string"), errors).filter("outcome <> 'failed'").select("stable_guid")
    return review.merged(blocks, store, errors).select("block", "outcome", "error")


@query(f"WITH b AS ({_COMMIT}) SELECT (SELECT count(DISTINCT guid) FROM b WHERE deck <> 'd3') AS created, (SELECT count(*) FROM b WHERE deck <> 'd3') - (SELECT count(DISTINCT guid) FROM b WHERE deck <> 'd3') AS updated, (SELECT count(*) FROM b WHERE deck = 'd3') AS failed")
def commit_counts(spark, sf_dir):
    errors = spark.createDataFrame([("d3", "denied")], "deck string, deck_error string")
    done = review.merged(_blocks_to_commit(spark, sf_dir), spark.createDataFrame([], "stable_guid string"), errors)
    return review.commit_summary(done).select(*[F.size(c).cast("bigint").alias(c) for c in ("created", "updated", "failed")])


@query(f"SELECT deck FROM ({_COMMIT}) GROUP BY deck")
def deck_distinct(spark, sf_dir):
    return review.decks(_blocks_to_commit(spark, sf_dir))


@query("SELECT name AS model_name FROM (VALUES ('Basic'), ('Cloze'), ('List'), ('Steps'), ('Table')) t(name) WHERE name NOT IN (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'Basic' ELSE 'Table' END FROM region)")
def bootstrap_missing(spark, sf_dir):
    present = _table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") % 2 == 0, "Basic").otherwise("Table").alias("model_name"))
    return models.missing(models.starter_models(spark), present).select("model_name")


@query("SELECT p_brand, coalesce(min(p_partkey) FILTER (p_size % 3 = 1), min(p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def shape_hint_first(spark, sf_dir):
    cards = _cards(spark, sf_dir).join(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    cards = cards.withColumn("shape", F.when(F.col("p_size") % 3 == 1, "term-list").otherwise("term-def"))
    return runs.chosen(cards, "term-list", "p_brand").select("p_brand", "p_partkey")


@query("SELECT doc_id FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') = '' OR doc_id % 10 = 0")
def extraction_failures(spark, sf_dir):
    texts = _texts(spark, sf_dir, F.when(F.col("doc_id") % 10 == 0, "\n \n").otherwise(F.col("text")))
    return _by_doc(build.extraction_errors(texts, build.from_text(texts)))


# Constructed books and pages out of documents.

def _markup(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


_HREFS = ("text/chapter-1.xhtml", "text/preface.xhtml", "toc.xhtml", "text/endnotes.xhtml", "text/Colophon.xhtml", "text/ch 2.xhtml")
_HREF_KINDS = (None, "preface", "table-of-contents", "endnotes", "colophon", None)
_SECTIONS, _SECTION_KINDS = ("chapter", "x bibliography", "toc", "halftitlepage dedication", "footnotes"), (None, "bibliography", "table-of-contents", "title-page", "endnotes")
_HEADS, _HEAD_KINDS = ("Methods", "About the Author", "References", "Notes "), (None, "author-info", "references", "references")


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def _rows(*rows: tuple) -> str:
    return "[" + ", ".join(f"{{'i': {i}, 'text': {text}, 'anchor': {anchor}, 'kind': {kind}}}" for i, (text, anchor, kind) in enumerate(rows)) + "]"


_BOOK_ROWS = _rows(
    ("'Opening words of document ' || doc_id || ' are here.'", "''", "item"),
    (_stripped("'Body ' || doc_id || ' ' || coalesce(text, '')"), "'#h' || doc_id", "coalesce(item, section, head)"),
    ("'Short ' || doc_id", "'#h' || doc_id", "coalesce(item, section, head)"),
    ("'Caption ' || doc_id", "'#h' || doc_id", "coalesce(item, section, 'figure-caption')"),
    ("'Closing words of document ' || doc_id || ' are here.'", "'#h' || doc_id", "item"),
)


@query(f"""WITH d AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'table-of-contents' ELSE {_sql_list(_HREF_KINDS)}[1 + doc_id % 6] END AS item, {_sql_list(_SECTION_KINDS)}[1 + doc_id % 5] AS section, {_sql_list(_HEAD_KINDS)}[1 + doc_id % 4] AS head, {_sql_list(_HREFS)}[1 + doc_id % 6] AS href FROM documents),
r AS (SELECT doc_id, href, unnest({_BOOK_ROWS}) AS x FROM d)
SELECT doc_id, (doc_id % 3) * 4294967296 + x.i AS chunk_ord, x.text AS text, href || x.anchor AS position, x.kind AS kind FROM r WHERE x.kind IS NOT NULL OR length(x.text) >= 30""")
def book_chunks(spark, sf_dir):
    n = F.col("doc_id")
    xhtml = _markup(
        "<html><body><p>Opening words of document ", n, " are here.</p><nav><p>skipped</p></nav><section epub:type='", _pick(_SECTIONS, n % 5), "' id='s", n, "'><h2 id='h", n, "'>", _pick(_HEADS, n % 4),
        "</h2><p>Body ", n, " ", _escaped(F.col("text")), "</p><div role='paragraph'>Sh<div>or</div>t ", n, "</div><figcaption>Caption <b>", n, "</b></figcaption></section><p>Closing words of document ", n, " are here.</p></body></html>",
    )
    items = _docs(spark, sf_dir).select(
        n.cast("string").alias("source_id"), F.lit("T").alias("title"), F.lit("f.epub").alias("filename"), (n % 3).cast("int").alias("ord"), _pick(_HREFS, n % 6).alias("href"),
        F.when(n % 7 == 0, F.array(F.lit("x"), F.lit("nav"))).otherwise(F.array().cast("array<string>")).alias("properties"), xhtml.alias("xhtml"),
    )
    return _by_doc(build.from_book_items(items), "chunk_ord", "text", "position", F.col("prefilter_kind").alias("kind"))


_PAGE_ROWS = _rows(("'A' || doc_id", "''", "NULL"), (_stripped("'B' || doc_id || ' ' || coalesce(text, '')"), "'#x' || doc_id", "head"), ("'C' || doc_id", "'#x' || doc_id", "'cited-by'"))


@query(f"""WITH r AS (SELECT doc_id, unnest({_PAGE_ROWS}) AS x FROM (SELECT *, {_sql_list((None, None, "references", "references"))}[1 + doc_id % 4] AS head FROM documents))
SELECT doc_id, x.i::INT AS chunk_ord, x.text AS text, x.anchor AS position, x.kind AS kind FROM r""")
def page_anchors(spark, sf_dir):
    n = F.col("doc_id")
    html = _markup("<h1>Top</h1><p>A", n, "</p><h2 id=x", n, ">", _pick(_HEADS, n % 4), "</h2><p>B", n, " ", _escaped(F.col("text")), "</p><nav><h2 id=no>No</h2><p>no</p></nav><h3>Cited <i>by</i></h3><p>C", n, "</p>")
    pages = _docs(spark, sf_dir).select(n.cast("string").alias("source_id"), F.lit("u").alias("url"), html.alias("html"))
    return _by_doc(build.from_pages(pages), "chunk_ord", "text", "position", F.col("prefilter_kind").alias("kind"))


def _archive(n: int) -> bytes:
    """A small e-book; of each six one is sound, one is in UTF-16, and four are bad in one way each."""
    import io
    import zipfile

    if n % 6 == 4:
        return b"no archive"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<c:container xmlns:c="x"><c:rootfiles><c:rootfile full-path="OEBPS/p.opf"/></c:rootfiles></c:container>')
        items = '<item id="b" href="b%202.xhtml" media-type="application/xhtml+xml" properties="x nav"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/>'
        last = "z" if n % 6 == 2 else "b"
        z.writestr("OEBPS/p.opf", f'<package xmlns:dc="y"><metadata><dc:title> Book {n} </dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="a"/><itemref idref="i"/><itemref idref="{last}"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", f"é{n}".encode("utf-16" if n % 6 == 1 else "utf-8"))
        if n % 6 != 3:
            z.writestr("OEBPS/b 2.xhtml", "a" * 300_000 if n % 6 == 5 else "second")
    return out.getvalue()


@query("""SELECT doc_id, 'Book ' || doc_id AS title, i::INT AS ord, ['OEBPS/a.xhtml', 'OEBPS/b 2.xhtml'][i + 1] AS href, ['', 'x nav'][i + 1] AS properties, ['é' || doc_id, 'second'][i + 1] AS xhtml, NULL AS error FROM documents, range(2) t(i) WHERE doc_id % 6 < 2
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, ['spine names unknown item z', 'spine names absent member OEBPS/b 2.xhtml', 'File is not a zip file', 'member OEBPS/b 2.xhtml expands too much'][doc_id % 6 - 1] FROM documents WHERE doc_id % 6 >= 2""")
def book_archives(spark, sf_dir):
    made = F.pandas_udf(lambda n: n.map(_archive), "binary")
    files = _docs(spark, sf_dir).select(F.concat(F.lit("/x/"), "doc_id").alias("path"), made("doc_id").alias("content"))
    items = epub.read_items(files)
    return items.select(F.substring("source_id", 4, 20).cast("bigint").alias("doc_id"), "title", "ord", "href", F.array_join("properties", " ").alias("properties"), "xhtml", F.substring_index("error", ":", 1).alias("error"))


# Prompts, replies, configs, sinks.

_TAG_PROMPT = "replace(replace(replace('{}', '{{tags}}', b), '{{note_type}}', 'Basic'), '{{fields}}', 'Back: ' || p_type || chr(10) || 'Front: ' || p_name)".format(tagging.PROMPT.replace("'", "''"))


@query(f"SELECT p_partkey, {_TAG_PROMPT} AS prompt FROM part, (SELECT coalesce(string_agg('- ' || tag, chr(10) ORDER BY tag), '(no tags yet)') AS b FROM (SELECT DISTINCT tag FROM ({_SEEDED}) ORDER BY tag LIMIT 200))")
def tag_prompt(spark, sf_dir):
    block = tagging.tags_block(tagging.seed(_vocabulary(spark, sf_dir))).first()["block"]  # 200 tags at most
    fields = F.create_map(F.lit("Back"), F.col("p_type"), F.lit("Source"), F.lit("s"), F.lit("Front"), F.col("p_name"), F.lit("Position"), F.lit("p"))
    return _table(spark, sf_dir, "part").select("p_partkey", tagging.prompt(F.lit(block), F.lit("Basic"), fields).alias("prompt"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN regexp_replace(t, '[{_BLANK}]+$', '') ELSE t || '```' END AS reply FROM (SELECT doc_id, 'x' || coalesce(text, '') AS t FROM documents)")
def reply_fences(spark, sf_dir):
    t, k = F.concat(F.lit("x"), F.coalesce("text", F.lit(""))), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), t, F.lit("\n``` \n"))).when(k == 1, F.concat(F.lit("```\n"), t)).otherwise(F.concat(t, F.lit("```")))
    return _docs(spark, sf_dir).select("doc_id", X.unfenced(raw).alias("reply"))


@query("SELECT sha1(text) AS text_sha1, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'new' ELSE 'old' END AS raw FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def merged_replies(spark, sf_dir):
    said = lambda raw: _docs(spark, sf_dir).filter("text is not null").select("doc_id", X.reply_key(F.col("text")).alias("text_sha1"), F.lit(raw).alias("raw"))
    return classify.merged_replies(said("old").drop("doc_id"), said("new").filter("doc_id % 2 = 0").drop("doc_id"))


@query("SELECT DISTINCT text, sha1(text) AS text_sha1 FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def unanswered_texts(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("text is not null")
    known = docs.filter("doc_id % 3 = 0").select(X.reply_key(F.col("text")).alias("text_sha1"))
    return classify.unanswered(docs.withColumn("prefilter_kind", F.lit("")), known)


@query("""SELECT r_name, ['unknown source types [''fax'']', 'missing source types [''doi'']', NULL, 'url: unknown keys [''more'']', 'url: missing key source_template'][1 + r_regionkey % 5] AS error FROM region""")
def config_faults(spark, sf_dir):
    good = {t: {"source_template": "{x}"} for t in SOURCE_TYPES}
    given = (good | {"fax": {}}, {t: c for t, c in good.items() if t != "doi"}, good, good | {"url": {"source_template": "x", "more": 1}}, good | {"url": {}})

    def fault(config: dict) -> str | None:
        try:
            readers.conventions_from(config)
        except ConfigError as e:
            return str(e)

    return _table(spark, sf_dir, "region").select("r_name", _pick([fault(g) for g in given], F.col("r_regionkey") % 5).cast("string").alias("error"))


@query(f"WITH {_ROUTED} SELECT bucket AS lane, '2026-01-02' AS ingestion_date, count(*) AS n, count(DISTINCT reason) AS reasons FROM routed GROUP BY ALL UNION ALL SELECT 'queue', '2026-01-02', count(*), 0 FROM part")
def lanes_roundtrip(spark, sf_dir):
    """Lanes written as Parquet, and read back by date and lane."""
    folder = scratch(spark)
    sinks.write_lanes(_routed(spark, sf_dir), _cards(spark, sf_dir), folder, "2026-01-02")
    count = lambda name, reasons: spark.read.parquet(f"{folder}/{name}").groupBy("lane", F.col("ingestion_date").cast("string").alias("ingestion_date")).agg(F.count("*").alias("n"), reasons.alias("reasons"))
    return count("overflow", F.countDistinct("reason")).unionAll(count("cards", F.lit(0).cast("bigint")))


@query("""SELECT substr(sha256('Basic' || chr(0) || 'd' || (k % 7) || chr(0) || 'q' || (k % 50)), 1, 16) AS stable_guid, 'd' || (k % 7) AS deck, CASE WHEN k % 2 = 0 THEN 'c' ELSE 'b' END || k AS back, 't' || k AS tags
FROM (SELECT max(p_partkey) AS k FROM part GROUP BY p_partkey % 350)""")
def commit_store(spark, sf_dir):
    """Notes of two commits, the second with other fields for some, read back from the store."""
    store = Store(spark, scratch(spark))
    n = F.col("block")
    blocks = lambda back: _blocks_to_commit(spark, sf_dir).withColumns({"fields": F.map_concat("fields", F.create_map(F.lit("Back"), F.concat(F.lit(back), n))), "tags": F.array(F.concat(F.lit("t"), n))})
    for rows in (blocks("b"), blocks("c").filter(n % 2 == 0)):
        store.add_decks(rows)
        store.upsert(review.merged(rows, store.notes()))
    notes = store.notes().join(store.decks(), "deck")
    return notes.select("stable_guid", "deck", F.col("fields")["Back"].alias("back"), F.array_join("tags", ",").alias("tags"))


@query("SELECT 'Cloze,List,Steps' AS created, 'Basic,Table' AS already_present")
def bootstrap_summary(spark, sf_dir):
    present = _table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") % 2 == 0, "Basic").otherwise("Table").alias("model_name"))
    return models.bootstrap(models.starter_models(spark), present).select(F.array_join("created", ",").alias("created"), F.array_join("already_present", ",").alias("already_present"))


@query("""SELECT r_name, ['A: unknown shape odd', 'A: unknown keys [''more'']', 'A: missing key fields', 'A: cutoffs must be whole numbers', NULL][1 + r_regionkey % 5] AS error FROM region""")
def shape_faults(spark, sf_dir):
    given = ({"shape": "odd", "fields": {}}, {"shape": "cloze", "fields": {}, "more": 1}, {"shape": "cloze"}, {"shape": "cloze", "fields": {}, "cutoffs": {"x": True}}, {"shape": "cloze", "fields": {}, "cutoffs": {"x": 1}})

    def fault(shape: dict) -> str | None:
        try:
            readers.shapes_from({"A": shape})
        except ConfigError as e:
            return str(e)

    return _table(spark, sf_dir, "region").select("r_name", _pick([fault(g) for g in given], F.col("r_regionkey") % 5).cast("string").alias("error"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 4 ELSE greatest(1, (n_nationkey - 1) // 2) END AS width FROM nation")
def call_widths(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", _pick([classify.width(n) for n in range(25)], F.col("n_nationkey")).alias("width"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'run-1' ELSE lower(p_type) || ',run-1' END AS tags FROM part")
def tagged_cards(spark, sf_dir):
    cards = _cards(spark, sf_dir).drop("tags")
    said = F.to_json(F.struct(F.array(F.col("p_type")).alias("tags")))
    replies = _table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("source_id"), F.lit(0).alias("chunk_ord"), F.lit(0).alias("row_ord"), said.alias("tag_raw"))
    return tagging.tagged(cards, replies, "run-1").select("p_partkey", F.array_join("tags", ",").alias("tags"))


def _tag_model(prompt: str) -> str:
    name = prompt.split("Front: ", 1)[1].split("\n", 1)[0]
    return '{"tags": ["t%d", "known"]}' % len(name) if "\n- " in prompt else "no tags"


@query("SELECT p_partkey, 't' || length(p_name) || ',known' AS tags FROM part")
def model_tags(spark, sf_dir):
    cards = _cards(spark, sf_dir).drop("tags")
    replies = runs.tag_with_model(_vocabulary(spark, sf_dir), _tag_model)(cards)
    return tagging.tagged(cards, replies).select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query("SELECT event_id, 'run-' || strftime(ts, '%Y%m%d-%H%M%S') AS tag FROM events")
def batch_tags(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", X.batch_tag(F.col("ts"), "run").alias("tag"))
