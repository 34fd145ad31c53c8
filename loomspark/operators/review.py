"""Review files: rendering of cards and overflow, parsing back, and the commit as a merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import BLANK, LINE_END, inline, strip, tag_list

EMPTY_QUEUE = "# Queue (empty)\n\nThis ingestion produced no cards: everything went to overflow or could not be read.\n"
NO_OVERFLOW = "This ingestion has no overflow here.\n"
FIRST_FIELDS = ("Front", "Back", "Text")


def _line(name: Column | str, value: Column) -> Column:
    return F.concat(F.lit("**"), F.lit(name) if isinstance(name, str) else name, F.lit(":** "), value)


def card_block(number: Column, deck: Column) -> Column:
    """One card: main fields first, then the others in their order, the citation last."""
    fields = F.col("fields")
    first = [F.when(F.map_contains_key(fields, F.lit(f)), _line(f, inline(fields[f]))) for f in FIRST_FIELDS]
    others = F.filter(F.col("field_order"), lambda k: ~k.isin(*FIRST_FIELDS, "Source", "Position"))
    rest = F.transform(others, lambda k: _line(k, inline(fields[k])))
    cited = [_line(n, inline(F.coalesce(fields[n], F.col(c)))) for n, c in (("Source", "source"), ("Position", "position"))]
    head = F.concat(F.lit("## Card "), number.cast("string"), F.lit(" — "), F.col("shape"))
    tail = [_line("Deck", deck), _line("Model", F.col("note_type")), _line("Tags", F.array_join("tags", ", ")), F.lit("---")]
    return F.concat(F.array_join(F.array_compact(F.concat(F.array(head, *first), rest, F.array(*cited, *tail))), "\n"), F.lit("\n"))


def _joined(rows: DataFrame, by: list[str], ord_: str, text: str, sep: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ord_, text))), lambda x: x[text]), sep).alias("body")
    return rows.groupBy(*by).agg(body) if by else rows.agg(body)


def rendered_queue(tagged: DataFrame, deck: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., body): the queue file of each ingestion. One ingestion's file is one value by its nature."""
    w = Window.partitionBy(*by).orderBy("source_id", "chunk_ord", "row_ord")
    numbered = tagged.withColumn("n", F.row_number().over(w))
    blocks = numbered.withColumn("block", card_block(F.col("n"), F.lit(deck)))
    out = _joined(blocks, [*by], "n", "block", "\n")
    return out.withColumn("body", F.when(F.col("body") == "", EMPTY_QUEUE).otherwise(F.col("body")))


def overflow_section() -> Column:
    place = F.when(F.coalesce(F.col("position"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("position"), F.lit(")"))).otherwise("")
    return F.concat(
        F.lit("## "), F.col("item_no").cast("string"), F.lit(". From "), F.col("source"), place,
        F.lit("\n\n_Stage: "), F.col("stage"), F.lit("_  \n_Reason: "), F.col("reason"), F.lit("_\n\n"), strip(F.col("text")), F.lit("\n"),
    )


def drift_footer(qa_with_chaff: Column, trimmed_without_chaff: Column) -> Column:
    return F.format_string("\n---\n\n_Routing drift (LLM bucket vs pattern): %d qa→trimmed override(s) on strong chaff signal; %d llm-trimmed chunk(s) with no pattern signal._\n", qa_with_chaff, trimmed_without_chaff)


def _beside(rows: DataFrame, other: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Left join on `by`, null-safe."""
    side = other.withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(side, same, "left").drop(*[f"_{c}" for c in by])


def rendered_overflow(numbered: DataFrame, lane: str, title: str, slug: str, date: str, drift: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., body): the overflow file of a lane, one of each ingestion; the trimmed one ends with the drift counts."""
    header = f"# {title} — {slug} ({date})\n\n"
    sections = numbered.filter(F.col("decision.bucket") == lane).withColumn("section", overflow_section())
    body = _joined(sections, [*by], "item_no", "section", "\n")
    if by:  # ingestions without an item in the lane have a file, too
        body = _beside(numbered.select(*by).distinct(), body, by).fillna("", "body")
    body = body.withColumn("body", F.when(F.col("body") == "", F.lit(header + NO_OVERFLOW)).otherwise(F.concat(F.lit(header + "\n"), F.col("body"))))
    if drift is None:
        return body
    both = _beside(body, drift, by) if by else body.join(drift, how="cross")
    return both.select(*by, F.concat("body", drift_footer(F.col("qa_with_chaff"), F.col("trimmed_without_chaff"))).alias("body"))


def parsed_blocks(files: DataFrame) -> DataFrame:
    """Blocks of reviewed files (file, body): block (1-based), shape, fields, field_order, deck, model, tags, error.

    Blank blocks and the empty-queue sentinel are skipped; stray lines are ignored.
    """
    rows = files.select("file", F.posexplode(F.split("body", "\n---\n")).alias("i", "raw")).withColumn("raw", strip(F.col("raw")))
    rows = rows.filter((F.col("raw") != "") & ~F.col("raw").startswith("# Queue"))
    rows = rows.withColumn("_lines", F.split("raw", LINE_END))
    head = F.get("_lines", F.lit(0))
    rows = rows.withColumn("shape", F.when(head.rlike(rf"^##[{BLANK}]+Card[{BLANK}]+\p{{Nd}}+[{BLANK}]+—[{BLANK}]+.+"), F.regexp_extract(head, rf"^##[{BLANK}]+Card[{BLANK}]+\p{{Nd}}+[{BLANK}]+—[{BLANK}]+(.+?)[{BLANK}]*$", 1)))
    pattern = rf"^\*\*([^:]+):\*\*[{BLANK}]*(.*)$"
    hits = F.filter(F.slice("_lines", F.lit(2), F.size("_lines")), lambda x: x.rlike(pattern))
    pairs = F.transform(hits, lambda x: F.struct(strip(F.regexp_extract(x, pattern, 1)).alias("key"), strip(F.regexp_extract(x, pattern, 2)).alias("value")))
    rows = rows.withColumn("_pairs", pairs)
    last = lambda name: F.try_element_at(F.filter("_pairs", lambda p: p["key"] == name), F.lit(-1))["value"]
    rows = rows.withColumns({"deck": last("Deck"), "model": last("Model"), "_tags": last("Tags")})
    content = F.filter("_pairs", lambda p: ~p["key"].isin("Deck", "Model", "Tags"))
    rows = rows.withColumn("_content", content)
    order = F.array_distinct(F.transform("_content", lambda p: p["key"]))
    rows = rows.withColumn("field_order", order)
    fields = F.map_from_entries(F.transform("field_order", lambda k: F.struct(k, F.element_at(F.filter("_content", lambda p: p["key"] == k), -1)["value"])))
    error = (
        F.when(F.col("shape").isNull(), "missing card header")
        .when(F.col("deck").isNull(), "missing Deck line")
        .when(F.col("model").isNull(), "missing Model line")
        .when(F.size("field_order") == 0, "no content fields")
    )
    return rows.select("file", (F.col("i") + 1).alias("block"), "shape", fields.alias("fields"), "field_order", "deck", "model", F.coalesce(tag_list(F.col("_tags")), F.array().cast("array<string>")).alias("tags"), error.alias("error"))


def guid(deck: Column, model: Column, first: Column) -> Column:
    """Identity of a note: its model, deck and first field."""
    return F.substring(F.sha2(F.concat_ws("\0", model, deck, first), 256), 1, 16)


def merged(blocks: DataFrame, store: DataFrame, deck_errors: DataFrame | None = None) -> DataFrame:
    """Commit of parsed blocks as a merge into `store` (stable_guid): file, block, stable_guid, deck, model, fields, tags, outcome, error.

    Blocks that did not parse or whose deck failed (deck, deck_error) are `failed`;
    a note that the store or an earlier block has is `updated`, else `created`.
    """
    rows = blocks.withColumn("stable_guid", guid(F.col("deck"), F.col("model"), F.col("fields")[F.get("field_order", F.lit(0))]))
    if deck_errors is not None:
        rows = rows.join(deck_errors, "deck", "left")
        rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("deck_error").isNotNull(), F.concat(F.lit("deck setup failed for '"), F.col("deck"), F.lit("': "), F.col("deck_error")))))
    there = store.select("stable_guid").distinct().withColumn("_there", F.lit(True))
    rows = rows.join(there, "stable_guid", "left")
    earlier = F.row_number().over(Window.partitionBy("stable_guid", F.col("error").isNull()).orderBy("file", "block")) > 1
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("_there") | earlier, "updated").otherwise("created")
    tags = F.col("tags") if "tags" in blocks.columns else F.array().cast("array<string>")
    return rows.select("file", "block", F.when(F.col("error").isNull(), F.col("stable_guid")).alias("stable_guid"), "deck", "model", "fields", tags.alias("tags"), outcome.alias("outcome"), "error")


def decks(blocks: DataFrame) -> DataFrame:
    """Distinct decks in the order of their first block."""
    return blocks.groupBy("deck").agg(F.min(F.struct("file", "block")).alias("first")).orderBy("first").select("deck")


def commit_summary(done: DataFrame) -> DataFrame:
    """Per file: guids created and updated and failures, in block order, and whether the file may be archived."""
    listed = lambda what, item: F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == what, F.struct("block", F.col(item).alias("x"))))), lambda s: s["x"]).alias(what)
    out = done.groupBy("file").agg(listed("created", "stable_guid"), listed("updated", "stable_guid"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.struct("block", "error")))).alias("failed"))
    return out.withColumn("archive", F.size("failed") == 0)
