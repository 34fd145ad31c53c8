"""Tags: the seed vocabulary, prompts, and tags from model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import strip, tag
from loomspark.schema import TagRules

# Tags that are never topics, and how many are shown and kept.
DENY = ("spike", "cloze")
DENY_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"^[a-z]+-skill-testrun-")
SHOWN, KEPT = 200, 3

PROMPT = """Give at most three topic tags for this study note, as topic::subtopic, lower case.
Prefer tags that exist:
{tags}

Note type: {note_type}
{fields}

Answer with JSON: {"tags": ["..."]}
"""


def seed(vocabulary: DataFrame, rules: TagRules | None = None, agents: DataFrame | None = None) -> DataFrame:
    """Vocabulary rows (column `tag`) fit for a prompt, in their own spelling.

    `agents`: names (column `name`) that are not topics, joined away. Patterns of the
    rules that do not compile are left out.
    """
    rules = rules or TagRules()
    clean = vocabulary.withColumn("_t", F.lower(strip(F.col("tag")))).filter("tag is not null and _t <> ''").filter(~F.col("_t").isin(*DENY))
    for p in (*DENY_PATTERNS, *rules.extra_deny_patterns):
        try:
            re.compile(p)
        except re.error:
            continue
        clean = clean.filter(~F.col("_t").rlike(p))
    if not rules.include_bare_leaves:
        clean = clean.filter(F.col("_t").contains("::"))
    if agents is not None and rules.use_agent_names:
        clean = clean.join(agents.select(F.lower(strip(F.col("name"))).alias("_t")).distinct(), "_t", "left_anti")
    return clean.drop("_t")


def shown(seeded: DataFrame) -> DataFrame:
    """The first distinct tags in code-point order, as many as a prompt shows."""
    return seeded.select("tag").distinct().orderBy("tag").limit(SHOWN)


def tags_block(seeded: DataFrame) -> DataFrame:
    """One row: the block of known tags."""
    one = shown(seeded).agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag")), lambda t: F.concat(F.lit("- "), t)), "\n").alias("block"))
    return one.select(F.when(F.col("block") == "", "(no tags yet)").otherwise(F.col("block")).alias("block"))


def fields_block(fields: Column) -> Column:
    shown_ = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin("Source", "Position"))
    return F.array_join(F.transform(shown_, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def prompt(block: Column, note_type: Column, fields: Column) -> Column:
    out = F.lit(PROMPT)
    for name, c in (("{tags}", block), ("{note_type}", note_type), ("{fields}", fields_block(fields))):
        out = F.replace(out, F.lit(name), c)
    return out


def tags_of(raw: Column, batch: Column | None = None) -> Column:
    """Up to three distinct normalised tags of a reply, then the batch tag if it is new. A bad reply has none."""
    said = F.try_variant_get(F.try_parse_json(raw), "$.tags", "array<variant>")
    text = F.transform(F.coalesce(said, F.array().cast("array<variant>")), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    good = F.slice(F.array_distinct(F.filter(F.transform(text, tag), lambda t: t.isNotNull())), 1, KEPT)
    if batch is None:
        return good
    b = strip(batch)
    return F.when(b.isNull() | (b == "") | F.array_contains(good, b), good).otherwise(F.concat(good, F.array(b)))


def tagged(cards: DataFrame, replies: DataFrame | None = None, batch: str | None = None) -> DataFrame:
    """Cards with `tags` from replies (source_id, chunk_ord, row_ord, tag_raw); a card without reply has the batch tag only."""
    keys = ["source_id", "chunk_ord", "row_ord"]
    met = cards.join(replies, keys, "left") if replies is not None else cards.withColumn("tag_raw", F.lit(None).cast("string"))
    return met.withColumn("tags", tags_of(F.col("tag_raw"), F.lit(batch).cast("string"))).drop("tag_raw")
