"""PDF text blocks to chunks: running headers, reference and thanks runs, affiliations.

`blocks`: source_id, page, block_ord (reading order in the document), text,
block_type. Running keys, the reference run and the thanks run are windows inside a
document, so all of them share one dealing by source_id: the plan shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import repeat_key, strip
from loomspark.operators import structure

LEAST_CHARS = 30
RUNNING_CHARS = 150


def _is_short(text: Column) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= RUNNING_CHARS)


def running_keys(blocks: DataFrame) -> DataFrame:
    """(source_id, key) of short blocks that stand on two pages or more."""
    keyed = blocks.filter(_is_short(F.col("text"))).withColumn("key", repeat_key(F.col("text"))).filter("key <> ''")
    return keyed.groupBy("source_id", "key").agg(F.min("page").alias("first"), F.max("page").alias("last")).filter("first <> last").select("source_id", "key")


def flagged(blocks: DataFrame) -> DataFrame:
    """Text blocks that become chunks, with prefilter_kind.

    Running blocks are flagged if long enough, else dropped, and leave the runs
    alone. A references heading of any length opens a run that lasts while blocks
    are shaped like citations; short blocks neither end it nor are kept. A thanks
    heading of any length flags what follows on its page and ends the references.
    """
    text = blocks.filter("block_type = 0").select("source_id", "page", "block_ord", strip(F.col("text")).alias("text"))
    rows = text.repartition("source_id").withColumn("key", repeat_key(F.col("text")))
    short = F.when(_is_short(F.col("text")) & (F.col("key") != ""), F.col("page"))
    alike = Window.partitionBy("source_id", "key")
    rows = rows.withColumn("running", F.coalesce(F.min(short).over(alike) != F.max(short).over(alike), F.lit(False)))
    c, live = F.col("text"), ~F.col("running")
    long_ = F.length(c) >= LEAST_CHARS
    refs, thanks = live & structure.is_references_heading(c), live & ~structure.is_references_heading(c) & structure.is_thanks_heading(c)
    rows = rows.withColumns({"refs": refs, "thanks": thanks, "long": long_, "cites": structure.is_citation(c)})
    before = Window.partitionBy("source_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("source_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda when: F.max(F.when(when, F.col("block_ord")))
    # Places of the last heading, the last thanks heading, and the last long block that is neither a heading nor a citation.
    rows = rows.withColumns({
        "opened": at(F.col("refs")).over(to_here),
        "closed": at(F.col("thanks") | (~F.col("running") & F.col("long") & ~F.col("refs") & ~F.col("cites"))).over(before),
        "thanked": at(F.col("thanks")).over(to_here),
        "thanks_page": F.last(F.when(F.col("thanks"), F.col("page")), ignorenulls=True).over(to_here),
    })
    in_refs = F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("closed") < F.col("opened")))
    in_refs = in_refs & ~F.col("thanks")
    own = (
        F.when(F.col("refs"), "bibliography")
        .when(F.col("thanks"), "acknowledgments")
        .when(in_refs & F.col("cites"), "bibliography")
        .when(in_refs, F.lit(None).cast("string"))
        .when((F.col("page") == 1) & (structure.affiliation_markers(c) >= 2), "author-affiliations")
    )
    thanked = F.col("thanked").isNotNull() & (F.col("thanks_page") == F.col("page")) & (F.col("opened").isNull() | (F.col("opened") < F.col("thanked")))
    kind = F.when(F.col("running"), "running-header").otherwise(F.coalesce(own, F.when(thanked, "acknowledgments")))
    return rows.withColumn("prefilter_kind", kind).filter("long").select("source_id", "page", "block_ord", "text", "prefilter_kind")
