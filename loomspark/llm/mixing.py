"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Documents get rates r that minimise sum(r log r - r) subject to the token
constraint of each source, sum(r * size) = target, and 0 <= r <= 2. The dual is
convex with one multiplier per source; its solution is r = min(2, exp(a * size)),
sizes in units of the source's largest. Newton steps on all multipliers run
together as one aggregation a step, over the table of (source, size, documents):
a rate depends on nothing else, so that table stands for the corpus.

Rates become whole copies by systematic rounding. Inside a source, documents stand
in the order of size, salt and hash; a document gets one further copy where the
running sum of fractions passes a whole number. Prefixes are summed in three
levels (blocks of sizes, sizes, salts), so no task holds a whole source. The
rounding starts at the one of 64 offsets whose words come closest to the target.

All sums that decide something are of whole numbers: reruns agree whatever the
order of rows. Ties are settled by a hash of doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Workspace, pick

UNIT = 1 << 20
OFFSETS = 64
#: Salts of a (source, size) cell: these, or one for so many documents of the table.
SALTS, SALT_ROWS = 64, 250_000
SIZE_BLOCK = 256
#: Halvings after the Newton steps: more than a bracket of doubles rounded to 9 places has.
HALVINGS = 100
#: Sources up to which a table of one row a source is broadcast (about 20 MB); beyond, joins shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")


def _sources(sized: DataFrame, ws: Workspace, weights: tuple[int, ...], share: float) -> tuple[DataFrame, int]:
    """One row a source: its size, its rank by code point (null last), weight and target.

    Ranks come from a range partitioning of the sources: place in the partition
    plus the partitions before. Targets: the level L with sum(min(2 * size, L *
    weight)) = share * total, reached by freezing sources above it until none is.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"))
    per = per.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    per = ws.write(per, "sources")
    n = per.count()
    parts = per.groupBy("part").count()
    parts = parts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    per = per.join(F.broadcast(parts), "part").withColumn("rank", F.col("before") + row - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    per = ws.write(per.drop("before", "part"), "weighted")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    left, level = share * total, 0.0
    while True:  # sources only ever join the frozen ones, so this ends
        capped = F.col("weight") * F.lit(level) >= 2.0 * F.col("source_size")
        free, frozen = per.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, 2 * F.col("source_size")))).first()
        level, before = ((left - (frozen or 0)) / free if free else level), level
        if level <= before or not free:
            break
    target = F.least(F.col("weight") * F.lit(level), 2.0 * F.col("source_size")) if total else F.lit(0.0)
    return ws.write(per.withColumn("target", target.cast("double")), "targets"), n


def _joined(df: DataFrame, per: DataFrame, n: int) -> DataFrame:
    """Null-safe join to the table of sources."""
    side = per.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(side) if n <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _rate(a: Column) -> Column:
    return F.when(F.col("full"), F.lit(2.0)).otherwise(F.least(F.lit(2.0), F.exp(F.least(a * F.col("size") / F.col("largest"), F.lit(1.0)))))


def _multipliers(cells: DataFrame, per: DataFrame, n: int, ws: Workspace, steps: int, tolerance: float) -> DataFrame:
    """Newton steps with a bracket: a step that leaves the bracket halves it instead.

    The bracket of a source follows from its smallest positive size: at its lower end no
    document has a word to give, at its upper end each has its 2 copies, so it holds the
    multiplier. After `steps` steps it is only halved; a source that still misses its
    target when there is nothing left to halve is an error.
    """
    full = F.col("target") >= 2.0 * F.col("source_size") - 0.5
    ratio = F.col("largest") / F.col("smallest")
    now = per.select("source", "largest", "source_size", "target", full.alias("full"), F.lit(0.0).alias("a"), (-700.0 * ratio).alias("low"), ratio.alias("high"))
    for step in range(steps + HALVINGS):
        rated = _joined(cells, now, n).withColumn("r", _rate(F.col("a")))
        term = (F.col("r") * F.col("size") * UNIT).cast("decimal(38,0)") * F.col("n")
        slope = F.when(F.col("r") < 2.0, F.col("r") * F.col("size") * F.col("size") / F.col("largest") * UNIT).otherwise(0.0).cast("decimal(38,0)") * F.col("n")
        sums = rated.groupBy("source").agg(F.sum(term).cast("double").alias("got"), F.sum(slope).cast("double").alias("slope"))
        sums = sums.withColumns({"got": F.col("got") / UNIT, "slope": F.col("slope") / UNIT})
        got = _joined(sums, now, n).withColumn("off", F.when(F.col("full"), 0.0).otherwise(F.col("got") - F.col("target")))
        low, high = F.when(F.col("off") <= 0, F.col("a")).otherwise(F.col("low")), F.when(F.col("off") >= 0, F.col("a")).otherwise(F.col("high"))
        got = got.withColumns({"low": low, "high": high}).withColumn("next", F.when(F.col("slope") > 0, F.col("a") - F.col("off") / F.col("slope")))
        inside = F.lit(step < steps) & F.col("next").isNotNull() & (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        done = F.abs("off") <= F.greatest(F.lit(0.25), F.col("target") * tolerance)
        got = got.withColumn("next", F.when(done, F.col("a")).when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2))
        got = got.select("source", "largest", "source_size", "target", "full", F.round("next", 9).alias("a"), "low", "high", done.alias("done"))
        now = ws.write(got, f"step{step}")
        if step:
            ws.drop(f"step{step - 1}")
        if not now.filter(~F.col("done")).limit(1).count():
            break
        if step + 1 == steps + HALVINGS:
            left = now.filter(~F.col("done")).select("source", "target").first()
            raise RuntimeError(f"source {left['source']!r} does not reach its target of {left['target']} words")
        now = now.drop("done")
    return now.select("source", "largest", "source_size", "target", "full", "a")


def mix(df: DataFrame, ws: Workspace, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, steps: int = 40, tolerance: float = 1e-4, carry: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target, rate, copies and taken = copies * size; further columns named in `carry` (name: type) come along.

    Null texts have size 0; a null source is a source of its own, ranked last.
    Documents of size 0 keep one copy, which takes no words. Repeated rows are
    documents of their own; equal ones are told apart by their place in the
    rounding, whichever of them that is. An empty table yields no row.
    """
    carry = carry or {}
    salts = max(SALTS, df.count() // SALT_ROWS)
    rows = pick(df, **{"doc_id": "bigint", "text": "string", "source": "string"} | carry)
    rows = rows.withColumn("size", word_count(F.col("text")))
    rows = rows.select("doc_id", "source", "size", *[c for c in carry if c not in ("doc_id", "source")])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    if not carry:
        rows = ws.write(rows, "sized")
    fine = ws.write(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "fine")
    cells = ws.write(fine.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    per, n_sources = _sources(cells.withColumn("size", F.col("size") * F.col("n")).select("source", "size"), ws, weights, share)
    smallest = F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(1)).alias("smallest")
    largest = cells.groupBy("source").agg(F.greatest(F.max("size"), F.lit(1)).alias("largest"), smallest)
    per = ws.write(_joined(largest, per.drop("largest"), n_sources), "per")
    a = _multipliers(cells, per, n_sources, ws, steps, tolerance)

    # Whole copies: floor of the rate, and the fraction in units, which all documents of a size share.
    rated = _joined(cells, a, n_sources).withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("a"))))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("part", F.round((F.col("rate") - F.col("whole")) * UNIT).cast("bigint"))
    rated = ws.write(rated.select("source", "size", "n", "rate", "whole", "part", "target", "source_size").withColumn("block", F.floor(F.col("size") / SIZE_BLOCK)), "rated")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    mass = (F.col("n") * F.col("part")).cast("decimal(38,0)")
    blocks = rated.groupBy("source", "block").agg(F.sum(mass).alias("mass"))
    blocks = blocks.select("source", "block", F.coalesce(F.sum("mass").over(before("source").orderBy("block")), F.lit(0)).alias("block_before"))
    sizes = rated.withColumn("size_before", F.coalesce(F.sum(mass).over(before("source", "block").orderBy("size")), F.lit(0)))
    blocks = blocks.withColumnsRenamed({"source": "_source", "block": "_block"})
    sizes = sizes.join(blocks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).drop("_source", "_block")
    sizes = ws.write(sizes.withColumn("start", (F.col("block_before") + F.col("size_before")).cast("decimal(38,0)")).drop("block_before", "size_before"), "starts")

    # The offset whose words come closest to the target, per source.
    unit = F.lit(UNIT).cast("decimal(38,0)")
    passed = lambda x, u: F.floor((x + u) / unit).cast("bigint")
    trial = sizes.select("source", "size", "target", "n", "whole", "part", "start", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1))).alias("o"))
    u = (F.col("o") * (UNIT // OFFSETS)).cast("decimal(38,0)")
    extra = passed(F.col("start") + F.col("n") * F.col("part"), u) - passed(F.col("start"), u)
    trial = trial.groupBy("source", "o").agg(F.sum((F.col("n") * F.col("whole") + extra) * F.col("size")).alias("words"), F.first("target").alias("target"))
    best = trial.groupBy("source").agg(F.min_by("o", F.struct(F.abs(F.col("words") - F.col("target")), F.col("o"))).alias("o"))
    best = ws.write(best, "offsets")
    sizes = _joined(sizes, best, n_sources)

    # Salted sub-cells: how many of their documents get the further copy.
    keyed = sizes.withColumnsRenamed({"source": "_source", "size": "_size", "n": "_n"})
    sub = fine.join(keyed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size", "_n")
    earlier = F.coalesce(F.sum("n").over(before("source", "size").orderBy("salt")), F.lit(0))
    sub = sub.withColumn("at", F.col("start") + earlier * F.col("part"))
    u = (F.col("o") * (UNIT // OFFSETS)).cast("decimal(38,0)")
    sub = sub.withColumn("extra", passed(F.col("at") + F.col("n") * F.col("part"), u) - passed(F.col("at"), u))
    # The same four columns deal both sides, and the ranks: the documents' rows move once.
    keyed = lambda x: x.withColumns({"_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_size": F.col("size"), "_salt": F.col("salt")})
    key = ["_none", "_source", "_size", "_salt"]
    sub = ws.write(keyed(sub).select(*key, "rate", "whole", "extra", "target", "source_size"), "sub")
    ranked = keyed(rows).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")))
    out = ranked.join(sub.hint("merge"), key).drop(*key)
    out = out.withColumn("copies", (F.col("whole") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)).cast("bigint"))
    keep = [c for c in carry if c not in ("doc_id",)]
    return out.select("doc_id", *keep, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, ws: Workspace, **options) -> DataFrame:
    """The table's rows, each as often as the mix takes it, with all their columns."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    own = {c: F.col(f"_{names.index(c)}").alias(c) for c in ("doc_id", "text", "source")}
    rows = plain.select(*own.values(), F.struct(*plain.columns).alias("payload"))
    kind = rows.schema["payload"].dataType.simpleString()
    taken = mix(rows, ws, carry={"payload": kind}, **options).filter("copies > 0")
    taken = taken.select("payload", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("payload.*").toDF(*names)
