"""MinHash near-dedup by an inverted join over signature coordinates.

Documents with equal shingle sets form a class. Each class posts itself under the
coordinate-value pairs of its MinHash signature. Two classes are candidates if at
least `matches` of their `size` coordinates agree; links are candidates whose full
sets reach the threshold. `matches` is the largest number that loses a link at the
threshold with a probability below `miss`. How lists are counted, skipped and merged
stands in `linking`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, WordHashes, Workspace, chunks, lean, mix, pick
from .linking import Shingling, class_components, class_of, text_hash


def least_matches(size: int, threshold: float, miss: float) -> int:
    """The largest m with P(fewer than m of `size` coordinates agree) <= miss at the threshold."""
    below, m = 0.0, 0
    while m < size:
        below += math.comb(size, m) * threshold**m * (1 - threshold) ** (size - m)
        if below > miss:
            break
        m += 1
    return max(m, 1)


def signatures(x: np.ndarray, count: np.ndarray, seeds: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Least hash of each text under each seed; rows of texts without shingles are 0."""
    out = np.zeros((len(count), len(seeds)), np.uint64)
    ends = np.cumsum(count)
    full = np.nonzero(count)[0]
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(ends[full], ends[full[a]] - count[full[a]] + step, "right")))
        first, last = int(ends[full[a]] - count[full[a]]), int(ends[full[b - 1]])
        part, at = x[first:last], (ends[full[a:b]] - count[full[a:b]]) - first
        h, t = np.empty_like(part), np.empty_like(part)
        for j, s in enumerate(seeds):
            np.bitwise_xor(part, s, out=h)
            np.multiply(h, np.uint64(0xFF51AFD7ED558CCD), out=h)
            np.right_shift(h, np.uint64(32), out=t)
            np.bitwise_xor(h, t, out=h)
            out[full[a:b], j] = np.minimum.reduceat(h, at)
        a = b
    return out


def _signed(rows: DataFrame, shingling: Shingling, size: int) -> DataFrame:
    """doc_id, th, n_shingles, cls (null without shingles), keys: one hash for each coordinate and value."""
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for at, texts in chunks(b.column(1), pa.array(range(b.num_rows))):
                x, count, sets = shingling.of(texts, hashes)
                keys = mix(signatures(x, count, seeds) ^ seeds).view(np.int64)
                ids, th = (b.column(i).take(pa.array(at)) for i in (0, 2))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids, th, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.binary()), lists], ["doc_id", "th", "n_shingles", "cls", "keys"])

    hashed = rows.select("doc_id", "text", text_hash(F.col("text")))
    return hashed.mapInArrow(lean(run), "doc_id bigint, th bigint, n_shingles bigint, cls binary, keys array<bigint>")


def near_duplicates(df: DataFrame, ws: Workspace, *, width: int = 5, percent: int = 80, size: int = 24, miss: float = 1e-6) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (hex, null without shingles), component_id, kept, th (`text_hash`).

    `percent`: least Jaccard similarity of a link, in hundredths. component_id is the
    least doc_id that links reach, null ids left aside; kept marks rows whose doc_id it
    is. Rows without words are linked with nothing: their component is their own doc_id.
    A row without doc_id is kept only if it reaches no doc_id and has no words. Repeated
    rows share a class, so each of them bears the component's id. An empty table
    yields no row.
    """
    shingling = Shingling(width)
    rows = pick(df, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    signed = ws.write(_signed(rows, shingling, size), "signed")
    ids = class_components(rows, signed, ws, shingling, size=size, matches=least_matches(size, percent / 100, miss), percent=percent)
    out = signed.select("doc_id", "n_shingles", "cls", "th").join(ids, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", F.hex("cls").alias("class_id"), component.alias("component_id"), "th")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | F.col("class_id").isNull())
    return out.withColumn("kept", kept).select("doc_id", "n_shingles", "class_id", "component_id", "kept", "th")


def deduplicated(df: DataFrame, ws: Workspace, *, width: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of a table that stay, with all their columns: one of each component, and every row without words.

    The least doc_id of a component stays (rows without one only if no other has
    one), of equal ids the row of the least class; repeated rows count once.
    """
    names = df.columns
    found = ws.write(near_duplicates(df, ws, width=width, percent=percent, **options), "found")
    linked = found.filter("class_id is not null")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("class "), F.col("class_id")))
    stay = linked.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "class_id", "th")).alias("x"))
    stay = stay.select(F.col("x.doc_id").alias("_id"), F.col("x.th").alias("_kept")).distinct()
    place, at = names.index("text"), names.index("doc_id")
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"_{place}"), F.lit(""))
    rows = plain.withColumn("_th", F.when(text.rlike(WORD_PATTERN), text_hash(text)))
    once = linked.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() == 0
    met = rows.filter("_th is not null").join(stay, F.col(f"_{at}").cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_kept")), "left_semi")
    met = met if once else met.dropDuplicates([f"_{at}", "_th"])
    return met.unionAll(rows.filter("_th is null")).drop("_th").toDF(*names)
