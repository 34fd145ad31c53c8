"""Exact top-k search by inner product with vector-approximation files.

Each block of candidates is held twice: as cells (each component in one of 2**bits
equal steps between the block's extremes) and as exact integers. Scanning the
cells bounds every inner product from both sides; the k-th best lower bound, or
the k-th score known from earlier blocks, rules most candidates out. Exact vectors
of the rest are read in the order of their upper bounds until the next bound
falls below the k-th score. Ties at the k-th score are read too, so the smaller id
wins as it should.

Cells and vectors of all candidates are written once, in blocks, and stay where they
are: no candidate is ever shuffled. Queries go to them in waves of bounded size. Each
task streams its blocks past one wave and holds that wave's best scores only; the
tasks' answers, k a query and task, are merged by query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, lean, pick, rows_of

EXACT = float(1 << 53)


def scaled(vectors: list[list[float]]) -> np.ndarray:
    """floor(256 * x); shorter vectors are filled up with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * 256.0)


_BLOCK = "ids binary, vectors binary, kind string, width int, code binary, low binary, step binary"


def _stored(rows_a_block: int, bits: int):
    """Blocks of candidates: exact integers, and their cells."""

    def run(batches):
        ids, vectors = [], []

        def block():
            x = scaled(vectors)
            cells = Cells.of(x, bits)
            kind = "<i2" if not x.size or np.abs(x).max() < 32768 else "<f8"
            row = [np.array(ids, "<i8").tobytes(), x.astype(kind).tobytes(), kind, x.shape[1], cells.code.tobytes(), cells.low.tobytes(), cells.step.tobytes()]
            kinds = [pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows_a_block:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return run


def _opened(r: dict) -> tuple[np.ndarray, np.ndarray, Cells]:
    ids = np.frombuffer(r["ids"], "<i8")
    shape = len(ids), r["width"]
    x = np.frombuffer(r["vectors"], r["kind"]).astype(np.float64).reshape(shape)
    return ids, x, Cells(np.frombuffer(r["code"], np.uint8).reshape(shape), np.frombuffer(r["low"]), np.frombuffer(r["step"]))


def _dots(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products, in doubles where those are exact."""
    if not len(x) or not x.shape[1] or np.abs(x).max() * np.abs(q).max() * x.shape[1] < EXACT:
        return [int(s) for s in x @ q]
    return [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]


@dataclass
class Cells:
    """The approximation of one block."""

    code: np.ndarray
    low: np.ndarray
    step: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, bits: int) -> Cells:
        low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(x.shape[1]),) * 2
        step = np.maximum((high - low) / (1 << bits), 1e-9)
        return cls(np.clip(((x - low) / step).astype(np.int64), 0, (1 << bits) - 1).astype(np.uint8), low, step)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of q's inner products with all rows."""
        middle = self.code @ (self.step * q) + (self.low + self.step / 2) @ q
        reach = np.abs(q) @ (self.step / 2)
        slack = 1e-9 * (1 + np.abs(middle) + reach)
        return middle - reach - slack, middle + reach + slack


def search_block(cells: Cells, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, k: int, best: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Merge a block into `best`, a sorted list of (-score, id); also the number of exact vectors read."""
    low, high = cells.bounds(q)
    own = ids == q_id
    low[own], high[own] = -np.inf, -np.inf
    sure = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
    if len(best) == k:
        sure = max(sure, -best[-1][0])
    left = np.nonzero((high >= sure) & ~own)[0]
    left = left[np.argsort(-high[left], kind="stable")]
    read, a, size = 0, 0, 4 * k
    while a < len(left):
        if len(best) == k and high[left[a]] < -best[-1][0]:
            break  # no later vector can reach the k-th score
        part = left[a : a + size]
        best = sorted([*best, *((-s, int(i)) for s, i in zip(_dots(x[part], q), ids[part], strict=True))])[:k]
        read, a, size = read + len(part), a + size, size * 2
    return best, read


def top_k(df: DataFrame, is_query: Column, ws: Workspace, *, k: int = 5, bits: int = 6, wave_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score.

    `is_query` is a condition on vec_id. Vectors that are null, or hold a null or
    non-finite component, take no part, nor do rows without vec_id. Vectors of
    unlike length compare as if filled up with zeros. A candidate with the query's
    own vec_id is the query's own row; repeated rows are candidates of their own,
    and repeated queries get an answer each. Fewer candidates than k: all of them.
    An empty table, or one without queries, yields no row.

    A wave holds about `wave_rows` queries, dealt by a hash of their rows; it is the
    only thing that is broadcast.
    """
    spark = df.sparkSession
    rows = pick(df, vec_id="bigint", embedding="array<double>")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    answer = "query_id bigint, rank int, vec_id bigint, score bigint"
    queries = ws.write(rows.filter(is_query).withColumn("q", F.monotonically_increasing_id()), "queries")
    waves = math.ceil(queries.count() / wave_rows)
    if not waves:
        return spark.createDataFrame([], answer)
    file = ws.write(rows.mapInArrow(lean(_stored(block_rows, bits)), _BLOCK), "cells")

    def searched(wave: int) -> DataFrame:
        asked = queries.filter(F.pmod(F.xxhash64("q"), F.lit(waves)) == wave).select("q", "vec_id", "embedding").collect()
        shared = spark.sparkContext.broadcast(([r["q"] for r in asked], np.array([r["vec_id"] for r in asked], np.int64), scaled([r["embedding"] for r in asked])))

        def run(batches):
            q, q_ids, q_x = shared.value
            best: list[list] = [[] for _ in q]
            for r in rows_of(batches):
                ids, x, cells = _opened(r)
                width = max(x.shape[1], q_x.shape[1])
                y = np.pad(q_x, ((0, 0), (0, width - q_x.shape[1])))
                if width > x.shape[1]:
                    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                    cells = Cells.of(x, bits)
                for j in range(len(q)):
                    best[j] = search_block(cells, x, ids, y[j], q_ids[j], k, best[j])[0]
            out = [(q[j], int(q_ids[j]), i, -s) for j, b in enumerate(best) for s, i in b]
            for a in range(0, len(out), 10_000):
                cols = list(zip(*out[a : a + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], ["q", "query_id", "vec_id", "score"])

        met = file.mapInArrow(lean(run), "q bigint, query_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = [ws.write(searched(w), f"wave_{w}") for w in range(waves)]
    ws.drop("cells", "queries")
    return spark.read.schema(answer).parquet(*[f"{ws.base}/wave_{w}" for w in range(waves)]) if waves > 1 else found[0]
