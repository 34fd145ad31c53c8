"""Document fingerprints: MinHash over word shingles, vectorised; bands joined in Spark.

A fingerprint holds, for each universal hash h(x) = a * x + b mod 2**64, the 16
bits below the top of the least hash of a document's shingles. The share of equal
positions estimates the Jaccard similarity. Texts post themselves under the bands of
their signatures; those that share one are verified on their full shingle sets, and
verified links make groups. How bands are joined without meeting all of a group with
all of it stands in `linking`.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, Workspace, chunks, lean, many_shingles, mix, pick, shingle_hashes, words
from .linking import Shingling, class_components, text_hash

#: Words count as they are written; equal texts are one class.
SHINGLING = Shingling(5, lower=False, by_text=True)


class MinHash:
    def __init__(self, size: int = 64, width: int = 5, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size, self.width = size, width
        self.a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        self.hashes = WordHashes()

    def shingles(self, text: str) -> np.ndarray:
        return shingle_hashes(self.hashes.of(words(text)), self.width)

    def signatures(self, texts: list[str]) -> np.ndarray:
        """One row of `size` 16-bit values a text; all ones without words."""
        return self.signed(texts)[0]

    def signed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of texts, and how many shingles each has, repeated ones counted."""
        x, count = many_shingles([self.hashes.of(words(t)) for t in texts], self.width)
        out = np.full((len(texts), self.size), 0xFFFF, np.uint16)
        full, ends = np.nonzero(count)[0], np.cumsum(count)
        starts = ends - count
        a, step = 0, 1 << 15
        while a < len(full):  # runs of about `step` shingles stay in cache
            b = max(a + 1, int(np.searchsorted(ends[full], starts[full[a]] + step, "right")))
            part, at = x[starts[full[a]] : ends[full[b - 1]]], starts[full[a:b]] - starts[full[a]]
            h = np.empty_like(part)
            for j in range(self.size):
                np.multiply(part, self.a[j], out=h)
                np.add(h, self.b[j], out=h)
                least = np.minimum.reduceat(h, at)
                out[full[a:b], j] = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
            a = b
        return out, count


def edited_text(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SIGNED = "th bigint, n_shingles bigint, cls binary"
_NAMES = [c.split()[0] for c in f"{_OUT}, {_SIGNED}".split(", ")]


def _rows(ids: list, hashes: list, texts: list[str], mh: MinHash, following: list[str] | None = None) -> list[pa.Array]:
    """Columns of texts beside those that follow them; without these, each text follows the one before it, and the last one only follows."""
    (signed, count), n = mh.signed(texts), len(ids)
    after = signed[1:] if following is None else mh.signatures(following)
    own, signed = texts[:n], signed[:n]
    edited = [edited_text(t, f) for t, f in zip(own, texts[1:] if following is None else following, strict=True)]
    other = mh.signatures(edited)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array([r.astype(">u2").tobytes().hex() for r in signed]), pa.array([r.astype(">u2").tobytes().hex() for r in other]),
        pa.array(likeness(signed, other), pa.float64()), pa.array(likeness(signed, after), pa.float64()),
        pa.array(hashes, pa.int64()), pa.array(count[:n], pa.int64()), pa.array(SHINGLING.classes(own, [range(k) for k in count[:n]]), pa.binary()),
    ]


def neighboured(df: DataFrame, ws: Workspace, *, size: int = 64, width: int = 5) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, likenesses, and the text's hash, number of shingles and class. Written.

    The following document is the next by descending doc_id (null last, equal ids by
    a hash of the text); the last one's is the first. Texts are compressed, dealt out
    by ranges of doc_id once, and stream through each sorted partition beside their
    neighbours; one row a partition edge is stitched after, by the partitions' order.
    """
    rows = pick(df, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", text_hash(F.col("text")))

    def squeeze(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for b in (x.slice(a, 256) for x in batches for a in range(0, x.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([c.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "th", "z"])

    z = rows.mapInArrow(lean(squeeze), "doc_id bigint, th bigint, z binary")
    order = [F.col("doc_id").desc_nulls_last(), F.col("th")]
    dealt = z.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        import zstandard

        d = zstandard.ZstdDecompressor()
        mh = MinHash(size, width)
        names, kinds = [*_NAMES, "part", "edge", "z"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.binary()]

        def edge(kind: str, row: tuple, part: int):
            held = {"doc_id": row[0], "th": row[1], "part": part, "edge": kind, "z": row[2].encode()}
            return pa.RecordBatch.from_arrays([pa.array([held.get(c)], k) for c, k in zip(names, kinds, strict=True)], names)

        last = None
        for b in batches:
            part = b.column(3)[0].as_py() if b.num_rows else 0
            for a in range(0, b.num_rows, 256):  # a few texts are unpacked at a time
                own = [(i, h, d.decompress(x).decode()) for i, h, x in zip(*(b.column(k).slice(a, 256).to_pylist() for k in range(3)), strict=True)]
                if last is None:
                    yield edge("head", own[0], part)
                else:
                    own = [last, *own]
                if len(own) > 1:
                    ids, hashes, texts = map(list, zip(*own, strict=True))
                    n = len(own) - 1
                    cols = _rows(ids[:-1], hashes[:-1], texts, mh)
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names)
                last = own[-1]
        if last is not None:
            yield edge("tail", last, part)

    made = ws.write(dealt.mapInArrow(lean(run), f"{_OUT}, {_SIGNED}, part int, edge string, z binary"), "fingerprints")
    heads = made.filter("edge = 'head'").select("part", F.col("z").alias("following"))
    order_of = [r[0] for r in heads.select("part").orderBy("part").collect()]  # one number a partition
    after = _next_part(order_of)
    tails = made.filter("edge = 'tail'").select("doc_id", "th", "z", after[F.col("part")].alias("part")).join(heads, "part").select("doc_id", "th", "z", "following")

    def stitch(batches):
        mh = MinHash(size, width)
        for b in batches:
            ids, hashes, own, following = (b.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays(_rows(ids, hashes, [t.decode() for t in own], mh, [t.decode() for t in following]), _NAMES)

    stitched = ws.write(tails.mapInArrow(lean(stitch), f"{_OUT}, {_SIGNED}"), "stitched")
    return made.filter("edge is null").select(*_NAMES).unionByName(stitched)


def _next_part(order: list[int]):
    """part -> the next part with rows, the first after the last."""
    pairs = zip(order, [*order[1:], *order[:1]], strict=True)
    return F.create_map(*[F.lit(x) for p in pairs for x in p]) if order else F.create_map().cast("map<int,int>")


def bands(signed: DataFrame, size: int, rows: int) -> DataFrame:
    """The rows of a table with `fingerprint`, with a hash for each band of `rows` positions as `keys`."""
    n = size // rows

    def run(batches):
        for b in batches:
            s = np.frombuffer(bytes.fromhex("".join(b.column(3).to_pylist())), ">u2").astype(np.uint64).reshape(-1, size)
            key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(48), (len(s), n)).copy()
            for k in range(rows):
                key = mix(key ^ s[:, k : n * rows : rows])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * n), pa.array(key.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 4)), lists], ["doc_id", "th", "n_shingles", "cls", "keys"])

    taken = signed.select("doc_id", "th", "n_shingles", "fingerprint", "cls")
    return taken.mapInArrow(lean(run), "doc_id bigint, th bigint, n_shingles bigint, cls binary, keys array<bigint>")


def with_neighbours(df: DataFrame, ws: Workspace, *, size: int = 64, width: int = 5, rows: int = 3, percent: int = 80) -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, likenesses, and the group of near texts.

    near_group is the least doc_id that verified links reach: two texts are linked if
    they share a signature band of `rows` positions and their shingle sets' Jaccard
    similarity is `percent` hundredths or more. With 21 bands of 3 a link at 0.8 shares
    none with probability 3e-7. A text without words is in a group of its own, and so
    is one without doc_id that reaches none: then near_group is null.

    A null text counts as empty, an empty text's fingerprint is all ones; a table of
    one row has itself as the following document; repeated rows each yield a row; an
    empty table yields none.
    """
    made = neighboured(df, ws, size=size, width=width)
    texts = pick(df, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    signed = bands(made.filter("cls is not null"), size, rows)
    groups = class_components(texts, signed, ws, replace(SHINGLING, width=width), size=size // rows, matches=1, percent=percent)
    group = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return made.join(groups, "cls", "left").select(*[c.split()[0] for c in _OUT.split(", ")], group.alias("near_group"))
