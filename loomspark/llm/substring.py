"""Substring dedup by recompression.

Each text's word sequence is compressed in rounds. The first names maximal runs of
one word; each further round deals every symbol to a left or a right side by a hash
of its name and names each pair of a left symbol before a right one. Names are
hashes of what they stand for, so all executors name equal runs and pairs alike
without any exchange, and equal substrings get equal symbols but for a few at their
ends. For each symbol the interval of words that settled its shape is carried
along. A symbol whose interval fits into a window stands, in every other place
where that window occurs, at the same offset: interior symbols are consistent.

1. Symbols: an exchange of names, with the hash of the settling interval, tells
   which occur in two documents. A window that holds a symbol of one document only
   cannot occur elsewhere. Windows without any interior symbol (long runs) stay in.
2. Windows that are left are verified: an exchange of their 128-bit hashes finds
   the smallest doc_id in which each starts.
3. Words of windows that start in a document with a smaller doc_id go.

Exchanges move packed arrays: each batch of documents sends each bucket its sorted
distinct names and gets one bit back for each. A name that a third of all documents
hold is sent once a batch, not once an occurrence; buckets are ranges of hashes, so
they are even.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import WordHashes, Workspace, lean, mix, pick, rows_of, words

FAR = 1 << 40
NULL_ID = (1 << 63) - 1
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def squeeze(ids: list, texts: list[str]) -> bytes:
    import zstandard

    blobs = [t.encode() for t in texts]
    known = np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes()
    sizes = np.array([len(b) for b in blobs], "<i8").tobytes()
    return struct.pack("<q", len(ids)) + zstandard.ZstdCompressor(level=3).compress(known + sizes + b"".join(blobs))


def unsqueeze(z: bytes) -> tuple[np.ndarray, list[str]]:
    import zstandard

    (n,) = struct.unpack("<q", z[:8])
    data = zstandard.ZstdDecompressor().decompress(z[8:])
    ids, sizes = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n)
    ends = 16 * n + np.cumsum(sizes)
    return ids, [data[e - s : e].decode() for s, e in zip(sizes, ends, strict=True)]


class Sequence:
    """The words of a batch of documents, one after another."""

    def __init__(self, texts: list[str], hashes: WordHashes):
        self.words = [words(t) for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.h = np.concatenate([hashes.of(w) for w in self.words]) if len(texts) else np.empty(0, _U)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        n = len(self.h)
        self._sums, self._inverse = [], []
        for base in _BASES:
            power = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, base, _U), dtype=_U)])
            back = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, _U(pow(int(base), -1, 1 << 64)), _U), dtype=_U)])
            self._sums.append(np.concatenate([np.zeros(1, _U), np.cumsum(self.h * power[:n], dtype=_U)]))
            self._inverse.append(back)

    def hashes(self, a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
        """Hash of the words a..b, as often as there are such pairs."""
        s = self._sums[lane]
        return mix((s[b] - s[a]) * self._inverse[lane][a] + (b - a).astype(_U) * _U(0xC2B2AE3D27D4EB4F))

    def window_starts(self, width: int) -> np.ndarray:
        """Places where a window of `width` words begins and ends in one document."""
        at = np.arange(len(self.h))
        return at[at + width <= self.ends[self.doc]] if len(at) else at


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after `rounds`, and the word intervals that settled each."""
    n = len(h)
    if not n:
        return h, np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.ones(n, bool)
    edge[1:] = doc[1:] != doc[:-1]
    new = edge.copy()
    new[1:] |= h[1:] != h[:-1]
    start = np.nonzero(new)[0]
    end = np.append(start[1:], n)
    length = (end - start).astype(_U)
    name = np.where(length > 1, mix(h[start] + length * _U(0x9FB21C651E98DF25)), h[start])
    doc = doc[start]
    first = edge[start]
    last = np.append(first[1:], True)
    low, high = np.where(first, -FAR, start - 1), np.where(last, FAR, end + 1)
    for r in range(rounds):
        right_side = (mix(name ^ _U((r + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) >> _U(63)).astype(bool)
        with_next = np.zeros(len(name), bool)
        with_next[:-1] = doc[:-1] == doc[1:]
        pair = np.zeros(len(name), bool)
        pair[:-1] = with_next[:-1] & ~right_side[:-1] & right_side[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # A left symbol's fate hangs on what follows, a right one's on what precedes.
        after = np.where(with_next, np.append(high[1:], FAR), FAR)
        before = np.where(np.append(False, with_next[:-1]), np.append(-FAR, low[:-1]), -FAR)
        high, low = np.where(right_side, high, after), np.where(right_side & ~second, before, low)
        i = np.nonzero(pair)[0]
        name = name.copy()
        name[i] = mix(mix(name[i] + _U(0xE7037ED1A0B428DB)) ^ (name[i + 1] * _U(0x8EBC6AF09C88C6E3)))
        keep = ~second
        name, low, high, doc = name[keep], low[keep], high[keep], doc[keep]
    return name, low, high


def settled(seq: Sequence, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and intervals of the symbols that a window can hold with all that settled them."""
    name, low, high = recompress(seq.h, seq.doc, rounds)
    ok = high - low <= width
    low, high = low[ok], high[ok]
    return mix(name[ok] ^ seq.hashes(low, high, 0)), low, high


def _elsewhere_first(keys: list[bytes], payload: list[bytes]):
    """Whether a window starts in a document smaller than the batch's smallest that has it."""
    parts = [np.frombuffer(k, [("a", "<u8"), ("b", "<u8")]) for k in keys]
    sizes = [len(p) for p in parts]
    all_keys, doc = np.concatenate(parts), np.concatenate([np.frombuffer(p, "<i8") for p in payload])
    order = np.lexsort((doc, all_keys["b"], all_keys["a"]))
    a, b, d = all_keys["a"][order], all_keys["b"][order], doc[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    least = d[new][np.cumsum(new) - 1]
    bits = np.empty(len(order), bool)
    bits[order] = least < d
    return sizes, bits


def _symbol_keys(seq: Sequence, width: int, rounds: int):
    key, low, high = settled(seq, width, rounds)
    keys, first, place = np.unique(key, return_index=True, return_inverse=True)
    doc = seq.doc[low] if len(low) else np.empty(0, np.int64)
    two = np.zeros(len(keys), bool)
    two[place[doc != doc[first][place]]] = True
    return keys, two, place, low, high


def _candidates(seq: Sequence, unique: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that hold no symbol of one document only."""
    at = seq.window_starts(width)
    ruled = np.zeros(len(seq.h) + 2, np.int64)
    a, b = np.maximum(high[unique] - width, 0), low[unique] + 1
    np.add.at(ruled, a, 1)
    np.add.at(ruled, b, -1)
    return at[np.cumsum(ruled)[at] == 0] if len(at) else at


def _window_keys(seq: Sequence, at: np.ndarray, ids: np.ndarray, width: int):
    """Distinct 128-bit keys of windows, sorted; the smallest doc_id of each; the key of each window."""
    pair = np.empty(len(at), [("a", "<u8"), ("b", "<u8")])
    pair["a"], pair["b"] = (seq.hashes(at, at + width, lane) for lane in (0, 1))
    own = ids[seq.doc[at]] if len(at) else np.empty(0, np.int64)
    order = np.lexsort((own, pair["b"], pair["a"]))
    s, d = pair[order], own[order]
    new = np.append(True, (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])) if len(s) else np.empty(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    keys = s[new]
    return np.stack([keys["a"], keys["b"]], 1), d[new], place, own


def _covered(seq: Sequence, at: np.ndarray, width: int) -> np.ndarray:
    cover = np.zeros(len(seq.h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return np.cumsum(cover)[: len(seq.h)] > 0


def _kept(seq: Sequence, i: int, gone: np.ndarray | None) -> str:
    ws = seq.words[i]
    if gone is not None:
        ws = [w for w, g in zip(ws, gone[seq.starts[i] : seq.ends[i]].tolist(), strict=True) if not g]
    return " ".join(ws)


def dedup(df: DataFrame, ws: Workspace, *, width: int = 50, rounds: int = 7, batch_chars: int = 4_000_000, bucket_keys: int = 2_000_000, least_buckets: int = 256, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    Null texts have no words. A text of fewer than `width` words keeps them all.
    Repeated rows with one doc_id do not remove each other's words; documents
    without doc_id count as larger than any other, and as one. An empty table yields
    no row. A window of one word without end has no interior symbol and goes
    straight to the verification, so it is judged like any other.
    """
    rows = pick(df, doc_id="bigint", text="string")

    def batched(batches):
        from pyspark import TaskContext

        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in (x.slice(a, 256) for x in batches for a in range(0, x.num_rows, 256)):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1]) + 64
                if size >= batch_chars:
                    yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([squeeze(ids, texts)], pa.binary()), pa.array([size], pa.int64())], ["batch", "z", "size"])
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([squeeze(ids, texts)], pa.binary()), pa.array([size], pa.int64())], ["batch", "z", "size"])

    raw = ws.write(rows.mapInArrow(lean(batched), "batch bigint, z binary, size bigint"), "batches")
    chars = raw.agg(F.sum("size")).first()[0] or 0
    buckets = max(least_buckets, chars // 30 // bucket_keys)

    def name_packets(batches):
        hashes = WordHashes()

        def made():
            for r in rows_of(batches):
                seq = Sequence(unsqueeze(r["z"])[1], hashes)
                keys, two, *_ = _symbol_keys(seq, width, rounds)
                yield from exchange.packets(r["batch"], keys, two, buckets)

        yield from exchange.emit(made())

    shared = ws.write(exchange.ask(raw.select("batch", "z").mapInArrow(lean(name_packets), exchange.PACKET), exchange.in_two), "names")
    result = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    names, kinds = [c.split()[0] for c in result.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(doc_id: int, seq: Sequence, i: int, gone: np.ndarray | None) -> tuple:
        kept = _kept(seq, i, gone)
        removed = 0 if gone is None else int(gone[seq.starts[i] : seq.ends[i]].sum())
        return None if doc_id == NULL_ID else int(doc_id), int(seq.sizes[i]), removed, hashlib.sha256(kept.encode()).hexdigest(), kept if keep_text else None

    def screened(batches):
        hashes = WordHashes()
        for r in rows_of(batches):
            ids, texts = unsqueeze(r["z"])
            seq = Sequence(texts, hashes)
            keys, _, place, low, high = _symbol_keys(seq, width, rounds)
            unique = ~exchange.bits(r["answers"], keys, buckets)[place]
            at = _candidates(seq, unique, low, high, width)
            has = np.zeros(len(ids), bool)
            has[seq.doc[at]] = True
            done = [(*row(ids[i], seq, i, None), None, None, None) for i in np.nonzero(~has)[0]]
            if has.any():
                left = np.nonzero(has)[0]
                bits = np.zeros(len(seq.h), bool)
                bits[at] = True
                bits = np.concatenate([bits[seq.starts[i] : seq.ends[i]] for i in left])
                z = squeeze([int(x) for x in ids[left]], [texts[i] for i in left])
                done.append((None,) * 5 + (r["batch"], z, np.packbits(bits).tobytes()))
            yield exchange.record(done, [*names, "batch", "z", "bits"], [*kinds, pa.int64(), pa.binary(), pa.binary()])

    met = raw.select("batch", "z").join(shared, "batch", "left")
    screen = ws.write(met.mapInArrow(lean(screened), result + ", batch bigint, z binary, bits binary"), "screened")
    ws.drop("names", "batches")
    left = screen.filter("batch is not null").select("batch", "z", "bits")

    def opened(r: dict, hashes: WordHashes):
        ids, texts = unsqueeze(r["z"])
        seq = Sequence(texts, hashes)
        at = np.nonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(seq.h)))[0]
        return ids, seq, at, *_window_keys(seq, at, ids, width)

    def window_packets(batches):
        hashes = WordHashes()

        def made():
            for r in rows_of(batches):
                *_, keys, least, _, _ = opened(r, hashes)
                yield from exchange.packets(r["batch"], keys, least, buckets)

        yield from exchange.emit(made())

    first = ws.write(exchange.ask(left.mapInArrow(lean(window_packets), exchange.PACKET), _elsewhere_first), "windows")

    def judged(batches):
        hashes = WordHashes()
        for r in rows_of(batches):
            ids, seq, at, keys, least, place, own = opened(r, hashes)
            gone = _covered(seq, at[exchange.bits(r["answers"], keys, buckets)[place] | (own > least[place])], width)
            yield exchange.record([row(ids[i], seq, i, gone) for i in range(len(ids))], names, kinds)

    checked = left.join(first, "batch", "left").mapInArrow(lean(judged), result)
    out = screen.filter("batch is null").select(*names).unionByName(checked)
    return out if keep_text else out.drop("kept_text")
