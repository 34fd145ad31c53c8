"""Byte-level BPE by reduction over a tree, and its inverse.

A piece (one match of the split pattern) is encoded by halves. Two encoded
neighbours are joined by encoding the bytes of a window around their seam anew;
the window grows until the tokens next to it are stable. Stability is provable:
a token sequence is the BPE encoding of its bytes if and only if each adjacent
pair of tokens is the encoding of that pair's bytes, so it is enough that the
pairs at both rims of the window hold. The join is associative (the result is the
one encoding of the joined bytes), which makes encodings a monoid and the shape
of the tree irrelevant. Decoding concatenates up the tree.

A text's pieces never interact, so a text's encoding is the plain concatenation
of theirs. Pieces, short subtrees and pairs of tokens recur; each worker remembers a
bounded number of each.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, lean, pick

_NONE = 1 << 60


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, *, leaf: int = 4, remembered: int = 250_000):
        import regex

        self.ranks, self.leaf, self.remembered = ranks, leaf, remembered
        self.split = regex.compile(pattern).findall
        self.tokens = {v: k for k, v in ranks.items()}
        self._pairs: dict[tuple[int, int], list[int] | None] = {}
        self._short: dict[bytes, list[int]] = {}
        self.known = _Known(self)

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until none is left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        cost = [ranks.get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while cost and (least := min(cost)) != _NONE:
            i = cost.index(least)
            parts[i] += parts.pop(i + 1)
            del cost[i]
            if i < len(cost):
                cost[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                cost[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return [ranks[p] for p in parts]

    def pair(self, a: int, b: int) -> list[int] | None:
        """The encoding of two adjacent tokens' bytes, or None where that is the two."""
        known = self._pairs.get((a, b), 0)
        if known == 0:
            if len(self._pairs) >= self.remembered // 2:
                self._pairs.clear()
            ids = self.merge(self.tokens[a] + self.tokens[b])
            known = self._pairs[a, b] = None if ids == [a, b] else ids
        return known

    def holds(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens are the encoding of their bytes."""
        return self.pair(a, b) is None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or (window := self.pair(left[-1], right[0])) is None:
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            if k > 1:
                window = self.merge(b"".join(map(self.tokens.__getitem__, left[a:] + right[:b])))
            if (not a or self.holds(left[a - 1], window[0])) and (b == len(right) or self.holds(window[-1], right[b])):
                return left[:a] + window + right[b:]
            k *= 2

    def tree(self, data: bytes) -> list[int]:
        """Ids of bytes; those of short subtrees are remembered, as pieces share their halves."""
        ids = self._short.get(data)
        if ids is None:
            half = len(data) // 2
            ids = self.merge(data) if len(data) <= self.leaf else self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= 3 * self.leaf:
                if len(self._short) >= self.remembered // 2:
                    self._short.clear()
                self._short[data] = ids
        return ids

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        ids = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: list[int], block: int = 4096) -> bytes:
        if len(ids) <= block:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Known(dict):
    """piece -> its ids as bytes; long pieces are not kept."""

    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.piece(piece.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.bpe.remembered:
                self.clear()
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> TreeBpe:
    with open(path, "rb") as f:
        return TreeBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def tokenize(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row: doc_id, ids (little-endian unsigned 32-bit), n_tokens, and the decoded bytes' sha256.

    `vocabulary` is the path of a rank file that every executor can open.
    Null texts count as empty; an empty text has no token; a text is encoded
    whole whatever its length; repeated rows each yield a row; an empty table yields
    none.
    """
    return _mapped(df, vocabulary, pattern, True)


def _mapped(df: DataFrame, vocabulary: str, pattern: str, keep_ids: bool) -> DataFrame:
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches):
        bpe = load(vocabulary, pattern)
        for batch in batches:
            for ids, texts in chunks(batch.column(1), batch.column(0)):
                out = []
                for text in texts:
                    packed = bpe.encode_bytes(text)
                    n = len(packed) // 4
                    back = bpe.decode(list(struct.unpack(f"<{n}I", packed)))
                    out.append((n, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), packed))
                n, a, b, packed = map(list, zip(*out, strict=True))
                cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols, names = [*cols, pa.array(packed, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return pick(df, doc_id="bigint", text="string").mapInArrow(lean(run), schema)


def digest(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, as `tokenize` has them; an empty table yields no row."""
    return _mapped(df, vocabulary, pattern, False)
