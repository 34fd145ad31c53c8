"""Token counts by Viterbi over unigram scores, without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches; the dynamic
programme carries the best score and its number of pieces to each end. Ties follow
the exact rule of the unigram tokenizers: ends are settled from left to right, the
candidates of one end in the order of their starts, and a later candidate wins by
a strictly greater score only. A character without a piece of its own costs the
least score less 10 and falls back to its bytes, which count one each.

No piece holds a blank after another character, so the best path passes through
each place where a blank follows something else: the text falls apart there
exactly, and each worker remembers a bounded number of such parts' counts.

Scores: the vocabulary files here rank pieces but hold no unigram likelihoods, so
scores follow Zipf's law over the ranks, -log(rank + 2), in steps of 1/1024; sums
of such numbers are exact, and equal scores are equal on any path.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, lean, pick

BLANK = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Ordinary pieces (no control, unknown or byte pieces) with their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return {p: -round(1024 * math.log(i + 2)) / 1024 for i, p in enumerate(pieces)}


class Counter(dict):
    """part of a text -> number of its tokens."""

    PARTS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def __init__(self, scores: dict[str, float], remembered: int = 250_000):
        import ahocorasick

        super().__init__()
        self.matches = ahocorasick.Automaton()
        for p, s in scores.items():
            self.matches.add_word(p, (len(p), s))
        self.matches.make_automaton()
        self.unknown = min(scores.values()) - 10
        self.remembered = remembered
        if any(BLANK in p.lstrip(BLANK) for p in scores):
            raise ValueError("a piece spans a blank after another character")

    def __missing__(self, part: str) -> int:
        n = self.viterbi(part)
        if len(part) <= 64:
            if len(self) >= self.remembered:
                self.clear()
            self[part] = n
        return n

    def viterbi(self, part: str) -> int:
        size = len(part)
        best, count = [0.0] + [-math.inf] * size, [0] * (size + 1)
        at = 0  # ends up to here are settled
        single = False  # whether the character that ends at `at` has a piece of its own

        def settle(end: int) -> None:
            nonlocal at, single
            while at < end:
                if at and not single:
                    score = best[at - 1] + self.unknown
                    if score > best[at]:
                        best[at], count[at] = score, count[at - 1] + len(part[at - 1].encode("utf-8"))
                at, single = at + 1, False

        for last, (length, score) in self.matches.iter(part):
            end = last + 1
            settle(end)
            start = end - length
            if length == 1:
                single = True
            if (score := best[start] + score) > best[end]:
                best[end], count[end] = score, count[start] + 1
        settle(size + 1)
        return count[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.PARTS.findall(BLANK + text.replace(" ", BLANK))))


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(df: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_chars (code points) and n_tokens.

    `path` is a vocabulary file that every executor can open. Null texts count as
    empty; an empty text has no token; other texts are counted whole, with one
    blank put before them; repeated rows each yield a row.
    """

    def run(batches):
        counter = load(path)
        for batch in batches:
            for ids, texts in chunks(batch.column(1), batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([counter.count(t) for t in texts], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return pick(df, doc_id="bigint", text="string").mapInArrow(lean(run), "doc_id bigint, n_chars bigint, n_tokens bigint")
