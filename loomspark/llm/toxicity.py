"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary documents, give each
expression (a run of letters and digits, in lower case) a likelihood, character by
character, given up to `order` characters before it. Each class has its own counts of
the longest contexts; what they leave goes to shared backoff counts: in how many
longer contexts, of either class, a character follows a shorter one. So where neither
class has seen an expression both give it the same share, and a rare expression weighs
as much as its known beginnings do. Counts are of documents, and a text's likelihood
is that of its different expressions: what a text repeats says nothing new.

A toxic document is mostly ordinary words: its likelihood draws each expression from
the toxic model with probability `admixture`, else from the ordinary one. A text's two
log-likelihoods are normalised by its length, the number of its expressions. Their
difference is a mean, whose error falls with the root of that number; it is compared
in units of that error, and a logistic curve maps it to 0..1.

The fit takes a bounded sample: `sample` toxic and twice as many ordinary labelled
rows, those of least hash. All their expressions count and all contexts are kept, as
arrays of hashes. The curve sees each row's score under a model of the other folds.
Scores see nothing but the text. Fit and scores prepare texts in the same way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, mix, pick

DISCOUNT = 0.75
START, END = "\x02", "\x03"
FOLDS = 3
_EXPRESSION = re.compile(r"[^\W_]+").findall


def expressions(text: str) -> set[str]:
    """The different runs of letters and digits of a text, in lower case."""
    return set(_EXPRESSION(text.lower()))


class Windows:
    """All characters of some words, and the ends of these, each with the characters before it in its word."""

    def __init__(self, ws: list[str], order: int):
        self.order = order
        pad = "\0" * (order - 1) + START
        self.codes = np.frombuffer("".join([pad + w + END for w in ws]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
        self.first = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(self.first, sizes)
        self.at = np.arange(len(inside)) + np.repeat(order * np.arange(1, len(ws) + 1), sizes)
        self.length = np.minimum(inside + 1, order)  # of the context, START counted
        self.word = np.repeat(np.arange(len(ws)), sizes)

    def hashes(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the last `length` characters before places i, and of these with the place's own."""
        h = np.full(len(i), 0x9E3779B97F4A7C15, np.uint64)
        at = self.at[i]
        for k in range(self.order, 0, -1):
            h = mix(h ^ np.where(length >= k, self.codes[at - k], 0))
        return h, mix(h ^ self.codes[at] ^ np.uint64(1 << 40))


@dataclass
class Table:
    """Rows of values by 64-bit keys."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of each key, 0 where there is none, and whether there is one."""
        out = np.zeros((len(keys), *self.values.shape[1:]))
        if not len(self.keys):
            return out, np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        out[held] = self.values[at[held]]
        return out, held


@dataclass
class Backoff:
    """Shared log-shares: of known pairs, and what contexts leave to shorter ones."""

    pairs: Table
    left: Table
    rest: float

    def log_p(self, w: Windows, i: np.ndarray, length: np.ndarray) -> np.ndarray:
        out, length, open_ = np.zeros(len(i)), length.copy(), np.arange(len(i))
        while len(open_):
            context, pair = w.hashes(i[open_], length[open_])
            p, held = self.pairs.find(pair)
            out[open_] += np.where(held, p, self.left.find(context)[0])
            open_ = open_[~held]
            done = length[open_] == 0
            out[open_[done]] += self.rest
            open_ = open_[~done]
            length[open_] -= 1
        return out


@dataclass
class Model:
    """Both classes' log-shares, ordinary first: `seen` for pairs that either knows, else what they leave by context."""

    order: int
    seen: Table
    left: Table
    shared: Backoff
    admixture: float
    slope: float = 0.0
    offset: float = -50.0

    def log_p(self, w: Windows, i: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(places, 2): log-share of the character at each place under the ordinary and the toxic model."""
        context, pair = w.hashes(i, length)
        out, held = self.seen.find(pair)
        rest = np.nonzero(~held)[0]
        out[rest] = self.left.find(context[rest])[0] + self.shared.log_p(w, i[rest], length[rest] - 1)[:, None]
        return out

    def word_log_p(self, ws: list[str]) -> np.ndarray:
        """(words, 2): log-likelihoods of words under both models."""
        if not ws:
            return np.zeros((0, 2))
        w = Windows(ws, self.order)
        return np.add.reduceat(self.log_p(w, np.arange(len(w.at)), w.length), w.first)

    def log_ratio(self, word: str) -> float:
        ordinary, toxic = self.word_log_p([word])[0]
        return float(toxic - ordinary)

    def classes(self, ws: list[str]) -> np.ndarray:
        """(words, 2): log-likelihoods of words in an ordinary and in a toxic document."""
        p, e = self.word_log_p(ws), self.admixture
        return np.stack([p[:, 0], np.logaddexp(p[:, 0] + math.log1p(-e), p[:, 1] + math.log(e))], 1)

    def score(self, evidence: float) -> float:
        x = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


class _Evidence:
    def __init__(self, model: Model, bound: int = 150_000, step: int = 10_000):
        self.model, self.bound, self.step = model, bound, step
        self.known: dict[str, tuple[float, float]] = {}

    def of(self, text: str) -> float:
        """The difference of the text's length-normalised log-likelihoods, toxic less ordinary, in units of its error."""
        different = expressions(text)
        if not different:
            return 0.0
        new = sorted(different.difference(self.known))
        if len(self.known) + len(new) > self.bound:
            self.known, new = {}, sorted(different)
        for a in range(0, len(new), self.step):
            part = new[a : a + self.step]
            self.known.update(zip(part, map(tuple, self.model.classes(part).tolist()), strict=True))
        n = len(different)
        ordinary, toxic = map(math.fsum, zip(*map(self.known.__getitem__, different), strict=True))
        return (toxic / n - ordinary / n) * math.sqrt(n)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each first stands, and the sum of its counts."""
    keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return keys, first, np.bincount(place, weights=counts, minlength=len(keys))


def _by_context(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair: its context's sum of counts and number of kinds; and the contexts' first places."""
    _, first, place, kinds = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(place, weights=counts)[place] if len(place) else counts, kinds[place], first


def _backoff(w: Windows, places: np.ndarray) -> Backoff:
    """Shared counts of all shorter contexts, from one place for each different pair of the longest ones."""
    length = w.length[places]
    level, levels = places[:0], []
    for m in range(w.order, 0, -1):
        level = np.concatenate([level, places[length == m]])
        level = level[np.unique(w.hashes(level, np.full(len(level), m))[1], return_index=True)[1]]
        context, pair = w.hashes(level, np.full(len(level), m - 1))
        _, first, n = _summed(pair, np.ones(len(level)))  # in how many contexts of m characters
        levels.append((level[first], context[first], pair[first], n))
        level = level[first]
    out = Backoff(Table(np.empty(0, np.uint64), np.empty(0)), Table(np.empty(0, np.uint64), np.empty(0)), 0.0)
    pairs, left = [], []
    for m, (at, context, pair, n) in enumerate(reversed(levels)):
        total, kinds, first = _by_context(context, n)
        if m == 0:
            out.rest = -math.log(len(at) + 1)  # every known character, and one for all others
            below = np.full(len(at), out.rest)
        else:
            below = out.log_p(w, at, np.full(len(at), m - 1))
        pairs.append((pair, np.log((n - DISCOUNT + DISCOUNT * kinds * np.exp(below)) / total)))
        left.append((context[first], np.log(DISCOUNT * kinds / total)[first]))
        out.pairs, out.left = (Table.of(*(np.concatenate(c) for c in zip(*x, strict=True))) for x in (pairs, left))
    return out


def fit_counts(ordinary: dict[str, int], toxic: dict[str, int], *, order: int = 4, admixture: float = 1e-2) -> Model:
    """The model of two word-count tables, with all their contexts."""
    ws = sorted({**ordinary, **toxic})
    w = Windows(ws, order)
    every = np.arange(len(w.at))
    context, pair = w.hashes(every, w.length)
    keys, first = np.unique(pair, return_index=True)
    shared = _backoff(w, first)
    below = np.exp(shared.log_p(w, first, w.length[first] - 1))
    contexts, context_first = np.unique(context[first], return_index=True)
    seen, left = np.empty((len(keys), 2)), np.zeros((len(contexts), 2))
    for k, counts in enumerate((ordinary, toxic)):
        weight = np.array([counts.get(x, 0) for x in ws], float)[w.word] if len(ws) else np.empty(0)
        own = np.bincount(np.searchsorted(keys, pair), weights=weight, minlength=len(keys))
        place = np.searchsorted(contexts, context[first])
        total = np.bincount(place, weights=own, minlength=len(contexts))
        kinds = np.bincount(place, weights=own > 0, minlength=len(contexts))
        known = total > 0
        seen[:, k] = np.log(np.where(known[place], (np.maximum(own - DISCOUNT, 0) + DISCOUNT * kinds[place] * below) / np.maximum(total, 1)[place], below))
        left[known, k] = np.log(DISCOUNT * kinds[known] / total[known])
    return Model(order, Table.of(keys, seen), Table.of(contexts, left), shared, admixture)


def fit_curve(evidence: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression by Newton steps, with a little ridge so that separable rows end too.

    Toxic rows weigh more by the root of the classes' ratio: half-way between rows
    that count alike and classes that do.
    """
    if not len(label) or label.min() == label.max():
        return 0.0, (50.0 if len(label) and label[0] else -50.0)
    x = np.stack([evidence, np.ones(len(evidence))], 1)
    v = np.where(label > 0, math.sqrt((label == 0).sum() / label.sum()), 1.0)
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6]) * len(label) * 1e-2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (v * (p - label)) + ridge @ w
        h = (x * (v * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return float(w[0]), float(w[1])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 2000, **options) -> Model:
    """Fit on rows whose crc32(doc_id) mod 5 is not 0. A document labelled both ways counts as toxic.

    Without labelled rows of both classes the model gives every text the same score.
    """
    docs = pick(docs, doc_id="bigint", text="string")
    marks = pick(labels, doc_id="bigint", toxic="int").dropna().filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order_by = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    ids = None
    for k, n in ((0, 2 * sample), (1, sample)):
        part = marks.filter(F.col("toxic") == k).orderBy(*order_by).limit(n)
        ids = part if ids is None else ids.unionAll(part)
    ids = ids.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)).cast("int"))
    rows = docs.join(F.broadcast(ids), "doc_id").select("toxic", "fold", "text")  # at most 3 * sample rows

    def count(batches):
        found: dict[tuple[int, int], Counter] = {}
        for b in batches:
            for keys, texts in chunks(b.column(2), pa.array(range(b.num_rows))):
                marked = zip(b.column(0).take(pa.array(keys)).to_pylist(), b.column(1).take(pa.array(keys)).to_pylist(), texts, strict=True)
                for toxic, fold, t in marked:
                    found.setdefault((toxic, fold), Counter()).update(expressions(t))
        for (toxic, fold), held in found.items():
            ws = list(held)
            for a in range(0, len(ws), 20_000):
                part = ws[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(part), pa.int32()), pa.array([fold] * len(part), pa.int32()), pa.array(part), pa.array([held[w] for w in part], pa.int64())], ["toxic", "fold", "w", "n"])

    counted = rows.mapInArrow(lean(count), "toxic int, fold int, w string, n bigint").groupBy("toxic", "fold", "w").agg(F.sum("n").alias("n"))
    folds: list[list[dict[str, int]]] = [[{}, {}] for _ in range(FOLDS)]
    for r in counted.toLocalIterator():  # the words of the sample
        folds[r["fold"]][r["toxic"]][r["w"]] = r["n"]

    def model_of(held: list[int]) -> Model:
        sums: tuple[Counter, Counter] = Counter(), Counter()
        for f in held:
            for k in (0, 1):
                sums[k].update(folds[f][k])
        return fit_counts(*sums, **options)

    if not all(any(f[k] for f in folds) for k in (0, 1)):
        return fit_counts({}, {}, **options)
    shared = docs.sparkSession.sparkContext.broadcast([model_of([f for f in range(FOLDS) if f != out]) for out in range(FOLDS)])  # bounded by the sample

    def run(batches):
        known = [_Evidence(m, bound=50_000) for m in shared.value]
        for b in batches:
            found = [known[f].of(t or "") for f, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["toxic", "evidence"])

    pdf = rows.mapInArrow(lean(run), "toxic int, evidence double").toPandas().sort_values(["evidence", "toxic"])
    shared.unpersist()
    model = model_of(list(range(FOLDS)))
    model.slope, model.offset = fit_curve(pdf["evidence"].to_numpy(float), pdf["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id and score, 0 to 1.

    A null or empty text has no evidence and scores what the curve gives to none.
    Very long texts are scored whole. Repeated rows each yield a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        known = _Evidence(shared.value)
        for b in batches:
            values = [known.model.score(known.of(t)) for _, ts in chunks(b.column(1)) for t in ts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(lean(run), "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of a table whose text scores below `limit`, with all their columns.

    Null and empty texts score what the curve gives to no evidence. Each of repeated
    rows is judged alike; null ids change nothing; an empty table yields no row.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    place = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = _Evidence(shared.value)
        for b in batches:
            keep = [known.model.score(known.of(t)) < limit for _, ts in chunks(b.column(place)) for t in ts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(lean(run), plain.schema).toDF(*names)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    model = fit(docs, labels, **options)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
