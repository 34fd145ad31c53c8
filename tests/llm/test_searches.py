"""Exact top-k, near-dedup, substring dedup, fingerprints: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from helpers import clashing, docs, odd_texts, words
from pyspark.sql import functions as F

from loomspark.llm import fingerprints, linking, neardup, substring, topk
from loomspark.llm.common import Workspace, many_shingles, shingle_hashes


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_top(rows, k=5):
    ok = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block, queries", [(64, 3), (4096, 1024)])
def test_top_k(spark, block, queries):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.15, (40, 16))
    rows = [(i, [float(x) for x in base[i % 40]]) for i in range(301)]  # many ties
    rows += [(350, None), (400, [None, 1.0]), (450, [float("nan")] * 16), (500, [float("inf")] * 16), (550, [1.0, 2.0]), (None, [1.0]), (600, []), (650, [3e4] * 16)]
    df = vectors(spark, rows).repartition(5)
    got = topk.top_k(clashing(df, "vec_id"), F.col("vec_id") % 50 == 0, Workspace(spark), block_rows=block, wave_rows=queries)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_top_k_of_few_and_none(spark):
    few = vectors(spark, [(0, [1.0]), (1, [2.0])])
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 50 == 0, Workspace(spark)).collect())) == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(few.filter("false"), F.col("vec_id") % 50 == 0, Workspace(spark)).count() == 0


def test_huge_components_stay_exact():
    x = np.array([[float(1 << 40), 3.0]])
    assert topk._dots(x, np.array([float(1 << 40), 1.0])) == [(1 << 80) + 3]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 60, (500, 32)))
    q = np.floor(rng.normal(0, 60, 32))
    low, high = topk.Cells.of(x, 4).bounds(q)
    assert ((low <= x @ q) & (x @ q <= high)).all()


def test_shingles_of_many_texts_equal_those_of_each():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 9, n, dtype=np.uint64) for n in (0, 1, 2, 3, 7, 0, 2, 5, 1)]
    for width in (1, 3, 5):
        x, count = many_shingles(parts, width)
        assert np.array_equal(x, np.concatenate([shingle_hashes(p, width) for p in parts]))
        assert count.tolist() == [len(shingle_hashes(p, width)) for p in parts]


def brute_near(pairs, width, percent):
    """component_id of each row by all pairs of sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        ws = words((t or "").translate(lower))
        return frozenset([tuple(ws)] if 0 < len(ws) < width else [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)])

    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(pairs):
        if sets[n] and i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return [(i, len(s), least.get(root(n)) if s else i) for n, ((i, _), s) in enumerate(zip(pairs, sets))]


def family(rng, base, n, most):
    """Edited copies of a text, with up to `most` words replaced."""
    out = []
    for _ in range(n):
        ws = base.split()
        for _ in range(rng.randint(0, most)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(7)
    texts = []
    for f in range(6):
        texts += family(rng, " ".join(rng.choice(["the", "of", "on", "er", f"t{rng.randrange(3000)}"]) for _ in range(rng.choice([20, 90, 200]))), 25, 9)
    texts += [texts[0].upper(), texts[1] + " one more", *texts[:5]]
    pairs = [*enumerate(texts, 100), *odd_texts()]
    got = neardup.near_duplicates(clashing(docs(spark, pairs)).repartition(6), Workspace(spark), width=width, percent=percent)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(brute_near(pairs, width, percent), key=key)


@pytest.mark.parametrize("broadcast, one_task", [(0, 2_000_000), (200_000, 0)])
def test_near_duplicates_beyond_the_bounds(spark, monkeypatch, broadcast, one_task):
    monkeypatch.setattr(linking, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(linking, "ONE_TASK_LINKS", one_task)
    rng = random.Random(11)
    texts = []
    for _ in range(4):
        texts += family(rng, " ".join(f"t{rng.randrange(3000)}" for _ in range(60)), 12, 6)
    pairs = [*enumerate(texts, 100), *odd_texts()]
    got = neardup.near_duplicates(docs(spark, pairs).repartition(3), Workspace(spark), width=3, percent=85)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(brute_near(pairs, 3, 85), key=key)


def test_hot_groups(spark, monkeypatch):
    """Many copies near one text, a shingle that all texts hold, and texts of one template that are not near."""
    monkeypatch.setattr(linking, "SALT_MEMBERS", 16)
    rng = random.Random(12)
    base = [f"t{i}" for i in range(120)]
    copies = []
    for k in range(3000):  # one word replaced, all within two words of each other
        ws = [*base]
        ws[rng.randrange(len(ws))] = f"c{k}"
        copies.append("all texts begin alike " + " ".join(ws))
    form = [f"f{i}" for i in range(60)]
    forms = ["all texts begin alike " + " ".join([*form, *(f"u{k}-{i}" for i in range(14))]) for k in range(150)]
    pairs = [*enumerate(copies, 1000), *enumerate(forms, 9000)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, pairs).repartition(5), Workspace(spark), width=3, percent=85).collect()}
    assert {got[i] for i, _ in enumerate(copies, 1000)} == {1000}
    assert [got[i] for i, _ in enumerate(forms, 9000)] == [i for i, _ in enumerate(forms, 9000)]


def test_contraction():
    rng = np.random.default_rng(4)
    e = rng.integers(0, 400, (300, 2))
    links = np.concatenate([e, 7000 - e], 1)
    nodes, roots, ids = linking._contract(links)
    up = {int(x): int(x) for x in e.ravel()}
    for _ in range(400):
        for a, b in e.tolist():
            up[a] = up[b] = min(up[a], up[b])
    assert dict(zip(nodes.tolist(), roots.tolist())) == up
    most = {r: max(n for n, x in up.items() if x == r) for r in up.values()}
    assert dict(zip(nodes.tolist(), ids.tolist())) == {n: 7000 - most[r] for n, r in up.items()}


def test_near_duplicates_of_none(spark):
    assert neardup.near_duplicates(docs(spark, {1: "a"}).filter("false"), Workspace(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    pairs = [(1, text), (2, text), (2, text), (3, text + " x"), (None, text), (4, "other words stand here now"), (4, "other words stand here now"), (None, "alone with no id at all"), (5, None), (6, "")]
    got = neardup.deduplicated(clashing(docs(spark, pairs)), Workspace(spark))
    assert got.columns == clashing(docs(spark, pairs)).columns
    kept = sorted((str(r[1]), (r[2] or "")[:5]) for r in got.collect())
    assert kept == [("1", "w0 w1"), ("4", "other"), ("5", ""), ("6", ""), ("None", "alone")]


def test_match_bound():
    assert [neardup.least_matches(24, t, 1e-6) for t in (0.8, 0.85)] == [9, 10]


def brute_kept(pairs, width=50):
    first = {}
    order = sorted(pairs, key=lambda p: (p[0] is None, p[0]))
    for i, t in order:
        ws = words(t)
        for j in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[j : j + width]), i)
    out = []
    for i, t in pairs:
        ws = words(t)
        gone = [False] * len(ws)
        for j in range(len(ws) - width + 1):
            f = first[tuple(ws[j : j + width])]
            if f is not None and (i is None or f < i):
                gone[j : j + width] = [True] * width
        out.append((str(i), len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone) if not g).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batch", [2_000, 4_000_000])
def test_substring_dedup(spark, batch):
    rng = random.Random(2)
    passages = [" ".join(f"p{rng.randrange(400)}" for _ in range(rng.choice([49, 50, 51, 80, 130]))) for _ in range(8)]
    passages += ["a " * 70, "a b " * 40, "x " * 49]
    pairs = odd_texts()
    for i in range(100, 160):
        parts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30))) for _ in range(4)]
        for p in rng.sample(passages, 2):
            parts.insert(rng.randrange(5), p)
        pairs.append((i, rng.choice([" ", "\n"]).join(parts)))
    got = substring.dedup(clashing(docs(spark, pairs)).repartition(5), Workspace(spark), batch_chars=batch, least_buckets=7)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_kept(pairs)


def test_substring_dedup_of_none(spark):
    assert substring.dedup(docs(spark, {1: "a"}).filter("false"), Workspace(spark)).count() == 0


def test_recompression_is_consistent():
    rng = np.random.default_rng(0)
    core = rng.integers(0, 30, 60, dtype=np.uint64)
    found = []
    for _ in range(2):
        h = np.concatenate([rng.integers(0, 30, 25, dtype=np.uint64), core, rng.integers(0, 30, 25, dtype=np.uint64)])
        name, low, high = substring.recompress(h, np.zeros(len(h), int), 6)
        inside = (low >= 25) & (high <= 85)
        found.append([(int(n), int(a) - 25, int(b) - 25) for n, a, b in zip(name[inside], low[inside], high[inside])])
    assert found[0] == found[1] and found[0]


M64 = (1 << 64) - 1


def plain_mix(x):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * k) & M64
    return x ^ (x >> 33)


def plain_signature(t, mh):
    """A signature by its definition, shingle by shingle."""
    import xxhash

    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words(t)]
    k = min(mh.width, len(h))
    hashed = []
    for i in range(len(h) - k + 1 if h else 0):
        x = 0x9E3779B97F4A7C15 + k
        for j in range(k):
            x = (plain_mix(x ^ h[i + j]) + j + 1) & M64
        hashed.append(x)
    ab = zip(mh.a.tolist(), mh.b.tolist())
    return [((min((a * x + b) & M64 for x in hashed) * 0x9E3779B97F4A7C15) & M64) >> 48 if hashed else 0xFFFF for a, b in ab]


def test_fingerprints(spark):
    pairs = [*odd_texts(), (70, "tail")]
    pairs[7] = (6, pairs[7][1][:9000])  # plain_signature is slow
    got = sorted(fingerprints.with_neighbours(clashing(docs(spark, pairs)).repartition(4), Workspace(spark)).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0)))
    mh = fingerprints.MinHash()
    show = lambda s: "".join(f"{x:04x}" for x in s)
    alike = lambda a, b: sum(x == y for x, y in zip(a, b)) / 64
    assert [r.doc_id for r in got] == [i for i, _ in order]
    for r, (_, t), (_, f) in zip(got, order, order[1:] + order[:1]):
        t, f = t or "", f or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + f[:k]
        own, other, after = (plain_signature(x, mh) for x in (t, edited, f))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (show(own), show(other), alike(own, other), alike(own, after))
    assert {r.near_group for r in got if r.doc_id in (9, 10)} == {9} and all(r.near_group == r.doc_id for r in got if r.doc_id != 10)


def test_fingerprints_estimate_jaccard():
    rng = random.Random(1)
    mh = fingerprints.MinHash(256)
    a = [f"w{rng.randrange(9999)}" for _ in range(400)]
    b = a[:300] + [f"v{i}" for i in range(100)]
    s = mh.signatures([" ".join(a), " ".join(b)])
    x, y = (set(mh.shingles(" ".join(t)).tolist()) for t in (a, b))
    assert abs(float((s[0] == s[1]).mean()) - len(x & y) / len(x | y)) < 0.1


def test_fingerprints_of_one_and_none(spark):
    one = docs(spark, {3: "a b c"})
    assert fingerprints.with_neighbours(one, Workspace(spark)).first().near_next == 1.0
    assert fingerprints.with_neighbours(one.filter("false"), Workspace(spark)).count() == 0


def test_band_groups(spark):
    """Edits of a text, and edits of these: groups are the components of all pairs that are near."""
    rng = random.Random(4)
    texts = []
    for f in range(12):
        base = " ".join(f"t{f}-{i}" for i in range(150))
        first, second = (base.replace(f"t{f}-{k}", "new") for k in (20, 120))
        texts += [base, first, second, *family(rng, first, 3, 6), *family(rng, second, 3, 6)]
    pairs = [*enumerate(texts, 100), (5, texts[3]), (5, texts[4]), (900, texts[1]), (None, texts[1]), (901, ""), (902, None), (903, texts[0].upper())]
    got = fingerprints.with_neighbours(clashing(docs(spark, pairs)).repartition(5), Workspace(spark)).collect()
    sets = [frozenset(tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)) for _, t in pairs]
    near = [[a == b or bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in range(len(pairs))] for a in range(len(pairs))]
    least = [i for i, _ in pairs]
    for _ in range(len(pairs)):  # to a fixed point
        least = [min((least[b] for b in range(len(pairs)) if near[a][b] and least[b] is not None), default=None) for a in range(len(pairs))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.near_group) for r in got), key=key) == sorted(((i, g) for (i, _), g in zip(pairs, least)), key=key)


def test_bands_reach_the_stated_share_of_near_pairs():
    """Of pairs at a similarity of 0.8 to 0.85, nine tenths and more share a band."""
    rng = random.Random(6)
    mh, found = fingerprints.MinHash(), []
    for _ in range(300):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = [*ws]
        for i in rng.sample(range(300), 6):
            other[i] = "x"
        texts = [" ".join(ws), " ".join(other)]
        x, y = (set(mh.shingles(t).tolist()) for t in texts)
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            s = mh.signatures(texts)[:, :63].reshape(2, 21, 3)
            found.append(bool((s[0] == s[1]).all(axis=1).any()))
    assert len(found) > 100 and np.mean(found) >= 0.99
