"""Tokenizers, secrets, personal data, toxicity, mixing, pipeline."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, clashing, docs, odd_texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import bpe, mixing, pii, secret_scan, token_counts, toxicity
from loomspark.llm.common import Workspace

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "é", "\n", "17", "!!", "漢", "ß", "'s", "😀", "▁", "zz", "<s>"]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def tiktoken_():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), ODD, st.text(alphabet="etaoinsh", min_size=30, max_size=400)))
def test_tree_bpe_equals_the_library(tiktoken_, text):
    own = bpe.load(RANKS, public_tokenizers.PATTERN)
    ids = own.encode(text)
    assert ids == tiktoken_.encode_ordinary(text) and own.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 4000, "!" * 5000, " " * 5000, "é" * 3000, "0123456789" * 500])
def test_tree_bpe_on_long_pieces(tiktoken_, text):
    assert bpe.load(RANKS, public_tokenizers.PATTERN).encode(text) == tiktoken_.encode_ordinary(text)


def test_any_tree_gives_the_same_tokens():
    own = bpe.load(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"theinganderst") for _ in range(rng.randint(2, 60)))
        whole, cut = own.merge(data), rng.randrange(1, len(data))
        assert own.join(own.merge(data[:cut]), own.merge(data[cut:])) == whole


def test_bpe_digest(spark, tiktoken_):
    pairs = odd_texts()
    got = sorted(map(tuple, bpe.digest(clashing(docs(spark, pairs)), RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t in pairs:
        ids = np.array(tiktoken_.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.tokenize(docs(spark, {1: "a"}).filter("false"), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models

    scores = token_counts.vocabulary(PIECES)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items()], 0, False))

    def count(text):
        if not text:
            return 0
        x = "▁" + text.replace(" ", "▁")
        e = t.encode(x)
        return sum(1 if i else len(x[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets))

    return count


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), ODD))
def test_counts_equal_the_tokenizer(unigram, text):
    assert token_counts.load(PIECES).count(text) == unigram(text)


def test_count_tokens(spark, unigram):
    pairs = odd_texts()
    got = token_counts.count_tokens(clashing(docs(spark, pairs)), PIECES).collect()
    assert token_counts.count_tokens(docs(spark, {1: "a"}).filter("false"), PIECES).count() == 0
    assert sorted(map(str, [(r.doc_id, r.n_chars, r.n_tokens) for r in got])) == sorted(map(str, [(i, len(t or ""), unigram(t or "")) for i, t in pairs]))


ASSIGN = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:word|WORD|Word|wd|WD)|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    t = t or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secret_base_spans(spark):
    rng = random.Random(3)
    parts = ["é😀 ", "password: secret: abcdefghijklmnop ", 'TOKEN = "', "abcdef0123456789", "AKIA", "ABCD1234EFGH5678", "api_key='x", "apikey=", "passwd : short ", "\n", "=", "secret", " ", "deadbeefdeadbeef0 "]
    pairs = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    pairs += odd_texts() + [(900, "password=abcdefabcdefabcdef ſecret=abcdefghijklmnop " * 300)]
    got = secret_scan.digest(secret_scan.scan(clashing(docs(spark, pairs)), Workspace(spark))).collect()
    want = sorted((str(i), hashlib.sha256(brute_secrets(t).encode()).hexdigest()) for i, t in pairs)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert all(r.n_assign + r.n_access + r.n_hex + r.n_linked == (r.spans.count(",") + 1 if r.spans else 0) for r in got)


def test_weak_parts_are_reported_together_only(spark):
    key, value, place = "AKIA" + "Z9" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "https://db.example.com:5432/x"
    texts = {1: f"{key} {value} {place}", 2: f"{value} {place}", 3: key + " x" * 300 + " " + value, 4: f"user: bob {value} {place}", 5: f"user=bob {place}", 6: f"{key} token=abc123"}
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.scan(docs(spark, texts), Workspace(spark))).collect()}
    kinds = {i: [s.split(":")[0] for s in x.split(",")] if x else [] for i, x in got.items()}
    assert kinds == {1: ["access", "opaque", "endpoint"], 2: [], 3: ["access"], 4: ["user", "opaque", "endpoint"], 5: [], 6: ["access", "short"]}


def brute_linked(t, scope=200):
    """Linked spans of a text, every pair of spans compared."""
    t = t or ""
    names = ["assign", "access", "hex", "user", "short", "opaque", "endpoint"]
    part = dict(zip(names, ["s", "i", "s", "i", "s", "s", "e"]))
    base = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in brute_secrets(t).split(",") if x)]
    weak = [(m.start(), "short", m.end()) for m in ASSIGN.finditer(t) if 6 <= len(m[2]) < 12]
    if base or "://" in t:
        weak += [(m.start(), "user", m.end()) for m in re.finditer(r"""(?i:user|username|login|client_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""", t, re.A)]
        weak += [(m.start(), "opaque", m.end()) for m in re.finditer("[A-Za-z0-9+/]{32,}", t)]
        weak += [(m.start(), "endpoint", m.end()) for m in re.finditer("[a-z]{2,8}://[A-Za-z0-9.:/_-]+", t)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    near = lambda w, xs: {part[x[1]] for x in xs if x[0] - w[2] <= scope and w[0] - x[2] <= scope} - {part[w[1]]}
    linked = [w for w in weak if near(w, base) or len(near(w, base + weak)) == 2]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base + linked, key=lambda x: (x[0], names.index(x[1]))))


def test_linked_spans_are_those_of_all_pairs(spark):
    rng = random.Random(13)
    parts = ["user: bob ", "client_id=x9 ", "password=abc1234 ", "AKIA" + "Z9" * 8 + " ", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY ", "https://db.example.com:5432/x ", "deadbeefdeadbeef ", "word " * 20, "é" * 90 + " ", "x " * 100, "secret=abcdefghijklmnop "]
    pairs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(2, 25)))) for i in range(300)]
    pairs += [(7, pairs[7][1]), (None, pairs[8][1]), *odd_texts()]
    pairs += [(900, "https://a.b/c " * 3000 + "login=me " + "z" * 5000 + " deadbeefdeadbeef " * 500)]
    got = secret_scan.digest(secret_scan.scan(clashing(docs(spark, pairs)).repartition(5), Workspace(spark))).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), brute_linked(t)) for i, t in pairs)
    assert sum(r.n_linked for r in got) > 300
    assert secret_scan.scan(docs(spark, {1: "a"}).filter("false"), Workspace(spark)).count() == 0


def test_a_text_of_very_many_secrets(spark):
    """Linear in the spans of one text."""
    import time

    n = 16_000
    df = docs(spark, {1: "https://h.example.com/p deadbeefdeadbeef0 " * n})
    scan = lambda: secret_scan.digest(secret_scan.scan(df, Workspace(spark))).collect()[0]
    scan()
    t = time.time()
    r = scan()
    assert (r.n_hex, r.n_linked) == (n, n) and time.time() - t < 30


def brute_pii(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", t) if all(int(p) < 256 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.com", "@", "a", ".", "1", "255", "256.", "1.2.3.4", "+1 (555) 555-0199", "4111 1111 1111 1111", "-", " ", "+", "é", "9999999999", "x_%", "()", "00"]), max_size=20).map("".join))
def test_base_personal_data(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_base_is_linear():
    import time

    t = time.time()
    for x in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "a@" * 150_000, "+1" * 150_000, "+1" + "(" * 300_000):
        pii.base_spans(x)
    assert time.time() - t < 20


def plain_texts(seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "of", "erty", "anth", "la", "mento", "über", "12", "x."]) for _ in range(200)) for _ in range(30)]


@pytest.fixture(scope="module")
def tagger():
    return pii.train(*pii.training_windows(plain_texts(0), n=2500), epochs=8)


def test_tagger_learns(tagger):
    x, y = pii.training_windows(plain_texts(1), n=600, seed=99)
    tags = pii.viterbi(pii.emissions(tagger, np.ascontiguousarray(x.T)), tagger.trans).T
    assert (tags == y).mean() > 0.97 and ((tags > 0) & (y > 0)).sum() / (y > 0).sum() > 0.85


def whole_emissions(finder, t):
    """Emissions of a text from all its windows, each weighed by its distance from rims inside the text."""
    step, n = finder.width - finder.overlap, len(t)
    total, weight = np.zeros((n, pii.TAGS)), np.zeros(n)
    for a in range(0, max(1, n - finder.overlap), step):
        x = np.full((1, finder.width), pii.PAD, np.uint8)
        c = pii.codes(t[a : a + finder.width])
        x[0, : len(c)] = c
        e = pii.emissions(finder.model, np.ascontiguousarray(x.T))[: len(c), :, 0]
        for k in range(len(c)):
            w = min([1.0] + [min(k + 1, finder.overlap) / (finder.overlap + 1)] * (a > 0) + [min(finder.width - k, finder.overlap) / (finder.overlap + 1)] * (a + len(c) < n))
            total[a + k] += w * e[k]
            weight[a + k] += w
    return total / weight[:, None]


def test_texts_are_decoded_whole(tagger):
    """Skipping places that are surely outside gives the tags of one search over all of a text."""
    rng = np.random.default_rng(5)
    texts = [" ".join([*plain_texts(7)[k].split()[: 9 * k], *(pii._planted(rng)[1] for _ in range(k % 4)), *plain_texts(8)[k].split()[:30]]) for k in range(20)]
    finder = pii.Finder(tagger, group=3)
    for t, tags in zip(texts, finder.tags(texts), strict=True):
        e = whole_emissions(finder, t)
        out = np.full((len(t) + 2, pii.TAGS, 1), -1e9)
        out[:, 0] = 0
        out[1:-1, :, 0] = e
        assert np.array_equal(tags, pii.viterbi(out, tagger.trans)[1:-1, 0])


def test_a_span_is_found_at_every_offset(tagger):
    """Between the same words a span is found wherever it stands to the seams of windows, and whole."""
    finder, words_ = pii.Finder(tagger), "the words of a text go on "
    put = "(555) 555-0123"
    texts = [f"{(words_ * 60)[:300 + k]} {put} {words_ * 30}" for k in range(4 * finder.width)]
    found = [put in [t[a:b] for a, _, b in added] for t, (_, added) in zip(texts, finder.spans(texts), strict=True)]
    assert np.mean(found) > 0.9
    assert all(found[k] == found[k % len(words_)] for k in range(len(texts)))


def test_find_in_none(spark, tagger):
    assert pii.find(docs(spark, {1: "a"}).filter("false"), tagger).count() == 0
    assert pii.redact(docs(spark, {1: "a"}).filter("false"), tagger).count() == 0


def test_fit_on_odd_tables(spark):
    """Nulls, ties and repeated rows in the sample, and no rows at all: a model comes out, the same on every run."""
    a, b = (pii.fit(clashing(docs(spark, odd_texts())).repartition(n), sample=6, epochs=1) for n in (2, 5))
    assert all(np.array_equal(x, y) for x, y in zip(a.parameters(), b.parameters(), strict=True))
    assert pii.fit(docs(spark, {1: "a"}).filter("false"), epochs=1).tables[0].shape[1] == pii.CHARS


def test_crf_gradient():
    rng = np.random.default_rng(0)
    e, trans, y = rng.normal(size=(5, 3, 2)), rng.normal(size=(3, 3)), rng.integers(0, 3, (5, 2))
    _, d_e, d_t = pii._crf(e, trans, y)
    for at, g, v in (((2, 1, 0), d_e, e), ((0, 2), d_t, trans)):
        keep = v[at]
        v[at] = keep + 1e-5
        up = pii._crf(e, trans, y)[0]
        v[at] = keep - 1e-5
        down = pii._crf(e, trans, y)[0]
        v[at] = keep
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_windows_reconcile(tagger):
    """Tags of a text do not depend on what stands beside it, and long texts are covered whole."""
    finder = pii.Finder(tagger)
    a, b = "call (555) 555-0123 now " + "words here " * 100 + " mail x.y@mail.example.com", "other text"
    assert np.array_equal(finder.tags([a])[0], finder.tags([b, a, b])[1])
    base, added = finder.spans([a])[0]
    assert [a[s:e] for s, _, e in base] == ["x.y@mail.example.com"] and all(pii.plausible(k, a[s:e]) for s, k, e in added)


def test_find_and_redact(spark, tagger):
    pairs = odd_texts() + [(50, "a@b.co, 1.2.3.4 and +1 (555) 555-0199"), (51, "clean")]
    df = clashing(docs(spark, pairs))
    got = {r.doc_id: r for r in pii.find(df, tagger).collect()}
    listed = lambda t: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_pii(t))
    assert all(got[i].base_sha256 == hashlib.sha256(listed(t).encode()).hexdigest() for i, t in pairs)
    assert (got[50].n_email, got[50].n_ip, got[50].n_card, got[50].n_phone) == (1, 1, 0, 1)
    out = pii.redact(df, tagger)
    assert out.columns == df.columns
    rows = {r[1]: r for r in out.collect()}
    assert rows[50][2].startswith("<email>, <ip> and ") and rows[50][5] == len(rows[50][2]) and rows[51][2] == "clean" and rows[1][2] is None


def toxic_rows(n=1200):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("the", "an", "er", "on", "st", "th") for b in ("re", "ing", "ly", "tion", "", "ed", "ou")]
    pairs, labels = [], []
    for i in range(n):
        ws = [rng.choice(plain) + rng.choice(["", "", rng.choice(plain)]) for _ in range(rng.randint(30, 150))]
        if toxic := i % 5 == 0:
            for _ in range(rng.randint(2, 6)):
                ws[rng.randrange(len(ws))] = rng.choice(["gronk", "zuffle"]) + rng.choice(["", "er", "aire", "sk", "ma"])
        pairs.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return pairs, labels


def test_toxicity(spark):
    pairs, labels = toxic_rows()
    truth = {i: t for i, _, t in labels}
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    pairs += [(i + 5000, t) for i, t in odd_texts() if i is not None]
    got = toxicity.classify(clashing(docs(spark, pairs)), marks).collect()
    assert len(got) == len(pairs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (5001, 5002, 5003, 5004, 5005, 5008))


def test_scores_see_no_held_out_labels(spark):
    pairs, labels = toxic_rows(400)
    df = docs(spark, pairs)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.classify(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classify(docs(spark, odd_texts()), none).collect()} == {0}
    assert toxicity.classify(docs(spark, {1: "x"}).filter("false"), none).count() == 0


def test_kneser_ney_sums_to_one():
    """After any context, known or not, each model's shares of all characters, and of one unknown, add up to one."""
    ordinary, toxic = {"ab": 3, "ac": 2, "b": 1, "über": 2, "abacus": 1}, {"ab": 1, "ad": 4, "abad": 2}
    m = toxicity.fit_counts(ordinary, toxic)
    letters = sorted(set("".join([*ordinary, *toxic]))) + [toxicity.END, "?"]
    for before in ("", "a", "ab", "aba", "abacu", "zzz", "xab", "abada", "ü"):
        ws = [before + x for x in letters if x != toxicity.END] + [before]
        w = toxicity.Windows(ws, m.order)
        at = np.nonzero(np.arange(len(w.at)) - w.first[w.word] == len(before))[0]
        assert np.allclose(np.exp(m.log_p(w, at, w.length[at])).sum(axis=0), 1), before
    assert m.log_ratio("ad") > 1 > 0 > m.log_ratio("ac")


def plain_word_log_p(ordinary, toxic, word, order=5, d=0.75):
    """Both models' log-likelihoods of a word, from counters."""
    grams = lambda w: [((toxicity.START + w)[max(0, i + 1 - order) : i + 1], (w + toxicity.END)[i]) for i in range(len(w) + 1)]
    own = [{}, {}]
    for k, counts in enumerate((ordinary, toxic)):
        for w, n in counts.items():
            for c, x in grams(w):
                own[k].setdefault(c, {}).setdefault(x, 0)
                own[k][c][x] += n
    level, shared = {(c, x) for k in own for c, xs in k.items() for x in xs}, {}
    for m in range(order, 0, -1):
        here = {(c, x) for c, x in level if len(c) == m}
        for c, x in here:
            shared.setdefault(c[1:], {}).setdefault(x, 0)
            shared[c[1:]][x] += 1
        level |= {(c[1:], x) for c, x in here}

    def back(c, x):
        below = back(c[1:], x) if c else 1 / (len(shared[""]) + 1)
        xs = shared.get(c)
        return below if not xs else (max(xs.get(x, 0) - d, 0) + d * len(xs) * below) / sum(xs.values())

    def p(k, c, x):
        xs, below = own[k].get(c), back(c[1:], x)
        return below if not xs else (max(xs.get(x, 0) - d, 0) + d * len(xs) * below) / sum(xs.values())

    return [sum(np.log(p(k, c, x)) for c, x in grams(word)) for k in (0, 1)]


def test_likelihoods_equal_plain_counting():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    ordinary, toxic = ({word(): rng.randint(1, 9) for _ in range(60)} for _ in range(2))
    m = toxicity.fit_counts(ordinary, toxic)
    ws = [*ordinary][:20] + [*toxic][:20] + [word() for _ in range(20)] + ["zq", "aaaaaaaaaaaa"]
    assert np.allclose(m.word_log_p(ws), [plain_word_log_p(ordinary, toxic, w, m.order) for w in ws])


def test_rare_toxic_words_are_kept():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    ordinary, toxic = {word(9): 9 for _ in range(45_000)}, {word(9): 1 for _ in range(300)}
    m = toxicity.fit_counts(ordinary, toxic)
    x = np.diff(m.word_log_p([*toxic]))[:, 0]
    assert x.min() > 3 and np.diff(m.word_log_p([*ordinary][:500])).max() < -1
    assert np.allclose(x[:20], [m.log_ratio(w) for w in [*toxic][:20]], rtol=0, atol=1e-9)


def test_accepted_keeps_odd_rows(spark):
    pairs, labels = toxic_rows(600)
    odd = [(i if i is None else i + 5000, t) for i, t in odd_texts()]
    df = clashing(docs(spark, [*pairs, *odd]))
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns and toxicity.accepted(df.filter("false"), model).count() == 0
    scores = {t: model.score(toxicity._Evidence(model).of(t or "")) for _, t in [*pairs, *odd]}
    show = lambda rows: sorted(map(repr, rows))
    assert show((r[1], r[2]) for r in kept.collect()) == show((i, t) for i, t in [*pairs, *odd] if scores[t] < 0.5)
    assert scores[None] == scores[""] and 0 < len([t for t in scores if scores[t] >= 0.5]) < 200


def brute_targets(sizes):
    """Targets by sharing and resharing the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(6)
    names = ["b", "a", "é", "B", None, "z", "empty"]
    rows = []
    for i in range(3000):
        s = rng.choices(names, [30, 5, 3, 2, 2, 1, 1])[0]
        rows.append((i, " ".join(["w"] * (0 if s == "empty" else rng.choice([1, 3, 7, 40, rng.randint(1, 300)]))) or None, "en", s, 0))
    rows += [(None, "x y", "en", "a", 0), (7, "x y", "en", "a", 0), (7, "x y", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(clashing(df), Workspace(spark)).collect()
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    by_size = {}
    for r in got:
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s, n in sizes.items():
        part = by_size[n, round(want[s], 6)]
        assert abs(sum(r.taken for r in part) - want[s]) <= max(3, 0.005 * want[s]), s
    again = mixing.mix(df.repartition(9), Workspace(spark)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)


@pytest.mark.parametrize("share", [0.4, 1.5])
def test_mixing_reaches_targets_beside_a_very_long_document(spark, share):
    from pyspark.sql import functions as F

    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("s").alias("source"))
    df = many.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.repeat(F.lit("w "), 20_000).alias("text"), F.lit("s").alias("source")))
    taken, target = mixing.mix(df, Workspace(spark), share=share).agg(F.sum("taken"), F.first("target")).first()
    assert target == share * 80_000 and abs(taken - target) <= 0.005 * target


def test_mixing_fails_where_a_target_is_missed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HALVINGS", 0)
    with pytest.raises(RuntimeError, match="source 's'"):
        mixing.mix(docs(spark, {i: "w " * (i + 1) for i in range(50)}, ["s"] * 50), Workspace(spark), steps=1)


def test_mixing_halves_to_the_target(spark):
    got = mixing.mix(docs(spark, {i: "w " * (i + 1) for i in range(300)}, ["s"] * 300), Workspace(spark), steps=0).collect()
    assert abs(sum(r.taken for r in got) - got[0].target) <= 0.005 * got[0].target


def test_mixing_beyond_the_bounds(spark, monkeypatch):
    """Many sources join by a shuffle, and large cells have more salts: the same targets, taken as closely."""
    rows = [(i, "w " * (i % 7 + 1), ["a", "b", None, "c"][i % 4]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    summed = lambda: sorted(map(str, mixing.mix(df, Workspace(spark)).groupBy("source_size", "target").sum("taken").collect()))
    before = summed()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert summed() == before
    monkeypatch.setattr(mixing, "SALT_ROWS", 10)
    got = mixing.mix(df, Workspace(spark)).groupBy("target").sum("taken").collect()
    assert all(abs(r[1] - r[0]) <= max(3, 0.005 * r[0]) for r in got) and len(got) >= 3


def test_mixing_of_few(spark):
    assert mixing.mix(docs(spark, {1: "a"}).filter("false"), Workspace(spark)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, {1: None, 2: ""}, ["s", "s"]), Workspace(spark)).collect()] == [0, 0]
    one = mixing.mix(docs(spark, {1: "a b c d"}, ["s"]), Workspace(spark)).first()
    assert one.target == 6.0 and one.taken in (4, 8)


def test_mixing_stays_in_the_jvm(spark):
    plan = mixing.mix(docs(spark, {1: "a b", 2: "c"}), Workspace(spark))._jdf.queryExecution().executedPlan().toString()
    plan += secret_scan.digest(secret_scan.scan(docs(spark, {1: "a"}), Workspace(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixed_rows(spark):
    df = clashing(docs(spark, [(i, "w " * (i % 9)) for i in range(60)]))
    out = mixing.mixed(df, Workspace(spark))
    copies = {r.doc_id: r.copies for r in mixing.mix(df, Workspace(spark)).collect()}
    counts = {}
    for r in out.collect():
        counts[r[1]] = counts.get(r[1], 0) + 1
    assert out.columns == df.columns and counts == {i: c for i, c in copies.items() if c}


def test_pipeline(spark, sf_dir, tiktoken_):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_searches import brute_near

    from loomspark.llm.common import table

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "personal_data", "source_mix", "bpe"]
    ws = Workspace(spark)
    start = table(spark, sf_dir, "documents")
    at, seen = start, []
    for name, stage in pipeline.STAGES:
        at = ws.write(stage(spark, at, sf_dir), name)
        seen.append(at)
    clean, alone, red, mix, ids = seen
    assert all(x.columns == start.columns for x in seen[:4])
    scores = {r.doc_id: r.predicted for r in toxicity.classify(start, table(spark, sf_dir, "labels")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scores.items() if not p}
    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in alone.collect()} == {i for i, _, c in brute_near(pairs, 5, 80) if c == i}
    assert alone.count() == red.count() and not any(brute_pii(r.text) for r in red.collect())
    sizes, taken = {}, {}
    for r in red.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in mix.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    most = max(len(words(r.text)) for r in red.collect())
    assert all(abs(taken.get(x, 0) - t) <= max(most, 0.01 * t) for x, t in brute_targets(sizes).items())
    assert {r.text for r in mix.collect()} <= {r.text for r in red.collect()}
    rows = {r.doc_id: r for r in mix.collect()}
    assert ids.count() == mix.count()
    for r in ids.collect()[:50]:
        assert r.n_tokens == len(tiktoken_.encode_ordinary(rows[r.doc_id].text))


def test_pipeline_of_none(spark, tmp_path):
    """Tables without rows pass all stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs(spark, {1: "a"}).filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_package(tmp_path):
    """The entry points import, and list the engine's queries, where the package and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "loomspark", tmp_path / "loomspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) == len(e.oracle_sql()) > 40)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr
