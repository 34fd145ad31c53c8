"""Personal data: fixed patterns, and a character BiLSTM with a CRF, in numpy.

Base spans are exact pattern matches. The model reads characters in overlapping
windows, both ways. Where windows overlap their emissions fade into each other, and
the CRF decodes each text as one sequence, so that a label never depends on where a
window ends. Labelled runs become spans, plausible ones of these that touch no base
span are added, and the longer wins where two collide.

The model is trained here, from labelled spans: windows of a bounded sample of
texts, whose base spans are labels, with generated personal data planted in them,
among it forms that the patterns miss. Gates are piecewise linear (clipped lines),
which numpy computes fast; training and use share them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, pick

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # always matches where it starts, so a long run is read once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @; linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
        end = host.end() if host else at + 1
        at = text.find("@", end)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Each four parts of a maximal dotted run are one match; the search never starts inside a part."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        a = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            b = a + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((a, b))
            a = b + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in addresses(text)]
        out += [(a, 2, b) for a, b in cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in phones(text)]
    return sorted(out)


# The model. Arrays are (features, windows): each step works on contiguous rows.

CHARS = 132
OUTSIDE, PAD = 0, 131
WIDTH = 192  # characters of a window, in training and in use
TAGS = 1 + len(KINDS)


def codes(text: str) -> np.ndarray:
    """One code a character: ASCII as it is, then Latin, other letters, the rest; PAD is no character."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(x < 128, x, np.where(x < 0x250, 128, np.where(x < 0x2000, 129, 130))).astype(np.uint8)


@dataclass
class Tagger:
    """Both directions' input tables (4H, CHARS), recurrent (4H, H), emissions (TAGS, H), the CRF."""

    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray
    trans: np.ndarray

    @classmethod
    def new(cls, hidden: int, rng: np.random.Generator) -> Tagger:
        f = np.float32
        tables = [rng.normal(0, 0.4, (4 * hidden, CHARS)).astype(f) for _ in range(2)]
        for t in tables:
            t[hidden : 2 * hidden] += 0.5  # remember at first
        return cls(tables, [rng.normal(0, 0.3, (4 * hidden, hidden)).astype(f) for _ in range(2)], [rng.normal(0, 0.3, (TAGS, hidden)).astype(f) for _ in range(2)], np.array([1.0] + [0.0] * (TAGS - 1), f), np.zeros((TAGS, TAGS), f))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.out, self.bias, self.trans]


def _states(table: np.ndarray, u: np.ndarray, x: np.ndarray, backwards: bool) -> np.ndarray:
    """Hidden states (T, H, B) for codes x (T, B). Rows of the gates: input, forget, output, candidate."""
    t_max, width = x.shape
    hid = u.shape[1]
    out = np.empty((t_max, hid, width), np.float32)
    h, c = np.zeros((hid, width), np.float32), np.zeros((hid, width), np.float32)
    z, r = np.empty((4 * hid, width), np.float32), np.empty((4 * hid, width), np.float32)
    # 0.5 + x / 2 clipped to 0..1; the candidate is twice that less 1.
    half, u_half = table * np.float32(0.5) + np.float32(0.5), u * np.float32(0.5)
    for t in range(t_max - 1, -1, -1) if backwards else range(t_max):
        np.take(half, x[t], axis=1, out=z, mode="clip")
        np.matmul(u_half, h, out=r)
        z += r
        np.maximum(z, 0, out=z)
        np.minimum(z, 1, out=z)
        g = z[3 * hid :]
        g *= 2
        g -= 1
        c *= z[hid : 2 * hid]
        g *= z[:hid]
        c += g
        h = out[t]
        np.maximum(c, -1, out=h)
        np.minimum(h, 1, out=h)
        h *= z[2 * hid : 3 * hid]
    return out


def emissions(m: Tagger, x: np.ndarray) -> np.ndarray:
    """(T, TAGS, B)"""
    e = np.matmul(m.out[0], _states(m.tables[0], m.recurrent[0], x, False))
    e += np.matmul(m.out[1], _states(m.tables[1], m.recurrent[1], x, True))
    e += m.bias[:, None]
    return e


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (T, B) for emissions (T, TAGS, B)."""
    score, back = e[0], []
    for t in range(1, len(e)):
        paths = score[:, None] + trans[:, :, None]
        back.append(paths.argmax(0))
        score = paths.max(0) + e[t]
    tags = [score.argmax(0)]
    at = np.arange(e.shape[2])
    for b in reversed(back):
        tags.append(b[tags[-1], at])
    return np.stack(tags[::-1])


def bounds(trans: np.ndarray) -> tuple[float, float]:
    """Leads of outside over every tag, beyond which a place is outside on the best path.

    Above the second, wherever it stands: to make n such places outside changes n + 1
    transitions, each for at most the spread of `trans`, and gains more than twice that
    a place. A run of other tags needs a place below the first: to make all of it
    outside costs at most what transitions can be better than outside to outside.
    """
    return 2 * max(0.0, float((trans - trans[0, 0]).max())), 2 * float(trans.max() - trans.min())


def best_tags(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (T) of a text's emissions (T, TAGS), outside before its first and after its last character.

    Only stretches below the bounds are searched; between outside places that is the
    search over the whole text.
    """
    some, every = bounds(trans)
    lead = e[:, 0] - e[:, 1:].max(1)
    tags = np.zeros(len(e), np.int8)
    cut = np.nonzero(np.diff((lead <= every).astype(np.int8), prepend=0, append=0))[0].reshape(-1, 2)
    low = np.concatenate([[0], np.cumsum(lead <= some)])
    cut = cut[low[cut[:, 1]] > low[cut[:, 0]]]
    cut = cut[np.argsort(cut[:, 1] - cut[:, 0], kind="stable")]
    for g in range(0, len(cut), 64):
        part = cut[g : g + 64]
        size = int((part[-1, 1] - part[-1, 0])) + 2
        x = np.full((size, e.shape[1], len(part)), -1e9, np.float32)  # all but outside cannot be
        x[:, 0] = 0
        for r, (a, b) in enumerate(part):
            x[1 : 1 + b - a, :, r] = e[a:b]
        found = viterbi(x, trans)
        for r, (a, b) in enumerate(part):
            tags[a:b] = found[1 : 1 + b - a, r]
    return tags


# Training.


def _forward(table, u, x, backwards):
    t_max, width = x.shape
    hid = u.shape[1]
    h, c = np.zeros((hid, width), np.float32), np.zeros((hid, width), np.float32)
    kept, out = [None] * t_max, np.empty((t_max, hid, width), np.float32)
    for t in range(t_max - 1, -1, -1) if backwards else range(t_max):
        raw = 0.5 * (table[:, x[t]] + u @ h) + 0.5
        z = np.clip(raw, 0, 1)
        g = 2 * z[3 * hid :] - 1
        c_new = z[hid : 2 * hid] * c + z[:hid] * g
        squashed = np.clip(c_new, -1, 1)
        kept[t] = h, c, (raw > 0) & (raw < 1), z, g, c_new, squashed
        h, c = z[2 * hid : 3 * hid] * squashed, c_new
        out[t] = h
    return out, kept


def _backward(table, u, x, backwards, kept, d_out):
    t_max, width = x.shape
    hid = u.shape[1]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    dh_next, dc_next = np.zeros((hid, width), np.float32), np.zeros((hid, width), np.float32)
    for t in range(t_max) if backwards else range(t_max - 1, -1, -1):
        h, c, live, z, g, c_new, squashed = kept[t]
        dh = d_out[t] + dh_next
        dc = dc_next + dh * z[2 * hid : 3 * hid] * (np.abs(c_new) < 1)
        dz = np.concatenate([dc * g, dc * c, dh * squashed, 2 * dc * z[:hid]]) * live * np.float32(0.5)
        np.add.at(d_table.T, x[t], dz.T)
        d_u += dz @ h.T
        dh_next, dc_next = u.T @ dz, dc * z[hid : 2 * hid]
    return d_table, d_u


def _crf(e: np.ndarray, trans: np.ndarray, y: np.ndarray):
    """Gradients of the mean negative log-likelihood by forward and backward sums."""
    t_max, k, width = e.shape

    def lse(v, axis):
        m = v.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis))

    alpha, beta = [e[0]], [np.zeros((k, width), np.float32)]
    for t in range(1, t_max):
        alpha.append(lse(alpha[-1][:, None] + trans[:, :, None], 0) + e[t])
    for t in range(t_max - 1, 0, -1):
        beta.append(lse(trans[:, :, None] + (e[t] + beta[-1])[None], 1))
    beta.reverse()
    z = lse(alpha[-1], 0)
    at = np.arange(width)
    d_e, d_trans, gold = np.empty_like(e), np.zeros_like(trans), 0.0
    for t in range(t_max):
        d_e[t] = np.exp(alpha[t] + beta[t] - z)
        d_e[t][y[t], at] -= 1
        gold += e[t][y[t], at]
        if t:
            p = np.exp(alpha[t - 1][:, None] + trans[:, :, None] + (e[t] + beta[t])[None] - z)
            d_trans += p.sum(2)
            np.add.at(d_trans, (y[t - 1], y[t]), -1)
            gold = gold + trans[y[t - 1], y[t]]
    return float((z - gold).mean()), d_e / width, d_trans / width


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.02, seed: int = 1) -> Tagger:
    """Adam over windows x with tags y, both (windows, T)."""
    rng = np.random.default_rng(seed)
    m = Tagger.new(hidden, rng)
    first, second = ([np.zeros_like(p) for p in m.parameters()] for _ in range(2))
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = order[a : a + batch]
            xs, ys = np.ascontiguousarray(x[i].T), np.ascontiguousarray(y[i].T)
            runs = [_forward(m.tables[d], m.recurrent[d], xs, d == 1) for d in (0, 1)]
            e = np.matmul(m.out[0], runs[0][0]) + np.matmul(m.out[1], runs[1][0]) + m.bias[:, None]
            _, d_e, d_trans = _crf(e, m.trans, ys)
            grads = [[], [], []]
            for d in (0, 1):
                hs, kept = runs[d]
                d_table, d_u = _backward(m.tables[d], m.recurrent[d], xs, d == 1, kept, np.matmul(m.out[d].T, d_e))
                for g, v in zip(grads, (d_table, d_u, np.einsum("tkb,thb->kh", d_e, hs)), strict=True):
                    g.append(v)
            flat = [*grads[0], *grads[1], *grads[2], d_e.sum((0, 2)), d_trans]
            size = np.sqrt(sum(float((g * g).sum()) for g in flat))
            step += 1
            now = rate * min(1.0, 3.0 * (1 - step / (total + 1)))
            for p, g, u, v in zip(m.parameters(), flat, first, second, strict=True):
                g = g * min(1.0, 5.0 / (size + 1e-9))
                u *= 0.9
                u += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= (now * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def _planted(rng: np.random.Generator) -> tuple[int, str]:
    """A generated piece of personal data and its tag; tag 0: something that only looks alike."""
    pick_ = lambda xs: xs[rng.integers(len(xs))]
    word = lambda a, b: "".join(pick_("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.integers(a, b)))
    num = lambda n: "".join(pick_("0123456789") for _ in range(n))
    what = rng.integers(8)
    if what < 2:
        name = pick_([word(3, 9), word(3, 8) + "." + word(3, 8), word(4, 8) + "." + num(2), word(2, 5) + "_" + word(3, 7)])
        host = ".".join([word(3, 9)] * 1 + [pick_(["com", "org", "net", "de", "example.com", "co.uk", "io"])])
        return 1, pick_([f"{name}@{host}"] * 5 + [f"{name} [at] {host}", f"{name} at {host}", f"{name}(at){host}"])
    if what == 2:
        return 2, ".".join(str(rng.integers(256)) for _ in range(4))
    if what == 3:
        d = pick_("3456") + num(14)
        d += next(x for x in "0123456789" if luhn(d + x))
        return 3, pick_([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])
    if what < 6:
        a, b, c = num(3), num(3), num(4)
        return 4, pick_([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+49 {a} {b}{c}", f"+{num(2)} {num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"00{num(2)} {a} {b}{c}"])
    hexes = "".join(pick_("0123456789abcdef") for _ in range(rng.integers(8, 41)))
    return 0, pick_([num(rng.integers(1, 7)), f"{num(2)}.{num(2)}.{num(4)}", f"v{num(1)}.{num(1)}.{num(2)}", hexes, f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)}.{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f'token = "{hexes}"', f"AKIA{num(8)}", f"{num(rng.integers(20, 30))}", "@" + word(3, 8), f"{num(2)}%", f"({num(1)})", f"+{num(2)}"])


def training_windows(texts: list[str], *, n: int = 2000, width: int = WIDTH, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts with planted data; base spans and planted ones are the labels."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["-"]
    x, y = np.full((n, width), PAD, np.uint8), np.zeros((n, width), np.int64)
    for k in range(n):
        t = texts[rng.integers(len(texts))]
        spans = base_spans(t) if len(t) < 20_000 else []
        if spans and rng.random() < 0.3:
            a = max(0, spans[rng.integers(len(spans))][0] - int(rng.integers(0, width)))
        else:
            a = int(rng.integers(0, max(1, len(t) - width)))
        s = t[a : a + width]
        tags = np.zeros(len(s), np.int64)
        for b, kind, e in base_spans(s):
            tags[b:e] = kind + 1
        for _ in range(2):
            if rng.random() < 0.6:
                tag, put = _planted(rng)
                at = int(rng.integers(0, max(1, len(s))))
                while at < len(s) and (tags[at] or s[at] != " " and rng.random() < 0.9):
                    at += 1
                s = f"{s[:at]} {put} {s[at:]}"
                tags = np.concatenate([tags[:at], [0], np.full(len(put), tag), [0], tags[at:]])
        if len(s) > width:
            cut = int(rng.integers(0, len(s) - width + 1))
            s, tags = s[cut : cut + width], tags[cut : cut + width]
        x[k, : len(s)], y[k, : len(s)] = codes(s), tags
    return x, y


# Use.


_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[a-z]{2,6}")


def plausible(kind: int, s: str) -> bool:
    """What a model span must hold to be reported."""
    d = _digits(s)
    if kind == 0:
        return bool(_WRITTEN.fullmatch(s))
    if kind == 1:
        return any(a == 0 and b == len(s) for a, b in addresses(s))
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 -]", s)
    return 10 <= len(d) <= 15 and not re.search(r"[^0-9+(). -]", s) and len(re.findall(r"[0-9]+", s)) >= 3


_TRIM = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.S)


class Finder:
    def __init__(self, model: Tagger, *, width: int = WIDTH, overlap: int = 32, group: int = 1024):
        self.model, self.width, self.overlap, self.group = model, width, overlap, group
        self.fade = np.minimum(np.arange(width) + 1, overlap).astype(np.float32) / np.float32(overlap + 1)

    def joined(self, texts: list[str]) -> dict[int, np.ndarray]:
        """Emissions of the texts that may hold more than outside; where no run of other tags can reach, outside is sure to lead.

        A run needs a place below the first bound and goes on below the second, so windows
        are kept from those with such a place on, as far as their own middles stay below.
        """
        step = self.width - self.overlap
        some, every = bounds(self.model.trans)
        all_codes = [codes(t) for t in texts]
        starts = [(i, a) for i, x in enumerate(all_codes) for a in range(0, max(1, len(x) - self.overlap), step) if len(x)]
        found: dict[int, np.ndarray] = {}  # emissions of windows that may be kept
        begins, passes = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        for g in range(0, len(starts), self.group):
            part = starts[g : g + self.group]
            x = np.full((len(part), self.width), PAD, np.uint8)
            for r, (i, a) in enumerate(part):
                c = all_codes[i][a : a + self.width]
                x[r, : len(c)] = c
            e = emissions(self.model, np.ascontiguousarray(x.T))
            lead = e[:, 0] - e[:, 1:].max(1)
            begins[g : g + len(part)] = lead.min(0) <= some
            passes[g : g + len(part)] = lead[self.overlap : self.width - self.overlap].max(0) <= every
            now = (begins | passes)[g : g + len(part)]
            near = now.copy()
            near[1:] |= now[:-1]
            near[:-1] |= now[1:]
            near[[0, -1]] = True  # windows beside those of another group
            found.update({g + int(r): e[:, :, r].copy() for r in np.nonzero(near)[0]})
        same = np.array([a[0] == b[0] for a, b in zip(starts, starts[1:], strict=False)], bool)  # with the next one, in one text
        keep, more = begins, begins
        while more.any():
            near = np.zeros(len(keep), bool)
            near[1:] |= more[:-1] & same
            near[:-1] |= more[1:] & same
            near &= ~keep
            keep, more = keep | near, near & passes
        out: dict[int, np.ndarray] = {}
        weight: dict[int, np.ndarray] = {}
        for w in np.nonzero(keep)[0]:
            e = found[int(w)]
            i, a = starts[w]
            n = len(all_codes[i])
            if i not in out:
                out[i], weight[i] = np.zeros((n, TAGS), np.float32), np.zeros(n, np.float32)
            b = min(n, a + self.width)
            fade = np.ones(b - a, np.float32)
            if a:
                fade = np.minimum(fade, self.fade[: b - a])
            if b < n:
                fade = np.minimum(fade, self.fade[::-1][: b - a])
            out[i][a:b] += e[: b - a] * fade[:, None]
            weight[i][a:b] += fade
        for i, e in out.items():
            e /= np.maximum(weight[i], 1e-9)[:, None]
            e[weight[i] == 0, 0] = 1e6
        return out

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """Tags of every character, each text decoded whole."""
        found = self.joined(texts)
        return [best_tags(found[i], self.model.trans) if i in found else np.zeros(len(t), np.int8) for i, t in enumerate(texts)]

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """Per text: base spans, and added spans, as (start, kind, end)."""
        out = []
        for t, tags in zip(texts, self.tags(texts), strict=True):
            base, added = base_spans(t), []
            if tags.any():
                cut = np.nonzero(np.diff(tags, prepend=0, append=0))[0]
                cut = [0, *(int(c) for c in cut), len(tags)]
                for a, b in zip(cut, cut[1:], strict=False):
                    if a < b and (k := int(tags[a])) and (m := _TRIM.search(t, a, b)) and plausible(k - 1, m[0]):
                        added.append((m.start(), k - 1, m.end()))
            taken = sorted((a, e) for a, _, e in base)
            good = []
            for a, k, e in sorted(added, key=lambda s: (s[0] - s[2], s)):
                if all(e <= x or y <= a for x, y in taken):
                    taken.append((a, e))
                    good.append((a, k, e))
            out.append((base, sorted(good)))
        return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in angle brackets; overlapping ones together, by the first's."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def fit(df: DataFrame, *, sample: int = 400, sample_chars: int = 20_000, **options) -> Tagger:
    """Train on a sample: the `sample` texts of least hash, among those of up to `sample_chars` characters."""
    rows = pick(df, doc_id="bigint", text="string").filter(F.length("text").between(1, sample_chars))
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Hashes first: texts of the chosen rows only go to the driver, at most sample * sample_chars characters.
    least = rows.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id", F.lit(21)), "doc_id", "h").limit(sample)
    least = least.withColumnsRenamed({"doc_id": "i", "h": "j"})
    chosen = rows.join(F.broadcast(least), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left_semi")
    one = chosen.groupBy("doc_id", "h").agg(F.min("text").alias("text"))
    texts = [r["text"] for r in one.orderBy(F.xxhash64("doc_id", F.lit(21)), "doc_id", "h").collect()]
    return train(*training_windows(texts), **options)


def find(df: DataFrame, model: Tagger) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Null texts count as empty: no span, the digest of the empty string. Texts are
    read whole whatever their length. Repeated rows each yield a row.
    """
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

    def run(batches):
        finder = Finder(model)
        for b in batches:
            for ids, texts in chunks(b.column(1), b.column(0)):
                found = finder.spans(texts)
                n = [[sum(k == j for _, k, _ in base) for base, _ in found] for j in range(len(KINDS))]
                cols = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in n), pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]), pa.array([listed(base + more) for base, more in found]), pa.array([len(more) for _, more in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    return pick(df, doc_id="bigint", text="string").mapInArrow(lean(run), schema)


def redact(df: DataFrame, model: Tagger) -> DataFrame:
    """The table with every span of `text` redacted, and `n_chars`, if it has that, set anew; null texts stay null."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    place, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        finder = Finder(model)
        for b in batches:
            at = 0
            for _, texts in chunks(b.column(place)):
                cols = [c.slice(at, len(texts)) for c in b.columns]
                was = cols[place].to_pylist()
                new = [None if o is None else redacted(t, base + more) for o, t, (base, more) in zip(was, texts, finder.spans(texts), strict=True)]
                cols[place] = pa.array(new, cols[place].type)
                if size is not None:
                    cols[size] = pa.array([None if t is None else len(t) for t in new], cols[size].type)
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return plain.mapInArrow(lean(run), plain.schema).toDF(*names)
