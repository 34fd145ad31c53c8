"""Components of near-equal classes by an inverted join over keys, without a hot task.

Documents with equal shingle sets form a class; classes are the nodes. Each class
posts itself under its keys (signature coordinates or bands with their values). Two
classes are candidates if at least `matches` keys agree; links are candidates whose
full sets reach the threshold.

Classes travel in packed batches. A batch asks buckets about its distinct keys and
gets numbers back (`exchange`), so a key that a third of all classes hold costs one
entry a batch, and no task sees a list whole. In this way:

* Prefix and skip merging: lists are counted. In the order from rare to frequent
  keys, two classes with `matches` keys in common share one within their first
  size - matches + 1. So each skips its most frequent lists, drops keys that it alone
  holds, and posts the rest; one with fewer shared keys than `matches` posts nothing.
* An exact bound: shingles of the posting classes are counted. Two classes have no
  more in common than either shares with any other, so a class that shares too few
  of its own for a link leaves.
* A star: every list names a pivot, the member that shares most; each member is
  tested against its lists' pivots, and what is linked is contracted.
* The rest: members of lists that still span components post their rarest shingles.
  Where a shingle's members lie in several components, those outside its largest one
  meet those of other components, in salted blocks, if the rest of both sets from
  that shingle on is enough for a link. So every link between different components
  is found, and links inside a component change nothing.

Tested pairs bring their sets together once a block of pairs, however many pairs of
the block want one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import WordHashes, Workspace, chunks, lean, many_shingles, mix, rows_of, words

#: Classes whose texts are fetched by a broadcast of their keys (16 bytes each); beyond, by a shuffle.
BROADCAST_KEYS = 200_000
#: Links (32 bytes each) that one task contracts; beyond, rounds of joins do.
ONE_TASK_LINKS = 2_000_000
#: A batch holds at most this many classes; a class's number is batch * CLASSES + place.
CLASSES = 1024
_SHIFT = 10
#: No id: above all others.
NONE = (1 << 63) - 1
#: Members of a shingle that one salt holds.
SALT_MEMBERS = 1024
LEAST_BUCKETS, BUCKET_KEYS = 128, 1_000_000


def lowered(text: str) -> str:
    """A-Z in lower case, all else unchanged: bytes.lower() knows ASCII only."""
    return text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")


@dataclass(frozen=True)
class Shingling:
    """How texts become sets: words a shingle, and whether A-Z count as a-z; what makes a class: equal sets or equal texts."""

    width: int
    lower: bool = True
    by_text: bool = False

    def of(self, texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Shingle hashes of all texts in a row, their counts, and the sorted distinct ones of each."""
        x, count = many_shingles([hashes.of(words(lowered(t) if self.lower else t)) for t in texts], self.width)
        ends = np.cumsum(count)
        return x, count, [np.unique(x[e - n : e]) for e, n in zip(ends, count, strict=True)]


    def classes(self, texts: list[str], sets: list[np.ndarray]) -> list[bytes | None]:
        return [class_of(np.frombuffer(t.encode(), np.uint8) if self.by_text else s) if len(s) else None for t, s in zip(texts, sets, strict=True)]


def class_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


# Packed rows: one binary column for each array of a batch.
_PACK = {"cls": "S16", "id": "<i8", "th": "<i8", "n": "<i8", "keys": "<u8"}
_POSTED = _PACK | {"posted": "<u8", "lists": "<i8"}
_HELD = {"c": "<i8", "id": "<i8", "n": "<i8", "keys": "<u8", "posted": "<u8", "lists": "<i8", "shingles": "<u8"}
_KNOWN = {"c": "<i8", "n": "<i8", "shared": "<i8", "posted": "<u8", "lists": "<i8", "prefix": "<u8", "pos": "<i8", "kept": "<i8"}


def _schema(kinds: dict, batch: str = "batch bigint, total bigint") -> str:
    return ", ".join([batch, *(f"{k} binary" for k in kinds)])


def _packed(batch: int, total: int, kinds: dict, values: dict) -> pa.RecordBatch:
    blobs = [values[k] if isinstance(values[k], bytes) else np.ascontiguousarray(values[k]).tobytes() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([int(total)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], ["batch", "total", *kinds])


def _open(row: dict, kinds: dict) -> dict:
    return {k: np.frombuffer(row[k], d) if d != "S16" else np.frombuffer(row[k], np.void(16).dtype) for k, d in kinds.items()}


def _buckets(packs: DataFrame) -> int:
    total = packs.agg(F.sum("total")).first()[0] or 0
    return max(LEAST_BUCKETS, total // BUCKET_KEYS)


class _Packer:
    """Collects rows of classes into batches with numbers of their own, bounded in rows and shingles."""

    def __init__(self, kinds: dict, most: int = 150_000):
        from pyspark import TaskContext

        self.kinds, self.most, self.next = kinds, most, TaskContext.get().partitionId() << 22
        self.clear()

    def clear(self):
        self.parts, self.rows, self.shingles, self.total = {k: [] for k in self.kinds}, 0, 0, 0

    def add(self, values: dict, shingles: int, total: int):
        for k in self.kinds:
            self.parts[k].append(values[k])
        self.rows, self.shingles, self.total = self.rows + 1, self.shingles + shingles, self.total + total

    def full(self) -> bool:
        return self.rows == CLASSES or self.shingles >= self.most

    def done(self):
        if self.rows:
            yield _packed(self.next, self.total, self.kinds, {k: b"".join(v) for k, v in self.parts.items()})
            self.next += 1
            self.clear()


def _pack_classes(signed: DataFrame, size: int) -> DataFrame:
    """Classes of the signed rows (doc_id, th, n_shingles, cls, keys), packed; the least doc_id stands for a class."""
    rep = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(NONE)).alias("id"), "th")
    classes = signed.filter("cls is not null").groupBy("cls").agg(F.min(rep).alias("rep"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = classes.select("cls", "rep.id", "rep.th", "n", "keys")

    def run(batches):
        p = _Packer(_PACK)
        for b in batches:
            ids, th, n = (b.column(i).to_numpy() for i in (1, 2, 3))
            keys = b.column(4).flatten().to_numpy().reshape(-1, size)
            for i, cls in enumerate(b.column(0).to_pylist()):
                p.add({"cls": cls, "id": ids[i].tobytes(), "th": th[i].tobytes(), "n": n[i].tobytes(), "keys": keys[i].tobytes()}, int(n[i]), size)
                if p.full():
                    yield from p.done()
        yield from p.done()

    return classes.mapInArrow(lean(run), _schema(_PACK))


def _sum_counts(keys, payload):
    sizes, all_keys, count = exchange.joined(keys, payload, "<u4")
    _, place = np.unique(all_keys, return_inverse=True)
    total = np.bincount(place, weights=count)
    return sizes, np.minimum(total, 0xFFFFFFFF).astype("<u4")[place]


def _sender(made):
    """Packets of every packed row; `made` yields (keys, payload) of one."""

    def run(batches):
        yield from exchange.emit(p for r in rows_of(batches) for p in made(r))

    return lean(run)


def _post(packs: DataFrame, size: int, matches: int) -> DataFrame:
    """Packed classes in play, with the keys they post, rare ones first."""
    buckets = _buckets(packs)

    def made(r):
        keys, count = np.unique(np.frombuffer(r["keys"], np.uint64), return_counts=True)
        yield from exchange.packets(r["batch"], keys, count.astype("<u4"), buckets)

    answers = exchange.ask(packs.select("batch", "keys").mapInArrow(_sender(made), exchange.PACKET), _sum_counts)

    def run(batches):
        p = _Packer(_POSTED)
        for r in rows_of(batches):
            x = _open(r, _PACK)
            own, place = np.unique(x["keys"], return_inverse=True)
            often = exchange.values(r["answers"], own, buckets, "<u4")[place].reshape(-1, size).astype(np.int64)
            keys = x["keys"].reshape(-1, size)
            often[often < 2] = 1 << 40  # held by this class alone
            order = np.lexsort((keys, often), axis=-1)
            left = (often < 1 << 40).sum(axis=1) - (matches - 1)
            for i in np.nonzero(left > 0)[0]:
                post = keys[i][order[i, : left[i]]]
                values = {k: x[k][i].tobytes() for k in ("cls", "id", "th", "n")}
                p.add(values | {"keys": keys[i].tobytes(), "posted": post.tobytes(), "lists": np.int64(left[i]).tobytes()}, int(x["n"][i]), int(left[i]))
                if p.full():
                    yield from p.done()
        yield from p.done()

    return packs.join(answers, "batch").mapInArrow(lean(run), _schema(_POSTED))


def _hold(posted: DataFrame, rows: DataFrame, shingling: Shingling) -> DataFrame:
    """The packed classes in play with their full sets, each from the row that stands for its class."""

    def flat(batches):
        for r in rows_of(batches):
            x = _open(r, {"id": "<i8", "th": "<i8"})
            yield pa.RecordBatch.from_arrays([pa.array((r["batch"] << _SHIFT) + np.arange(len(x["id"]))), pa.array(x["id"]), pa.array(x["th"])], ["c", "_id", "_th"])

    need = posted.select("batch", "id", "th").mapInArrow(lean(flat), "c bigint, _id bigint, _th bigint")
    few = need.count() <= BROADCAST_KEYS
    texts = rows.select(F.coalesce("doc_id", F.lit(NONE)).alias("_id"), text_hash(F.col("text")).alias("_th"), "text")
    asked = texts.join(F.broadcast(need) if few else need, ["_id", "_th"]).select("c", "text")

    def sets(batches):
        hashes = WordHashes()
        for b in batches:
            for c, texts in chunks(b.column(1), b.column(0)):
                found = shingling.of(texts, hashes)[2]
                yield pa.RecordBatch.from_arrays([pa.array([v >> _SHIFT for v in c], pa.int64()), pa.array(c, pa.int64()), pa.array(shingling.classes(texts, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["batch", "c", "cls", "shingles"])

    made = asked.mapInArrow(lean(sets), "batch bigint, c bigint, cls binary, shingles binary")

    def meet(packs: pa.Table, sets: pa.Table) -> pa.Table:
        r = packs.to_pylist()[0]
        c = (r["batch"] << _SHIFT) + np.arange(len(r["id"]) // 8)
        held = {v: s for v, k, s in zip(*(sets.column(x).to_pylist() for x in ("c", "cls", "shingles")), strict=True) if k == r["cls"][16 * (v % CLASSES) : 16 * (v % CLASSES) + 16]}
        found = [held[v] for v in c.tolist()]
        out = {"c": c, "n": np.array([len(s) // 8 for s in found], "<i8"), "shingles": b"".join(found)} | {k: r[k] for k in ("id", "keys", "posted", "lists")}
        return pa.Table.from_batches([_packed(r["batch"], len(out["shingles"]) // 8, _HELD, out)])

    kinds = ("batch", "id", "cls", "keys", "posted", "lists")
    return posted.select(*kinds).groupBy("batch").cogroup(made.groupBy("batch")).applyInArrow(meet, _schema(_HELD))


def _know(held: DataFrame, percent: int) -> DataFrame:
    """Classes that share enough of their shingles for a link, with their rarest ones.

    `prefix` has the shingles, from rare to frequent over all of `held`, at places
    `pos` up to n - ceil(n * percent / 100), without those that no other class holds.
    """
    buckets = _buckets(held)

    def made(r):
        keys, count = np.unique(np.frombuffer(r["shingles"], np.uint64), return_counts=True)
        yield from exchange.packets(r["batch"], keys, count.astype("<u4"), buckets)

    answers = exchange.ask(held.select("batch", "shingles").mapInArrow(_sender(made), exchange.PACKET), _sum_counts)

    def run(batches):
        for r in rows_of(batches):
            x = _open(r, _HELD)
            own, place = np.unique(x["shingles"], return_inverse=True)
            often = exchange.values(r["answers"], own, buckets, "<u4")[place]
            owner = np.repeat(np.arange(len(x["n"])), x["n"])
            first = np.cumsum(x["n"]) - x["n"]
            shared = np.bincount(owner[often > 1], minlength=len(x["n"]))
            keep = 100 * shared >= percent * x["n"]
            order = np.lexsort((x["shingles"], often, owner))
            pos = np.arange(len(order)) - first[owner]
            last = x["n"] - -(-x["n"] * percent // 100)  # the last place from which enough may follow
            take = (often[order] > 1) & (pos <= last[owner]) & keep[owner]
            lists = np.repeat(keep, x["lists"])
            out = {"c": x["c"][keep], "n": x["n"][keep], "shared": shared[keep].astype("<i8"), "posted": x["posted"][lists], "lists": x["lists"][keep]}
            out |= {"prefix": x["shingles"][order][take], "pos": pos[take], "kept": np.bincount(owner[take], minlength=len(keep))[keep].astype("<i8")}
            if keep.any():
                yield _packed(r["batch"], len(out["posted"]), _KNOWN, out)

    kinds = ("batch", "n", "c", "id", "keys", "posted", "lists", "shingles")
    return held.select(*kinds).join(answers, "batch").mapInArrow(lean(run), _schema(_KNOWN))


_PIVOT = np.dtype([("order", "<u8"), ("c", "<i8"), ("n", "<i8"), ("shared", "<i8")])


def _least_pivot(keys, payload):
    sizes, all_keys, found = exchange.joined(keys, payload, _PIVOT)
    order = np.lexsort((found["c"], found["order"], all_keys))
    first = np.concatenate([[True], all_keys[order][1:] != all_keys[order][:-1]])
    best = order[first]
    return sizes, found[best][np.searchsorted(all_keys[best], all_keys)]


ASKED = "g bigint, a bigint, b bigint"


def _star(known: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, a, b) of classes and their lists' pivots; rows without b name the sets that block g wants."""
    buckets = _buckets(known)

    def spread(r):
        x = _open(r, _KNOWN)
        return x, np.repeat(np.arange(len(x["c"])), x["lists"])

    def made(r):
        x, owner = spread(r)
        rank = (x["n"] - x["shared"]).astype(np.uint64) << np.uint64(32)
        out = np.empty(len(owner), _PIVOT)
        out["order"] = (rank | (_mixed(x["c"]) >> np.uint64(32)))[owner]
        for k in ("c", "n", "shared"):
            out[k] = x[k][owner]
        order = np.lexsort((out["c"], out["order"], x["posted"]))
        keys = x["posted"][order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        yield from exchange.packets(r["batch"], keys[first], out[order][first], buckets)

    answers = exchange.ask(known.mapInArrow(_sender(made), exchange.PACKET), _least_pivot)

    def run(batches):
        for r in rows_of(batches):
            x, owner = spread(r)
            own, place = np.unique(x["posted"], return_inverse=True)
            p = exchange.values(r["answers"], own, buckets, _PIVOT)[place]
            a = x["c"][owner]
            ok = (a != p["c"]) & ((100 + percent) * np.minimum(x["shared"][owner], p["shared"]) >= percent * (x["n"][owner] + p["n"]))
            pairs = np.unique(np.stack([a[ok], p["c"][ok]], 1), axis=0) if ok.any() else np.empty((0, 2), np.int64)
            wants = np.unique(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wants) + len(pairs), r["batch"])), pa.array(np.concatenate([wants, pairs[:, 0]])), pa.array([None] * len(wants) + pairs[:, 1].tolist(), pa.int64())], ["g", "a", "b"])

    return known.join(answers, "batch").mapInArrow(lean(run), ASKED)


def _mixed(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Forest:
    """Union-find over few nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int):
        self.up[max(a, b)] = min(a, b)


LINKS = "links bigint, edges binary"


def _verified(asked: DataFrame, held: DataFrame, percent: int, matches: int) -> DataFrame:
    """Packed links (a, b, id of a, id of b) of the asked pairs that hold; in each block only those that join components."""

    def flat(batches):
        for r in rows_of(batches):
            x = _open(r, {k: _HELD[k] for k in ("c", "id", "n", "keys")})
            ends, size = np.cumsum(x["n"]) * 8, len(r["keys"]) // max(1, len(x["c"]))
            blobs = [r["shingles"][e - 8 * n : e] for e, n in zip(ends.tolist(), x["n"].tolist(), strict=True)]
            for a in range(0, len(blobs), 128):
                part = slice(a, a + 128)
                yield pa.RecordBatch.from_arrays([pa.array(x["c"][part]), pa.array(x["id"][part]), pa.array([r["keys"][i * size : (i + 1) * size] for i in range(a, min(a + 128, len(blobs)))], pa.binary()), pa.array(blobs[part], pa.binary())], ["a", "id", "keys", "shingles"])

    sets = held.select("c", "id", "n", "keys", "shingles").mapInArrow(lean(flat), "a bigint, id bigint, keys binary, shingles binary")
    wants = asked.filter("b is null").select("g", "a").join(sets, "a").select("g", F.lit(None).cast("bigint").alias("b"), "a", "id", "keys", "shingles")
    none = F.lit(None)
    pairs = asked.filter("b is not null").select("g", "b", "a", none.cast("bigint").alias("id"), none.cast("binary").alias("keys"), none.cast("binary").alias("shingles"))
    met = wants.unionAll(pairs).repartition("g").sortWithinPartitions("g", F.col("b").asc_nulls_first(), "a")

    def run(batches):
        at, sets, forest, found = None, {}, _Forest(), []

        def out():
            e = np.array(found, "<i8").reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array([len(e)], pa.int64()), pa.array([e.tobytes()], pa.binary())], ["links", "edges"])

        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                for r in batch.slice(s, 256).to_pylist():
                    if r["g"] != at:
                        at, sets, forest = r["g"], {}, _Forest()
                        if len(found) > 4096:
                            yield out()
                            found = []
                    a, b = r["a"], r["b"]
                    if b is None:
                        sets[a] = r["id"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["shingles"], np.uint64)
                        continue
                    (id_a, k_a, s_a), (id_b, k_b, s_b) = sets[a], sets[b]
                    p, q = forest.root(a), forest.root(b)
                    if p == q or (k_a == k_b).sum() < matches or 100 * min(len(s_a), len(s_b)) < percent * max(len(s_a), len(s_b)):
                        continue
                    both = np.concatenate([s_a, s_b])
                    both.sort()
                    both = int((both[1:] == both[:-1]).sum())
                    if 100 * both >= percent * (len(s_a) + len(s_b) - both):
                        forest.join(p, q)
                        found.append((a, b, id_a, id_b))
        if found:
            yield out()

    return met.mapInArrow(lean(run), LINKS)


ROOTS = "batch bigint, nodes binary, roots binary, ids binary"


def _contract(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of links (a, b, id, id), their components' least nodes, and those components' least ids."""
    nodes, place = np.unique(e[:, :2], return_inverse=True)
    a, b = place.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    least = np.full(len(nodes), NONE, np.int64)
    np.minimum.at(least, label[a], e[:, 2])
    np.minimum.at(least, label[b], e[:, 3])
    return nodes, nodes[label], least[label]


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Packed by batch: each linked node, its component's name and least id."""
    total = links.agg(F.sum("links")).first()[0] or 0
    if total <= ONE_TASK_LINKS:

        def run(batches):
            parts = [np.frombuffer(x, "<i8").reshape(-1, 4) for b in batches for x in b.column(0).to_pylist()]
            if parts:
                nodes, roots, ids = _contract(np.concatenate(parts))
                cut = np.nonzero(np.diff(nodes >> _SHIFT, prepend=-1))[0]
                for a, b in zip(cut, [*cut[1:], len(nodes)], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([int(nodes[a]) >> _SHIFT], pa.int64()), *(pa.array([x[a:b].tobytes()], pa.binary()) for x in (nodes, roots, ids))], ["batch", "nodes", "roots", "ids"])

        return ws.write(links.select("edges").coalesce(1).mapInArrow(lean(run), ROOTS), name)

    def flat(batches):
        for r in rows_of(batches):
            e = np.frombuffer(r["edges"], "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, i].copy()) for i in range(4)], ["a", "b", "id_a", "id_b"])

    edges = ws.write(links.mapInArrow(lean(flat), "a bigint, b bigint, id_a bigint, id_b bigint"), f"{name}_edges")
    rooted = _least_labels(edges, ws, name)
    ids = edges.select(F.col("a").alias("node"), F.col("id_a").alias("id")).unionAll(edges.select("b", "id_b")).distinct()
    least = ids.join(rooted, "node").groupBy("root").agg(F.min("id").alias("id"))
    packed = rooted.join(least, "root").groupBy(F.shiftright("node", _SHIFT).alias("batch")).agg(F.collect_list(F.struct("node", "root", "id")).alias("x"))

    def pack(batches):
        for r in rows_of(batches):
            cols = [np.array([y[k] for y in r["x"]], "<i8").tobytes() for k in ("node", "root", "id")]
            yield pa.RecordBatch.from_arrays([pa.array([r["batch"]], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], ["batch", "nodes", "roots", "ids"])

    return ws.write(packed.mapInArrow(lean(pack), ROOTS), name)


def _least_labels(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, root for every node of the edges (a, b): least labels, with pointer jumping, to a fixed point."""
    both = ws.write(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_both")
    now = ws.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), f"{name}_0")
    step = 0
    while True:
        heard = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        least = now.join(heard, "node", "left").select("node", F.least("root", "heard").alias("root"))
        jump = now.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = least.join(jump, "root", "left").select("node", F.least("root", "further").alias("root"))
        step += 1
        after = ws.write(after, f"{name}_{step}")
        changed = after.withColumnRenamed("root", "was").join(now, "node").filter("was != root").limit(1).count()
        ws.drop(f"{name}_{step - 1}")
        now = after
        if not changed:
            ws.drop(f"{name}_both")
            return now


_ROOTED = {"c": "<i8", "n": "<i8", "root": "<i8", "posted": "<u8", "lists": "<i8", "prefix": "<u8", "pos": "<i8", "kept": "<i8"}
_SPAN = np.dtype([("low", "<i8"), ("high", "<i8")])


def _rooted(known: DataFrame, roots: DataFrame) -> DataFrame:
    def run(batches):
        for r in rows_of(batches):
            x = _open(r, {k: v for k, v in _KNOWN.items() if k != "shared"})
            root = x["c"].copy()
            if r["nodes"] is not None:
                nodes = np.frombuffer(r["nodes"], "<i8")
                order = np.argsort(nodes)
                at = np.minimum(np.searchsorted(nodes[order], root), len(nodes) - 1)
                root = np.where(nodes[order][at] == root, np.frombuffer(r["roots"], "<i8")[order][at], root)
            yield _packed(r["batch"], len(x["posted"]), _ROOTED, {k: r[k] for k in _ROOTED if k != "root"} | {"root": root})

    kinds = ("batch", "c", "n", "posted", "lists", "prefix", "pos", "kept")
    return known.select(*kinds).join(roots.select("batch", "nodes", "roots"), "batch", "left").mapInArrow(lean(run), _schema(_ROOTED))


def _spans(keys, payload):
    """Whether a list spans components."""
    sizes, all_keys, span = exchange.joined(keys, payload, _SPAN)
    _, place = np.unique(all_keys, return_inverse=True)
    low, high = np.full(place.max() + 1, NONE), np.full(place.max() + 1, -1)
    np.minimum.at(low, place, span["low"])
    np.maximum.at(high, place, span["high"])
    return sizes, (low != high)[place]


def _still_open(rooted: DataFrame) -> DataFrame:
    """Classes in a list that spans components."""
    buckets = _buckets(rooted)

    def made(r):
        posted, root = np.frombuffer(r["posted"], np.uint64), np.repeat(np.frombuffer(r["root"], "<i8"), np.frombuffer(r["lists"], "<i8"))
        keys, place = np.unique(posted, return_inverse=True)
        span = np.empty(len(keys), _SPAN)
        span["low"], span["high"] = NONE, -1
        np.minimum.at(span["low"], place, root)
        np.maximum.at(span["high"], place, root)
        yield from exchange.packets(r["batch"], keys, span, buckets)

    answers = exchange.ask(rooted.select("batch", "posted", "root", "lists").mapInArrow(_sender(made), exchange.PACKET), _spans)

    def run(batches):
        for r in rows_of(batches):
            x = _open(r, _ROOTED)
            own, place = np.unique(x["posted"], return_inverse=True)
            wide = exchange.bits(r["answers"], own, buckets)[place]
            keep = np.bincount(np.repeat(np.arange(len(x["c"])), x["lists"])[wide], minlength=len(x["c"])) > 0
            if keep.any():
                took = np.repeat(keep, x["kept"])
                out = {k: x[k][keep] for k in ("c", "n", "root", "kept")} | {"prefix": x["prefix"][took], "pos": x["pos"][took], "posted": b"", "lists": b""}
                yield _packed(r["batch"], len(out["prefix"]), _ROOTED, out)

    return rooted.join(answers, "batch").mapInArrow(lean(run), _schema(_ROOTED))


_MAIN = np.dtype([("main", "<i8"), ("members", "<i8")])


def _main_roots(keys, payload):
    """For each shingle the component with most of its members, and their number; none where there is but one component."""
    sizes, v, found = exchange.joined(keys, payload, _MAIN)  # here: a component, and its members in the batch
    order = np.lexsort((found["main"], v))
    v_, root, members = v[order], found["main"][order], found["members"][order]
    new = np.concatenate([[True], (v_[1:] != v_[:-1]) | (root[1:] != root[:-1])])
    held = np.bincount(np.cumsum(new) - 1, weights=members).astype(np.int64)
    v_, root = v_[new], root[new]
    best = np.lexsort((root, -held, v_))
    first = np.concatenate([[True], v_[best][1:] != v_[best][:-1]])
    different, place, parts = np.unique(v_, return_inverse=True, return_counts=True)
    out = np.empty(len(different), _MAIN)
    out["main"], out["members"] = root[best][first], np.where(parts > 1, np.bincount(place, weights=held).astype(np.int64), 0)
    return sizes, out[np.searchsorted(different, v)]


READY = "v bigint, salt bigint, outside boolean, c bigint, root bigint, main bigint, n bigint, pos bigint"


def _settle(opened: DataFrame) -> DataFrame:
    """Members of the shingles that span components: once under a salt, and those outside the main one under every salt."""
    buckets = _buckets(opened)

    def spread(r):
        x = _open(r, {k: v for k, v in _ROOTED.items() if k not in ("posted", "lists")})
        owner = np.repeat(np.arange(len(x["c"])), x["kept"])
        order = np.lexsort((x["root"][owner], x["prefix"]))
        v, root = x["prefix"][order], x["root"][owner][order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (root[1:] != root[:-1])])
        return x, owner[order], x["pos"][order], v, root, new

    def made(r):
        _, _, _, v, root, new = spread(r)
        out = np.empty(int(new.sum()), _MAIN)
        out["main"], out["members"] = root[new], np.bincount(np.cumsum(new) - 1)
        yield from exchange.packets(r["batch"], v[new], out, buckets)

    answers = exchange.ask(opened.filter("total > 0").mapInArrow(_sender(made), exchange.PACKET), _main_roots)

    def run(batches):
        for r in rows_of(batches):
            x, owner, pos, v, root, new = spread(r)
            m = exchange.values(r["answers"], v[new], buckets, _MAIN)[np.cumsum(new) - 1]
            salts = -(-m["members"] // SALT_MEMBERS)
            own = np.nonzero(m["members"])[0]
            out = own[root[own] != m["main"][own]]
            copies = np.repeat(out, salts[out])
            at = np.concatenate([own, copies])
            salt = np.concatenate([(_mixed(x["c"][owner[own]]) >> np.uint64(1)).astype(np.int64) % np.maximum(salts[own], 1), np.arange(len(copies)) - np.repeat(np.cumsum(salts[out]) - salts[out], salts[out])])
            for a in range(0, len(at), 50_000):
                i, part = at[a : a + 50_000], slice(a, a + 50_000)
                cols = [v[i].view(np.int64), salt[part], np.arange(len(at))[part] >= len(own), x["c"][owner[i]], root[i], m["main"][i].copy(), x["n"][owner[i]], pos[i]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in READY.split(", ")])

    return opened.filter("total > 0").join(answers, "batch").mapInArrow(lean(run), READY)


def _rest(ready: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be linked, by blocks of both sides' batches."""
    x = ready.filter("outside").select("v", "salt", *[F.col(c).alias(f"{c}_a") for c in ("c", "root", "n", "pos")])
    y = ready.filter("not outside").select("v", "salt", "main", *[F.col(c).alias(f"{c}_b") for c in ("c", "root", "n", "pos")])
    once = (F.col("root_b") == F.col("main")) | (F.col("c_a") < F.col("c_b"))
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    fits = (100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = x.join(y, ["v", "salt"]).filter((F.col("root_a") != F.col("root_b")) & once & fits).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    return pairs.distinct().select(F.xxhash64(F.shiftright("a", _SHIFT), F.shiftright("b", _SHIFT)).alias("g"), "a", "b")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionAll(x)
    return out


def class_components(rows: DataFrame, signed: DataFrame, ws: Workspace, shingling: Shingling, *, size: int, matches: int, percent: int) -> DataFrame:
    """cls, component_id: for every class of the signed rows the least doc_id that links reach.

    rows: doc_id, text (not null). signed: doc_id, th (`text_hash`), n_shingles (as many
    or more), cls (null without shingles), keys (`size` hashes). The id is null where no linked row
    has one. Tables of the workspace are dropped as soon as nothing reads them.
    """
    packs = ws.write(_pack_classes(signed, size), "packs")
    posted = ws.write(_post(packs, size, matches), "posted")
    held = ws.write(_hold(posted, rows, shingling), "held")
    known = ws.write(_know(held, percent), "known")
    asked = ws.write(_star(known, percent), "asked")
    links = [ws.write(_verified(asked, held, percent, matches), "links")]
    roots = components(links[0], ws, "roots")
    rooted = ws.write(_rooted(known, roots), "rooted")
    ws.drop("asked", "known")
    opened = ws.write(_still_open(rooted), "opened")
    ws.drop("rooted")
    if opened.limit(1).count():
        ready = ws.write(_settle(opened), "ready")
        pairs = ws.write(_rest(ready, percent), "pairs")
        if pairs.limit(1).count():
            wants = pairs.select("g", "a").unionAll(pairs.select("g", "b")).distinct().select("g", "a", F.lit(None).cast("bigint").alias("b"))
            links.append(ws.write(_verified(pairs.unionAll(wants), held, percent, matches), "more_links"))
            roots = components(_union(links), ws, "all_roots")
        ws.drop("ready", "pairs")
    ws.drop("held", "opened")

    def named(batches):
        for r in rows_of(batches):
            nodes, ids = np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["ids"], "<i8")
            cls = [r["cls"][16 * i : 16 * i + 16] for i in (nodes & (CLASSES - 1)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(ids)], ["cls", "linked"])

    def alone(batches):
        for r in rows_of(batches):
            ids = np.frombuffer(r["id"], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([r["cls"][16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary()), pa.array(ids)], ["cls", "id"])

    linked = posted.select("batch", "cls").join(roots.select("batch", "nodes", "ids"), "batch").mapInArrow(lean(named), "cls binary, linked bigint")
    every = packs.select("cls", "id").mapInArrow(lean(alone), "cls binary, id bigint")
    both = every.join(linked, "cls", "left").select("cls", F.nullif(F.coalesce("linked", "id"), F.lit(NONE)).alias("component_id"))
    out = ws.write(both, "ids")
    ws.drop("packs", "posted", "links", "more_links", "roots", "all_roots")
    return out
