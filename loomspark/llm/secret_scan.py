"""Secret scans with linking of multipart credentials, in DataFrame functions only.

Base spans come from three patterns. Weak candidates (user names, short or
opaque values, endpoints) are interval-joined with the parts around them, inside
one document: one is reported only where complementary parts of a credential
stand within `scope` characters of it. The patterns run once over each text; spans
alone are written, and joined on (row, bucket of places): a span stands in every
bucket that it, or a candidate's scope, reaches. So the join is linear in the spans,
and a text with very many of them is dealt over many tasks.

Defined results: a null text counts as empty; a text without match yields counts
of 0, the digest of the empty string and an empty span list; repeated rows each
yield their row; an empty table yields no row; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pick

# The patterns of the scan.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
USER = r"""(?i:(user|username|login|client_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
OPAQUE = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"[a-z]{2,8}://[A-Za-z0-9.:/_-]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_SHORT = 12, 18, 6

#: kind -> (rank among spans that start together, part of a credential, strong)
KINDS = {"assign": (0, "secret", True), "access": (1, "identifier", True), "hex": (2, "secret", True), "user": (3, "identifier", False), "short": (4, "secret", False), "opaque": (5, "secret", False), "endpoint": (6, "endpoint", False)}
_SPAN = "array<struct<s:int,k:int,e:int>>"
_BLOCK = 64


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _blocks(xs: Column) -> Column:
    """Sums of runs of 64 values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: _sum(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))


def _running(lens: Column) -> Column:
    """Running sums of an int array, by sums of blocks and of blocks of blocks: about 200 additions a value up to a million values."""

    def part(i: Column, size: int) -> Column:
        return F.floor(i / size).cast("int")

    def sums(xs: Column, small: Column, large: Column) -> Column:
        big = _BLOCK * _BLOCK
        return F.transform(xs, lambda x, i: _sum(F.slice(large, F.lit(1), part(i, big))) + _sum(F.slice(small, part(i, big) * _BLOCK + 1, part(i, _BLOCK) - part(i, big) * _BLOCK)) + _sum(F.slice(xs, part(i, _BLOCK) * _BLOCK + 1, i % _BLOCK + 1)))

    return _let(lens, lambda xs: _let(_blocks(xs), lambda small: _let(_blocks(small), lambda large: sums(xs, small, large))))


def _found(df: DataFrame, name: str, pattern: str, value_group: int | None = None, when: Column | None = None) -> DataFrame:
    """Adds `name`: array of (s, e, v): code points, end exclusive, and the length of the value group.

    Matches and the text between them come from the same regex engine; running
    sums of their lengths are the places.
    """
    has = F.col("text").rlike(pattern)
    has = when & has if when is not None else has
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("_g", F.when(F.col("_m").isNotNull(), F.split("text", pattern, -1)))
    if value_group is not None:
        df = df.withColumn("_v", F.when(F.col("_m").isNotNull(), F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(value_group)), lambda x: F.length(x))))
    df = df.withColumn("_m", F.transform("_m", lambda x: F.length(x)))
    df = df.withColumn("_g", F.transform(F.slice("_g", F.lit(1), F.size("_m")), lambda x, i: F.length(x) + F.when(i > 0, F.element_at("_m", i)).otherwise(0)))
    df = df.withColumn("_s", _running(F.col("_g")))
    value = (lambda i: F.get("_v", i)) if value_group is not None else (lambda i: F.get("_m", i))
    spans = F.transform("_s", lambda s, i: F.struct(s.alias("s"), (s + F.get("_m", i)).alias("e"), value(i).alias("v")))
    return df.withColumn(name, F.coalesce(spans, F.array().cast("array<struct<s:int,e:int,v:int>>"))).drop("_m", "_g", "_s", "_v")


def _kind(name: str, spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS[kind][0]).alias("k"), x["e"].alias("e"))).cast(_SPAN)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def _spans(found: DataFrame, name: str) -> DataFrame:
    part = F.array(*[F.lit({"identifier": 1, "secret": 2, "endpoint": 4}[p]) for _, p, _ in KINDS.values()])
    return found.select("row", F.explode(name).alias("x")).select("row", "x.s", "x.k", "x.e", F.get(part, F.col("x.k")).alias("part"))


def _met(weak: DataFrame, other: DataFrame, scope: int) -> DataFrame:
    """Each weak span beside the other spans of its row within its scope; a pair may stand in two buckets."""
    width = 4 * scope + 1
    bucket = lambda c: F.floor(c / width)
    w = weak.withColumn("bucket", F.explode(F.sequence(bucket(F.col("s") - scope), bucket(F.col("e") + scope))))
    x = other.select("row", *[F.col(c).alias(f"x_{c}") for c in ("s", "e", "part")])
    x = x.withColumn("bucket", F.explode(F.sequence(bucket(F.col("x_s")), bucket(F.col("x_e")))))
    near = (F.col("x_s") - F.col("e") <= scope) & (F.col("s") - F.col("x_e") <= scope)
    return w.join(x, ["row", "bucket"]).filter(near)


def scan(df: DataFrame, ws: Workspace, *, scope: int = 200) -> DataFrame:
    """Per row: doc_id, base and linked spans as arrays of (s, k, e), sorted by start, then kind.

    `scope`: most characters between a weak candidate and the parts that back it.
    A weak candidate that touches no base span is reported if a strong span of
    another part lies in its scope, or if both other parts lie there, weak or strong.
    """
    df = pick(df, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    df = _found(df, "_assign", ASSIGN, 2)
    df = _found(df, "_access", ACCESS)
    df = _found(df, "_hex", HEX)
    base = F.concat(
        _kind("s", F.filter("_assign", lambda x: x["v"] >= LEAST_VALUE), "assign"),
        _kind("s", F.filter("_access", lambda x: x["v"] >= LEAST_ACCESS), "access"),
        _kind("s", F.col("_hex"), "hex"),
    )
    df = df.withColumn("base", F.array_sort(base))
    likely = (F.size("base") > 0) | F.col("text").contains("://")
    df = _found(df, "_user", USER, 2, likely)
    df = _found(df, "_opaque", OPAQUE, None, likely)
    df = _found(df, "_endpoint", ENDPOINT, None, likely)
    weak = F.concat(
        _kind("s", F.col("_user"), "user"),
        _kind("s", F.filter("_assign", lambda x: (x["v"] < LEAST_VALUE) & (x["v"] >= LEAST_SHORT)), "short"),
        _kind("s", F.col("_opaque"), "opaque"),
        _kind("s", F.col("_endpoint"), "endpoint"),
    )
    found = ws.write(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", weak.alias("weak")), "found")

    asked = found.filter(F.size("weak") > 0)
    keys = ["row", "s", "k", "e", "part"]
    every, strong = _spans(asked, "weak"), _spans(asked, "base")
    touches = (F.col("x_s") < F.col("e")) & (F.col("s") < F.col("x_e"))
    other = F.when(F.col("x_part") != F.col("part"), F.col("x_part")).otherwise(0)
    backing = _met(every, strong, scope).groupBy(*keys).agg(F.max(touches).alias("touches"), F.bit_or(other).alias("parts"))
    # base spans are the strong ones: one of another part is enough
    weak = every.join(backing, keys, "left").filter(~F.coalesce("touches", F.lit(False))).select(*keys, F.coalesce("parts", F.lit(0)).alias("parts"))
    weak = ws.write(weak, "weak")
    pairs = _met(weak.filter("parts = 0"), weak, scope).groupBy(*keys).agg(F.bit_or(other).alias("parts"))
    linked = weak.filter("parts > 0").select(*keys).unionAll(pairs.filter(F.bit_count("parts") >= 2).select(*keys))
    linked = linked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("linked"))
    none = F.array().cast(_SPAN)
    beside = asked.join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))
    return beside.unionAll(found.filter(F.size("weak") == 0).select("doc_id", "base", none.alias("linked")))


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS[k][0])).cast("bigint")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"),
    )
