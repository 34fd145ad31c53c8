"""What the operators share: column choice, written tables, word rules, hashing.

Column choice is by position, so a table may hold further columns whose names
clash with ours, in any case. Missing columns raise at once.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import ship

#: Words are maximal runs of anything but these six characters.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD_PATTERN).findall
#: Blanks at which str.split() would split as well.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

#: Aim for this many characters of text in one numpy working set.
CHUNK_CHARS = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, and let Arrow batches hold 1,000 rows unless the session says otherwise than the default.

    Documents are long: the default of 10,000 rows makes batches of 30 MB and more, several of which
    a task holds at once on either side.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
    return ship(spark)


def lean(run, least: int = 8 << 20):
    """A function over batches that hands free memory back to the system when it ends; workers live on.

    Tasks that read less than `least` bytes leave too little behind to be worth it.
    """

    def lean_run(batches):
        read = 0

        def counted():
            nonlocal read
            for b in batches:
                read += b.nbytes
                yield b

        try:
            yield from run(counted())
        finally:
            if read >= least:
                import ctypes
                import gc

                gc.collect()
                pa.default_memory_pool().release_unused()
                if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                    libc.malloc_trim(0)

    return lean_run


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; other columns, whatever their names, are left out."""
    names = df.columns
    places = {c: names.index(c) for c in kinds}
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{i}").cast(kinds[c]).alias(c) for c, i in places.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[str]:
    return _WORDS(text) if _OTHER_BLANK(text) else text.split()


def chunks(texts: pa.Array, ids: pa.Array | None = None, size: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Rows of Arrow columns in runs of about `size` characters, few rows open at a time; null texts become empty."""
    run_ids, run, n = [], [], 0
    for a in range(0, len(texts), 128):
        part = texts.slice(a, 128)
        keys = ids.slice(a, 128).to_pylist() if ids is not None else [None] * len(part)
        for i, t in zip(keys, part.to_pylist(), strict=True):
            run_ids.append(i)
            run.append(t or "")
            n += len(run[-1]) + 64
            if n >= size:
                yield run_ids, run
                run_ids, run, n = [], [], 0
    if run:
        yield run_ids, run


def rows_of(batches) -> Iterator[dict]:
    """Rows of Arrow batches, one open at a time: for rows that hold packed arrays."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return v

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` words; with fewer words, one for all of them; none for none.

    The width that was used goes into the hash, so a short text's only shingle
    cannot equal a run inside a longer text.
    """
    if not len(h):
        return h
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
    for i in range(k):
        out = mix(out ^ h[i : len(h) - k + 1 + i]) + np.uint64(i + 1)
    return out


def many_shingles(hashed: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several texts, one after another, and how many each has (as `shingle_hashes` gives them)."""
    sizes = np.array([len(h) for h in hashed], np.int64)
    count = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    out = np.empty(int(count.sum()), np.uint64)
    ends = np.cumsum(count)
    long_ = np.nonzero(sizes >= width)[0]
    if len(long_):
        all_words = np.concatenate([hashed[i] for i in long_])
        runs = shingle_hashes(all_words, width)
        word_ends = np.cumsum(sizes[long_])
        inside = np.ones(len(runs), bool)
        for k in range(1, width):  # runs that begin in one text and end in the next
            cut = word_ends[:-1] - k
            inside[cut[cut < len(runs)]] = False
        place = np.repeat(sizes >= width, count)
        out[place] = runs[inside]
    for i in np.nonzero((sizes > 0) & (sizes < width))[0]:
        out[ends[i] - 1] = shingle_hashes(hashed[i], width)[0]
    return out, count


class Workspace:
    """Written tables in the folder that all executors share (spark.checkpoint.dir)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not base and own.isDefined():
            base = own.get()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="loomspark-")
        self.base = f"{base.rstrip('/')}/loomspark-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write, then read: cuts the lineage, and every later reader sees the same rows."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}"), True)
