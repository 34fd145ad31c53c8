"""Readers of files and services: PDF, web pages, configs, ledgers, review files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspark.functions.text import strip
from loomspark.schema import LEDGER, SHAPES, SOURCE_TYPES, ConfigError, Convention, ExtractionError, Shape, TagRules

PDF_BLOCKS = "source_id string, filename string, page int, block_ord int, text string, block_type int, error string"


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def read_pdf_blocks(files: DataFrame) -> DataFrame:
    """Text blocks of PDF files (path, content). Needs a PDF library on the executors; without it each file is one row with `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError:
            pymupdf = None
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                name, rows, error = posixpath.basename(path), [], None
                try:
                    if pymupdf is None:
                        raise ExtractionError("no PDF library is installed")
                    with pymupdf.open(stream=content, filetype="pdf") as doc:
                        if doc.needs_pass:
                            raise ExtractionError("the file is encrypted")
                        for page, p in enumerate(doc, 1):
                            rows += [(path, name, page, len(rows) + i, x[4], x[6], None) for i, x in enumerate(p.get_text("blocks")) if len(x) >= 7]
                except Exception as e:  # noqa: BLE001 - a bad file is an outcome of its row
                    error = f"{type(e).__name__}: {e}"
                if error:
                    rows = [(path, name, None, None, None, None, error)]
                yield pd.DataFrame(rows, columns=["source_id", "filename", "page", "block_ord", "text", "block_type", "error"]).astype({"page": "Int32", "block_ord": "Int32", "block_type": "Int32"})

    return files.select("path", "content").mapInPandas(run, PDF_BLOCKS)


class _Urls(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float, agent: str):
        self.urls, self.timeout, self.agent = urls, timeout, agent

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        import urllib.error
        import urllib.request

        try:
            request = urllib.request.Request(partition.value, headers={"User-Agent": self.agent})
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                yield partition.value, r.headers.get_content_type() or "", bytearray(r.read()), None
        except (urllib.error.URLError, TimeoutError, ValueError, OSError) as e:
            yield partition.value, "", None, f"could not fetch: {e}"


class UrlSource(DataSource):
    """`spark.read.format("web")` with option `urls` (one a line): url, content_type, content, error."""

    @classmethod
    def name(cls):
        return "web"

    def schema(self):
        return "url string, content_type string, content binary, error string"

    def reader(self, schema):
        return _Urls(self.options.get("urls", "").split(), float(self.options.get("timeout", 30)), self.options.get("agent", "loomspark"))


def read_urls(spark: SparkSession, urls: list[str], timeout: float = 30.0) -> DataFrame:
    spark.dataSource.register(UrlSource)
    return spark.read.format("web").option("urls", "\n".join(urls)).option("timeout", timeout).load()


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes, faults replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_whole(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Text files, one row each: source_id (the path), label (the stem), suffix, text."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("source_id", F.col("_metadata.file_path"))
    name = F.element_at(F.split("source_id", "/"), -1)
    return rows.select("source_id", F.regexp_replace(name, r"\.[^.]*$", "").alias("label"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), F.col("value").alias("text"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a file or folder of JSON lines; `line_no` orders them as they were appended.

    Batches follow each other by their time, files without one by that of their last
    change, lines by their place. Blank lines are skipped; a corrupt line is an error
    that names its file and line.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    rows = lines.withColumn("e", F.from_json("value", f"{LEDGER}, batch bigint, place bigint"))
    corrupt = F.lit(False)
    for c in LEDGER.split(", "):
        corrupt = corrupt | F.col("e")[c.split()[0]].isNull()
    rows = rows.filter(strip(F.col("value")) != "")
    if bad := rows.filter(corrupt).orderBy("file", "block", "i").first():
        before = (F.col("block") < bad["block"]) | ((F.col("block") == bad["block"]) & (F.col("i") <= bad["i"]))
        n = lines.filter((F.col("file") == bad["file"]) & before).count()
        raise ValueError(f"corrupt ledger line {n} of {bad['file']}: {bad['value']}")
    order = F.struct(F.coalesce("e.batch", F.unix_micros("changed") * 1000).alias("batch"), F.when(F.col("e.batch").isNull(), F.col("file")).alias("file"), F.coalesce("e.place", "block").alias("block"), F.when(F.col("e.batch").isNull(), F.col("i")).alias("i"))
    return rows.select("e.key", "e.source", "e.stable_guid", "e.deck", "e.ingested_at", order.alias("line_no"))


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return read_whole(spark, path, "*.md").select(F.col("source_id").alias("file"), F.col("text").alias("body"))


# Configs: small files read on the driver; unknown keys are errors.


def _mapping(path: str | Path) -> dict:
    import yaml

    p = Path(path)
    if not p.exists():
        raise ConfigError(f"no such config: {p}")
    try:
        data = yaml.safe_load(p.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigError(f"invalid config {p}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"config {p} is not a mapping")
    return data


def _checked(name: str, given, kind, known: dict):
    if not isinstance(given, dict):
        raise ConfigError(f"{name}: not a mapping")
    if extra := sorted(set(given) - set(known)):
        raise ConfigError(f"{name}: unknown keys {extra}")
    for key, (types, needed) in known.items():
        if needed and key not in given:
            raise ConfigError(f"{name}: missing key {key}")
        if key in given and not isinstance(given[key], types):
            raise ConfigError(f"{name}: bad value of {key}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def shapes_from(data: dict) -> dict[str, Shape]:
    found = {n: _checked(n, g, Shape, {"shape": (str, True), "fields": (dict, True), "cutoffs": (dict, False)}) for n, g in data.items()}
    for n, s in found.items():
        if s.shape not in SHAPES:
            raise ConfigError(f"{n}: unknown shape {s.shape}")
        if any(not isinstance(v, int) or isinstance(v, bool) for v in s.cutoffs.values()):
            raise ConfigError(f"{n}: cutoffs must be whole numbers")
    return found


def conventions_from(data: dict) -> dict[str, Convention]:
    if missing := sorted(set(SOURCE_TYPES) - set(data)):
        raise ConfigError(f"missing source types {missing}")
    if extra := sorted(set(data) - set(SOURCE_TYPES)):
        raise ConfigError(f"unknown source types {extra}")
    known = {"source_template": (str, True), "position_template": (str, False), "source_required": (list, False), "position_required": (list, False), "description": (str, False)}
    return {n: _checked(n, g, Convention, known) for n, g in data.items()}


def load_shapes(path: str | Path) -> dict[str, Shape]:
    return shapes_from(_mapping(path))


def load_conventions(path: str | Path) -> dict[str, Convention]:
    return conventions_from(_mapping(path))


def load_tag_rules(path: str | Path) -> TagRules:
    """Rules of the tagger; defaults if there is no file."""
    if not Path(path).exists():
        return TagRules()
    return _checked("tagger", _mapping(path), TagRules, {"include_bare_leaves": (bool, False), "extra_deny_patterns": (list, False), "use_agent_names": (bool, False)})


def agent_names(spark: SparkSession, agents: list) -> DataFrame:
    """Lower-case ids and names of agent records; records of another kind are skipped."""
    names = {v.strip().lower() for a in agents if isinstance(a, dict) for v in (a.get("id"), a.get("name")) if isinstance(v, str) and v.strip()}
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


