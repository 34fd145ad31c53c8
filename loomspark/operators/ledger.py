"""The ledger of ingested chunks: an append-only folder of JSON lines, the last entry of a key counts.

Entries carry the time of their batch (nanoseconds) and their place in it, as Spark
neither writes nor reads files in the order in which they were appended.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import content_key

COLUMNS = ("key", "source", "stable_guid", "deck", "ingested_at")


def keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("key", content_key(F.col("source"), F.col("text")))


def latest(ledger: DataFrame, order: str = "line_no") -> DataFrame:
    """One entry a key, the one with the greatest `order`, by aggregation (partial on the map side) rather than a window."""
    names = [c for c in ledger.columns if c != "key"]
    last = ledger.groupBy("key").agg(F.max_by(F.struct(*names), F.col(order)).alias("_e"))
    return last.select("key", *[F.col(f"_e.{c}").alias(c) for c in names])


def seen(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    return keyed(chunks).join(ledger.select("key").distinct(), "key", "left_semi")


def unseen(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    return keyed(chunks).join(ledger.select("key").distinct(), "key", "left_anti")


def lookup(chunks: DataFrame, ledger: DataFrame, order: str = "line_no") -> DataFrame:
    found = latest(ledger, order).select("key", "stable_guid", "deck", "ingested_at")
    return keyed(chunks).join(found, "key", "left")


def entries(committed: DataFrame, at: str | None = None) -> DataFrame:
    """Ledger rows of committed chunks (source, text, stable_guid, deck); time in UTC seconds."""
    now = F.lit(at) if at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return keyed(committed).withColumn("ingested_at", now).select(*COLUMNS)


def record(committed: DataFrame, path: str, at: str | None = None) -> DataFrame:
    """Append to the ledger's folder of JSON lines; a later call's entries count as later ones."""
    rows = entries(committed, at)
    rows.withColumns({"batch": F.lit(time.time_ns()), "place": F.monotonically_increasing_id()}).write.mode("append").json(path)
    return rows


def size(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.countDistinct("key").alias("entries"))
