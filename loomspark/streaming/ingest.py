"""Streaming ingest, an extension: new files flow through extract, ledger and routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import ledger
from loomspark.sources import readers


def stream_chunks(spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame], per_trigger: int = 1000):
    """A stream of chunks from Parquet files as they arrive."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return build(rows)


def start(chunks: DataFrame, handle: Callable[[DataFrame, int], DataFrame], ledger_path: str, checkpoint: str, deck: str):
    """For each micro-batch: leave out chunks that the ledger has, `handle` the rest, record them.

    A replayed batch finds its own entries in the ledger, so it adds nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = ledger.keyed(batch).dropDuplicates(["key"]).drop("key")
        try:
            fresh = ledger.unseen(fresh, readers.read_ledger(spark, ledger_path)).drop("key")
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
        done = handle(fresh, number)
        ledger.record(done.withColumns({"stable_guid": F.sha1(F.col("text").cast("binary")), "deck": F.lit(deck)}), ledger_path)

    return chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
