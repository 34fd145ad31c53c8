"""A store of notes, decks and note types: folders of JSON lines, the last entry of a note counts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "stable_guid string, deck string, model string, fields map<string,string>, tags array<string>"


class Store:
    """Notes under root/notes, decks under root/decks, note types under root/models."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.root}/{name}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).json(folder) if there else self.spark.createDataFrame([], schema)

    def notes(self) -> DataFrame:
        """One row a note, as it was last written."""
        rows = self._read("notes", f"{NOTES}, batch bigint, place bigint")
        names = [c.split()[0] for c in NOTES.split(", ")]
        last = rows.groupBy("stable_guid").agg(F.max_by(F.struct(*names[1:]), F.struct("batch", "place")).alias("n"))
        return last.select("stable_guid", *[F.col(f"n.{c}").alias(c) for c in names[1:]])

    def decks(self) -> DataFrame:
        return self._read("decks", "deck string").distinct()

    def models(self) -> DataFrame:
        return self._read("models", "model_name string")

    def add_decks(self, decks: DataFrame) -> None:
        """Adds the decks that the store lacks."""
        new = decks.select("deck").distinct().join(self.decks(), "deck", "left_anti")
        rows = new.collect()  # the decks of one review file
        if rows:
            self.spark.createDataFrame(rows, "deck string").write.mode("append").json(f"{self.root}/decks")

    def add_models(self, models: DataFrame) -> None:
        models.write.mode("append").json(f"{self.root}/models")

    def upsert(self, done: DataFrame) -> None:
        """Writes the notes of committed blocks with their fields and tags; of equal notes the last block counts."""
        kept = done.filter(F.col("outcome") != "failed")
        place = F.struct("file", "block")
        last = kept.groupBy("stable_guid").agg(F.max_by(F.struct("deck", "model", "fields", "tags", "block"), place).alias("n"))
        rows = last.select("stable_guid", "n.deck", "n.model", "n.fields", "n.tags", F.lit(time.time_ns()).alias("batch"), F.col("n.block").cast("bigint").alias("place"))
        rows.write.mode("append").json(f"{self.root}/notes")

