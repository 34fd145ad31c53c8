"""Structural pre-filter: flagged chunks become overflow and never reach a model call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_flagged(kind: Column) -> Column:
    return kind.isNotNull() & (kind != "")


def reason_of(kind: Column) -> Column:
    return F.when(is_flagged(kind), F.concat(F.lit("extractor: pre-filtered "), kind))


def split(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks to classify, overflow of the flagged ones). Both are filters on the scan's side of any UDF."""
    flagged = is_flagged(F.col("prefilter_kind"))
    over = chunks.filter(flagged).withColumn("reason", reason_of(F.col("prefilter_kind"))).withColumn("llm_bucket", F.lit(None).cast("string"))
    return chunks.filter(~flagged), over
