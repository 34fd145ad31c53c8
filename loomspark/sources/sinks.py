"""Sinks: lanes as Parquet for bulk runs, review files for one ingestion."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import review, routing

#: Items that a review file may hold.
REVIEW_ROWS = 100_000


def write_lanes(routed: DataFrame, tagged: DataFrame, path: str, ingestion_date: str, mode: str = "append") -> None:
    """Overflow under lane=qa and lane=trimmed, cards under lane=queue, partitioned by date and lane."""
    over = routed.select("source_id", "chunk_ord", "text", "source", "position", "reason", "stage", "decision", F.col("decision.bucket").alias("lane"))
    for rows in (over, tagged.withColumn("lane", F.lit("queue"))):
        rows.withColumn("ingestion_date", F.lit(ingestion_date)).write.mode(mode).partitionBy("ingestion_date", "lane").option("mergeSchema", "true").parquet(f"{path}/{'cards' if rows is not over else 'overflow'}")


def write_review(tagged: DataFrame, overflow: DataFrame, *, deck: str, slug: str, date: str, queue_dir: str, qa_dir: str, trimmed_dir: str) -> tuple[Path, Path, Path]:
    """The three review files of one ingestion, always all of them.

    A review file is for one reader: its text is one row, its items are numbered in
    one task. Beyond REVIEW_ROWS items that is an error; bulk runs take `write_lanes`.
    """
    routed = routing.route(overflow)
    if (n := max(tagged.count(), overflow.count())) > REVIEW_ROWS:
        raise ValueError(f"{n} items are too many for a review file: use write_lanes")
    numbered = routing.numbered(routed)
    bodies = (
        review.rendered_queue(tagged, deck),
        review.rendered_overflow(numbered, "qa", "Q&A", slug, date),
        review.rendered_overflow(numbered, "trimmed", "Trimmed", slug, date, routing.drift(routed)),
    )
    out = []
    for folder, body in zip((queue_dir, qa_dir, trimmed_dir), bodies, strict=True):
        p = Path(folder) / f"{date}-{slug}.md"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body.first()["body"], encoding="utf-8")
        out.append(p)
    return tuple(out)
