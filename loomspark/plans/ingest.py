"""Whole runs: ingest, one card, commit, bootstrap, and all of them in turn."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date as day
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import source_slug
from loomspark.operators import classify, ledger, models, review, routing, tagging
from loomspark.schema import DEFAULT_SHAPES, ExtractionError, QueueParseError, Shape, TagRules
from loomspark.sources import chunks as build
from loomspark.sources import epub, readers, sinks
from loomspark.sources.store import Store

Reply = Callable[[DataFrame], DataFrame]


@dataclass
class Ingested:
    chunks: DataFrame
    cards: DataFrame
    overflow: DataFrame

    @property
    def routed(self) -> DataFrame:
        return routing.route(self.overflow)

    def summary(self) -> DataFrame:
        """One row: how many cards, qa and trimmed."""
        return self.cards.agg(F.count("*").alias("candidates")).join(routing.lane_counts(self.routed), how="cross")


def _opened(spark: SparkSession, location: str, label: str | None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks, files that could not be read: source_id, error) of a file, a folder pattern or a URL."""
    lowered = location.lower()
    if location.startswith(("http://", "https://")):
        page = readers.read_urls(spark, [location])
        kind = build.dispatch(F.col("url"), F.col("content_type"), F.col("content"))
        row = page.withColumn("kind", kind).first()
        if row["error"]:
            raise ExtractionError(row["error"])
        if row["kind"] != "pdf":
            return build.from_pages(page.select(F.col("url").alias("source_id"), "url", readers.decoded(F.col("content")).alias("html"))), None
        files, make, unpack = page.select(F.col("url").alias("path"), "content"), build.from_pdf_blocks, readers.read_pdf_blocks
    elif lowered.endswith((".pdf", ".epub")):
        files = readers.read_binary(spark, location)
        make, unpack = (build.from_pdf_blocks, readers.read_pdf_blocks) if lowered.endswith(".pdf") else (build.from_book_items, epub.read_items)
    elif lowered.endswith((".md", ".txt")):
        files = readers.read_whole(spark, location)
        files = files.withColumn("label", F.lit(label)) if label else files
        return (build.from_markdown(files) if lowered.endswith(".md") else build.from_text(files)), None
    else:
        raise ExtractionError(f"no reader for {location}")
    rows = unpack(files)
    return make(rows.filter("error is null")), rows.filter("error is not null").select("source_id", "error")


def bad_sources(spark: SparkSession, location: str) -> DataFrame:
    """source_id and error of the files that cannot be read."""
    bad = _opened(spark, location, None)[1]
    return bad if bad is not None else spark.createDataFrame([], "source_id string, error string")


def read(spark: SparkSession, location: str, label: str | None = None, *, skip_bad: bool = False) -> DataFrame:
    """Chunks of a file, a folder pattern or a URL, by its kind.

    No content is an error, and so is a file that cannot be read, unless such files
    are to be skipped; `bad_sources` lists them.
    """
    found, bad = _opened(spark, location, label)
    if bad is not None and not skip_bad and (first := bad.orderBy("source_id").first()):
        raise ExtractionError(f"cannot read {first['source_id']}: {first['error']}")
    if found.limit(1).count() == 0:
        raise ExtractionError(f"no content in {location}")
    return found


def ingest(found: DataFrame, reply: Reply, *, shapes: dict[str, Shape] = DEFAULT_SHAPES, tag_replies: Callable[[DataFrame], DataFrame] | None = None, batch: str | None = None, known: DataFrame | None = None) -> Ingested:
    """Chunks to tagged cards and overflow. With a ledger (`known`), chunks seen before are left out first."""
    if known is not None:
        found = ledger.unseen(found, known).drop("key")
    made, over = classify.classify_chunks(found, reply, shapes)
    return Ingested(found, tagging.tagged(made, tag_replies(made) if tag_replies else None, batch), over)


def tag_with_model(vocabulary: DataFrame, model: Callable[[str], str], rules: TagRules | None = None, agents: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from cards to tag replies; the seed vocabulary is filtered once and shared by all cards."""
    block = tagging.tags_block(tagging.seed(vocabulary, rules, agents)).first()["block"]

    def replies(cards: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def ask(prompts: pd.Series) -> pd.Series:
            def one(p):
                try:
                    return model(p)
                except Exception:  # noqa: BLE001 - a failing call leaves the batch tag only
                    return None

            return prompts.map(one)

        text = tagging.prompt(F.lit(block), F.col("note_type"), F.col("fields"))
        return cards.select("source_id", "chunk_ord", "row_ord", ask.asNondeterministic()(text).alias("tag_raw"))

    return replies


def chosen(cards: DataFrame, hint: str | None, *by: str) -> DataFrame:
    """The first card of the hinted shape, else the first card; one for each `by`."""
    off = F.lit(0) if hint is None else (F.col("shape") != hint).cast("int")
    order = [off.alias("off"), "source_id", "chunk_ord", "row_ord"]
    if not by:
        return cards.orderBy(*order).limit(1)
    names = [c for c in cards.columns if c not in by]
    best = cards.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_c"))
    return best.select(*[c if c in by else F.col(f"_c.{c}").alias(c) for c in cards.columns])


def card_from_text(spark: SparkSession, text: str, source: str, reply: Reply, *, position: str = "", hint: str | None = None, tags: tuple[str, ...] = (), shapes: dict[str, Shape] = DEFAULT_SHAPES) -> DataFrame:
    """One tagged card of one paragraph; the given tags come first. No card is an error."""
    found = build.from_text(spark.createDataFrame([(source, source, text)], "source_id string, label string, text string"))
    run = ingest(found.withColumn("position", F.lit(position)), reply, shapes=shapes)
    card = chosen(run.cards, hint).withColumn("tags", F.array_distinct(F.concat(F.array(*[F.lit(t) for t in tags]).cast("array<string>"), "tags")))
    if card.limit(1).count() == 0:
        raise ExtractionError("the passage yields no card")
    return card


def slug_of(spark: SparkSession, source: str, source_type: str) -> str:
    return spark.range(1).select(source_slug(F.lit(source), F.lit(source_type)).alias("s")).first()["s"]


def write(run: Ingested, *, deck: str, slug: str, root: str, on: str | None = None) -> tuple[Path, Path, Path]:
    """The three review files under root/queue, root/qa and root/trimmed."""
    return sinks.write_review(run.cards, run.overflow, deck=deck, slug=slug, date=on or day.today().isoformat(), queue_dir=f"{root}/queue", qa_dir=f"{root}/qa", trimmed_dir=f"{root}/trimmed")


def commit(spark: SparkSession, path: str, store: DataFrame | Store, *, dry_run: bool = False, deck_errors: DataFrame | None = None, archive_dir: str | None = None) -> tuple[DataFrame, bool]:
    """(outcome a block, whether the file was archived). An archived file is a no-op; a block that does not parse is an error.

    Into a Store the decks are added first, but for those in `deck_errors` (deck,
    deck_error), then the notes' fields and tags. A table of stable_guid only decides
    what is created. A dry run writes nothing.
    """
    p = Path(path)
    if p.parent.name == "committed":
        return spark.createDataFrame([], "file string, block int, stable_guid string, deck string, model string, outcome string, error string"), False
    if not p.exists():
        raise QueueParseError(f"no such file: {p}")
    blocks = review.parsed_blocks(spark.createDataFrame([(str(p), p.read_text(encoding="utf-8"))], "file string, body string"))
    if bad := blocks.filter("error is not null").orderBy("block").first():
        raise QueueParseError(f"block {bad['block']} in {p}: {bad['error']}")
    held = isinstance(store, Store)
    if held and not dry_run:
        wanted = review.decks(blocks)
        store.add_decks(wanted if deck_errors is None else wanted.join(deck_errors, "deck", "left_anti"))
    done = review.merged(blocks, store.notes() if held else store, None if dry_run else deck_errors).orderBy("block")
    rows = done.collect()  # one review file
    outcome = spark.createDataFrame(rows, done.schema)
    if held and not dry_run and any(r["outcome"] != "failed" for r in rows):
        store.upsert(outcome)
    archived = not dry_run and all(r["outcome"] != "failed" for r in rows)
    if archived:
        folder = Path(archive_dir) if archive_dir else p.parent / "committed"
        folder.mkdir(parents=True, exist_ok=True)
        p.rename(folder / p.name)
    return outcome, archived


def whole_run(spark: SparkSession, location: str, reply: Reply, *, deck: str, root: str, store: DataFrame | Store, present: DataFrame, on: str | None = None) -> dict:
    """Bootstrap, ingest and commit in turn; a report of counts."""
    types = models.bootstrap(models.starter_models(spark), present).first()
    found = read(spark, location)
    run = ingest(found, reply)
    first = found.select("source", "source_type").first()
    queue, qa, trimmed = write(run, deck=deck, slug=slug_of(spark, first["source"], first["source_type"]), root=root, on=on)
    counts = run.summary().first().asDict()
    done, archived = commit(spark, str(queue), store)
    return {"created_models": types["created"], **counts, "queue": str(queue), "qa_file": str(qa), "trimmed_file": str(trimmed), "committed": done.filter("outcome <> 'failed'").count(), "archived": archived}
