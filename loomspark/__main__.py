"""Command line: bootstrap, ingest, card, commit. Each prints one JSON object.

Notes, decks and note types are kept in a folder of JSON lines (`--store`); `--ledger` names a folder of the
chunks that were ingested: those are left out, and new ones recorded. Model replies come from a command
(`--model`) or from recorded replies (`--replies`: JSON lines of text_sha1 and raw).
"""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import classify, ledger, models
from loomspark.plans import ingest as runs
from loomspark.schema import DEFAULT_SHAPES, CitationError, ConfigError, ExtractionError, QueueParseError
from loomspark.session import ship
from loomspark.sources import chunks as build
from loomspark.sources import readers
from loomspark.sources.models import command_model
from loomspark.sources.store import Store


def state_root() -> Path:
    """LOOMSPARK_STATE, else XDG_STATE_HOME/loomspark, else ~/.local/state/loomspark."""
    if own := os.environ.get("LOOMSPARK_STATE"):
        return Path(own)
    return Path(os.environ.get("XDG_STATE_HOME") or Path.home() / ".local" / "state") / "loomspark"


def _reply(spark: SparkSession, a):
    if a.replies:
        recorded = spark.read.schema("text_sha1 string, raw string").json(a.replies)
        return lambda ask: classify.replay(ask, recorded, strict=False)
    if not a.model:
        raise ConfigError("a model command or recorded replies are needed")
    model = command_model(shlex.split(a.model))
    width = classify.width(os.cpu_count(), os.environ.get("LOOMSPARK_WIDTH"))
    return lambda ask: classify.call_model(ask, model, width=width)


def _shapes(a):
    return readers.load_shapes(a.shapes) if a.shapes else DEFAULT_SHAPES


def _found(spark: SparkSession, a) -> DataFrame:
    if a.text is not None:
        found = build.from_text(spark.createDataFrame([("text", a.label, a.text)], "source_id string, label string, text string"))
        if found.limit(1).count() == 0:
            raise ExtractionError("the text is empty")
        return found
    return runs.read(spark, a.source, a.label)


def bootstrap(spark: SparkSession, a) -> dict:
    store = Store(spark, a.store) if a.store else None
    present = store.models() if store else spark.createDataFrame([], "model_name string")
    all_ = models.starter_models(spark, _shapes(a))
    out = models.bootstrap(all_, present).first().asDict()
    if store and not a.dry_run and out["created"]:
        store.add_models(models.missing(all_, present))
    return out


def ingest(spark: SparkSession, a) -> dict:
    if (a.source is None) == (a.text is None):
        raise ConfigError("one of a source and --text is needed")
    found = _found(spark, a)
    known = readers.read_ledger(spark, a.ledger) if a.ledger and Path(a.ledger).exists() else None
    batch = a.batch or f"loomspark-{datetime.now(timezone.utc):%Y%m%d-%H%M%S}"
    run = runs.ingest(found, _reply(spark, a), shapes=_shapes(a), batch=batch, known=known)
    first = found.select("source", "source_type").first()
    paths = runs.write(run, deck=a.deck, slug=runs.slug_of(spark, first["source"], first["source_type"]), root=a.root)
    if a.ledger:
        ledger.record(run.chunks.withColumns({"stable_guid": F.sha1(F.col("text").cast("binary")), "deck": F.lit(a.deck)}), a.ledger)
    return run.summary().first().asDict() | dict(zip(("queue", "qa_file", "trimmed_file"), map(str, paths), strict=True)) | {"batch": batch}


def card(spark: SparkSession, a) -> dict:
    made = runs.card_from_text(spark, a.text, a.label, _reply(spark, a), position=a.position, hint=a.shape, tags=tuple(a.tag), shapes=_shapes(a))
    run = runs.Ingested(made, made, spark.createDataFrame([], "source_id string, chunk_ord int, text string, source string, position string, source_type string, reason string, llm_bucket string"))
    queue, *_ = runs.write(run, deck=a.deck, slug="card-" + runs.slug_of(spark, a.label, "manual"), root=a.root)
    row = made.first()
    return {"note_type": row["note_type"], "fields": row["fields"], "tags": row["tags"], "queue": str(queue)} | (commit(spark, a, str(queue)) if a.commit else {})


def commit(spark: SparkSession, a, path: str | None = None) -> dict:
    store = Store(spark, a.store) if a.store else spark.createDataFrame([], "stable_guid string")
    done, archived = runs.commit(spark, path or a.file, store, dry_run=a.dry_run)
    rows = done.collect()
    by = lambda what: [r["stable_guid"] for r in rows if r["outcome"] == what]
    return {"created": by("created"), "updated": by("updated"), "failed": [[r["block"], r["error"]] for r in rows if r["outcome"] == "failed"], "archived": archived}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--shapes", help="YAML of note types")
    common.add_argument("--store", help="folder of notes and note types")
    common.add_argument("--root", default=str(state_root()))
    common.add_argument("--dry-run", action="store_true")
    reply = argparse.ArgumentParser(add_help=False)
    reply.add_argument("--model", help="command that answers a prompt", default=os.environ.get("LOOMSPARK_MODEL"))
    reply.add_argument("--replies", help="recorded replies")
    reply.add_argument("--deck", default="Default")
    reply.add_argument("--label")
    sub.add_parser("bootstrap", parents=[common])
    one = sub.add_parser("ingest", parents=[common, reply])
    one.add_argument("source", nargs="?")
    one.add_argument("--text")
    one.add_argument("--batch")
    one.add_argument("--ledger")
    one = sub.add_parser("card", parents=[common, reply])
    one.add_argument("text")
    one.add_argument("--position", default="")
    one.add_argument("--shape")
    one.add_argument("--tag", action="append", default=[])
    one.add_argument("--commit", action="store_true")
    one = sub.add_parser("commit", parents=[common])
    one.add_argument("file")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "card" and not a.label:
        a.label = "manual"
    spark = ship(spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate())
    try:
        out = {"bootstrap": bootstrap, "ingest": ingest, "card": card, "commit": commit}[a.command](spark, a)
    except (ExtractionError, ConfigError, CitationError, QueueParseError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(out, ensure_ascii=False))
    return 1 if out.get("failed") else 0


if __name__ == "__main__":
    sys.exit(main())
