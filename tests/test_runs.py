"""Ledger, review files, commits, whole runs, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import classify, ledger, models, review
from loomspark.plans import ingest
from loomspark.schema import ExtractionError, QueueParseError
from loomspark.sources import readers
from loomspark.sources.store import Store


def replies(spark, pairs):
    rows = spark.createDataFrame([(t, r if isinstance(r, str) else json.dumps(r)) for t, r in pairs.items()], "t string, raw string")
    recorded = rows.select(F.sha1(F.col("t").cast("binary")).alias("text_sha1"), "raw")
    return lambda ask: classify.replay(ask, recorded, strict=False)


@pytest.fixture
def note(tmp_path):
    p = tmp_path / "cells.md"
    p.write_text("# Cells\n**Scope:** x\n\n## Energy\nMitochondria make ATP.\n\n## Contents\n- [a](b)\n\n## Size\nToo much to say here.\n")
    return str(p)


def answers(spark):
    return replies(spark, {
        "## Energy\n\nMitochondria make ATP.": {"choice": "Basic", "fields": {"Front": "What makes ATP?", "Back": "Mitochondria"}},
        "## Size\n\nToo much to say here.": {"choice": "overflow", "reason": "too long", "bucket": "qa"},
    })


def test_whole_run(spark, note, tmp_path):
    root = str(tmp_path / "out")
    store = spark.createDataFrame([], "stable_guid string")
    report = ingest.whole_run(spark, note, answers(spark), deck="D", root=root, store=store, present=spark.createDataFrame([("Cloze",)], "model_name string"), on="2026-01-02")
    assert (report["candidates"], report["qa"], report["trimmed"]) == (1, 1, 2)
    assert report["created_models"] == ["Basic", "List", "Steps", "Table"] and report["committed"] == 1 and report["archived"]
    trimmed = open(report["trimmed_file"]).read()
    assert trimmed.startswith("# Trimmed — cells (2026-01-02)\n\n") and "pre-filtered table-of-contents" in trimmed and "0 qa→trimmed override(s)" in trimmed
    done, archived = ingest.commit(spark, root + "/queue/committed/2026-01-02-cells.md", store)
    assert done.count() == 0 and not archived


def test_ledger_skips_what_is_known(spark, note, tmp_path):
    found = ingest.read(spark, note)
    path = str(tmp_path / "ledger")
    ledger.record(found.filter("chunk_ord = 1").withColumns({"stable_guid": F.lit("g"), "deck": F.lit("D")}), path, "2026-01-01T00:00:00+00:00")
    known = readers.read_ledger(spark, path)
    run = ingest.ingest(found, answers(spark), known=known)
    assert run.cards.count() == 0 and run.overflow.count() == 3
    assert ledger.lookup(found, known).filter("stable_guid = 'g'").count() == 1 and ledger.size(known).first().entries == 1


def test_corrupt_ledger_line(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"key": "k"}\n\nnot json\n')
    with pytest.raises(Exception, match="corrupt ledger line"):
        readers.read_ledger(spark, str(tmp_path / "l.json")).collect()


def test_last_entry_counts(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("j", "c", 0)], "key string, deck string, line_no long")
    assert {r.key: r.deck for r in ledger.latest(df).collect()} == {"k": "b", "j": "c"}


def test_empty_files(spark, tmp_path):
    md = tmp_path / "x.md"
    md.write_text("## A\n\n- [a](b)\n")
    run = ingest.ingest(ingest.read(spark, str(md)), replies(spark, {"x": "y"}))
    queue, qa, trimmed = ingest.write(run, deck="D", slug="s", root=str(tmp_path), on="2026-01-01")
    assert queue.read_text() == review.EMPTY_QUEUE and review.NO_OVERFLOW in qa.read_text() and "## 1. From x (#a)" in trimmed.read_text()
    done, archived = ingest.commit(spark, str(queue), spark.createDataFrame([], "stable_guid string"))
    assert done.count() == 0 and archived


@pytest.mark.parametrize("body, message", [("oops\n**Deck:** d", "header"), ("## Card 1 — x\n**Model:** m\n**A:** b", "Deck"), ("## Card 1 — x\n**Deck:** d\n**A:** b", "Model"), ("## Card 1 — x\n**Deck:** d\n**Model:** m", "fields")])
def test_parse_errors(spark, tmp_path, body, message):
    p = tmp_path / "q.md"
    p.write_text(body)
    with pytest.raises(QueueParseError, match=message):
        ingest.commit(spark, str(p), spark.createDataFrame([], "stable_guid string"))
    assert p.exists()


def test_commit_failures_and_dry_run(spark, tmp_path):
    p = tmp_path / "q.md"
    block = "## Card {} — term-def\nstray\n**Front:** f{}\n**Deck:** {}\n**Model:** Basic\n**Tags:** a, ,b\n---\n"
    p.write_text(block.format(1, 1, "d1") + block.format(2, 2, "d2") + block.format(3, 1, "d1"))
    empty = spark.createDataFrame([], "stable_guid string")
    bad = spark.createDataFrame([("d2", "denied")], "deck string, deck_error string")
    done, archived = ingest.commit(spark, str(p), empty, deck_errors=bad)
    assert [r.outcome for r in done.orderBy("block").collect()] == ["created", "failed", "updated"] and not archived
    assert not ingest.commit(spark, str(p), empty, dry_run=True)[1] and p.exists()
    assert ingest.commit(spark, str(p), empty)[1] and (tmp_path / "committed" / "q.md").exists()


def test_card_of_a_passage(spark):
    reply = replies(spark, {"p": {"choice": "Basic", "fields": {"Front": "q", "Back": "b"}}})
    card = ingest.card_from_text(spark, "p", "Me", reply, position="p. 9", tags=("x", "x")).first()
    assert (card.source, card.position, card.tags) == ("Me", "p. 9", ["x"])
    with pytest.raises(ExtractionError):
        ingest.card_from_text(spark, "other", "Me", reply)


def test_tags_from_a_model(spark):
    vocabulary = spark.createDataFrame([("bio::cell",)], "tag string")
    ask = ingest.tag_with_model(vocabulary, lambda p: json.dumps({"tags": ["Bio::Cell", 7, "Bio::cell", "B", "C", "D"]}) if "bio::cell" in p else "")
    reply = replies(spark, {"p": {"choice": "Basic", "fields": {"Front": "q"}}})
    found = spark.createDataFrame([("s", 0, "p", "s", "", "manual", None)], "source_id string, chunk_ord int, text string, source string, position string, source_type string, prefilter_kind string")
    assert ingest.ingest(found, reply, tag_replies=ask, batch="run-1").cards.first().tags == ["bio::cell", "b", "c", "run-1"]


def test_bootstrap_is_idempotent(spark):
    all_ = models.starter_models(spark)
    assert models.bootstrap(all_, all_).first().created == []
    table = all_.filter("model_name = 'Table'").first()
    assert len(table.card_templates) == 4 and table.in_order_fields[0] == "Key"


def test_stream_adds_nothing_twice(spark, tmp_path):
    from loomspark.streaming import ingest as live

    src, out = str(tmp_path / "in"), str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a", "one"), ("a", "two"), ("a", "one")], "source string, text string")
    for n in (1, 2):
        rows.write.mode("append").parquet(src)
        stream = live.stream_chunks(spark, src, "source string, text string", lambda d: d)
        live.start(stream, lambda b, _: b, out, str(tmp_path / "cp"), "D").awaitTermination()
        assert readers.read_ledger(spark, out).count() == 2


def test_unreachable_url_is_a_row(spark):
    row = readers.read_urls(spark, ["http://127.0.0.1:9/x"], 1.0).first()
    assert row.error and row.content is None


def test_partitioning_does_not_matter(spark, sf_dir, tmp_path):
    from loomspark.plans import catalog

    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(7).write.parquet(f"{tmp_path}/pages.parquet")
    run = catalog.QUERIES["flagship_lane_counts"]
    assert sorted(map(tuple, run(spark, sf_dir).collect())) == sorted(map(tuple, run(spark, str(tmp_path)).collect()))


def test_a_later_entry_counts_whatever_its_size(spark, tmp_path):
    path = str(tmp_path / "ledger")
    entry = lambda n, guid: spark.createDataFrame([("s", f"t{i}", guid, "D") for i in range(n)], "source string, text string, stable_guid string, deck string").coalesce(1)
    ledger.record(entry(1, "old"), path)
    ledger.record(entry(50, "new"), path)
    assert {r.stable_guid for r in ledger.latest(readers.read_ledger(spark, path)).collect()} == {"new"}
    ledger.record(entry(1, "last"), path)
    assert sorted(r.stable_guid for r in ledger.latest(readers.read_ledger(spark, path)).collect()) == ["last"] + ["new"] * 49


def test_lines_of_one_ledger_file_count_in_order(spark, tmp_path):
    line = '{"key": "%s", "source": "s", "stable_guid": "%s", "deck": "D", "ingested_at": "2026-01-01T00:00:00+00:00"}\n'
    (tmp_path / "l.jsonl").write_text(line % ("k", "a") + "\n" + line % ("j", "b") + line % ("k", "c"))
    assert {r.key: r.stable_guid for r in ledger.latest(readers.read_ledger(spark, str(tmp_path / "l.jsonl"))).collect()} == {"k": "c", "j": "b"}
    with (tmp_path / "l.jsonl").open("a") as f:
        f.write("{}\n")
    with pytest.raises(ValueError, match="corrupt ledger line 5 of .*l.jsonl"):
        readers.read_ledger(spark, str(tmp_path / "l.jsonl"))


def test_commit_writes_decks_fields_and_tags(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    block = "## Card 1 — term-def\n**Front:** f\n**Back:** {}\n**Deck:** {}\n**Model:** Basic\n**Tags:** {}\n---\n"
    for k, (back, tags) in enumerate((("one", "a"), ("two", "b, c"))):
        p = tmp_path / f"q{k}.md"
        p.write_text(block.format(back, "d1", tags) + block.format("x", "d2", "").replace("f\n", "g\n"))
        bad = spark.createDataFrame([("d2", "denied")], "deck string, deck_error string")
        assert not ingest.commit(spark, str(p), store, dry_run=True)[1] and store.notes().count() == k
        done, archived = ingest.commit(spark, str(p), store, deck_errors=bad)
        assert [r.outcome for r in done.orderBy("block").collect()] == [("created", "updated")[k], "failed"] and not archived
    note = store.notes().first()
    assert store.notes().count() == 1 and (note.fields, note.tags, note.deck) == ({"Front": "f", "Back": "two"}, ["b", "c"], "d1")
    assert [r.deck for r in store.decks().collect()] == ["d1"]


def test_bad_files_are_errors(spark, tmp_path):
    from loomspark.plans import catalog

    (tmp_path / "a.epub").write_bytes(b"no archive")
    with pytest.raises(ExtractionError, match="a.epub: File is not a zip file"):
        ingest.read(spark, str(tmp_path / "a.epub"))
    good = catalog._archive(0)
    (tmp_path / "b.epub").write_bytes(good.replace(b"second", b"second"))
    with pytest.raises(ExtractionError, match="cannot read"):
        ingest.read(spark, str(tmp_path / "*.epub"))
    assert [r.error for r in ingest.bad_sources(spark, str(tmp_path / "*.epub")).collect()] == ["File is not a zip file"]
    with pytest.raises(ExtractionError, match="no content"):
        ingest.read(spark, str(tmp_path / "*.epub"), skip_bad=True)
    (tmp_path / "c.pdf").write_bytes(b"%PDF-broken")
    with pytest.raises(ExtractionError, match="cannot read"):
        ingest.read(spark, str(tmp_path / "c.pdf"))


def test_a_review_file_has_a_bound(spark, tmp_path, monkeypatch):
    from loomspark.sources import sinks

    monkeypatch.setattr(sinks, "REVIEW_ROWS", 0)
    p = tmp_path / "x.md"
    p.write_text("## A\n\n- [a](b)\n")
    run = ingest.ingest(ingest.read(spark, str(p)), replies(spark, {"x": "y"}))
    with pytest.raises(ValueError, match="write_lanes"):
        ingest.write(run, deck="D", slug="s", root=str(tmp_path))
