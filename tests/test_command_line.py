"""The command line, run in this process."""

import hashlib
import json
import sys

import pytest

from loomspark.__main__ import main, state_root
from loomspark.sources.models import command_model, reply_text


def said(spark, capsys, *argv):
    code = main([*map(str, argv)], spark)
    out = capsys.readouterr().out.strip()
    return code, json.loads(out) if out else None


@pytest.fixture
def replies(tmp_path):
    p = tmp_path / "replies.json"
    rows = {"ATP is made in mitochondria.": {"choice": "Basic", "fields": {"Front": "Where is ATP made?", "Back": "Mitochondria"}}, "Nothing.": {"choice": "overflow", "reason": "boilerplate"}}
    p.write_text("".join(json.dumps({"text_sha1": hashlib.sha1(t.encode()).hexdigest(), "raw": json.dumps(r)}) + "\n" for t, r in rows.items()))
    return p


def test_in_turn(spark, capsys, tmp_path, replies):
    store, root = tmp_path / "store", tmp_path / "root"
    assert len(said(spark, capsys, "bootstrap", "--store", store)[1]["created"]) == 5
    assert said(spark, capsys, "bootstrap", "--store", store)[1]["created"] == []
    text = "ATP is made in mitochondria.\n\nNothing."
    code, out = said(spark, capsys, "ingest", "--text", text, "--label", "L", "--replies", replies, "--root", root, "--batch", "b-1")
    assert (code, out["candidates"], out["qa"], out["trimmed"]) == (0, 1, 0, 1) and "b-1" in open(out["queue"]).read()
    code, done = said(spark, capsys, "commit", out["queue"], "--store", store)
    assert (code, len(done["created"]), done["archived"]) == (0, 1, True)
    code, card = said(spark, capsys, "card", "ATP is made in mitochondria.", "--label", "Me", "--tag", "x", "--replies", replies, "--root", root, "--store", store, "--deck", "Default", "--commit")
    assert (code, card["tags"], len(card["updated"])) == (0, ["x"], 1)


def test_errors(spark, capsys, tmp_path, replies):
    assert said(spark, capsys, "ingest", "--replies", replies)[0] == 2
    assert said(spark, capsys, "ingest", "--text", " ", "--replies", replies)[0] == 2
    assert said(spark, capsys, "commit", tmp_path / "none.md")[0] == 2
    assert said(spark, capsys, "card", "unknown", "--replies", replies)[0] == 2


def test_command_model():
    ask = command_model([sys.executable, "-c", "import sys, json; print(json.dumps({'outputs': [{'text': '```json\\n' + sys.argv[1] + '\\n```'}]}))"])
    assert ask("hello") == "hello" and reply_text("plain") == "plain"


def test_child_has_no_private_settings(monkeypatch):
    monkeypatch.setenv("PYTHONPATH", "/x")
    ask = command_model([sys.executable, "-c", "import os; print(os.environ.get('PYTHONPATH'), 'PATH' in os.environ)"])
    assert ask("p") == "None True"


def test_ledger_of_ingested_chunks(spark, capsys, tmp_path, replies):
    argv = ("ingest", "--text", "ATP is made in mitochondria.\n\nNothing.", "--label", "L", "--replies", replies, "--root", tmp_path / "r", "--ledger", tmp_path / "ledger")
    first, second = (said(spark, capsys, *argv)[1] for _ in range(2))
    assert (first["candidates"], first["trimmed"]) == (1, 1) and (second["candidates"], second["qa"], second["trimmed"]) == (0, 0, 0)


def test_state_root(monkeypatch):
    monkeypatch.setenv("LOOMSPARK_STATE", "/x/y")
    assert str(state_root()) == "/x/y"
    monkeypatch.delenv("LOOMSPARK_STATE")
    monkeypatch.setenv("XDG_STATE_HOME", "/s")
    assert str(state_root()) == "/s/loomspark"
