"""Replies, budgets, tags, citations, configs."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import citation, classify, prefilter, routing, tagging
from loomspark.schema import DEFAULT_SHAPES, ConfigError, Shape, TagRules
from loomspark.sources import readers

CHUNK = "source_id string, chunk_ord int, text string, source string, position string, source_type string, raw string, llm_error string"


def done(spark, *replies, shapes=DEFAULT_SHAPES, error=None):
    rows = [("s", i, f"t{i}", "src", "", "manual", r if isinstance(r, str) or r is None else json.dumps(r), error) for i, r in enumerate(replies)]
    return classify.classified(spark.createDataFrame(rows, CHUNK), shapes).orderBy("chunk_ord").collect()


def card(choice, **fields):
    return {"choice": choice, "fields": fields}


def table(*rows):
    return {"choice": "Table", "rows": [*rows]}


def row(key, *pairs):
    return {"key": key, "attrs": [{"name": n, "value": v} for n, v in pairs]}


@pytest.mark.parametrize("reply, reason", [
    ("nope", "invalid_response: not JSON"), (None, "invalid_response: not JSON"), ("[]", "invalid_response: got array (expected single object)"),
    ("3", "invalid_response: missing 'choice'"), ({"a": 1}, "invalid_response: missing 'choice'"), ({"choice": "overflow"}, "no_shape_fit"),
    ({"choice": "overflow", "reason": "why"}, "why"), ({"choice": "It's"}, 'invalid_response: unknown note type "It\'s"'), ({"choice": 5}, "invalid_response: unknown note type 5"),
    ({"choice": "Basic"}, "invalid_response: missing or non-dict 'fields'"), (card("Basic", Back="x" * 201), "exceeds_budget: Back is 201 chars, limit 200"),
    (card("Basic", back="x" * 201), "exceeds_budget: Back is 201 chars, limit 200"), (card("List", Back="\n".join("abcdefgh")), "exceeds_budget: Back has 8 items, limit 7"),
    (card("Steps", Back="1. a 2. b 3. c 4. d 5. e 6. f"), "exceeds_budget: Back has 6 steps, limit 5"), (card("Cloze", Text="{c1::a b c d e f}} x"), "exceeds_budget: cloze deletion '{{c1::a b c d e f}}' has 6 words, limit 5"),
    ({"choice": "Table"}, "invalid_response: missing or empty 'rows'"), (table(), "invalid_response: missing or empty 'rows'"), (table(3), "invalid_response: row 1 is not an object"),
    (table(row(" ", ("a", "b"))), "invalid_response: row 1 missing 'key'"), (table(row("k")), "invalid_response: row 1 missing 'attrs'"),
    (table(row("k", *[("a", "b")] * 5)), "exceeds_budget: row 1 has 5 attrs, per-row limit 4"), (table(row("k", ("a", "b")), row("k", ("a", "x" * 81))), "exceeds_budget: row 2 attr 1 value is 81 chars, limit 80"),
    (table({"key": "k", "attrs": [3]}), "invalid_response: row 1 attr 1 is not an object"), (table({"key": "k", "attrs": [{"name": "n"}]}), "invalid_response: row 1 attr 1 missing 'name'/'value'"),
])
def test_ladder(spark, reply, reason):
    got = done(spark, reply)[0]
    assert (got.kind, got.reason) == ("overflow", reason)


def test_good_replies(spark):
    a, b, c, d = done(spark, card("Basic", front="q", BACK="x" * 200, extra=True), card("Cloze", Text="{{c1::a b} and {c2::c}"), table(row(" k ", ("n", "v"))), "```json\n" + json.dumps(card("Basic", Back=1.5)) + "\n```")
    assert a.cards == [{"Front": "q", "Back": "x" * 200, "extra": "True"}] and (a.note_type, a.shape) == ("Basic", "term-def")
    assert b.cards == [{"Text": "{{c1::a b}} and {{c2::c}}"}]
    assert c.cards[0]["Key"] == "k" and c.cards[0]["Attr1Name"] == "n" and c.cards[0]["Attr4Value"] == ""
    assert d.cards == [{"Back": "1.5"}]


def test_bucket_and_errors(spark):
    a, b = done(spark, {"choice": "overflow", "bucket": "qa"}, {"choice": "overflow", "bucket": "else"})
    assert (a.llm_bucket, b.llm_bucket) == ("qa", None)
    assert done(spark, None, error="TimeoutError")[0].reason == "llm_error: TimeoutError"
    assert done(spark, "{}", shapes={})[0].reason == "no_shape_fit"


def test_flagged_chunks_never_reach_the_model(spark, tmp_path):
    log = tmp_path / "calls"

    def model(prompt: str) -> str:
        with open(log, "a") as f:
            f.write(prompt.split("Passage:\n")[1].strip() + "\n")
        if "bad" in prompt.split("Passage:")[1]:
            raise ValueError
        return '{"choice": "overflow", "reason": "r", "bucket": "qa"}'

    rows = [("s", 0, "a", "src", "", "manual", None), ("s", 1, "b", "src", "", "manual", "heading"), ("s", 2, "a", "src", "", "manual", ""), ("s", 3, "bad", "src", "", "manual", None)]
    df = spark.createDataFrame(rows, "source_id string, chunk_ord int, text string, source string, position string, source_type string, prefilter_kind string")
    _, over = classify.classify_chunks(df, lambda ask: classify.call_model(ask, model))
    assert [r.reason for r in over.orderBy("chunk_ord").collect()] == ["r", "extractor: pre-filtered heading", "r", "llm_error: ValueError"]
    assert sorted(set(log.read_text().split())) == ["a", "bad"]


def test_filter_stands_below_the_model_in_the_plan(spark):
    df = spark.range(3).selectExpr("cast(id as string) source_id", "0 chunk_ord", "'t' text", "'s' source", "'' position", "'manual' source_type")
    ask, _ = prefilter.split(df.withColumn("prefilter_kind", F.when(F.col("source_id") == "1", F.lit("k"))))
    lines = classify.call_model(ask, str, once=False)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    model, kept = (next(i for i, x in enumerate(lines) if what in x) for what in ("ArrowEvalPython", "Filter"))
    assert model < kept  # a plan is printed from the top


def test_replay_misses_are_errors(spark):
    df = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(Exception, match="no recorded reply"):
        classify.replay(df, spark.createDataFrame([], "text_sha1 string, raw string")).collect()


def test_prompt_and_shapes():
    block = classify.shapes_block(DEFAULT_SHAPES | {"Free": Shape("term-def", {"front": "F", "source": "S"})})
    assert "back_max_chars 200" in block and "at most 4 named values" in block and '"Free", a term-def: the fields F. Limits: none.' in block


def test_width():
    assert [classify.width(20), classify.width(1), classify.width(None), classify.width(8, "3"), classify.width(8, "0")] == [9, 1, 4, 3, 3]


@pytest.mark.parametrize("reason, bucket, want", [
    ("extractor: pre-filtered x", "qa", ("trimmed", None, False, None)), ("no_shape_fit", "trimmed", ("qa", "trimmed", False, None)), ("No_shape_fit", None, ("qa", None, False, None)),
    ("a Bibliography entry", "qa", ("trimmed", "qa", True, "qa_with_chaff")), ("plain", "trimmed", ("trimmed", "trimmed", False, "trimmed_without_chaff")),
    ("boilerplate", "qa", ("qa", "qa", False, None)), ("boilerplate", "odd", ("trimmed", None, False, None)), ("refractive index", None, ("qa", None, False, None)), ("book index", None, ("trimmed", None, False, None)),
])
def test_routing(spark, reason, bucket, want):
    df = spark.createDataFrame([(reason, bucket)], "r string, b string")
    assert tuple(df.select(routing.decision(F.col("r"), F.col("b")).alias("d")).first().d) == want


def test_every_strong_phrase_is_within_a_phrase():
    assert all(any(s in c or c in s for c in routing.CHAFF) for s in routing.STRONG_CHAFF)


def test_seed_and_tags(spark):
    v = spark.createDataFrame([("a::b",), ("A::B ",), ("bare",), ("cloze",), ("x::2024-01-01",), (None,), (" ",), ("my-skill-testrun-3::x",), ("agent::x",)], "tag string")
    assert [r.tag for r in tagging.seed(v).collect()] == ["a::b", "A::B ", "agent::x"]
    rules = TagRules(include_bare_leaves=True, extra_deny_patterns=("^a::", "("))
    assert [r.tag for r in tagging.seed(v, rules, spark.createDataFrame([(" Bare",)], "name string")).collect()] == ["agent::x"]
    assert "- A::B " in tagging.tags_block(tagging.seed(v)).first().block
    assert tagging.tags_block(v.filter("false")).first().block == "(no tags yet)"


@pytest.mark.parametrize("tag, want", [(" Cell Biology::Mitosis::Phase ", "cell-biology::mitosis"), ("::", None), ("Ünïcode", "ncode"), ("::a::::b::c", "a::b")])
def test_tag(spark, tag, want):
    assert spark.createDataFrame([(tag,)], "t string").select(X.tag(F.col("t")).alias("x")).first().x == want


@pytest.mark.parametrize("source, kind, want", [("https://u:p@h.org:80/a/B_c/?q=1#f", "url", "u-p-h-org-80-a-b-c"), ("My Paper.v2.pdf", "pdf", "my-paper-v2"), ("***", "manual", "untitled"), ("x" * 90, "book", "x" * 80)])
def test_slug(spark, source, kind, want):
    assert spark.createDataFrame([(source, kind)], "s string, k string").select(X.source_slug(F.col("s"), F.col("k")).alias("x")).first().x == want


def test_keys(spark):
    import hashlib

    got = spark.createDataFrame([("s", "t é")], "s string, t string").select(X.content_key(F.col("s"), F.col("t")).alias("a"), X.reply_key(F.col("t")).alias("b"), X.repeat_key(F.lit(" Page 12  of  3 ")).alias("c")).first()
    assert tuple(got) == (hashlib.sha256("s\0t é".encode()).hexdigest()[:16], hashlib.sha1("t é".encode()).hexdigest(), "page of")


def test_citations(spark):
    rows = [("book", {"title": "T", "edition": "2", "chapter": "1"}), ("book", {"title": "T"}), ("pdf", {"filename": "f", "page": "3"}), ("zip", {}), ("url", {"url": "  "})]
    df = spark.createDataFrame(rows, "source_type string, metadata map<string,string>")
    got = [(r.cite_source, r.cite_position, r.cite_error) for r in citation.cited(df).collect()]
    assert got == [("T, 2", "", None), (None, None, "missing metadata: edition"), ("f", "page 3", None), (None, None, "unknown source type zip"), (None, None, "missing metadata: url")]
    for row, message in ((1, "missing metadata: edition"), (3, "unknown source type zip"), (4, "missing metadata: url")):
        with pytest.raises(Exception, match=message):
            citation.cited(spark.createDataFrame([rows[row]], df.schema), fail=True).collect()
    assert citation.cited(spark.createDataFrame([rows[0], rows[2]], df.schema), fail=True).count() == 2


def test_configs(tmp_path):
    with pytest.raises(ConfigError):
        readers.shapes_from({"A": {"shape": "cloze", "fields": {}, "more": 1}})
    with pytest.raises(ConfigError):
        readers.shapes_from({"A": {"shape": "odd", "fields": {}}})
    with pytest.raises(ConfigError, match="missing source types"):
        readers.conventions_from({"url": {"source_template": "x"}})
    with pytest.raises(ConfigError, match="unknown source types"):
        readers.conventions_from({t: {"source_template": "x"} for t in ("url", "doi", "pdf", "epub", "book", "manual", "fax")})
    assert readers.load_tag_rules(tmp_path / "none.yaml") == TagRules()
    with pytest.raises(ConfigError):
        readers.load_shapes(tmp_path / "none.yaml")
