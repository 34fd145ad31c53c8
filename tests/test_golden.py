"""Three small corpora, end to end with recorded replies: chunks, dispatched chunks, routing."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import classify, prefilter
from loomspark.plans import ingest
from loomspark.sources import chunks

MARKDOWN = """---
title: Plugs
---
# Plugs
**Scope:** how to tell one from another

## Contents
- [By wire](#by-wire)
- [By face](#by-face)

## By wire
A twisted pair carries one signal on two wires of opposite sign.

## By face

| Plug | Pins |
| --- | --- |
| RJ45 | 8 |
| RJ11 | 6 |

## Elsewhere
- [Standards](https://example.org/std)
- https://example.org/more
"""
HTML = """<html><nav><p>Home</p></nav><h2 id="content">Chloroplast</h2><p>The chloroplast fixes carbon &amp; makes sugar.</p>
<p>Its many steps cannot be told in one short answer.</p><h2 id="refs">References</h2><p>A. Author, 1999.</p>
<h2 id="cited">Cited by</h2><p>Others, 2004.</p><h2 id="about">Author information</h2><p>A. Author works somewhere.</p><footer><p>end</p></footer></html>"""
PDF = [
    (1, 1, "Department of Zoology, University of Somewhere, Institute of Seas"),
    (1, 2, "An octopus has three hearts, two of which serve the gills."),
    (1, 3, "References\nAuthor A (1999) On hearts. J. Sea 12:34-56"),
]


def card(**fields):
    return json.dumps({"choice": "Basic", "fields": fields})


def corpora(spark):
    md = spark.createDataFrame([("m", "plugs", MARKDOWN)], "source_id string, label string, text string")
    page = spark.createDataFrame([("h", "https://example.org/c", HTML)], "source_id string, url string, html string")
    blocks = spark.createDataFrame([("p", "octopus.pdf", p, o, t, 0) for p, o, t in PDF], "source_id string, filename string, page int, block_ord int, text string, block_type int")
    return {"markdown": chunks.from_markdown(md), "html": chunks.from_pages(page), "pdf": chunks.from_pdf_blocks(blocks)}


REPLIES = {
    "twisted pair": card(Front="What does a twisted pair carry?", Back="One signal on two wires"),
    "RJ45": card(Front="Pins of RJ45?", Back="8"),
    "fixes carbon": card(Front="What fixes carbon?", Back="The chloroplast"),
    "many steps": json.dumps({"choice": "overflow", "reason": "too complex for one note", "bucket": "qa"}),
    "three hearts": card(Front="Hearts of an octopus?", Back="Three"),
}


@pytest.mark.parametrize("name, want", [("markdown", (5, 2, 2, 0, 3)), ("html", (5, 2, 1, 1, 3)), ("pdf", (3, 1, 1, 0, 2))])
def test_corpus(spark, name, want):
    found = corpora(spark)[name]
    ask, _ = prefilter.split(found)
    texts = [r.text for r in ask.collect()]
    rows = [(t, next(v for k, v in REPLIES.items() if k in t)) for t in texts]
    recorded = spark.createDataFrame(rows, "t string, raw string").select(F.sha1(F.col("t").cast("binary")).alias("text_sha1"), "raw")
    run = ingest.ingest(found, lambda a: classify.replay(a, recorded))
    s = run.summary().first()
    assert (found.count(), len(texts), s.candidates, s.qa, s.trimmed) == want
    assert classify.unanswered(found, recorded).count() == 0 and classify.unanswered(found, recorded.filter("false")).count() == want[1]
    cost = found.agg(F.sum(F.when(~prefilter.is_flagged(F.coalesce("prefilter_kind", F.lit(""))), F.length(classify.prompt(F.col("text")))))).first()[0]
    assert cost == sum(len(classify.PROMPT.replace("{shapes}", classify.shapes_block(classify.DEFAULT_SHAPES)).replace("{passage}", t)) for t in texts)


def test_merged_replies(spark):
    rows = lambda *x: spark.createDataFrame([*x], "text_sha1 string, raw string")
    got = classify.merged_replies(rows(("a", "1"), ("b", "2")), rows(("b", "3")))
    assert {r.text_sha1: r.raw for r in got.collect()} == {"a": "1", "b": "3"}
