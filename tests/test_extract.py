"""Extraction operators on literal rows."""

import io
import zipfile

import pytest

from loomspark.operators import blocks, structure
from loomspark.operators.html import walk_text
from loomspark.schema import ExtractionError
from loomspark.sources import chunks, epub


def texts(df, *cols):
    return [tuple(r) for r in df.orderBy("chunk_ord").select(*cols).collect()]


def pages(spark, html):
    return chunks.from_pages(spark.createDataFrame([("p", "http://h/x", html)], "source_id string, url string, html string"))


def test_walk_skips_resets_and_keeps_anchors(spark):
    html = "<nav><p>no</p><nav></nav></nav><h1>Top</h1><p>first</p><h2 id='s'>See also</h2><p>lost <p>kept &amp; done</p><h3>Deep</h3><p>x</p><p> </p><p>open"
    assert texts(pages(spark, html), "text", "position", "prefilter_kind") == [("first", "", None), ("kept & done", "#s", "further-reading"), ("x", "#s", None)]


def test_heading_text_goes_to_the_heading():
    assert walk_text("<p>a<h2>T</h2>b</p>") == [("ab", None, "t", None, False)]


def test_book_walk_scopes_headings_and_kinds():
    html = "<section epub:type='bibliography' id='b'><h2>References</h2><div role='listitem'>one<div>two</div></div></section><p>body</p><figcaption>cap</figcaption><section role='region doc-abstract'><p>abs</p></section>"
    assert walk_text(html, True) == [("onetwo", "b", "references", "bibliography", False), ("body", "b", "", None, False), ("cap", "b", "", None, True), ("abs", "b", "", "abstract", False)]


def test_text_and_label(spark):
    df = spark.createDataFrame([("a", " lab ", "one\n \t\ntwo\n\n\n"), ("b", " ", "x")], "source_id string, label string, text string")
    got = chunks.from_text(df)
    assert [(r.text, r.source) for r in got.filter("source_id = 'a'").orderBy("chunk_ord").collect()] == [("one", "lab"), ("two", "lab")]
    assert got.filter("source_id = 'b'").first().source.startswith("manual 20")


def test_markdown_sections(spark):
    md = "---\na: 1\n---\npre\n## A: b!\nx\n#### deep\n### C ##\n"
    df = spark.createDataFrame([("m", "lab", md)], "source_id string, label string, text string")
    assert texts(chunks.from_markdown(df), "text", "position") == [("pre", ""), ("## A: b!\n\nx\n#### deep", "#a-b"), ("### C ##", "#c")]


def brute_blocks(rows):
    """The rules for one document, as a loop."""
    import re

    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"\d+", "", t)).strip().lower()[:80]
    pages_of = {}
    for page, t in rows:
        if 0 < len(t) <= 150:
            pages_of.setdefault(norm(t), set()).add(page)
    running = {k for k, p in pages_of.items() if k and len(p) > 1}
    refs, thanks, out = False, None, []
    for page, t in rows:
        if norm(t) in running:
            out.append("running-header" if len(t) >= 30 else "-")
            continue
        is_refs, is_thanks = bool(re.search(structure.REFERENCES_HEADING, t)), bool(re.search(structure.THANKS_HEADING, t))
        if is_refs:
            refs, thanks = True, None
        elif is_thanks:
            refs, thanks = False, page
        if len(t) < 30:
            out.append("-")
            continue
        kind = "bibliography" if is_refs else "acknowledgments" if is_thanks else None
        if not kind and refs:
            refs = bool(re.search(structure.CITATION, t))
            kind = "bibliography" if refs else None
        elif not kind and page == 1 and sum(m in t.lower() for m in structure.AFFILIATIONS) > 1:
            kind = "author-affiliations"
        if kind is None and thanks == page and not refs:
            kind = "acknowledgments"
        out.append(kind)
    return out


def test_blocks_match_the_loop(spark):
    import random

    random.seed(4)
    parts = ["References", "Acknowledgments", "ACKNOWLEDGEMENTS to all those who helped us here", "12", "Smith et al. (1999) wrote a long paper on it", "A plain paragraph of some length, number {}", "Journal of running heads, volume {}", "Department of X, University of Y, and more text", "short {}", "References and a body that is long enough to stay"]
    docs = {}
    for d in range(60):
        n = random.randint(1, 30)
        docs[str(d)] = [(1 + i // 5, random.choice(parts).format(random.randint(0, 99))) for i in range(n)]
    rows = [(d, p, i, t, 0) for d, ts in docs.items() for i, (p, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "source_id string, page int, block_ord int, text string, block_type int")
    got = {(r.source_id, r.block_ord): r.prefilter_kind for r in blocks.flagged(df).collect()}
    want = {(d, i): k for d, ts in docs.items() for i, k in enumerate(brute_blocks(ts)) if k != "-"}
    assert got == want


def archive(items, spine="<itemref idref='a'/>", ratio=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", "<container xmlns='c'><rootfiles><rootfile full-path='O/p.opf'/></rootfiles></container>")
        manifest = "".join(f"<item id='{i}' href='{h}' media-type='application/xhtml+xml' properties='{p}'/>" for i, h, p, _ in items)
        z.writestr("O/p.opf", f"<package xmlns='p' xmlns:dc='d'><metadata><dc:title> Book </dc:title></metadata><manifest>{manifest}<item id='n' href='t.ncx' media-type='x'/></manifest><spine>{spine}</spine></package>")
        for _, h, _, body in items:
            z.writestr(f"O/{h.replace('%20', ' ')}", body)
    return out.getvalue()


def book(spark, content):
    df = spark.createDataFrame([("/b/x.epub", bytearray(content))], "path string, content binary")
    return epub.read_items(df)


def test_books(spark):
    long_ = "A body paragraph of at least thirty characters."
    content = archive([("a", "dedication.xhtml", "", "<p>To M.</p>"), ("b", "c%20h.xhtml", "", f"<h1 id='k'>One</h1><p>{long_}</p><p>tiny</p>".encode("utf-16"))], "<itemref idref='a'/><itemref idref='n'/><itemref idref='b'/>")
    got = chunks.from_book_items(book(spark, content).filter("error is null"))
    assert texts(got, "text", "source", "position", "prefilter_kind") == [("To M.", "Book", "O/dedication.xhtml", "dedication"), (long_, "Book", "O/c h.xhtml#k", None)]


@pytest.mark.parametrize("spine, body, message", [("<itemref idref='zz'/>", "<p>x</p>", "unknown item"), ("", "<p>x</p>", "no XHTML"), ("<itemref idref='a'/>", "<p>" + "x" * 200_000 + "</p>", "expands too much")])
def test_bad_books(spark, spine, body, message):
    assert message in book(spark, archive([("a", "a.xhtml", "", body)], spine)).first().error


def test_not_an_archive(spark):
    assert book(spark, b"plain").first().error


def test_ratio():
    assert epub.ratio_allowed(0, 10) and epub.ratio_allowed(2000, 100) and not epub.ratio_allowed(2001, 100)
    assert epub.ratio_allowed(60_000_000, 6_000_000) and not epub.ratio_allowed(60_000_001, 6_000_000)


def test_no_reader(spark):
    from loomspark.plans import ingest

    with pytest.raises(ExtractionError):
        ingest.read(spark, "/x/y.docx")
