"""Chaff kinds of headings, file names, sections and markdown, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import BLANK, lines

# Phrases of headings and the kinds they mean, in the order in which they are tried.
HEADING_KINDS = (
    (("cited by",), "cited-by"),
    (("author information", "author info", "acknowledgment", "acknowledgement"), "author-info"),
    (("references", "bibliography", "citations", "footnotes", "works cited"), "references"),
)
LATER_HEADING_KINDS = (
    (("further reading", "external links", "see also"), "further-reading"),
    (("contents",), "table-of-contents"),
)
BOOK_HEADING_KINDS = (
    (("about the author",), "author-info"),
    (("title page",), "title-page"),
    (("copyright",), "copyright"),
    (("dedication",), "dedication"),
    (("preface",), "preface"),
    (("colophon",), "colophon"),
)
# File names of whole book items, by how they are matched, and their kinds.
FILE_NAMES = (
    ("table-of-contents", "name", ("toc", "nav")),
    ("title-page", "end", ("titlepage",)),
    ("copyright", "whole", ("imprint", "copyright", "uncopyright", "copyrightpage")),
    ("dedication", "end", ("dedication",)),
    ("colophon", "end", ("colophon",)),
    ("endnotes", "start", ("endnotes", "footnotes")),
    ("bibliography", "whole", ("bibliography", "references")),
    ("preface", "end", ("preface",)),
    ("author-info", "whole", ("abouttheauthor", "abouttheauthors")),
)
#: `name`: the lower-case stem; the others: its letters and digits.
_NAME_SHAPES = {"name": r"\A(%s)\z", "whole": r"\A(%s)\z", "start": r"\A(%s)", "end": r"(%s)\z"}
# Section types of e-books and roles of sections.
SECTION_TYPES = {
    "titlepage": "title-page", "halftitlepage": "title-page", "imprint": "copyright", "copyright-page": "copyright",
    "dedication": "dedication", "preface": "preface", "colophon": "colophon", "bibliography": "bibliography",
    "endnotes": "endnotes", "footnotes": "endnotes", "toc": "table-of-contents", "index": "index",
    "abstract": "abstract", "acknowledgments": "acknowledgments",
}
SECTION_ROLES = {
    "doc-bibliography": "bibliography", "doc-endnotes": "endnotes", "doc-footnotes": "endnotes", "doc-dedication": "dedication",
    "doc-colophon": "colophon", "doc-preface": "preface", "doc-toc": "table-of-contents", "doc-index": "index",
    "doc-abstract": "abstract", "doc-acknowledgments": "acknowledgments",
}
# Marks of affiliations, and the shapes of headings and citations in PDF text.
AFFILIATIONS = ("department of", "university of", "institute of", "school of", "faculty of", "laboratory of", "college of", "division of", "affiliation", "@")
REFERENCES_HEADING = rf"(?i)^[{BLANK}]*(references|bibliography|works cited|literature cited|notes and references)\b"
THANKS_HEADING = rf"(?i)^[{BLANK}]*acknowledge?ments\b"
CITATION = r"(?i)\(\d{4}\)|\b\d{1,4}:\d{1,4}[–-]\d{1,4}\b|\bet al\.?|\bpp?\.\s*\d"


def _first(pairs: list[tuple[Column, str]]) -> Column:
    """The kind of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(k)) for c, k in pairs]) if pairs else F.lit(None).cast("string")


def _has(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def heading_kind(title: Column) -> Column:
    """Kind of the section under a heading; `title` in lower case. Null: ordinary text."""
    named = [(_has(title, ps), k) for ps, k in HEADING_KINDS]
    notes = [((title == "notes") | title.startswith("notes "), "references")]
    return _first([*named, *notes, *[(_has(title, ps), k) for ps, k in LATER_HEADING_KINDS]])


def book_heading_kind(title: Column) -> Column:
    return F.coalesce(_first([(_has(title, ps), k) for ps, k in BOOK_HEADING_KINDS]), heading_kind(title))


def file_stem_kind(href: Column) -> Column:
    """Kind of a whole book item by its file name; of several rules the first one counts."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(href, "(?s)^.*/", ""), r"(?s)\.[^.]*$", ""))
    plain = F.regexp_replace(stem, "[^a-z0-9]", "")
    return F.coalesce(*[F.when((stem if how == "name" else plain).rlike(_NAME_SHAPES[how] % "|".join(names)), kind) for kind, how, names in FILE_NAMES])


def book_item_kind(href: Column, properties: Column) -> Column:
    return F.when(F.array_contains(properties, "nav"), "table-of-contents").otherwise(file_stem_kind(href))


def markdown_kind(text: Column) -> Column:
    """`heading`, `front-matter`, `table-of-contents`, `link-list`, or null; one line of prose means null."""
    is_heading = lambda x: x.rlike(rf"^#{{1,6}}[{BLANK}]")
    all_lines = lines(text)
    heads, body = F.filter(all_lines, is_heading), F.filter(all_lines, lambda x: ~is_heading(x))
    item = lambda x: F.regexp_extract(x, rf"^[{BLANK}]*(?:[-*+]|\p{{Nd}}+\.)[{BLANK}]+(.*)$", 1)
    linked = F.forall(body, lambda x: item(x).rlike(rf"\[[^\]]+\]\([^)]+\)|https?://[^{BLANK}]"))
    some, first = F.size(body) > 0, F.get(all_lines, F.lit(0))
    return (
        F.when((F.size(heads) > 0) & ~some, "heading")
        .when(some & first.rlike(rf"^#[{BLANK}]") & F.forall(body, lambda x: x.rlike(r"^\*\*[^*]+:\*\*")), "front-matter")
        .when(some & linked, F.when(F.lower(F.coalesce(F.get(heads, F.lit(0)), F.lit(""))).contains("contents"), "table-of-contents").otherwise("link-list"))
    )


def affiliation_markers(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a + b, [lowered.contains(m).cast("int") for m in AFFILIATIONS])


def is_references_heading(text: Column) -> Column:
    return text.rlike(REFERENCES_HEADING)


def is_thanks_heading(text: Column) -> Column:
    return text.rlike(THANKS_HEADING)


def is_citation(text: Column) -> Column:
    return text.rlike(CITATION)


