"""Paragraph walks over HTML and e-book XHTML.

The general walk runs the standard library's HTML parser in an Arrow UDF. Pages
without heading ids or nested skipped tags can take `paragraphs_sql`, which is
regular expressions only and stays in the JVM.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import strip
from loomspark.operators.structure import SECTION_ROLES, SECTION_TYPES

SKIPPED = ("nav", "header", "footer", "aside", "script", "style", "form")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
RECORDS = "array<struct<text:string,anchor:string,section_title:string,type_kind:string,is_caption:boolean>>"


class Walk(HTMLParser):
    """Collects (text, anchor, section title, section kind, is caption).

    `book` adds e-book idioms: containers other than <p>, and a stack of sections
    whose headings stay inside them.
    """

    def __init__(self, book: bool = False):
        super().__init__()
        self.book, self.records = book, []
        self.anchor, self.title = None, ""
        self.skipped = 0
        self.paragraph: list[str] | None = None
        self.heading: list[str] | None = None
        self.container, self.inner = "p", 0
        self.sections: list[tuple[str | None, str]] = []

    def _section_kind(self) -> str | None:
        return next((kind for kind, _ in reversed(self.sections) if kind), None)

    def _close(self) -> None:
        self.records.append(("".join(self.paragraph), self.anchor, self.title, self._section_kind(), self.container == "figcaption"))
        self.paragraph, self.container = None, "p"

    def _book_start(self, tag: str, attrs: dict) -> bool:
        if tag == "section":
            named = [SECTION_TYPES.get(t) for t in (attrs.get("epub:type") or "").split()] + [SECTION_ROLES.get(t) for t in (attrs.get("role") or "").split()]
            self.sections.append((next((k for k in named if k), None), self.title))
            self.anchor = attrs.get("id") or self.anchor
            return True
        if self.skipped or tag not in ("div", "figcaption"):
            return False
        if self.paragraph is not None:
            nested = tag == "div" and self.container == "div"
            self.inner += nested
            return nested
        if tag == "figcaption" or attrs.get("role") in ("paragraph", "listitem"):
            self.paragraph, self.container, self.inner = [], tag, 0
            return True
        return False

    def _book_end(self, tag: str) -> bool:
        if tag == "section":
            if self.sections:
                self.title = self.sections.pop()[1]
            return True
        if self.paragraph is None or tag != self.container or tag == "p":
            return False
        if self.inner:
            self.inner -= 1
        else:
            self._close()
        return True

    def handle_starttag(self, tag, attrs):
        if self.book and self._book_start(tag, dict(attrs)):
            return
        if tag in SKIPPED:
            self.skipped += 1
        elif self.skipped:
            return
        elif tag in HEADINGS:
            self.anchor = dict(attrs).get("id") or self.anchor
            self.heading = []
        elif tag == "p":
            self.paragraph = []

    def handle_endtag(self, tag):
        if self.book and self._book_end(tag):
            return
        if tag in SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif tag in HEADINGS and self.heading is not None:
            self.title, self.heading = "".join(self.heading).strip().lower(), None
        elif tag == "p" and self.paragraph is not None:
            self._close()

    def handle_data(self, data):
        if self.skipped:
            return
        part = self.paragraph if self.heading is None else self.heading
        if part is not None:
            part.append(data)


def walk_text(html: str, book: bool = False) -> list[tuple]:
    w = Walk(book)
    w.feed(html)
    w.close()
    return [(t.strip(), *rest) for t, *rest in w.records if t.strip()]


def _walker(book: bool):
    @F.pandas_udf(RECORDS)
    def walk(html: pd.Series) -> pd.Series:
        names = ("text", "anchor", "section_title", "type_kind", "is_caption")
        return html.map(lambda h: [dict(zip(names, r, strict=True)) for r in walk_text(h or "", book)])

    return walk


def paragraphs(html: Column, book: bool = False) -> Column:
    """Non-blank paragraphs in document order."""
    return _walker(book)(html)


def paragraphs_sql(html: Column) -> Column:
    """Paragraph texts of a page by regular expressions alone: an array of strings.

    Agrees with the walk where skipped tags do not nest and only the four entities
    &lt; &gt; &quot; &amp; and numeric-free names &middot; &copy; &nbsp; occur.
    """
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in SKIPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    closed = F.split(c, r"(?i)</p\s*>")
    bodies = F.filter(F.slice(closed, F.lit(1), F.size(closed) - 1), lambda x: x.rlike(r"(?i)<p[\s>]"))

    def clean(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?is)^.*<p(?:\s[^>]*)?>", "")
        x = F.regexp_replace(x, r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>", "")
        x = F.regexp_replace(x, r"(?s)<[^>]*>", "")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(char))
        return strip(x)

    return F.filter(F.transform(bodies, clean), lambda x: x != "")


