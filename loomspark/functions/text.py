"""Scalar functions as column expressions. Blank space is Unicode's, as `strip()` sees it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What `str.strip()` removes and `\s` of a Unicode regex matches.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What `str.splitlines()` splits at.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
_EDGES = rf"^[{BLANK}]+|[{BLANK}]+$"
SLUG_CHARS = REPEAT_CHARS = 80
TAG_DEPTH = 2


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def is_blank(c: Column) -> Column:
    """Absent, or nothing but blank space."""
    return c.isNull() | (strip(c) == "")


def source_slug(source: Column, source_type: Column) -> Column:
    """File-name-safe name of a source: authority and path of a URL, a PDF's name without its last extension."""
    rest = F.regexp_replace(source, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_replace(F.regexp_replace(rest, "(?s)[?#].*$", ""), ";[^/]*$", "")
    url = F.translate(F.regexp_replace(place, "^/+|/+$", ""), "/", "-")
    raw = F.when(source_type == "url", url).when(source_type == "pdf", F.regexp_replace(source, r"(?s)\.[^.]*$", "")).otherwise(source)
    dashed = F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, SLUG_CHARS)
    return F.when(cut == "", "untitled").otherwise(cut)


def heading_slug(line: Column) -> Column:
    text = F.regexp_extract(strip(line), rf"^#{{1,6}}[{BLANK}]+(.+?)[{BLANK}]*#*[{BLANK}]*$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tag(c: Column) -> Column:
    """Lower case, hyphens for spaces, other characters gone, at most two levels; null if nothing is left."""
    clean = F.regexp_replace(F.translate(F.lower(strip(c)), " ", "-"), "[^a-z0-9:-]+", "")
    levels = F.slice(F.filter(F.split(clean, "::"), lambda x: x != ""), 1, TAG_DEPTH)
    return F.when(F.size(levels) > 0, F.array_join(levels, "::"))


def repeat_key(c: Column) -> Column:
    """What a running header keeps from page to page: no digits, single spaces, lower case."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\p{Nd}+", ""), f"[{BLANK}]+", " ")
    return F.substring(F.lower(F.btrim(plain, F.lit(" "))), 1, REPEAT_CHARS)


def content_key(source: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("\0"), text), 256), 1, 16)


def reply_key(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def inline(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\r?\n", " "))


def unfenced(c: Column) -> Column:
    """A reply without the code fence around it."""
    opened = F.regexp_replace(c, r"^```[^\n]*\n?", "")
    end = F.regexp_replace(F.regexp_replace(F.regexp_replace(opened, f"[{BLANK}]+$", ""), "```$", ""), f"[{BLANK}]+$", "")
    return F.when(c.startswith("```"), end).otherwise(c)


def tag_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def pieces(text: Column, pattern: str) -> Column:
    """Stripped, non-blank parts of a text between matches of a separator."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def lines(text: Column) -> Column:
    """`splitlines()`, blank lines left out."""
    return F.filter(F.split(text, LINE_END), lambda x: strip(x) != "")


def batch_tag(at: Column, prefix: str = "batch") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd-HHmmss"))
