"""E-books: archives to spine items, with the archive checked before anything is unpacked."""

from __future__ import annotations

import codecs
import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from loomspark.schema import ExtractionError

XHTML = "application/xhtml+xml"
# How much a member may expand.
SMALL_BYTES, SMALL_RATIO, LARGE_RATIO = 5 * 1024 * 1024, 20.0, 10.0
ITEMS = "source_id string, title string, filename string, ord int, href string, properties array<string>, xhtml string, error string"


def ratio_allowed(size: int, packed: int) -> bool:
    if not size or not packed:
        return True
    return size / packed <= (SMALL_RATIO if size <= SMALL_BYTES else LARGE_RATIO)


def read_member(z: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes; its expansion is judged by the archive's directory before it is read."""
    try:
        info = z.getinfo(name)
    except KeyError as e:
        raise ExtractionError(f"missing member {name}") from e
    if not ratio_allowed(info.file_size, info.compress_size):
        raise ExtractionError(f"member {name} expands too much: {info.file_size} bytes from {info.compress_size}")
    return z.read(name)


def decode(data: bytes) -> str:
    wide = data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE))
    return data.decode("utf-16" if wide else "utf-8-sig", errors="replace")


def _parsed(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(read_member(z, name))
    except ElementTree.ParseError as e:
        raise ExtractionError(f"cannot parse {name}: {e}") from e


def _elements(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]


def package(z: zipfile.ZipFile) -> tuple[str | None, list[tuple[str, list[str]]]]:
    """Title and (member, properties) of the XHTML items in reading order; every reference must resolve."""
    named = [e.get("full-path") for e in _elements(_parsed(z, "META-INF/container.xml"), "rootfile") if e.get("full-path")]
    if not named:
        raise ExtractionError("container names no package")
    root = _parsed(z, named[0])
    titles = [t for e in _elements(root, "title") if (t := (e.text or "").strip())]
    manifest = {e.get("id"): e for e in _elements(root, "item") if e.get("id") and e.get("href")}
    items = []
    for ref in filter(None, (e.get("idref") for e in _elements(root, "itemref"))):
        if ref not in manifest:
            raise ExtractionError(f"spine names unknown item {ref}")
        item = manifest[ref]
        if item.get("media-type") == XHTML:
            member = posixpath.normpath(posixpath.join(posixpath.dirname(named[0]), unquote(item.get("href"))))
            items.append((member, (item.get("properties") or "").split()))
    if not items:
        raise ExtractionError("spine has no XHTML item")
    present = set(z.namelist())
    if absent := [m for m, _ in items if m not in present]:
        raise ExtractionError(f"spine names absent member {absent[0]}")
    return (titles[0] if titles else None), items


def items_of(name: str, content: bytes) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            title, items = package(z)
            return [(title, name, i, href, props, decode(read_member(z, href)), None) for i, (href, props) in enumerate(items)]
    except (zipfile.BadZipFile, ExtractionError) as e:
        return [(None, name, None, None, None, None, str(e))]


def read_items(files: DataFrame) -> DataFrame:
    """Spine items of archives (path, content as read by `binaryFile`); a bad archive is one row with `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path, *r) for r in items_of(posixpath.basename(path), content)]
                yield pd.DataFrame(rows, columns=["source_id", "title", "filename", "ord", "href", "properties", "xhtml", "error"]).astype({"ord": "Int32"})

    return files.select("path", "content").mapInPandas(run, ITEMS)
