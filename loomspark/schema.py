"""Record schemas, shapes and citation conventions, and the errors of the library."""

from __future__ import annotations

from dataclasses import dataclass, field

SOURCE_TYPES = ("url", "doi", "pdf", "epub", "book", "manual")
SHAPES = ("term-def", "cloze", "term-list", "term-steps", "term-table")
CHUNKS = "source_id string, chunk_ord int, text string, source string, position string, source_type string, metadata map<string,string>, prefilter_kind string"
LEDGER = "key string, source string, stable_guid string, deck string, ingested_at string"


class ExtractionError(Exception):
    pass


class ConfigError(Exception):
    pass


class CitationError(Exception):
    pass


class QueueParseError(Exception):
    pass


@dataclass(frozen=True)
class Shape:
    """A note type: its shape, role -> field name in order, cutoff -> inclusive limit in order."""

    shape: str
    fields: dict[str, str]
    cutoffs: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Convention:
    source_template: str
    position_template: str = ""
    source_required: tuple[str, ...] = ()
    position_required: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class TagRules:
    include_bare_leaves: bool = False
    extra_deny_patterns: tuple[str, ...] = ()
    use_agent_names: bool = True


_CITED = {"source": "Source", "position": "Position"}

#: Default note types; limits are fixed values.
DEFAULT_SHAPES = {
    "Basic": Shape("term-def", {"front": "Front", "back": "Back"} | _CITED, {"back_max_chars": 200}),
    "Cloze": Shape("cloze", {"text": "Text"} | _CITED, {"deletion_max_words": 5}),
    "List": Shape("term-list", {"front": "Front", "back": "Back"} | _CITED, {"list_max_items": 7}),
    "Steps": Shape("term-steps", {"front": "Front", "back": "Back"} | _CITED, {"steps_max": 5}),
    "Table": Shape("term-table", {"key": "Key"} | {f"attr{i}_{p.lower()}": f"Attr{i}{p}" for i in (1, 2, 3, 4) for p in ("Name", "Value")} | _CITED, {"attrs_per_row_max": 4, "attr_max_chars": 80}),
}

#: Default citation conventions; templates and required keys are fixed values.
DEFAULT_CONVENTIONS = {
    "url": Convention("{url}", "{anchor}", ("url",)),
    "doi": Convention("{doi}", "{section}", ("doi",)),
    "pdf": Convention("{filename}", "page {page}", ("filename",), ("page",)),
    "epub": Convention("{title}", "{spine_item}{anchor}", ("title",), ("spine_item",)),
    "book": Convention("{title}, {edition}", "ch. {chapter}, p. {page}", ("title", "edition"), ("chapter", "page")),
    "manual": Convention("{label}", "", ("label",)),
}
