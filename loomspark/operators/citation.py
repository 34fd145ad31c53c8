"""Source and position of a record from the convention of its source type."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import is_blank, strip
from loomspark.schema import DEFAULT_CONVENTIONS, Convention


def rendered(template: str, metadata: Column) -> Column:
    """A template with {key} filled from a map; a missing key leaves nothing."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [F.coalesce(metadata[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p]
    return strip(F.concat(*cols)) if cols else F.lit("")


def cited(df: DataFrame, conventions: dict[str, Convention] | None = None, fail: bool = False) -> DataFrame:
    """Adds cite_source, cite_position and cite_error from source_type and metadata.

    An unknown type, a missing required key or an empty source is an error: a
    message in cite_error, or an exception if `fail`. A position whose keys are
    missing is empty.
    """
    conventions = DEFAULT_CONVENTIONS if conventions is None else conventions
    kind, meta = F.col("source_type"), F.col("metadata")
    source, position, missing = F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string")
    for name, c in conventions.items():
        lacks = F.array_compact(F.array(*[F.when(is_blank(meta[k]), F.lit(k)) for k in c.source_required])) if c.source_required else F.array().cast("array<string>")
        source = F.when(kind == name, rendered(c.source_template, meta)).otherwise(source)
        missing = F.when(kind == name, F.when(F.size(lacks) > 0, F.array_join(lacks, ", "))).otherwise(missing)
        known = F.lit(True)
        for k in c.position_required:
            known = known & ~is_blank(meta[k])
        position = F.when(kind == name, F.when(known, rendered(c.position_template, meta)).otherwise("")).otherwise(position)
    error = (
        F.when(kind.isNull() | ~kind.isin(*conventions), F.concat(F.lit("unknown source type "), F.coalesce(kind, F.lit("null"))))
        .when(missing.isNotNull(), F.concat(F.lit("missing metadata: "), missing))
        .when(source == "", "source is empty")
    )
    if fail:
        source = F.when(error.isNotNull(), F.raise_error(error)).otherwise(source)
    return df.withColumns({"cite_error": error, "cite_source": F.when(error.isNull(), source) if not fail else source, "cite_position": F.when(error.isNull(), position)})
