"""Routing of overflow to `qa` (kept for reference) or `trimmed` (chaff), with drift telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prefixes of reasons and phrases that name chaff.
EXTRACTOR_PREFIX = "extractor:"
MECHANICAL_PREFIXES = ("exceeds_budget:", "invalid_response:", "llm_error:", "no_shape_fit")
CHAFF = (
    "bibliographic", "bibliography", "citation header", "citation metadata", "citation/header", "is a citation",
    "is a journal citation", "citation/reference", "passage contains only a citation", "journal citation",
    "citation with multiple", "publication metadata", "table of contents", "section header", "section heading",
    "document header", "document overview", "page header", "structural metadata", "header block",
    "list of topic headings", "minireview title", "book index", "book-index", "index entry", "index entries",
    "index listing", "author names", "author names and affiliations", "list of authors", "affiliations and citations",
    "affiliations and metadata", "acknowledgments", "acknowledgements", "funding information", "transitional text",
    "introductory/transitional", "introductory material", "previews future sections", "upcoming content structure",
    "boilerplate", "disclaimer", "reference list", "reference links", "list of links", "list of reference links",
    "collection of reference links", "is a fragment", "passage is fragmentary", "passage is incomplete",
    "bare taxonomic label", "no substantive content", "no factual content", "no learnable fact", "no discrete fact",
    "metadata rather than",
)
STRONG_CHAFF = (
    "bibliograph", "table of contents", "section header", "section heading", "document header", "page header",
    "header block", "author names", "affiliations", "acknowledgment", "acknowledgement", "reference list",
    "reference links", "list of links", "is a citation", "journal citation", "citation metadata", "citation header",
    "publication metadata",
)


def names_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Theta join of a text with a list of phrases by `contains`, as one alternation."""
    return F.lower(text).rlike("|".join(p.replace(".", r"\.") for p in phrases))


def is_mechanical(reason: Column) -> Column:
    return reason.rlike("^(" + "|".join(MECHANICAL_PREFIXES) + ")")


def decision(reason: Column, bucket: Column) -> Column:
    """STRUCT<bucket, llm_bucket, downgraded, disagreement> of an overflow reason and the model's bucket.

    In this order: reasons of the extractor; mechanical reasons; the model's bucket,
    which only a strong phrase can lower; phrases in the reason; else `qa`.
    """
    none, said = F.lit(None).cast("string"), F.when(bucket.isin("qa", "trimmed"), bucket)

    def made(where, llm, downgraded=False, disagreement=none) -> Column:
        where = F.lit(where) if isinstance(where, str) else where
        disagreement = F.lit(disagreement) if isinstance(disagreement, str) else disagreement
        return F.struct(where.alias("bucket"), llm.alias("llm_bucket"), F.lit(downgraded).alias("downgraded"), disagreement.alias("disagreement"))

    chaff, strong = names_any(reason, CHAFF), names_any(reason, STRONG_CHAFF)
    return (
        F.when(reason.startswith(EXTRACTOR_PREFIX), made("trimmed", none))
        .when(is_mechanical(reason), made("qa", said))
        .when((said == "qa") & strong, made("trimmed", said, True, "qa_with_chaff"))
        .when((said == "trimmed") & ~chaff, made("trimmed", said, False, "trimmed_without_chaff"))
        .when(said.isNotNull(), made(said, said))
        .otherwise(made(F.when(chaff, "trimmed").otherwise("qa"), none))
    )


def bucket_of(reason: Column, bucket: Column) -> Column:
    return decision(reason, bucket)["bucket"]


def stage_label(reason: Column, downgraded: Column) -> Column:
    return (
        F.when(reason.startswith(EXTRACTOR_PREFIX), "extractor (structural pre-filter, no LLM call)")
        .when(is_mechanical(reason), "classifier (mechanical: budget/shape/parse)")
        .when(downgraded, "LLM → backstop downgrade (chaff signal)")
        .otherwise("LLM (content judgment)")
    )


def route(overflow: DataFrame) -> DataFrame:
    """Adds `decision` and `stage` to rows with `reason` and `llm_bucket`."""
    routed = overflow.withColumn("decision", decision(F.col("reason"), F.col("llm_bucket")))
    return routed.withColumn("stage", stage_label(F.col("reason"), F.col("decision.downgraded")))


def numbered(routed: DataFrame, *by: str) -> DataFrame:
    """1-based number of each item in its lane; lanes of one ingestion (`by`) number on their own."""
    w = Window.partitionBy(*by, "decision.bucket").orderBy("source_id", "chunk_ord")
    return routed.withColumn("item_no", F.row_number().over(w))


def drift(routed: DataFrame, *by: str) -> DataFrame:
    kind = F.col("decision.disagreement")
    counts = [F.count_if(kind == k).alias(k) for k in ("qa_with_chaff", "trimmed_without_chaff")]
    return routed.groupBy(*by).agg(*counts) if by else routed.agg(*counts)


def lane_counts(routed: DataFrame, *by: str) -> DataFrame:
    where = F.col("decision.bucket")
    counts = [F.count_if(where == k).alias(k) for k in ("qa", "trimmed")]
    return routed.groupBy(*by).agg(*counts) if by else routed.agg(*counts)
