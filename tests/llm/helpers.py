"""Small tables with the odd cases, and plain versions of the contracts."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark, texts, sources=None):
    """Rows of documents; `texts` maps ids to texts, or lists (id, text) pairs."""
    pairs = [*(texts.items() if isinstance(texts, dict) else texts)]
    rows = [(i, t, "en", sources[n] if sources else f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, first="doc_id"):
    """The same table between columns whose names clash with others, in any case."""
    from pyspark.sql import functions as F

    extra = [F.lit(1).alias(n) for n in ("TEXT", "EMBEDDING", "score", "size", "kept", "n_words", "key", "batch", "copies", "rate", "cls", "part", "n", "q", "row", "ids", "rank")]
    return df.select(F.lit("x").alias(first.title()), *[F.col(f"`{c}`") for c in df.columns], *extra)


def odd_texts():
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (None, "null id here"), (6, long_), (7, "a" * 50_000), (8, "é漢😀 x y z"), (9, "the same words again and again " * 40), (10, "the same words again and again " * 40), (11, "dup " * 3000)]
