"""Model replies to cards or overflow: a ladder of checks, then hard budgets.

Replies come from a pluggable function in an Arrow UDF, or from a table of recorded
replies keyed by a hash of the text (no Python at all). Everything after the reply
is column expressions. Budgets are inclusive limits and are checked on the fields as
they will be stored, whatever the model claims.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import BLANK, lines, reply_key, strip, unfenced
from loomspark.operators.prefilter import split
from loomspark.schema import DEFAULT_SHAPES, Shape

PROMPT = """Make one study note out of the passage below, or say that it has none.

Note types and what each may hold at most:
{shapes}

How to choose:
- Take one note type, by the name in quotes. Its budget is a hard limit: what does not fit is overflow.
- Say only what the passage says, in few words, and put one fact on the note.
- A cloze hides the terms worth learning, each as {{c1::term}}, {{c2::next term}}, with two braces on both sides.
- A table that is looked up by its first column goes into a table note type if there is one, even with prose around it:
  one row for each line of the table, however many. The limit on attributes counts those of one row.
- With several facts and no such table, note the central one; if none is central, it is overflow.
- Leave Source and Position out; they are filled in later.

Answer with one JSON object and nothing else, no list, no code fence:
{"choice": "<note type>", "fields": {"<field>": "<text>"}}
{"choice": "<table note type>", "rows": [{"key": "<first column>", "attrs": [{"name": "<column>", "value": "<cell>"}]}]}
{"choice": "overflow", "reason": "<a few words>", "bucket": "qa" or "trimmed"}

Buckets of overflow:
- "qa" keeps matter worth reading: facts, definitions, explanations that are too long, too involved or too many for a note.
- "trimmed" is for text with nothing to learn: references, indexes, contents, headings, names and addresses, thanks, links, filler.
Say, "Smith J (1999) On cells. J Biol 4:1-9." is trimmed (a reference), "Aal, 3. Abbot, 7-9. Acid, 12." is trimmed (an index),
a list of chapter titles is trimmed (contents), and a paragraph that defines three terms is qa (several facts).

Passage:
{passage}
"""


def _offer(s: Shape) -> str:
    """What a note type takes, in words."""
    if s.shape == "term-table":
        pairs = [r for r in s.fields if r.startswith("attr") and r.endswith("_value")]
        return f"rows of a key with at most {len(pairs)} named values each"
    return "the fields " + ", ".join(f for r, f in s.fields.items() if r not in ("source", "position"))


def shapes_block(shapes: dict[str, Shape]) -> str:
    """The note types as the prompt shows them."""
    limits = lambda s: "; ".join(f"{k} {v}" for k, v in s.cutoffs.items()) or "none"
    return "\n".join(f'- "{name}", a {s.shape}: {_offer(s)}. Limits: {limits(s)}.' for name, s in shapes.items())


def prompt(text: Column, shapes: dict[str, Shape] = DEFAULT_SHAPES) -> Column:
    head, tail = PROMPT.replace("{shapes}", shapes_block(shapes)).split("{passage}")
    return F.concat(F.lit(head), text, F.lit(tail))


# Replies.


def call_model(chunks: DataFrame, model: Callable[[str], str], shapes: dict[str, Shape] = DEFAULT_SHAPES, width: int | None = None, once: bool = True) -> DataFrame:
    """Adds `raw` and `llm_error` (name of the exception's type) from a model function.

    The filter on flagged chunks belongs before this. `once`: equal texts are asked
    once and joined back. `width`: how many calls run side by side.
    """

    @F.pandas_udf("struct<raw:string,llm_error:string>")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompts:
            try:
                out.append((model(p), None))
            except Exception as e:  # noqa: BLE001 - a failing call is an outcome of its row
                out.append((None, type(e).__name__))
        return pd.DataFrame(out, columns=["raw", "llm_error"])

    ask = ask.asNondeterministic()
    if not once:
        rows = chunks.repartition(width) if width else chunks
        return rows.withColumn("_r", ask(prompt(F.col("text"), shapes))).select("*", F.col("_r.raw").alias("raw"), F.col("_r.llm_error").alias("llm_error")).drop("_r")
    texts = chunks.select("text").distinct()
    texts = texts.repartition(width) if width else texts
    replies = texts.select(reply_key(F.col("text")).alias("_key"), ask(prompt(F.col("text"), shapes)).alias("_r"))
    met = chunks.withColumn("_key", reply_key(F.col("text"))).join(replies, "_key", "left")
    return met.withColumns({"raw": F.col("_r.raw"), "llm_error": F.col("_r.llm_error")}).drop("_key", "_r")


def replay(chunks: DataFrame, responses: DataFrame, strict: bool = True) -> DataFrame:
    """Adds `raw` from recorded replies (text_sha1, raw). Strict: a text without reply is an error."""
    recorded = responses.select(F.col("text_sha1").alias("_key"), F.col("raw"), F.lit(True).alias("_there"))
    met = chunks.withColumn("_key", reply_key(F.col("text"))).join(recorded, "_key", "left")
    missing = F.raise_error(F.concat(F.lit("no recorded reply for text "), F.col("_key")))
    raw = F.when(F.col("_there").isNull(), missing).otherwise(F.col("raw")) if strict else F.col("raw")
    error = F.lit(None).cast("string") if strict else F.when(F.col("_there").isNull(), "KeyError")
    return met.withColumns({"raw": raw, "llm_error": error}).drop("_key", "_there")


def merged_replies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recorded replies of both; where both have a text, the new one counts."""
    both = old.select("text_sha1", "raw", F.lit(0).alias("age")).unionAll(new.select("text_sha1", "raw", F.lit(1)))
    return both.groupBy("text_sha1").agg(F.max_by("raw", "age").alias("raw"))


def unanswered(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Distinct texts of unflagged chunks without a recorded reply."""
    ask, _ = split(chunks)
    texts = ask.select("text").distinct().withColumn("text_sha1", reply_key(F.col("text")))
    return texts.join(responses.select("text_sha1").distinct(), "text_sha1", "left_anti")


# Checks of one reply.


def quoted(c: Column) -> Column:
    """A string as Python's repr shows it (control characters other than \\n, \\r and \\t as they are)."""
    body = F.regexp_replace(c, r"\\", r"\\\\")
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _view(v: Column) -> Column:
    """What checks need of a JSON value: its kind and its text (nested values as JSON); nulls if it is absent."""
    return F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"))


def _is(view: Column, kind: str) -> Column:
    return F.coalesce(view["kind"].startswith(kind), F.lit(False))


def _string(view: Column) -> Column:
    return F.when(_is(view, "STRING"), view["text"])


def _shown(view: Column, as_repr: bool = False) -> Column:
    """str() or repr() of a JSON value; numbers and nested values as their JSON text."""
    text = view["text"]
    return F.when(_is(view, "STRING"), quoted(text) if as_repr else text).when(_is(view, "BOOLEAN"), F.initcap(text)).when(_is(view, "VOID"), "None").otherwise(text)


def item_count(text: Column) -> Column:
    """Non-blank lines if there are several; else the larger number of numbers or bullets, 1 at least."""
    edge = rf"(?:^|[{BLANK}])"
    # What marks an item in running text.
    marked = (r"\p{Nd}+\.", r"[•\-*]")

    def counted(t: Column) -> Column:
        marks = [F.size(F.regexp_extract_all(t, F.lit(rf"{edge}{mark}[{BLANK}]"), F.lit(0))) for mark in marked]
        return let(F.size(lines(t)), lambda n: F.when(n > 1, n).otherwise(F.greatest(F.lit(1), *marks)))

    return let(text, counted)


def cloze_repaired(text: Column) -> Column:
    """Deletions with a brace too few on either side or both get their two."""
    # A deletion, and the three ways in which braces are missing.
    body = r"(c\p{Nd}+::[^{}]*?)"
    for pattern in (rf"(?<!\{{)\{{{body}\}}\}}", rf"\{{\{{{body}\}}(?!\}})", rf"(?<!\{{)\{{{body}\}}(?!\}})"):
        text = F.regexp_replace(text, pattern, "{{$1}}")
    return text


def cloze_violation(text: Column, limit: int) -> Column:
    pattern = r"\{\{c\p{Nd}+::([^}]+)\}\}"
    whole, inner = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1))
    counted = F.zip_with(whole, inner, lambda w, i: F.struct(w.alias("w"), F.size(F.filter(F.split(i, f"[{BLANK}]+"), lambda x: x != "")).alias("n")))
    first = F.get(F.filter(counted, lambda x: x["n"] > limit), F.lit(0))
    said = lambda x: F.concat(F.lit("cloze deletion "), let(x["w"], quoted), F.lit(" has "), x["n"], F.lit(f" words, limit {limit}"))
    return let(first, lambda x: F.when(x.isNotNull(), said(x)))


def budget_violation(fields: Column, shape: Shape) -> Column:
    """The first cutoff that is exceeded, in the order in which the shape declares them."""
    found = []
    back, text = shape.fields.get("back"), shape.fields.get("text")

    def over(count: Column, limit: int, what: str) -> Column:
        verb = "is" if what == "chars" else "has"
        return let(count, lambda n: F.when(n > limit, F.concat(F.lit(f"{back} {verb} "), n, F.lit(f" {what}, limit {limit}"))))

    for cutoff, limit in shape.cutoffs.items():
        if back and cutoff == "back_max_chars":
            found.append(over(F.length(fields[back]), limit, "chars"))
        elif back and cutoff in ("list_max_items", "steps_max"):
            found.append(F.when(fields[back].isNotNull(), over(item_count(fields[back]), limit, "items" if cutoff == "list_max_items" else "steps")))
        elif text and cutoff == "deletion_max_words":
            found.append(cloze_violation(fields[text], limit))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _fields(raw: Column, reply: Column, shape: Shape) -> Column:
    """Fields in the reply's order, keys in the shape's spelling where they differ by case only; of equal keys the last counts."""
    texts = F.map_entries(F.from_json(F.from_json(raw, "map<string,string>")["fields"], "map<string,string>"))
    kinds = F.transform_values(F.try_variant_get(reply, "$.fields", "map<string,variant>"), lambda k, v: F.schema_of_variant(v))
    known = F.create_map(*[F.lit(x) for f in shape.fields.values() for x in (f.lower(), f)])

    def value(e: Column, kind: Column) -> Column:
        v = F.when(kind == "BOOLEAN", F.initcap(e["value"])).when(kind == "VOID", "None").otherwise(e["value"])
        if shape.shape == "cloze" and "text" in shape.fields:
            return let(v, lambda t: F.when(F.lower(e["key"]) == shape.fields["text"].lower(), cloze_repaired(t)).otherwise(t))
        return v

    def named(ks: Column) -> Column:
        return F.transform(texts, lambda e: F.struct(F.coalesce(known[F.lower(e["key"])], e["key"]).alias("key"), value(e, ks[e["key"]]).alias("value")))

    def last(ns: Column) -> Column:
        keys = F.array_distinct(F.transform(ns, lambda e: e["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(ns, lambda e: e["key"] == k), -1)["value"])))

    return let(let(kinds, named), last)


def _rows(reply: Column) -> Column:
    """Rows of a table reply: kind, key, and attrs (null unless a list) with the views of their parts."""
    view = lambda v, path: _view(F.try_variant_get(v, path, "variant"))
    attr = lambda a: F.struct(F.schema_of_variant(a).alias("kind"), view(a, "$.name").alias("name"), view(a, "$.value").alias("value"))
    row = lambda r: F.struct(F.schema_of_variant(r).alias("kind"), view(r, "$.key").alias("key"), F.transform(F.try_variant_get(r, "$.attrs", "array<variant>"), attr).alias("attrs"))
    return F.transform(F.try_variant_get(reply, "$.rows", "array<variant>"), row)


def _row_violation(row: Column, i: Column, shape: Shape) -> Column:
    most, chars = shape.cutoffs.get("attrs_per_row_max", 4), shape.cutoffs.get("attr_max_chars", 80)
    slots = sum(f"attr{k}_name" in shape.fields and f"attr{k}_value" in shape.fields for k in range(1, 1 + len(shape.fields)))
    at = F.concat(F.lit("row "), (i + 1).cast("string"))
    pairs, n = row["attrs"], F.size(row["attrs"])

    def attr_violation(a: Column, j: Column) -> Column:
        here = F.concat(at, F.lit(" attr "), (j + 1).cast("string"))
        too_long = lambda what: F.when(F.length(a[what]["text"]) > chars, F.concat(F.lit("exceeds_budget: "), here, F.lit(f" {what} is "), F.length(a[what]["text"]), F.lit(f" chars, limit {chars}")))
        return F.coalesce(
            F.when(~_is(a, "OBJECT"), F.concat(F.lit("invalid_response: "), here, F.lit(" is not an object"))),
            F.when(~_is(a["name"], "STRING") | ~_is(a["value"], "STRING"), F.concat(F.lit("invalid_response: "), here, F.lit(" missing 'name'/'value'"))),
            too_long("name"), too_long("value"),
            F.when(j >= slots, F.concat(F.lit("invalid_response: shape has no slot for attr "), (j + 1).cast("string"))),
        )

    return F.coalesce(
        F.when(~_is(row, "OBJECT"), F.concat(F.lit("invalid_response: "), at, F.lit(" is not an object"))),
        F.when(~_is(row["key"], "STRING") | (strip(row["key"]["text"]) == ""), F.concat(F.lit("invalid_response: "), at, F.lit(" missing 'key'"))),
        F.when(pairs.isNull() | (n == 0), F.concat(F.lit("invalid_response: "), at, F.lit(" missing 'attrs'"))),
        F.when(n > most, F.concat(F.lit("exceeds_budget: "), at, F.lit(" has "), n, F.lit(f" attrs, per-row limit {most}"))),
        F.get(F.filter(F.transform(pairs, attr_violation), lambda v: v.isNotNull()), F.lit(0)),
    )


def _row_fields(row: Column, shape: Shape) -> Column:
    pairs = [F.lit(shape.fields["key"]), strip(row["key"]["text"])]
    for k in range(1, shape.cutoffs.get("attrs_per_row_max", 4) + 1):
        for part in ("name", "value"):
            if f"attr{k}_{part}" in shape.fields:
                pairs += [F.lit(shape.fields[f"attr{k}_{part}"]), F.coalesce(F.get(row["attrs"], F.lit(k - 1))[part]["text"], F.lit(""))]
    return F.create_map(*pairs)


def _violations_of(shape: Shape):
    return lambda row, i: _row_violation(row, i, shape)


def _fields_of(shape: Shape):
    return lambda row: _row_fields(row, shape)


def classified(replied: DataFrame, shapes: dict[str, Shape] = DEFAULT_SHAPES) -> DataFrame:
    """Adds kind (`card` or `overflow`), note_type, shape, cards (array of field maps), reason, llm_bucket.

    A table reply yields a card a row, and its first faulty row sends the whole chunk
    to overflow. Needs `raw` and `llm_error`.
    """
    null = F.lit(None).cast("string")
    if not shapes:
        return replied.withColumns({"kind": F.lit("overflow"), "note_type": null, "shape": null, "cards": F.array().cast("array<map<string,string>>"), "reason": F.lit("no_shape_fit"), "llm_bucket": null})
    plain = {n: s for n, s in shapes.items() if s.shape != "term-table"}
    tables = {n: s for n, s in shapes.items() if s.shape == "term-table"}
    no_cards = F.lit(None).cast("array<map<string,string>>")
    shape_of = F.create_map(*[F.lit(x) for n, s in shapes.items() for x in (n, s.shape)])

    def out(reason: Column, bucket: Column = null, made: Column = no_cards) -> Column:
        return F.struct(reason.cast("string").alias("reason"), bucket.alias("llm_bucket"), made.alias("cards"))

    def fault(text: str) -> Column:
        return out(F.lit(f"invalid_response: {text}"))

    def as_card(shape: Shape, raw: Column, v: Column) -> Column:
        judged = lambda m: let(budget_violation(m, shape), lambda why: F.when(why.isNull(), out(null, made=F.array(m))).otherwise(out(F.concat(F.lit("exceeds_budget: "), why))))
        is_map = _is(_view(F.try_variant_get(v, "$.fields", "variant")), "OBJECT")
        return F.when(is_map, let(_fields(raw, v, shape), judged)).otherwise(fault("missing or non-dict 'fields'"))

    def as_table(shape: Shape, v: Column) -> Column:
        def judged(rows: Column) -> Column:
            first = F.get(F.filter(F.transform(rows, _violations_of(shape)), lambda x: x.isNotNull()), F.lit(0))
            whole = let(first, lambda why: F.when(why.isNull(), out(null, made=F.transform(rows, _fields_of(shape)))).otherwise(out(why)))
            return F.when(rows.isNull() | (F.size(rows) == 0), fault("missing or empty 'rows'")).otherwise(whole)

        return let(_rows(v), judged)

    def as_overflow(v: Column) -> Column:
        said, bucket = (_view(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("reason", "bucket"))
        reason = let(said, lambda x: F.coalesce(_shown(x), F.lit("no_shape_fit")))
        return out(F.when(F.try_variant_get(v, "$.reason", "variant").isNull(), "no_shape_fit").otherwise(reason), let(bucket, lambda x: F.when(_string(x).isin("qa", "trimmed"), x["text"])))

    def by_choice(choice: Column, raw: Column, v: Column) -> Column:
        named = _string(choice)
        made = F.when(choice["kind"].isNull(), fault("missing 'choice'")).when(named == "overflow", as_overflow(v))
        for n, s in plain.items():
            made = made.when(named == n, as_card(s, raw, v))
        for n, s in tables.items():
            made = made.when(named == n, as_table(s, v))
        return made.otherwise(out(F.concat(F.lit("invalid_response: unknown note type "), _shown(choice, True))))

    def of_reply(raw: Column) -> Column:
        def of_value(v: Column) -> Column:
            kind = F.schema_of_variant(v)
            choice = _view(F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.choice", "variant")))
            return (
                F.when(v.isNull(), fault("not JSON"))
                .when(kind.startswith("ARRAY"), fault("got array (expected single object)"))
                .otherwise(let(choice, lambda c: by_choice(c, raw, v)))
            )

        return let(F.try_parse_json(raw), of_value)

    failed = out(F.concat(F.lit("llm_error: "), F.col("llm_error")))
    df = replied.withColumn("_o", F.when(F.col("llm_error").isNotNull(), failed).otherwise(let(unfenced(F.col("raw")), of_reply)))
    card = F.col("_o.cards").isNotNull()
    named = F.when(card, F.try_variant_get(F.try_parse_json(unfenced(F.col("raw"))), "$.choice", "string"))
    df = df.withColumns({
        "kind": F.when(card, "card").otherwise("overflow"), "note_type": named, "shape": shape_of[named],
        "cards": F.coalesce("_o.cards", F.array().cast("array<map<string,string>>")), "reason": F.col("_o.reason"), "llm_bucket": F.col("_o.llm_bucket"),
    })
    return df.drop("_o")


def cards(done: DataFrame) -> DataFrame:
    """One row a card: row_ord inside the chunk, fields, and the order of their names."""
    keys = [c for c in done.columns if c not in ("cards", "reason", "llm_bucket", "kind", "raw", "llm_error")]
    out = done.filter("kind = 'card'").select(*keys, F.posexplode("cards").alias("row_ord", "fields"))
    return out.withColumn("field_order", F.map_keys("fields"))


def overflow(done: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Overflow of the model stage, and that of the pre-filter with it."""
    keep = ["source_id", "chunk_ord", "text", "source", "position", "source_type", "reason", "llm_bucket"]
    out = done.filter("kind = 'overflow'").select(*keep)
    return out if flagged is None else flagged.select(*keep).unionByName(out)


def classify_chunks(chunks: DataFrame, reply: Callable[[DataFrame], DataFrame], shapes: dict[str, Shape] = DEFAULT_SHAPES) -> tuple[DataFrame, DataFrame]:
    """(cards, overflow) of chunks; `reply` adds raw and llm_error to those that are not flagged."""
    ask, flagged = split(chunks)
    done = classified(reply(ask), shapes)
    return cards(done), overflow(done, flagged)


def width(cores: int | None, setting: str | None = None) -> int:
    """How many calls run side by side: the setting if a positive number, else half of the other cores, 1 at least."""
    if setting and setting.strip().isdigit() and int(setting) > 0:
        return int(setting)
    return max(1, (cores - 1) // 2) if cores else 4
