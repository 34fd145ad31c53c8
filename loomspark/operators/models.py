"""Note-type definitions and their bootstrap into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.schema import DEFAULT_SHAPES, Shape

SCHEMA = "ord int, model_name string, in_order_fields array<string>, is_cloze boolean, card_templates array<struct<name:string,front:string,back:string>>"
# The markup of card templates; their fields come from the shapes.
_CITATION = "<small>{{Source}} {{Position}}</small>"


def _templates(shape: Shape) -> list[tuple[str, str, str]]:
    answer = "{{FrontSide}}<hr id=answer>"
    if shape.shape == "cloze":
        text = "{{cloze:%s}}" % shape.fields["text"]
        return [("Cloze", text, f"{text}<br><br>{_CITATION}")]
    if shape.shape == "term-table":
        slots = [k for k in range(1, 10) if f"attr{k}_name" in shape.fields]
        row = "".join("{{#%s}}{{%s}}: {{%s}}<br>{{/%s}}" % (n, n, v, n) for n, v in ((shape.fields[f"attr{k}_name"], shape.fields[f"attr{k}_value"]) for k in slots))
        key = shape.fields["key"]
        return [(f"Key→Attr{k}", "{{#%s}}{{%s}} ({{%s}}){{/%s}}" % (n, key, n, n), "%s{{%s}}<br><br><small>%s{{Source}} {{Position}}</small>" % (answer, shape.fields[f"attr{k}_value"], row)) for k in slots for n in [shape.fields[f"attr{k}_name"]]]
    front, back = shape.fields["front"], shape.fields["back"]
    side = lambda a, b: ("{{%s}}" % a, "%s{{%s}}<br><br>%s" % (answer, b, _CITATION))
    if shape.shape == "term-def":
        return [("Front→Back", *side(front, back)), ("Back→Front", *side(back, front))]
    return [({"term-list": "Front→List", "term-steps": "Front→Steps"}[shape.shape], *side(front, back))]


def starter_models(spark: SparkSession, shapes: dict[str, Shape] = DEFAULT_SHAPES) -> DataFrame:
    rows = [(i, n, [*s.fields.values()], s.shape == "cloze", _templates(s)) for i, (n, s) in enumerate(shapes.items())]
    return spark.createDataFrame(rows, SCHEMA)


def missing(models: DataFrame, present: DataFrame) -> DataFrame:
    """Definitions whose model_name the store lacks, in the order of definition."""
    return models.join(present.select("model_name").distinct(), "model_name", "left_anti").orderBy("ord")


def bootstrap(models: DataFrame, present: DataFrame) -> DataFrame:
    """One row: names to create and names already there. A second run creates nothing."""
    there = present.select("model_name").distinct().withColumn("_there", F.lit(True))
    rows = models.join(there, "model_name", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    listed = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "model_name")))), lambda s: s["model_name"])
    return rows.agg(listed(~F.col("_there")).alias("created"), listed(F.col("_there")).alias("already_present"))
