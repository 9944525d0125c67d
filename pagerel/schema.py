"""Explicit schemas: selector steps, columns, recipes, datasets."""

from __future__ import annotations

from pyspark.sql import types as T

# One selector step. comb: 'desc' (descendant of the previous step / scope)
# or 'child'. Null fields are "not constrained".
STEP = T.StructType([
    T.StructField("comb", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("nth", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("has_child", T.StringType()),
])
STEPS = T.ArrayType(STEP)

COLUMN = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("steps", STEPS),
    T.StructField("attr", T.StringType()),
    T.StructField("attr_name", T.StringType()),
])

TARGET = T.StructType([
    T.StructField("steps", STEPS),
    T.StructField("text", T.StringType()),
    T.StructField("aria", T.StringType()),
    T.StructField("rel", T.StringType()),
])

PAGINATION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("target", TARGET),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("delay_ms", T.IntegerType()),
    T.StructField("timeout_ms", T.IntegerType()),
])

OPTIONS = T.StructType([
    T.StructField("dedupe", T.BooleanType()),
    T.StructField("append", T.BooleanType()),
    T.StructField("page_url", T.BooleanType()),
])

RECIPE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("row_steps", STEPS),
    T.StructField("columns", T.ArrayType(COLUMN)),
    T.StructField("pagination", PAGINATION),
    T.StructField("options", OPTIONS),
])


def step(tag=None, comb="desc", id=None, classes=None, attrs=None, nth=None, text=None, has_child=None):
    """Driver-side helper to write a step literal."""
    return {"comb": comb, "tag": tag, "id": id, "classes": list(classes or []),
            "attrs": dict(attrs or {}), "nth": nth, "text": text, "has_child": has_child}


def css(*parts):
    """Build steps from (comb, step-dict) pairs: css(('desc', step('nav')), ('child', step('a')))."""
    out = []
    for comb, s in parts:
        s = dict(s)
        s["comb"] = comb
        out.append(s)
    return out
