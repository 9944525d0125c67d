"""Selector rendering rules as Column expressions (L08): CSS identifier
escaping (CSSOM serialize-an-identifier), CSS strings, XPath literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def css_escape(s: Column) -> Column:
    """CSS.escape() as four regex rewrites: NUL -> U+FFFD; every character
    outside [A-Za-z0-9_-] and non-ASCII gets a backslash; a leading digit
    (also after a leading '-') becomes its hex escape; a lone '-' is '\\-'.
    (C0 control characters get a plain backslash instead of a hex escape.)"""
    v = F.coalesce(s, F.lit(""))
    e = F.regexp_replace(v, "\u0000", "\ufffd")
    e = F.regexp_replace(e, r"([^A-Za-z0-9_\x{80}-\x{10FFFF}-])", r"\\$1")
    e = F.regexp_replace(e, r"^([0-9])", r"\\3$1 ")
    e = F.regexp_replace(e, r"^-([0-9])", r"-\\3$1 ")
    # most names have nothing to escape
    return F.when(v.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), v).when(v == "-", F.lit("\\-")).otherwise(e)


def css_string(v: Column) -> Column:
    """Quoted CSS string: backslash before '"' and '\\', newline as '\\a '."""
    e = F.regexp_replace(F.coalesce(v, F.lit("")), r'(["\\])', r"\\$1")
    e = F.regexp_replace(e, "\n", r"\\a ")
    return F.concat(F.lit('"'), e, F.lit('"'))


def xpath_string(v: Column) -> Column:
    """XPath 1.0 literal: '...' unless it holds a quote, then "...", else a
    concat() of the pieces around single quotes."""
    v = F.coalesce(v, F.lit(""))
    parts = F.transform(F.split(v, "'"), lambda p: F.concat(F.lit("'"), p, F.lit("'")))
    return (
        F.when(~v.contains("'"), F.concat(F.lit("'"), v, F.lit("'")))
        .when(~v.contains('"'), F.concat(F.lit('"'), v, F.lit('"')))
        .otherwise(F.concat(F.lit("concat("), F.array_join(parts, ", \"'\", "), F.lit(")")))
    )
