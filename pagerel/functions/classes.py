"""Class and id classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def looks_random(t: Column) -> Column:
    """5-12 alnum with a digit and a letter (unless letters + 1-2
    digits); or 5-8 letters with a lower->upper step and an upper..upper mix.
    The original lookaheads are split into plain conjunctions (RE2-safe)."""
    first = (
        t.rlike("^[a-zA-Z0-9]{5,12}$") & t.rlike("[0-9]") & t.rlike("[a-zA-Z]")
        & ~t.rlike("^[a-zA-Z]+[0-9]{1,2}$")
    )
    second = t.rlike("^[a-zA-Z]{5,8}$") & t.rlike("[a-z][A-Z]") & t.rlike("[A-Z][a-z]?[A-Z]")
    return first | second


def class_kind(c: Column) -> Column:
    """State / dynamic / utility / semantic, tested in that order."""
    return (
        F.when(c.rlike(rules.STATE_CLASS), "state")
        .when(c.rlike(rules.DYNAMIC_CLASS) | looks_random(c), "dynamic")
        .when(c.rlike(rules.UTILITY_CLASS), "utility")
        .otherwise("semantic")
    )


def semantic_classes(classes: Column) -> Column:
    """Semantic class tokens in attribute order."""
    return F.filter(classes, lambda c: class_kind(c) == "semantic")


def group_classes(classes: Column) -> Column:
    """Semantic or utility class tokens ("group" classes) in order."""
    return F.filter(classes, lambda c: class_kind(c).isin("semantic", "utility"))


def utility_classes(classes: Column) -> Column:
    return F.filter(classes, lambda c: class_kind(c) == "utility")


def is_stable_id(i: Column) -> Column:
    """P10: a hand-written id (not empty, short, not numeric, not generated)."""
    return (
        (F.coalesce(i, F.lit("")) != "")
        & (F.length(i) <= 64)
        & ~i.rlike("^[0-9]+$")
        & ~i.rlike("[0-9]{4,}")
        & ~i.rlike(rules.ID_HEXLIKE)
        & ~i.rlike(rules.ID_FRAMEWORK_PREFIX)
        & ~looks_random(i)
    )
