"""String rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# JS ``\s`` (Unicode spaces) plus NBSP, zero-width space/joiners and BOM.
# Java's ``\s`` is ASCII-only, so the class is spelled out.
WS_CLASS = ("[\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
            "\ufeff\u200b\u200c\u200d]+")
# JS ``trim``: as above without the zero-width space and joiners.
JS_WS_CLASS = ("[\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
XPATH_WS = "[ \t\r\n]+"


def named(name: str) -> Column:
    """The column of this name, whatever characters a scraped name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(c: Column) -> Column:
    """Whitespace runs -> one space, trimmed; null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), WS_CLASS, " "))


def match_text(c: Column) -> Column:
    """Only [ \\t\\r\\n]+ collapsed; the ends lose every space that
    JavaScript's ``trim`` knows."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), XPATH_WS, " "), f"^{JS_WS_CLASS}|{JS_WS_CLASS}$", "")


def describe(tag: Column, id_: Column, classes: Column) -> Column:
    """Tag, #id, first two classes, '…' when more."""
    return F.concat(
        tag,
        F.when(id_ != "", F.concat(F.lit("#"), id_)).otherwise(F.lit("")),
        F.when(F.size(classes) > 0, F.concat(F.lit("."), F.array_join(F.slice(classes, 1, 2), "."))).otherwise(F.lit("")),
        F.when(F.size(classes) > 2, F.lit("…")).otherwise(F.lit("")),
    )


def value_kind(sample: Column) -> Column:
    """Value-kind guess of a sample value; first match wins."""
    s = F.coalesce(sample, F.lit(""))
    return (
        F.when(s.rlike(rules.PRICE), "Price")
        .when(s.rlike(rules.EMAIL), "Email")
        .when(s.rlike(rules.PHONE_CHARS) & s.rlike(rules.PHONE_DIGITS), "Phone")
        .when(s.rlike(rules.RATING), "Rating")
        .when(s.rlike(rules.NUMBER), "Number")
        .otherwise("Text")
    )


def fnv1a36(c: Column) -> Column:
    """32-bit FNV-1a over the string's code units, rendered base 36.
    ``ascii()`` returns the code point, equal to the UTF-16 unit in the BMP."""
    chars = F.split(F.coalesce(c, F.lit("")), "")
    chars = F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(chars)
    h = F.aggregate(
        chars,
        F.lit(2166136261).cast("bigint"),
        lambda acc, ch: F.pmod((acc.bitwiseXOR(F.ascii(ch).cast("bigint"))) * F.lit(16777619), F.lit(4294967296)),
    )
    return F.lower(F.conv(h.cast("string"), 10, 36))
