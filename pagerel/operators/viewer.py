"""Dataset queries of the viewer (V01-V05) and sorts / limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import named
from .dataset import row_numbers


def _as_text(c: str) -> Column:
    return F.coalesce(named(c).cast("string"), F.lit(""))


def search(df: DataFrame, q: str, cols: list[str] | None = None) -> DataFrame:
    """Trimmed, lower-cased literal substring in any column; blank = all."""
    q = (q or "").strip().lower()
    if not q:
        return df
    cols = cols or df.columns
    cond = None
    for c in cols:
        e = F.lower(_as_text(c)).contains(F.lit(q))
        cond = e if cond is None else (cond | e)
    return df.filter(cond)


def mark(df: DataFrame, col: str, q: str) -> DataFrame:
    """First hit of ``q`` split into before / hit / after (case-insensitive)."""
    q = (q or "").strip()
    t = _as_text(col)
    i = F.locate(q.lower(), F.lower(t))
    return df.select(
        "*",
        F.when(i > 0, F.substring(t, 1, i - 1)).otherwise(t).alias("before"),
        F.when(i > 0, F.substring(t, i, len(q))).otherwise(F.lit("")).alias("hit"),
        F.when(i > 0, F.right(t, F.length(t) - (i + len(q) - 1))).otherwise(F.lit("")).alias("after"),
    ) if q else df.select("*", t.alias("before"), F.lit("").alias("hit"), F.lit("").alias("after"))


def is_url(c: Column) -> Column:
    return c.rlike(r"(?i)^https?://\S+$")


def cell_kinds(df: DataFrame, col: str, attr: str = "text", limit: int | None = None) -> DataFrame:
    """Link / image / text typing; ``limit``: the display cut with '…'."""
    v = _as_text(col)
    kind = F.when((F.lit(attr) == "src") & is_url(v), "image").when(is_url(v), "link").otherwise("text")
    shown = v if limit is None else F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit - 1), F.lit("…"))).otherwise(v)
    return df.select("*", kind.alias("kind"), shown.alias("shown"))


def export_view(df: DataFrame, path: str, cols: list[str], q: str = "", order: list[str] | None = None, kind: str = "csv", bom: bool = True) -> None:
    """The rows that the search leaves, in the view's order (a column's
    natural order, then the others' as they are given), written as CSV or TSV
    files. The header is in the first file; the files put together in the order
    of their names are the view."""
    from ..sources.sinks import write_csv, write_tsv

    if kind not in ("csv", "tsv"):
        raise ValueError(f"kind must be csv or tsv, not {kind!r}")
    view = search(df, q)
    view = view if not order else view.withColumn("_natural", natural_key(named(order[0])))
    keys = ["_natural", *order] if order else None
    write_csv(view, path, cols, bom=bom, order=keys) if kind == "csv" else write_tsv(view, path, cols, order=keys)


def written_lines(spark, path: str, line_end: str) -> DataFrame:
    """(line_no, line) of the files that ``export_view`` has written: of each
    file in the order of names its lines."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", line_end).alias("lines"))
    files = files.select("file", F.slice("lines", 1, F.size("lines") - 1).alias("lines")).withColumn("n", F.size("lines"))
    from .run import running_totals

    files = running_totals(files.withColumn("all", F.lit(1)), "all", ["file"], "n", "end")
    return files.select((F.col("end") - F.col("n")).alias("before"), F.posexplode("lines").alias("i", "line")).select((F.col("before") + F.col("i") + 1).alias("line_no"), "line")


def search_counts(df: DataFrame, q: str, cols: list[str] | None = None) -> DataFrame:
    """V04: "n of m rows match" (or "m rows" without a query)."""
    q = (q or "").strip().lower()
    cols = cols or df.columns
    cond = F.lit(True)
    if q:
        cond = None
        for c in cols:
            e = F.lower(_as_text(c)).contains(F.lit(q))
            cond = e if cond is None else (cond | e)
    agg = df.agg(F.count_if(cond).alias("matched"), F.count(F.lit(1)).alias("total"))
    status = (F.concat(F.format_number("matched", 0), F.lit(" of "), F.format_number("total", 0), F.lit(" rows match"))
              if q else F.concat(F.format_number("total", 0), F.lit(" rows")))
    return agg.select("matched", "total", status.alias("status"))


def natural_key(c: Column) -> Column:
    """T01 sort key: each digit run, without leading zeros, behind its length
    (numeric order at any length), other runs lower-cased; compared under a
    case- and accent-insensitive collation."""
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+|[^0-9]+)"), 1)

    def run(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.lower(x))

    return F.collate(F.array_join(F.transform(parts, run), ""), "UNICODE_CI_AI")


def natural_sort(df: DataFrame, col: str, desc: bool = False, order: list[str] | None = None) -> DataFrame:
    """Numeric-aware, case/accent-insensitive; ties keep row order."""
    k = natural_key(named(col))
    tie = [named(c).asc() for c in (order or [])]
    return df.orderBy(k.desc() if desc else k.asc(), *tie)


def page(df: DataFrame, order: list, p: int, per_page: int) -> DataFrame:
    """Page ``p`` (0-based, clamped to the last page) in ``order``: a
    range of the distributed row numbers, so no task holds what comes before."""
    numbered = row_numbers(df, order)
    total = numbered.agg(F.max("row_no")).first()[0] or 0
    p = max(0, min(p, max(1, -(-total // per_page)) - 1))
    return numbered.filter((F.col("row_no") > p * per_page) & (F.col("row_no") <= (p + 1) * per_page))


def preview(df: DataFrame, order: list[str], n: int = rules.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)
