"""A recipe run as one job (U02, U03, A08, L17, A05-A07): which rows of which
pages enter the dataset, and what each page added.

Rows are in long form: ``source`` (the run: a recipe on a chain of pages),
``page_ord``, ``row_ord``, and ``cells``, an array of (name, value) in column
order. The values of a row's cells are its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .extract import recipe_extract

PAGE_URL = "Page URL"
CUMULATIVE = ("scroll", "loadmore")
ROW = ["source", "page_ord", "row_ord"]


def as_rows(cells: DataFrame, by: list[str]) -> DataFrame:
    """(…, name, value, col_ord) -> (*by, cells): one row per ``by``, with as
    many cells as there are columns."""
    cell = F.struct("col_ord", F.col("name").alias("name"), F.col("value").alias("value"))
    rows = cells.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.withColumn("cells", F.transform("cells", lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"))))


def values(cells: Column) -> Column:
    """The key of a row: its values in column order, missing ones empty."""
    return F.transform(cells, lambda c: F.coalesce(c["value"], F.lit("")))


def first_rows(rows: DataFrame, key: str = "key", place: tuple[str, ...] = ("page_ord", "row_ord")) -> DataFrame:
    """The first row of each key within its source, by an aggregate: a value
    on very many rows is combined where it lies."""
    firsts = rows.groupBy("source", key).agg(F.min(F.struct(*place)).alias("_at")).select("source", key, *(F.col("_at")[c].alias(c) for c in place))
    return rows.join(firsts, ["source", key, *place], "left_semi")


def merge_snapshots(snapshots: DataFrame, key_columns: list[str] | None = None) -> DataFrame:
    """Pages that grow (scrolling, load more) are seen as snapshots that
    overlap: (source, page_ord, row_ord, cells), each with the rows so far. The
    dataset is their ordered union: each row once, as it is where it is seen
    first. A row's key are its values of ``key_columns`` ('' where it has none
    of a column, which may come later), or of all its columns.
    -> (source, row_no, page_ord, row_ord, cells)"""
    value_of = lambda n: F.coalesce(F.get(F.filter("cells", lambda c: c["name"] == n), F.lit(0))["value"], F.lit(""))
    key = values(F.col("cells")) if key_columns is None else F.array(*(value_of(F.lit(n)) for n in key_columns))
    once = first_rows(snapshots.withColumn("key", key)).drop("key")
    return numbered(once, "source", ["page_ord", "row_ord"], "row_no")


def columns_of(rows: DataFrame) -> DataFrame:
    """(source, col_ord, name): a dataset's columns in the order in which they
    are seen first, by page, row and place in the row."""
    at = rows.select("source", "page_ord", "row_ord", F.posexplode("cells").alias("i", "c"))
    first = at.groupBy("source", F.col("c.name").alias("name")).agg(F.min(F.struct("page_ord", "row_ord", "i")).alias("at"))
    # as many rows as a dataset has columns
    return first.select("source", F.row_number().over(Window.partitionBy("source").orderBy("at")).alias("col_ord"), "name")


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with a number from 1 in each group, by ranges of (group, order):
    a group on a third of all rows spreads over many tasks."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, "_one", name).drop("_one")


def running_totals(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row of its group:
    a range sort, sums in each range, and the ranges' sums before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    part = cut.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    # as many rows for a group as ranges
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    part = part.select(group, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("_inside", inside).join(part, [group, "_range"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def enter(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Which rows enter (A05, A06, U02): rows (source, page_ord, row_ord,
    cells, n_key, dedupe, append) with ``key``, the first ``n_key`` values.
    Without ``dedupe`` all do. With it, the first of each key does, unless
    ``append`` is set and the dataset ``stored`` (source, cells) has it; where
    the dataset lacks one of the key's columns nothing counts as seen."""
    keyed = rows.withColumn("key", F.slice(values(F.col("cells")), 1, F.col("n_key")))
    out = first_rows(keyed.filter("dedupe")).unionByName(keyed.filter(~F.col("dedupe")))
    if stored is None:
        return out
    names = keyed.filter("dedupe and append").groupBy("source").agg(F.first(F.slice(F.transform("cells", lambda c: c["name"]), 1, F.col("n_key"))).alias("names"))
    has = stored.select("source", F.explode("cells").alias("c")).groupBy("source").agg(F.collect_set("c.name").alias("has"))
    names = names.join(has, "source").filter(F.size(F.array_except("names", "has")) == 0).select("source", "names")
    value_of = lambda n: F.coalesce(F.get(F.filter("cells", lambda c: c["name"] == n), F.lit(0))["value"], F.lit(""))
    seen = stored.join(names, "source").select("source", F.transform("names", value_of).alias("key")).distinct()
    return out.join(seen, ["source", "key"], "left_anti")


def report(rows: DataFrame, entered: DataFrame, pages: DataFrame) -> DataFrame:
    """What each page of a run added. pages: (source, page_ord, reason)
    of all pages visited -> (source, page_ord, rows_seen, rows_new, total,
    pages, reason)"""
    at = ["source", "page_ord"]
    seen = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("rows_seen"))
    new = entered.groupBy(*at).agg(F.count(F.lit(1)).alias("rows_new"))
    out = pages.select(*at, "reason").join(seen, at, "left").join(new, at, "left").na.fill(0, ["rows_seen", "rows_new"])
    out = running_totals(out, "source", ["page_ord"], "rows_new", "total")
    return numbered(out, "source", ["page_ord"], "pages").select(*at, "rows_seen", "rows_new", "total", "pages", "reason")


def run_recipes(ps, recipes: DataFrame, chains: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every recipe on every chain of pages of its host, as the recipe's options
    say: rows of the pages in their order, the page's url as the last column
    and no part of the key (L17), duplicates left out (always where pages are
    cumulative), new data appended to or in place of the stored (U02).

    recipes: normalised; chains (G06): (start_id, step, page_id, reason), cut
    at each recipe's ``max_pages`` (1 without pagination); stored: (source,
    cells, ...) -> (rows that enter, report), source being 'recipe@start'."""
    p = F.col("pagination.type")
    most = F.when(F.coalesce(p, F.lit("none")) == "none", 1).otherwise(F.greatest(F.lit(1), F.coalesce("pagination.max_pages", F.lit(1))))
    option = lambda n, d: F.coalesce(F.col(f"options.{n}"), F.lit(d)).alias(n)
    how = recipes.select("id", most.alias("most"), (F.coalesce(F.col("options.dedupe"), F.lit(True)) | F.coalesce(p.isin(*CUMULATIVE), F.lit(False))).alias("dedupe"),
                         option("append", False), option("page_url", False), F.size("columns").alias("n_key"))
    cells = cut_lineage(recipe_extract(ps, recipes), "cells")
    found = as_rows(cells, ["id", "page_id", "row_ord"])
    from .recipes import pages_for

    visits = pages_for(recipes, ps.pages).select("id", "page_id").join(chains.hint("merge"), "page_id").join(how, "id").filter(F.col("step") <= F.col("most"))
    source = F.concat("id", F.lit("@"), F.col("start_id").cast("string"))
    reason = F.when((F.col("step") == F.col("most")) & (F.col("most") > 1) & F.col("reason").isNull(), "limit").otherwise(F.col("reason"))
    visits = cut_lineage(visits.select("id", "page_id", source.alias("source"), F.col("step").alias("page_ord"), reason.alias("reason"), "dedupe", "append", "page_url", "n_key"), "visits")
    rows = found.join(visits.drop("reason"), ["id", "page_id"]).join(ps.info.select("page_id", "url"), "page_id")
    url = F.array(F.struct(F.lit(PAGE_URL).alias("name"), F.coalesce("url", F.lit("")).alias("value")))
    rows = rows.withColumn("cells", F.when(F.col("page_url"), F.concat("cells", url)).otherwise(F.col("cells")))
    rows = cut_lineage(rows.select(*ROW, "cells", "n_key", "dedupe", "append"), "run-rows")
    entered = cut_lineage(enter(rows, stored).select(*ROW, "cells", "append"), "run-new")
    return entered, report(rows, entered, visits)


def after_run(stored: DataFrame | None, entered: DataFrame) -> DataFrame:
    """The datasets (source, cells) after a run: the stored rows of those
    sources that were appended to or not run at all, and the rows that entered."""
    new = entered.select("source", "cells")
    if stored is None:
        return new
    replaced = entered.filter(~F.col("append")).select("source").distinct()
    return stored.select("source", "cells").join(replaced, "source", "left_anti").unionByName(new)
