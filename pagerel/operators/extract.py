"""Values and extraction: P05-P07 value reads, L16 extract, L17 page url
column, L18 auto pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clean
from ..functions.urls import absolutize, host_of
from .columns import detect_columns, img_url_raw
from .lists import find_lists, list_rows
from .select import Matcher
from .tree import sliced, with_text


_OF_ELEMENT = ["tag", "attrs", "own_text", "t_start", "t_end", "anc"]


def node_values(ps, cells: DataFrame, attr_col: str = "attr", attr_name_col: str | None = None) -> DataFrame:
    """Read the value of each (cell) node in its mode; an unknown mode
    is an error.

    text: cleaned subtree text (slice of the page text stream); ownText;
    href: closest a[href] ancestor-or-self, else the first descendant one,
    absolutised; src: own or first descendant img (lazy attributes win over
    empty / data: src; else srcset), else inline background url; value;
    html / outerHtml: source slices; attr(name): trimmed, absolutised for
    url attributes. cells: (..., page_id, node_id, <attr_col>) -> + value."""
    from ..session import cut_lineage

    html = F.col(attr_col).isin("html", "outerHtml")
    given = cells.columns
    # stored with what its element says, which every mode below reads anew
    cells = cut_lineage(cells.join(ps.nodes.select("page_id", "node_id", *_OF_ELEMENT), ["page_id", "node_id"]), "cells")
    return _plain_values(ps, cells.filter(~html), attr_col, attr_name_col).unionByName(html_values(ps, cells.filter(html).select(*given), attr_col))


def _plain_values(ps, cells: DataFrame, attr_col: str, attr_name_col: str | None) -> DataFrame:
    from ..session import cut_lineage

    nodes, c = ps.nodes, cells
    mode = F.col(attr_col)
    # closest a[href] (ancestor-or-self) for href mode
    need_href = c.filter(mode == "href").select("page_id", "node_id", "anc").distinct()
    ex = need_href.select("page_id", F.col("node_id").alias("cell_id"), F.posexplode("anc").alias("d", "node_id"))
    is_a = (F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()
    ahref = nodes.filter(is_a).select("page_id", "node_id", F.col("attrs")["href"].alias("h"))
    up = ex.join(ahref, ["page_id", "node_id"]).groupBy("page_id", "cell_id").agg(F.max_by("h", "d").alias("href_up"))
    # first descendant a[href] / img for href / src modes; a select's value is its chosen option, else its first
    need_down = c.filter(mode.isin("href", "src", "value")).select("page_id", F.col("node_id").alias("cell_id")).distinct()
    is_img, is_opt = F.col("tag") == "img", F.col("tag") == "option"
    below = nodes.filter(is_a | is_img | is_opt).select(
        "page_id", "node_id", "tag", F.when(is_a, F.col("attrs")["href"]).when(is_img, img_url_raw(F.col("attrs"))).otherwise(F.col("attrs")["value"]).alias("v"),
        F.col("attrs")["selected"].isNull().alias("off"), "t_start", "t_end", F.explode("anc").alias("cell_id")).filter(F.col("cell_id") != F.col("node_id"))
    down = below.join(need_down, ["page_id", "cell_id"], "left_semi").groupBy("page_id", "cell_id").agg(
        F.min_by("v", F.when(F.col("tag") == "a", F.col("node_id"))).alias("href_down"), F.min_by("v", F.when(is_img, F.col("node_id"))).alias("img_down"),
        F.min_by(F.struct(F.col("v").alias("o"), "t_start", "t_end"), F.when(is_opt, F.struct("off", "node_id"))).alias("c"))
    down = cut_lineage(down, "below")
    opt = with_text(ps, down.filter(F.col("c").isNotNull()).select("page_id", "cell_id", "c.*"))
    opt = opt.select("page_id", "cell_id", F.coalesce("o", clean(F.col("raw_text"))).alias("chosen"))
    down = down.select("page_id", F.col("cell_id").alias("node_id"), "href_down", "img_down")
    c = c.join(opt.withColumnRenamed("cell_id", "node_id"), ["page_id", "node_id"], "left")
    c = c.join(up.withColumnRenamed("cell_id", "node_id"), ["page_id", "node_id"], "left")
    c = c.join(down, ["page_id", "node_id"], "left")
    # only modes that show text read it
    shows = (F.coalesce(mode, F.lit("text")) == "text") | ((mode == "value") & (F.col("tag") == "textarea"))
    texts = with_text(ps, cells.filter(shows).select("page_id", "node_id", "t_start", "t_end").distinct()).drop("t_start", "t_end")
    c = c.join(texts, ["page_id", "node_id"], "left").join(ps.info.select("page_id", "base"), "page_id", "left")
    # stored, so that the long url expression below meets a plain scan
    c = cut_lineage(c, "read")
    bg = F.regexp_extract(F.coalesce(F.col("attrs")["style"], F.lit("")),
                          r"(?i)background(?:-image)?\s*:[^;]*url\(\s*['\"]?([^'\")]+)['\"]?\s*\)", 1)
    src = F.when(F.col("tag") == "img", img_url_raw(F.col("attrs"))).otherwise(
        F.coalesce(F.col("img_down"), F.when(bg != "", bg), F.lit("")))
    text = clean(F.col("raw_text"))
    an = F.col(attr_name_col) if attr_name_col else F.lit(None).cast("string")
    raw_attr = F.trim(F.col("attrs")[an])
    # one url expression for all modes that read one
    is_url = mode.isin("href", "src") | ((mode == "attr") & an.isNotNull() & F.coalesce(an.rlike(rules.URL_ATTRS), F.lit(False)))
    url = absolutize(F.when(mode == "href", F.coalesce("href_up", "href_down")).when(mode == "src", F.when(src != "", src)).otherwise(raw_attr), F.col("base"))
    value = (
        F.when(mode == "ownText", F.col("own_text"))
        .when(is_url, F.coalesce(url, F.lit("")))
        .when(mode == "value", F.when(F.col("tag") == "textarea", F.col("raw_text"))
              .when(F.col("tag") == "select", F.coalesce("chosen", F.lit(""))).otherwise(F.coalesce(F.col("attrs")["value"], F.lit(""))))
        .when(mode == "attr", F.when(an.isNull() | raw_attr.isNull(), F.lit("")).otherwise(raw_attr))
        .when(F.coalesce(mode, F.lit("text")) == "text", text)
        .otherwise(F.raise_error(F.concat(F.lit("unknown value mode: "), mode)).cast("string"))
    )
    drop = [*_OF_ELEMENT, "href_up", "href_down", "img_down", "chosen", "raw_text", "base"]
    return cut_lineage(c.withColumn("value", F.coalesce(value, F.lit(""))).drop(*drop), "values")


def html_values(ps, cells: DataFrame, attr_col: str = "attr") -> DataFrame:
    """P07 html / outerHtml modes: source slices of the page (the source
    text, not a re-serialised DOM)."""
    if cells.isEmpty():  # asked before any join
        return cells.withColumn("value", F.lit(""))
    n = ps.nodes.select("page_id", "node_id", "o_start", "i_start", "i_end", "o_end")
    outer = F.col(attr_col) == "outerHtml"
    c = cells.join(n, ["page_id", "node_id"]).withColumns({"_from": F.when(outer, F.col("o_start")).otherwise(F.col("i_start")),
                                                           "_to": F.when(outer, F.col("o_end")).otherwise(F.col("i_end"))})
    c = sliced(ps.sources, c, "_from", "_to", "value")
    return c.withColumn("value", F.when(outer, F.col("value")).otherwise(F.trim("value"))).drop("o_start", "i_start", "i_end", "o_end", "_from", "_to")


def apply_columns(ps, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """L16 core: evaluate every column selector inside every row (first match
    in document order), read its value in its mode, keep rows with any
    non-empty value. rows: (page_id, list_rank, row_id, row_ord); cols:
    (page_id, list_rank, col_ord, name, steps, attr[, attr_name]) -> long cells
    (page_id, list_rank, row_ord, col_ord, name, value)."""
    if "attr_name" not in cols.columns:
        cols = cols.withColumn("attr_name", F.lit(None).cast("string"))
    col_key = ["page_id", "list_rank", "col_ord"]
    key = [*col_key, "row_ord"]
    sels = cols.select(*col_key, "steps")
    scopes = rows.withColumnRenamed("row_id", "scope_id").join(cols.select(*col_key), ["page_id", "list_rank"]).select(*key, "scope_id")
    m = Matcher(ps).match(scopes, sels, col_key, key[1:])
    first = m.groupBy(*key).agg(F.min("node_id").alias("node_id"))
    # empty selector = the row itself
    selfrow = scopes.join(sels.filter(F.size("steps") == 0), col_key, "left_semi").select(*key, F.col("scope_id").alias("node_id"))
    cells = first.unionByName(selfrow).join(cols.select(*col_key, "attr", "attr_name"), col_key)
    vals = node_values(ps, cells, attr_name_col="attr_name").select(*key, "value")
    # where no column reads html the union goes, and the values' size is that of their file
    grid = scopes.select(*key).join(vals.hint("merge"), key, "left").withColumn("value", F.coalesce("value", F.lit("")))
    w = Window.partitionBy("page_id", "list_rank", "row_ord")
    grid = grid.withColumn("_any", F.max((F.col("value") != "").cast("int")).over(w)).filter(F.col("_any") == 1).drop("_any")
    return grid.join(cols.select(*col_key, "name"), col_key)


def auto_extract(ps, index: int = 0, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per page pick list ``index`` (wrapping modulo the number of lists
    found), detect its columns and extract all of its rows.
    -> (cells long form, columns)"""
    lists = find_lists(ps) if lists is None else lists
    total = lists.groupBy("page_id").agg(F.count(F.lit(1)).alias("total"))
    pick = lists.join(total, "page_id").filter(F.col("list_rank") == F.pmod(F.lit(index), F.col("total")) + 1)
    rows = list_rows(ps, pick)
    from ..session import cut_lineage

    rows = cut_lineage(rows)
    cols, _ = detect_columns(ps, rows)
    cols = cut_lineage(cols)
    cells = apply_columns(ps, rows, cols)
    return cells, cols


def wide(cells: DataFrame, names: list[str]) -> DataFrame:
    """Long cells -> one STRING column per name ('' when absent)."""
    p = cells.groupBy("page_id", "row_ord").pivot("name", names).agg(F.first("value"))
    return p.na.fill("", subset=names)


def with_page_url(ds: DataFrame, pages: DataFrame) -> DataFrame:
    """Append the page url as the last column (not part of the key)."""
    return ds.join(pages.select("page_id", F.col("url").alias("Page URL")), "page_id")


def host_rollup(ds: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Flagship tail: rows de-duplicated per host on ``keys``, counted per host."""
    d = ds.join(pages.select("page_id", host_of(F.col("url")).alias("host")), "page_id")
    per = d.groupBy("host", *keys).agg(F.min("page_id").alias("p"))
    pages_per_host = d.groupBy("host").agg(F.countDistinct("page_id").alias("pages"))
    return per.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).join(pages_per_host, "host")


def recipe_extract(ps, recipes: DataFrame) -> DataFrame:
    """J10 + L16: apply every recipe of a host to every page of that host: the
    row selector is matched on the page, then the recipe's columns inside
    every row. A page's recipes are kept apart by ``list_rank`` (their order by
    name and id). -> long cells (id, page_id, list_rank, row_ord, col_ord,
    name, value)."""
    from ..session import cut_lineage
    from .recipes import pages_for

    on_page = Window.partitionBy("page_id").orderBy("name", "id")
    pr = pages_for(recipes, ps.pages).select("page_id", "id", F.row_number().over(on_page).alias("list_rank"))
    # read several times below; a row for each page, which a join would lose sight of
    pr = cut_lineage(pr.join(recipes.select("id", "row_steps", "columns"), "id"), "page-recipes")
    pick = ["page_id", "list_rank"]
    roots = ps.nodes.filter(F.col("parent_id").isNull()).select("page_id", F.col("node_id").alias("scope_id"))
    scopes = pr.select(*pick).join(roots, "page_id")
    m = Matcher(ps).match(scopes, pr.select(*pick, F.col("row_steps").alias("steps")), pick, ["list_rank"], include_scope=True)
    rows = cut_lineage(m.select(*pick, F.col("node_id").alias("row_id")).withColumn(
        "row_ord", F.row_number().over(Window.partitionBy(*pick).orderBy("row_id"))), "rows")
    cols = pr.select(*pick, F.posexplode("columns").alias("i", "c")).select(
        *pick, (F.col("i") + 1).alias("col_ord"), "c.name", "c.steps", "c.attr", "c.attr_name")
    return apply_columns(ps, rows, cols).join(pr.select("id", *pick), pick)
