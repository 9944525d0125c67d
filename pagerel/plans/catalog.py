"""Registered queries: one job per operator of the inventory, each reading
the test tables (or what Spark derives from them), plus the equivalent
DuckDB SQL used as the correctness oracle.

Node-level oracles number start tags in document order with a regex; on the
test pages every element is written out, so that index is the preorder
``node_id`` the shredder assigns."""

from __future__ import annotations

import contextlib
import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import text as TX
from ..functions.urls import absolutize, host_of, restricted_reason
from ..operators import dataset as D
from ..operators import viewer as V
from ..operators.columns import data_nodes, dedupe_names, humanize
from ..operators.extract import auto_extract, host_rollup, node_values
from ..operators.lists import find_lists, leaf_counts, list_rows, row_steps, unique_selectors
from ..operators.select import select_nodes
from ..operators.tree import PageSet, with_text
from ..schema import css, step
from ..sources import sinks as S

FIXED_CLOCK = _dt.datetime(2026, 1, 2, 3, 4, 5)
SEARCH_Q = "the"

_SHARED: dict | None = None


@contextlib.contextmanager
def shared():
    """Inside, queries of one folder share pages, lists and columns. Outside
    (by default) each query makes its own, so none depends on another."""
    global _SHARED
    _SHARED, before = {}, _SHARED
    try:
        yield
    finally:
        _SHARED = before


def _shared(key: tuple, make):
    if _SHARED is None:
        return make()
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pageset(spark: SparkSession, sf_dir: str) -> PageSet:
    """The pages table, shredded."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return _shared(("ps", sf_dir), lambda: PageSet(_read(spark, sf_dir, "pages")))


def lists_of(ps: PageSet, sf_dir: str) -> DataFrame:
    """L03 result."""
    return _shared(("lists", sf_dir), lambda: find_lists(ps))


def auto(spark: SparkSession, sf_dir: str, ps: PageSet | None = None, lists: DataFrame | None = None):
    """Cells and columns of each page's main list."""
    from ..session import cut_lineage

    def make():
        own = ps or pageset(spark, sf_dir)
        cells, cols = auto_extract(own, lists=lists if lists is not None else lists_of(own, sf_dir))
        return cut_lineage(cells), cols

    return _shared(("auto", sf_dir), make)


def derived_recipes(spark: SparkSession, sf_dir: str, ps: PageSet | None = None) -> DataFrame:
    """One recipe per host, built from the list and columns detected on the
    host's first page (row steps = container steps + child row step)."""
    from ..operators.recipes import normalize_recipes
    from ..session import cut_lineage

    if _SHARED is not None and ("recipes", sf_dir) in _SHARED:
        return _SHARED["recipes", sf_dir]
    ps = ps or pageset(spark, sf_dir)
    every = lists_of(ps, sf_dir)
    _, cols = auto(spark, sf_dir, ps, every)
    lists = every.filter(F.col("list_rank") == 1)
    pages = _read(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"))
    first = pages.groupBy("host").agg(F.min("page_id").alias("page_id"))
    l = lists.join(first, "page_id").select("host", "page_id", row_steps().alias("row_steps"))
    c = cols.join(first, "page_id").groupBy("page_id").agg(F.array_sort(
        F.collect_list(F.struct("col_ord", F.struct("name", "steps", "attr", F.lit("").alias("attr_name")).alias("c"))),
        lambda a, b: F.when(a["col_ord"] < b["col_ord"], -1).when(a["col_ord"] > b["col_ord"], 1).otherwise(0)).alias("cs"))
    r = l.join(c, "page_id").select(
        F.concat(F.lit("r-"), F.col("host")).alias("id"), F.concat(F.col("host"), F.lit(" list")).alias("name"), "host",
        "row_steps", F.transform("cs", lambda x: x["c"]).alias("columns"),
        F.lit(None).cast("struct<type:string,target:struct<steps:array<struct<comb:string,tag:string,id:string,classes:array<string>,attrs:map<string,string>,nth:int,text:string,has_child:string>>,text:string,aria:string,rel:string>,max_pages:int,delay_ms:int,timeout_ms:int>").alias("pagination"),
        F.lit(None).cast("struct<dedupe:boolean,append:boolean,page_url:boolean>").alias("options"))
    return _shared(("recipes", sf_dir), lambda: cut_lineage(normalize_recipes(r)))


def _rows(spark, sf_dir) -> DataFrame:
    """(page_id, row_ord, cells, Link, Link Text): rows with all their columns,
    and two of them by name."""
    from ..operators.run import as_rows

    cells, _ = auto(spark, sf_dir)
    named = lambda n: F.coalesce(F.get(F.filter("cells", lambda c: c["name"] == n), F.lit(0))["value"], F.lit("")).alias(n)
    return as_rows(cells, ["page_id", "row_ord"]).select("page_id", "row_ord", "cells", named("Link"), named("Link Text"))


# ----------------------------------------------------------------------------
# queries
# ----------------------------------------------------------------------------
def q_s01(spark, d):
    p = _read(spark, d, "pages")
    return p.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


def q_s02(spark, d):
    ps = pageset(spark, d)
    return ps.nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def q_s03(spark, d):
    p = _read(spark, d, "pages")
    toks = F.regexp_extract_all(F.col("html"), F.lit("<[^>]+>"), 0)
    return p.select("page_id", F.size(toks).cast("bigint").alias("n_tokens"))


def q_s06(spark, d):
    docs = _read(spark, d, "documents")
    return S.csv_lines(docs, ["doc_id", "text", "lang", "source"], keep=["doc_id"])


def q_s06_events(spark, d):
    ev = _read(spark, d, "events")
    return S.csv_lines(ev, ["event_id", "event_type", "props"], keep=["event_id"])


def q_s07(spark, d):
    docs = _read(spark, d, "documents")
    return S.tsv_lines(docs, ["doc_id", "text", "lang", "source"], keep=["doc_id"])


def q_s08(spark, d):
    cu = _read(spark, d, "customer")
    return S.json_objects(cu, ["c_custkey", "c_name", "c_mktsegment"], keep=["c_custkey"])


def q_s09(spark, d):
    docs = _read(spark, d, "documents")
    cols = ["text", "lang", "source"]
    return docs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), S.looks_like_formula(F.coalesce(F.col(c), F.lit(""))).alias("g")) for c in cols])).alias("x")).groupBy(
        F.col("x.col_name").alias("col_name")).agg(F.count_if(F.col("x.g")).alias("n_guarded"), F.count(F.lit(1)).alias("n"))


def q_s10(spark, d):
    ev = _read(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("value"), "props")
    rn = D.row_numbers(ev, ["event_id"])
    cells = S.sheet_cells(rn, ["event_type", "value", "props"])
    return cells.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "ref", "kind",
                        F.col("style").cast("bigint").alias("style"), "preserve", "text")


def q_s11(spark, d):
    part = _read(spark, d, "part")
    return part.select("p_partkey", S.column_letter(F.col("p_partkey")).alias("letter"))


def q_s12(spark, d):
    part = _read(spark, d, "part")
    w = S.column_widths(part, ["p_name", "p_brand", "p_type", "p_size"], ["p_partkey"])
    return w.select(F.col("col").cast("bigint").alias("col"), "name", F.col("width").cast("bigint").alias("width"))


def q_s13(spark, d):
    p = _read(spark, d, "pages")
    h = p.select(host_of(F.col("url")).alias("host")).distinct()
    return h.select("host", S.export_stem(F.col("host"), F.lit(FIXED_CLOCK).cast("timestamp")).alias("stem"))


def q_p01(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", TX.clean(F.col("text")).alias("text_clean"))


def q_p02(spark, d):
    ps = pageset(spark, d)
    n = ps.nodes.filter(F.col("tag").isin("title", "h1")).select("page_id", "tag", "t_start", "t_end")
    return with_text(ps, n).select("page_id", "tag", TX.clean(F.col("raw_text")).alias("text"))


def q_p04(spark, d):
    ps = pageset(spark, d)
    n = ps.nodes.filter(F.col("tag") == "a").select("page_id", "t_start", "t_end")
    m = with_text(ps, n).select("page_id", TX.match_text(F.col("raw_text")).alias("text"))
    return m.groupBy("page_id", "text").agg(F.count(F.lit(1)).alias("n"))


def q_p05(spark, d):
    ps = pageset(spark, d)
    a = ps.nodes.filter(F.col("usable_a")).select("page_id", F.col("node_id").cast("bigint").alias("node_id"),
                                                  F.col("attrs")["href"].alias("href"))
    return a.join(ps.info.select("page_id", "base"), "page_id").select(
        "page_id", "node_id", absolutize(F.col("href"), F.col("base")).alias("url"))


def q_p08(spark, d):
    ps = pageset(spark, d)
    ex = ps.nodes.select("page_id", "node_id", F.explode("classes").alias("class"))
    return ex.groupBy("class").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("page_id").alias("n_pages")).select(
        "class", C.class_kind(F.col("class")).alias("kind"), "n_nodes", "n_pages")


def q_p11(spark, d):
    docs = _read(spark, d, "documents")
    tok = docs.select(F.explode(F.split(F.col("text"), "[ \t\r\n]+")).alias("token")).filter(C.looks_random(F.col("token")))
    return tok.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def q_p10(spark, d):
    docs = _read(spark, d, "documents")
    tok = docs.select(F.explode(F.split(F.col("text"), "[ \t\r\n]+")).alias("token")).filter(F.col("token") != "")
    return tok.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", C.is_stable_id(F.col("token")).alias("stable"), "n")


def q_p12(spark, d):
    ps = pageset(spark, d)
    return ps.nodes.select("page_id", F.col("node_id").cast("bigint").alias("node_id"),
                           TX.describe(F.col("tag"), F.col("id"), F.col("classes")).alias("label"))


def q_p14(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select(TX.value_kind(F.col("text")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def q_p15(spark, d):
    docs = _read(spark, d, "documents")
    tok = docs.select(F.explode(F.split(F.col("source"), "[ /.]+")).alias("token")).filter(F.col("token") != "").distinct()
    return tok.select("token", humanize(F.col("token")).alias("name"))


def q_p16(spark, d):
    cu = _read(spark, d, "customer")
    return cu.select("c_custkey", TX.fnv1a36(F.col("c_name")).alias("fp"))


def q_p17(spark, d):
    p = _read(spark, d, "pages")
    return p.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))


def q_p18(spark, d):
    p = _read(spark, d, "pages")
    return p.select(restricted_reason(F.col("url")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


NAV_LINKS = css(("desc", step("nav")), ("child", step("ul")), ("child", step("li")), ("child", step("a")))


def q_f01(spark, d):
    ps = pageset(spark, d)
    return select_nodes(ps, NAV_LINKS).select("page_id", F.col("node_id").cast("bigint").alias("node_id"))


def q_f05(spark, d):
    ps = pageset(spark, d)
    return ps.nodes.filter(F.col("usable_a")).select("page_id", F.col("node_id").cast("bigint").alias("node_id"),
                                                     F.col("attrs")["href"].alias("href"))


def q_f09(spark, d):
    ps = pageset(spark, d)
    m = select_nodes(ps, css(("desc", step("ul")), ("child", step("li"))))
    per = ps.pages.select("page_id").join(m.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")), "page_id", "left")
    per = per.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return per.select("page_id", "n", F.when(F.col("n") == 1, "unique").when(F.col("n") == 0, "0")
                      .otherwise(F.concat(F.col("n").cast("string"), F.lit(" matches"))).alias("status"))


def q_n01(spark, d):
    ps = pageset(spark, d)
    return ps.nodes.filter(F.col("tag") == "li").select("page_id", F.col("node_id").cast("bigint").alias("node_id"),
                                                          F.col("nth").cast("bigint").alias("nth"),
                                                          F.col("nth_count").cast("bigint").alias("nth_count"))


def q_a01(spark, d):
    ps = pageset(spark, d)
    li = ps.nodes.filter(F.col("tag") == "li").select("page_id", F.col("node_id").alias("root_id"))
    return leaf_counts(ps.nodes, li).select("page_id", F.col("root_id").cast("bigint").alias("node_id"),
                                               F.col("leaves").cast("bigint").alias("leaves"))


def _links_ds(spark, d):
    p = _read(spark, d, "pages").select("page_id", host_of(F.col("url")).alias("host"))
    return _rows(spark, d).join(p, "page_id").select("host", F.col("page_id").alias("page_ord"), "row_ord", "cells", "Link", "Link Text")


def q_a05(spark, d):
    ds = _links_ds(spark, d)
    out = D.dedupe(ds, ["host", "cells"])
    return out.select("host", "Link", "Link Text", F.col("page_ord").alias("first_page"), F.col("row_ord").cast("bigint").alias("first_row"))


def q_a06(spark, d):
    ds = _links_ds(spark, d)
    p = _read(spark, d, "pages").select(F.col("page_id").alias("page_ord"), F.col("url").startswith("https").alias("tls"))
    ds = ds.join(p, "page_ord")
    stored = ds.filter(F.col("tls"))
    incoming = ds.filter(~F.col("tls"))
    return D.new_rows(incoming, stored, ["Link Text"]).select(
        "page_ord", F.col("row_ord").cast("bigint").alias("row_ord"), "Link", "Link Text")


def q_a07(spark, d):
    ps = pageset(spark, d)
    title = ps.nodes.filter(F.col("tag") == "title").groupBy("page_id").agg(F.min_by(F.struct("t_start", "t_end"), "node_id").alias("t"))
    title = with_text(ps, title.select("page_id", "t.t_start", "t.t_end")).select("page_id", TX.clean(F.col("raw_text")).alias("title"))
    t = title.join(ps.info.select("page_id", "url"), "page_id", "right").na.fill("", ["title"])
    runs = t.select(host_of(F.col("url")).alias("dataset"), F.col("page_id").alias("page_ord"), "url", "title",
                    host_of(F.col("url")).alias("host"), F.lit(FIXED_CLOCK).cast("timestamp").alias("ts"))
    return D.dataset_meta(runs).select(F.col("dataset").alias("host_key"), "pages", "source", "title", "host")


def q_a08(spark, d):
    ds = _links_ds(spark, d)
    firsts = D.dedupe(ds, ["host", "cells"])
    seen = ds.groupBy("host", "page_ord").agg(F.count(F.lit(1)).alias("rows_seen"))
    new = firsts.groupBy("host", "page_ord").agg(F.count(F.lit(1)).alias("rows_new"))
    return seen.join(new, ["host", "page_ord"], "left").select("host", "page_ord", "rows_seen",
                                                                F.coalesce("rows_new", F.lit(0)).cast("bigint").alias("rows_new"))


def q_a10(spark, d):
    o = _read(spark, d, "orders")
    return D.dataset_counts(o, o.columns)


def q_n02(spark, d):
    part = _read(spark, d, "part")
    return dedupe_names(part, ["p_size"], "p_partkey", name="p_brand").select("p_size", "p_partkey", "name")


def q_t01(spark, d):
    cu = _read(spark, d, "customer").select("c_custkey", "c_name")
    rn = D.row_numbers(cu, [V.natural_key(F.col("c_name")), F.col("c_custkey")])
    return rn.select("c_custkey", "c_name", F.col("row_no").alias("pos"))


def q_t02(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return V.page(o, ["o_orderkey"], 2, 100).select("o_orderkey", "o_totalprice")


def q_t03(spark, d):
    return V.preview(_rows(spark, d), ["page_id", "row_ord"]).select("page_id", F.col("row_ord").cast("bigint").alias("row_ord"), "Link", "Link Text")


def q_l03(spark, d):
    fl = lists_of(pageset(spark, d), d)
    return fl.select("page_id", F.col("list_rank").cast("bigint").alias("list_rank"), "row_selector", "row_count", "score")


def q_l11(spark, d):
    ps = pageset(spark, d)
    fl = lists_of(ps, d).filter(F.col("list_rank") == 1)
    rows = list_rows(ps, fl)
    dn = data_nodes(ps, rows)
    return dn.select("page_id", F.col("row_id").cast("bigint").alias("row_id"), F.col("node_id").cast("bigint").alias("node_id"),
                     "attr", F.col("ord").cast("bigint").alias("ord"))


def q_l14(spark, d):
    _, cols = auto(spark, d)
    return cols.select("page_id", F.col("col_ord").cast("bigint").alias("col_ord"), "name", "sel", "attr",
                       F.col("fill").cast("bigint").alias("fill"))


def q_l16(spark, d):
    cells, _ = auto(spark, d)
    return cells.select("page_id", F.col("row_ord").cast("bigint").alias("row_ord"),
                        F.col("col_ord").cast("bigint").alias("col_ord"), "name", "value")


def q_l18(spark, d):
    # rows as they are: every detected column counts, whatever its name
    cells, _ = auto(spark, d)
    ds = cells.groupBy("page_id", "row_ord").agg(F.sort_array(F.collect_list(F.struct("col_ord", "name", "value"))).alias("cells"))
    return host_rollup(ds, _read(spark, d, "pages"), ["cells"]).select(
        "host", F.col("rows").cast("bigint").alias("rows"), F.col("pages").cast("bigint").alias("pages"))


def q_l06(spark, d):
    ps = pageset(spark, d)
    ul = ps.nodes.filter(F.col("tag").isin("ul", "nav", "article", "div", "footer")).select("page_id", "node_id")
    u = unique_selectors(ps, ul)
    return u.select("page_id", F.col("node_id").cast("bigint").alias("node_id"), "selector")


def q_u01(spark, d):
    cu = _read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("Name"),
                                            F.col("c_mktsegment").alias("Segment"))
    su = _read(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("key"), F.col("s_name").alias("Name"),
                                            F.col("s_nationkey").cast("string").alias("Nation"))
    return D.merge(cu, su)


def q_v01(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return V.search(docs, SEARCH_Q).select("doc_id")


def q_v02(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text")
    return V.mark(docs, "text", SEARCH_Q).select("doc_id", "before", "hit", "after")


def q_v03(spark, d):
    p = _read(spark, d, "pages").select("page_id", "url")
    return V.cell_kinds(p, "url").select("page_id", "kind", "shown")


def q_v04(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return V.search_counts(docs, SEARCH_Q)


def q_v05(spark, d):
    cu = _read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    hit = V.search(cu, "building")
    return S.csv_lines(hit, ["c_custkey", "c_name", "c_mktsegment"], keep=["c_custkey"])


def q_r01(spark, d):
    r = derived_recipes(spark, d)
    return r.select("host", "name", F.size("columns").cast("bigint").alias("n_columns"), F.size("row_steps").cast("bigint").alias("n_steps"),
                    F.col("pagination.type").alias("pagination"), F.col("pagination.max_pages").cast("bigint").alias("max_pages"),
                    F.col("pagination.delay_ms").cast("bigint").alias("delay_ms"), F.col("pagination.timeout_ms").cast("bigint").alias("timeout_ms"),
                    F.col("options.dedupe").alias("dedupe"))


def q_r04(spark, d):
    from ..operators.recipes import check_recipes

    return check_recipes(derived_recipes(spark, d)).select("host", "reason")


def q_s05(spark, d):
    from ..operators.recipes import export_recipes

    r = derived_recipes(spark, d)
    return export_recipes(r).select("slug", F.get_json_object("json", "$.version").cast("bigint").alias("version"),
                                    F.get_json_object("json", "$.recipe.host").alias("host"),
                                    F.get_json_object("json", "$.recipe.columns[1].name").alias("second_column"))


def q_j10(spark, d):
    from ..operators.extract import recipe_extract

    ps = pageset(spark, d)
    cells = recipe_extract(ps, derived_recipes(spark, d, ps))
    return cells.select("page_id", F.col("row_ord").cast("bigint").alias("row_ord"),
                        F.col("col_ord").cast("bigint").alias("col_ord"), "name", "value")


def q_t05(spark, d):
    from ..operators.recipes import rank_recipes

    r = rank_recipes(derived_recipes(spark, d), _read(spark, d, "pages"))
    return r.select("page_id", "host", "recipe_id", "same_host")


def q_l01(spark, d):
    from ..operators.explorer import detect_lists

    ps = pageset(spark, d)
    first_link = ps.nodes.filter(F.col("usable_a")).groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    r = detect_lists(ps, first_link)
    return r.select("page_id", F.col("level").cast("bigint").alias("level"), "row_selector")


def q_l02(spark, d):
    from ..operators.explorer import detect_lists_pairs

    ps = pageset(spark, d)
    a = ps.nodes.filter(F.col("usable_a")).groupBy("page_id").agg(F.min("node_id").alias("a_id"), F.max("node_id").alias("b_id"))
    r = detect_lists_pairs(ps, a)
    return r.select("page_id", F.col("level").cast("bigint").alias("level"), "row_selector")


def q_l09(spark, d):
    from ..operators.explorer import xpaths

    ps = pageset(spark, d)
    a = ps.nodes.filter(F.col("usable_a")).select("page_id", "node_id")
    return xpaths(ps, a).select("page_id", F.col("node_id").cast("bigint").alias("node_id"), "xpath")


def q_j02(spark, d):
    from ..operators.tree import lca

    ps = pageset(spark, d)
    a = ps.nodes.filter(F.col("usable_a")).groupBy("page_id").agg(F.min("node_id").alias("a_id"), F.max("node_id").alias("b_id"))
    return lca(ps.nodes, a).select("page_id", F.col("lca_id").cast("bigint").alias("lca_id"))


def q_j04(spark, d):
    from ..operators.tree import neighbourhood

    ps = pageset(spark, d)
    li = ps.nodes.filter(F.col("tag") == "li").select("page_id", "node_id")
    n = neighbourhood(ps.nodes, li)
    return n.select("page_id", F.col("node_id").cast("bigint").alias("node_id"), F.col("prev_id").cast("bigint").alias("prev_id"),
                    F.col("next_id").cast("bigint").alias("next_id"), F.col("index").cast("bigint").alias("index"),
                    F.col("sibling_count").cast("bigint").alias("sibling_count"))


def q_g03(spark, d):
    from ..operators.pager import is_disabled

    ps = pageset(spark, d)
    return is_disabled(ps).groupBy("page_id").agg(F.count_if("disabled").alias("n_disabled"))


def q_g05(spark, d):
    from ..operators.pager import page_signatures

    ps = pageset(spark, d)
    rows = list_rows(ps, lists_of(ps, d).filter(F.col("list_rank") == 1))
    return page_signatures(ps, rows).select("page_id", "url", "n", "fp_first", "fp_last", "sig")


def q_p13(spark, d):
    from ..operators.explorer import element_profile

    ps = pageset(spark, d)
    h1 = ps.nodes.filter(F.col("tag") == "h1").select("page_id", "node_id")
    return element_profile(ps, h1).select("page_id", "tag", "text", F.col("children").cast("bigint").alias("children"), "visible", "href", "src")


def q_g06(spark, d):
    from ..operators.pager import is_disabled, page_chain, page_signatures, resolve_targets

    ps = pageset(spark, d)
    t = ps.pages.select("page_id", F.lit("Next").alias("text"), F.lit("").alias("aria"), F.lit("next").alias("rel"))
    res = resolve_targets(ps, t)
    href = ps.nodes.select("page_id", "node_id", F.col("attrs")["href"].alias("href"))
    nl = res.join(href, ["page_id", "node_id"]).join(is_disabled(ps), ["page_id", "node_id"]).filter(F.col("href").isNotNull())
    rows = list_rows(ps, lists_of(ps, d).filter(F.col("list_rank") == 1))
    chain = page_chain(ps, nl.select("page_id", "href", "disabled"), None, page_signatures(ps, rows).select("page_id", "n", "sig"))
    return chain.select(F.col("start_id").cast("bigint").alias("start_id"), F.col("step").cast("bigint").alias("step"),
                        F.col("page_id").cast("bigint").alias("page_id"), "reason")


def derived_pages(spark: SparkSession, sf_dir: str) -> PageSet:
    """The pages rendered from the customer table, shredded once."""
    from .derived import customer_pages

    return _shared(("derived", sf_dir), lambda: PageSet(customer_pages(spark, sf_dir)))


def q_j10_several(spark, d):
    from ..operators.extract import recipe_extract
    from ..operators.recipes import normalize_recipes
    from .derived import customer_recipes

    cells = recipe_extract(derived_pages(spark, d), normalize_recipes(customer_recipes(spark, d)))
    return cells.select(F.split("id", "@")[0].alias("recipe"), "page_id", F.col("row_ord").cast("bigint").alias("row_ord"), "name", "value")


def q_s04(spark, d):
    import uuid

    from ..operators.recipes import normalize_recipes, read_recipes, write_recipes
    from ..session import ensure_checkpoint_dir
    from .derived import customer_recipes

    at = f"{ensure_checkpoint_dir(spark)}/recipes-{uuid.uuid4().hex}"
    write_recipes(normalize_recipes(customer_recipes(spark, d)), at)
    return read_recipes(spark, at).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def q_f03(spark, d):
    hits = select_nodes(derived_pages(spark, d), css(("desc", step("td", text="BUILDING"))))
    return hits.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def q_j09(spark, d):
    from ..operators.explorer import header_names

    ps = derived_pages(spark, d)
    td = ps.nodes.filter(F.col("tag") == "td").select("page_id", F.col("parent_id").alias("row"), F.col("node_id").alias("el"))
    return header_names(ps, td).groupBy("page_id", "header").agg(F.count(F.lit(1)).alias("n"))


def q_g06_customers(spark, d):
    from ..operators.pager import is_disabled, page_chain, page_signatures, resolve_targets

    ps = derived_pages(spark, d)
    t = ps.pages.select("page_id", F.lit("Onward").alias("text"), F.lit("").alias("aria"), F.lit("next").alias("rel"))
    res = resolve_targets(ps, t).join(ps.nodes.select("page_id", "node_id", F.col("attrs")["href"].alias("href")), ["page_id", "node_id"])
    nl = res.join(is_disabled(ps), ["page_id", "node_id"]).select("page_id", "href", "disabled")
    rows = ps.nodes.filter((F.col("tag") == "tr") & F.array_contains("child_tags", "td")).select("page_id", F.col("node_id").alias("row_id"))
    return page_chain(ps, nl, None, page_signatures(ps, rows).select("page_id", "n", "sig"))


def q_l06_every(spark, d):
    """Every node of pages whose containers have no class: what its selector matches."""
    from ..operators.select import Matcher

    ps = derived_pages(spark, d)
    u = unique_selectors(ps, ps.nodes).withColumnRenamed("node_id", "target_id")
    m = Matcher(ps).match(u.select("page_id", F.lit(0).alias("scope_id"), "target_id"), u.select("page_id", "target_id", "steps"),
                          ["page_id", "target_id"], ["target_id"], include_scope=True, texts=False)
    per = m.groupBy("page_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("node_id"))
    met = u.join(per, ["page_id", "target_id"], "left")
    return met.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if((F.col("n") == 1) & (F.col("node_id") == F.col("target_id"))).alias("n_unique"),
                                      F.count_if(F.col("steps").isNull()).alias("n_without"), F.count_if(F.col("phase") == 3).alias("n_paths"))


def q_l06_cells(spark, d):
    ps = derived_pages(spark, d)
    return unique_selectors(ps, ps.nodes.filter("tag = 'td'")).select("page_id", "selector")


def q_f09_rows(spark, d):
    """Selectors tried inside the rows of the customer tables."""
    from ..operators.select import steps_lit, validate

    ps = derived_pages(spark, d)
    rows = select_nodes(ps, css(("desc", step("tr")))).withColumnRenamed("node_id", "row_id")
    kinds = F.array(F.struct(F.lit("td").alias("sel"), steps_lit(css(("child", step("td")))).alias("steps")), F.struct(F.lit("a").alias("sel"), steps_lit(css(("desc", step("a")))).alias("steps")),
                    F.struct(F.lit("th").alias("sel"), steps_lit(css(("child", step("th")))).alias("steps")))
    sels = ps.pages.select("page_id", F.explode(kinds).alias("k")).select("page_id", "k.*")
    return validate(ps, sels, rows).select("page_id", "sel", "matches", "rows_with", "n_rows", "status")


def q_w01(spark, d):
    from ..streaming.incremental import stream_extract_links

    return stream_extract_links(spark, d)


QUERIES = {
    "S01_pages": q_s01, "S02_tag_counts": q_s02, "S03_tokens": q_s03, "S06_csv_documents": q_s06,
    "S06_csv_events": q_s06_events, "S07_tsv": q_s07, "S08_json": q_s08, "S09_guard_audit": q_s09,
    "S10_sheet_cells": q_s10, "S11_column_letters": q_s11, "S12_column_widths": q_s12, "S13_export_stems": q_s13,
    "P01_clean": q_p01, "P02_node_text": q_p02, "P04_match_text": q_p04, "P05_absolute_links": q_p05,
    "P08_class_profile": q_p08, "P10_id_profile": q_p10, "P11_random_tokens": q_p11, "P12_describe": q_p12,
    "P14_value_kinds": q_p14, "P15_token_names": q_p15, "P16_fingerprints": q_p16, "P17_hosts": q_p17,
    "P18_restricted": q_p18, "F01_select_nodes": q_f01, "F05_usable_links": q_f05, "F09_validate": q_f09,
    "N01_nth_of_type": q_n01, "N02_dedupe_names": q_n02, "A01_leaf_counts": q_a01, "A05_dedupe": q_a05,
    "A06_new_rows": q_a06, "A07_dataset_meta": q_a07, "A08_run_report": q_a08, "A10_dataset_counts": q_a10,
    "T01_natural_sort": q_t01, "T02_page": q_t02, "T03_preview": q_t03, "L03_find_lists": q_l03,
    "L06_unique_selectors": q_l06, "L11_data_nodes": q_l11, "L14_detect_columns": q_l14, "L16_extract": q_l16,
    "L18_auto_extract": q_l18, "U01_merge": q_u01, "V01_search": q_v01, "V02_mark": q_v02, "V03_cell_kinds": q_v03,
    "V04_search_counts": q_v04, "V05_export_view": q_v05, "W01_stream_extract": q_w01,
    "R01_normalize_recipes": q_r01, "R04_check_recipes": q_r04, "S05_export_recipes": q_s05, "J10_recipe_extract": q_j10,
    "T05_rank_recipes": q_t05, "L01_detect_list": q_l01, "L02_detect_list_pairs": q_l02, "L09_xpaths": q_l09, "J02_lca": q_j02, "J04_neighbourhood": q_j04,
    "G03_disabled": q_g03, "G05_page_signatures": q_g05, "G06_page_chain": q_g06, "J10_several_recipes": q_j10_several,
    "L06_every_node": q_l06_every, "L06_cell_selectors": q_l06_cells, "F09_validate_in_rows": q_f09_rows,
    "S04_recipe_round_trip": q_s04, "F03_text_steps": q_f03, "J09_header_names": q_j09, "G06_customer_chains": q_g06_customers, "P13_element_profile": q_p13,
}

from . import runs as _runs  # noqa: E402  (its queries use the pages above)

QUERIES.update(_runs.QUERIES)
