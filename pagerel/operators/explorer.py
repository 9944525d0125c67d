"""Element explorer and example-driven list detection: element profile (P13),
own text / image url / visibility helpers (P03, P06, F06-F08), selector
model and rendering (L07, L08), absolute paths (L09), similar siblings
(J07, J08), table header names (J09), detect list from an example (L01,
N04), level shift (L05) and picked columns (L15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import rules
from ..functions.selectors import css_escape, css_string, xpath_string
from ..functions.text import clean, match_text
from .lists import leaf_counts, model_attrs, row_selectors, row_steps, unique_selectors
from .select import make_step
from .tree import signatures, with_text
from ..session import cut_lineage


# -- P03 / F06-F08 --------------------------------------------------------------------
def own_texts(ps) -> DataFrame:
    """Direct text nodes joined by spaces, cleaned (computed while shredding)."""
    return ps.nodes.select("page_id", "node_id", "own_text")


def formatting_flags(ps) -> DataFrame:
    """Formatting subtree and text-container flags."""
    return ps.nodes.select("page_id", "node_id", F.col("fmt").alias("formatting"), F.col("text_container"))


def visible(ps) -> DataFrame:
    """elements without a hidden ancestor-or-self (hidden attribute or
    inline display:none / visibility:hidden)."""
    return ps.nodes.filter(~F.col("hidden"))


# -- P13 ---------------------------------------------------------------------------------
def element_profile(ps, targets: DataFrame) -> DataFrame:
    """Tag, text, own text, child count, visible, value, href, img src
    and all attributes, each in full."""
    from .extract import node_values

    t = targets.select("page_id", "node_id").distinct()
    n = ps.nodes.join(t, ["page_id", "node_id"], "left_semi")
    base = with_text(ps, n).select(
        "page_id", "node_id", "tag", clean(F.col("raw_text")).alias("text"), "own_text",
        F.col("n_children").alias("children"), (~F.col("hidden")).alias("visible"),
        F.coalesce(F.col("attrs")["value"], F.lit("")).alias("value"), F.col("attrs").alias("attributes"),
    )
    modes = t.select("page_id", "node_id", F.explode(F.array(F.lit("href"), F.lit("src"))).alias("attr"))
    vals = node_values(ps, modes).groupBy("page_id", "node_id").pivot("attr", ["href", "src"]).agg(F.first("value"))
    return base.join(vals, ["page_id", "node_id"], "left")


# -- L07 / L08 ------------------------------------------------------------------------------
PART = "struct<k:string,n:string,v:string,stable:boolean,kind:string,on:boolean>"


def _part(k: str, v: Column, n: Column | None = None, stable: Column | None = None, kind: Column | None = None, on: Column | None = None) -> Column:
    """One part of a model node; switched off unless ``on``."""
    no, nob = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return F.struct(F.lit(k).alias("k"), (no if n is None else n).alias("n"), v.alias("v"), (nob if stable is None else stable).alias("stable"),
                    (no if kind is None else kind).alias("kind"), (F.lit(False) if on is None else on).alias("on"))


def selector_parts(ps, targets: DataFrame, text_max: int | None = None) -> DataFrame:
    """The editable model of each target: per chain node (body..target)
    the parts tag, id (+stable), classes (+kind), allowed attributes, nth if
    the count > 1, text (if <= ``text_max`` characters; None: any length). On
    the target, tag, stable id and semantic classes are switched on; L08
    renders what is on.
    -> (page_id, target_id, level, node_id, tag, is_svg, label, on, parts)"""
    from ..functions.text import describe

    t = targets.select("page_id", F.col("node_id").alias("target_id")).join(
        ps.nodes.select("page_id", F.col("node_id").alias("target_id"), "anc"), ["page_id", "target_id"])
    ch = t.select("page_id", "target_id", F.posexplode("anc").alias("pos", "node_id")).filter(F.col("pos") >= 1)
    ch = with_text(ps, ch.join(ps.nodes, ["page_id", "node_id"]))
    mt = match_text(F.col("raw_text"))
    target = F.col("node_id") == F.col("target_id")
    none = F.array().cast(f"array<{PART}>")
    stable = C.is_stable_id(F.col("id"))
    parts = F.concat(
        F.array(_part("tag", F.col("tag"), on=target)),
        F.when(F.col("id") != "", F.array(_part("id", F.col("id"), stable=stable, on=target & stable))).otherwise(none),
        F.transform("classes", lambda c: _part("class", c, kind=C.class_kind(c), on=target & (C.class_kind(c) == "semantic"))),
        F.transform(model_attrs(F.col("attr_names"), F.col("attrs")), lambda p: _part("attr", p["v"], n=p["n"])),
        F.when(F.col("nth_count") > 1, F.array(_part("nth", F.col("nth").cast("string")))).otherwise(none),
        F.when((mt != "") & (F.lit(text_max is None) | (F.length(mt) <= F.lit(text_max or 0))), F.array(_part("text", mt))).otherwise(none),
    )
    return ch.select("page_id", "target_id", (F.col("pos") - 1).alias("level"), "node_id", "tag", "is_svg", target.alias("on"),
                     describe(F.col("tag"), F.col("id"), F.col("classes")).alias("label"), parts.alias("parts"))


def render_node_css(tag: Column, parts: Column) -> Column:
    """L08 for one model node: enabled parts -> CSS (tag only when switched
    on or with nth; '*' when nothing is on). parts carry an ``on`` flag."""
    on = F.filter(parts, lambda p: p["on"])
    has_nth = F.exists(on, lambda p: p["k"] == "nth")
    head = F.when(F.exists(on, lambda p: p["k"] == "tag") | has_nth, css_escape(tag)).otherwise(F.lit(""))
    body = F.array_join(F.transform(on, lambda p: F.when(p["k"] == "id", F.concat(F.lit("#"), css_escape(p["v"])))
                                    .when(p["k"] == "class", F.concat(F.lit("."), css_escape(p["v"])))
                                    .when(p["k"] == "attr", F.concat(F.lit("["), css_escape(p["n"]), F.lit("="), css_string(p["v"]), F.lit("]")))
                                    .otherwise(F.lit(""))), "")
    nth = F.array_join(F.transform(F.filter(on, lambda p: p["k"] == "nth"), lambda p: F.concat(F.lit(":nth-of-type("), p["v"], F.lit(")"))), "")
    s = F.concat(head, body, nth)
    return F.when(s == "", F.lit("*")).otherwise(s)


def render_node_xpath(tag: Column, is_svg: Column, parts: Column) -> Column:
    """L08 for one model node in XPath form (svg by local-name)."""
    on = F.filter(parts, lambda p: p["on"])
    has_nth = F.exists(on, lambda p: p["k"] == "nth")
    named = F.exists(on, lambda p: p["k"] == "tag") | has_nth
    head = (F.when(~named, F.lit("*")).when(is_svg, F.concat(F.lit("*[local-name()='"), tag, F.lit("']"))).otherwise(tag))
    nth = F.array_join(F.transform(F.filter(on, lambda p: p["k"] == "nth"), lambda p: F.concat(F.lit("["), p["v"], F.lit("]"))), "")
    preds = F.array_join(F.transform(on, lambda p: F.when(p["k"] == "id", F.concat(F.lit("[@id="), xpath_string(p["v"]), F.lit("]")))
                                     .when(p["k"] == "class", F.concat(F.lit("[contains(concat(' ', normalize-space(@class), ' '), "),
                                                                        xpath_string(F.concat(F.lit(" "), p["v"], F.lit(" "))), F.lit(")]")))
                                     .when(p["k"] == "attr", F.concat(F.lit("[@"), p["n"], F.lit("="), xpath_string(p["v"]), F.lit("]")))
                                     .when(p["k"] == "text", F.concat(F.lit("[normalize-space(.)="), xpath_string(p["v"]), F.lit("]")))
                                     .otherwise(F.lit(""))), "")
    return F.concat(head, nth, preds)


def render_model(model: DataFrame, key: list[str]) -> DataFrame:
    """Compile each model (rows = chain nodes with ``on`` and parts
    carrying ``on``) to CSS, or to XPath when any enabled node has an
    enabled text part. Adjacent enabled nodes join with the child
    combinator, gaps with the descendant one."""
    m = model.withColumn("css", render_node_css(F.col("tag"), F.col("parts"))).withColumn(
        "xp", render_node_xpath(F.col("tag"), F.col("is_svg"), F.col("parts"))).withColumn(
        "has_text", F.exists("parts", lambda p: p["on"] & (p["k"] == "text")))
    on = m.filter(F.col("on"))
    g = on.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("level", "css", "xp"))).alias("ns"),
                             F.max(F.col("has_text").cast("int")).alias("use_xpath"))

    def join_nodes(field, child_sep, desc_sep, first_prefix):
        idx = F.sequence(F.lit(1), F.size("ns"))
        return F.array_join(F.transform(idx, lambda i: F.concat(
            F.when(i == 1, F.lit(first_prefix)).when(
                F.try_element_at(F.col("ns"), i)["level"] == F.try_element_at(F.col("ns"), F.greatest(i - 1, F.lit(1)))["level"] + 1, F.lit(child_sep)).otherwise(F.lit(desc_sep)),
            F.try_element_at(F.col("ns"), i)[field])), "")

    return g.select(*key, F.when(F.col("use_xpath") == 1, join_nodes("xp", "/", "//", "//"))
                    .otherwise(join_nodes("css", " > ", " ", "")).alias("selector"))


# -- L09 ---------------------------------------------------------------------------------------
def xpaths(ps, targets: DataFrame) -> DataFrame:
    """XPath anchored on the closest element with a stable id that is
    unique in its page, else absolute from the root; an index only when
    several same-tag siblings exist; svg elements by local-name."""
    nodes = ps.nodes
    t = targets.select("page_id", F.col("node_id").alias("target_id")).join(
        nodes.select("page_id", F.col("node_id").alias("target_id"), "anc"), ["page_id", "target_id"])
    ex = t.select("page_id", "target_id", F.posexplode("anc").alias("pos", "node_id"))
    idn = nodes.filter(F.col("id") != "").groupBy("page_id", "id").agg(F.count(F.lit(1)).alias("idn"))
    info = nodes.select("page_id", "node_id", "tag", "is_svg", "id", "nth", "nth_count").join(idn, ["page_id", "id"], "left")
    ex = ex.join(info.hint("merge"), ["page_id", "node_id"])
    anchor = C.is_stable_id(F.col("id")) & (F.col("idn") == 1)
    w = Window.partitionBy("page_id", "target_id")
    ex = ex.withColumn("apos", F.max(F.when(anchor, F.col("pos"))).over(w))
    ex = ex.filter(F.col("apos").isNull() | (F.col("pos") >= F.col("apos")))
    name = F.when(F.col("is_svg"), F.concat(F.lit("*[local-name()='"), F.col("tag"), F.lit("']"))).otherwise(F.col("tag"))
    stepx = F.when(F.col("pos") == F.col("apos"), F.concat(F.lit("//*[@id="), xpath_string(F.col("id")), F.lit("]"))).otherwise(
        F.concat(name, F.when(F.col("nth_count") > 1, F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("]"))).otherwise(F.lit(""))))
    g = ex.groupBy("page_id", "target_id").agg(F.array_sort(F.collect_list(F.struct("pos", stepx.alias("s")))).alias("st"),
                                                F.max("apos").alias("apos"))
    steps = F.transform("st", lambda x: x["s"])
    return g.select("page_id", F.col("target_id").alias("node_id"),
                    F.when(F.col("apos").isNull(), F.concat(F.lit("/"), F.array_join(steps, "/")))
                    .otherwise(F.array_join(steps, "/")).alias("xpath"))


# -- J07 / J08 ----------------------------------------------------------------------------------
def signatures_for(nodes: DataFrame, which: DataFrame) -> DataFrame:
    """J06 restricted to ``which`` (page_id, node_id)."""
    # a semi join is taken to be as small as the file of its left side, which says little of its rows: these are merged
    kids = nodes.select("page_id", F.col("parent_id").alias("node_id"), "tag", "child_tags").join(which, ["page_id", "node_id"], "left_semi")
    items = kids.select("page_id", "node_id", F.concat(F.array("tag"), F.transform("child_tags", lambda g: F.concat(F.col("tag"), F.lit(">"), g))).alias("it"))
    sig = items.select("page_id", "node_id", F.explode("it").alias("s")).groupBy("page_id", "node_id").agg(F.array_sort(F.collect_set("s")).alias("sig"))
    return which.join(sig.hint("merge"), ["page_id", "node_id"], "left").select("page_id", "node_id", F.coalesce("sig", F.array().cast("array<string>")).alias("sig"))


def sibling_kinds(ps, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The siblings of ``targets`` (page_id, node_id), themselves included, by
    kind: elements alike in tag, group classes and structure signature (J06).
    -> members (page_id, parent_id, kind, node_id, skipped) and kinds
    (page_id, parent_id, kind, tag, grp, sig, n), n without skipped ones"""
    nodes = ps.nodes
    parents = nodes.join(targets.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi").select("page_id", "parent_id").distinct()
    sib = nodes.join(parents, ["page_id", "parent_id"], "left_semi").select("page_id", "parent_id", "node_id", "tag", F.array_sort("grp").alias("grp"), "skipped")
    sib = sib.join(signatures_for(nodes, sib.select("page_id", "node_id")).hint("merge"), ["page_id", "node_id"])
    sib = cut_lineage(sib.withColumn("kind", F.md5(F.to_json(F.struct("tag", "grp", "sig")))), "siblings")
    kinds = sib.groupBy("page_id", "parent_id", "kind").agg(*(F.first(c).alias(c) for c in ("tag", "grp", "sig")), F.count_if(~F.col("skipped")).alias("n"))
    return sib.select("page_id", "parent_id", "kind", "node_id", "skipped"), cut_lineage(kinds, "kinds")


def _similar(tx: Column, gx: Column, sx: Column, ty: Column, gy: Column, sy: Column) -> Column:
    """Same tag; if either has group classes they must share one; of
    empty signatures both are, or x has group classes; else Jaccard >= 0.34."""
    cls = ((F.size(gx) == 0) & (F.size(gy) == 0)) | F.arrays_overlap(gx, gy)
    jaccard = F.size(F.array_intersect(sx, sy)) / F.size(F.array_union(sx, sy))
    sig = F.when((F.size(sx) == 0) | (F.size(sy) == 0), (F.size(sx) == F.size(sy)) | (F.size(gx) > 0)).otherwise(jaccard >= rules.SIMILARITY_MIN)
    return (tx == ty) & cls & sig


def similar_kinds(kinds: DataFrame) -> DataFrame:
    """J07 between the kinds of each parent's children, as a set-similarity
    join: (page_id, parent_id, x, y), y similar to x; every kind to itself.

    Signatures that overlap by the limit share one of their rarest tokens: of n
    tokens, the first n - ceil(limit * n) + 1 by how many kinds have them. Where
    a signature is empty the kinds must share a class (or be one kind)."""
    at = ["page_id", "parent_id", "tag"]
    tokens = kinds.select(*at, "kind", F.explode("sig").alias("t"))
    often = tokens.groupBy(*at, "t").agg(F.count(F.lit(1)).alias("f"))
    ranked = tokens.join(often, [*at, "t"]).groupBy(*at, "kind").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ts"))
    n = F.size("ts")
    prefix = ranked.select(*at, "kind", F.explode(F.slice("ts", 1, n - F.ceil(n * F.lit(rules.SIMILARITY_MIN) - 1e-9).cast("int") + 1)).alias("t"))
    prefix = prefix.select(*at, "kind", F.concat(F.lit("s:"), "t.t").alias("key"), F.lit(False).alias("bare"))
    classes = kinds.select(*at, "kind", F.explode("grp").alias("c"), (F.size("sig") == 0).alias("bare")).select(*at, "kind", F.concat(F.lit("c:"), "c").alias("key"), "bare")
    keyed = cut_lineage(prefix.unionByName(classes), "kind-keys")
    x, y = keyed.select(*at, "key", F.col("kind").alias("x"), F.col("bare").alias("bx")), keyed.select(*at, "key", F.col("kind").alias("y"), F.col("bare").alias("by"))
    met = x.join(y, [*at, "key"]).filter(F.col("key").startswith("s:") | F.col("bx") | F.col("by")).select("page_id", "parent_id", "x", "y").distinct()
    of = lambda k: kinds.select("page_id", "parent_id", F.col("kind").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("tag", "grp", "sig")))
    met = met.filter("x <> y").join(of("x"), ["page_id", "parent_id", "x"]).join(of("y"), ["page_id", "parent_id", "y"])
    met = met.filter(_similar(*(F.col(f"{c}_{k}") for k in "xy" for c in ("tag", "grp", "sig")))).select("page_id", "parent_id", "x", "y")
    # where no two kinds are similar the union goes, and the size of the kinds is their file's
    return met.unionByName(kinds.select("page_id", "parent_id", F.col("kind").alias("x"), F.col("kind").alias("y"))).hint("merge")


def similar_siblings(ps, targets: DataFrame) -> DataFrame:
    """J07 + J08: for each target, its similar siblings (self always in,
    skipped tags out). Similarity is between the kinds of siblings; only the
    members of the targets' kinds are listed. -> (page_id, target_id, node_id)"""
    t = targets.select("page_id", "node_id").distinct()
    members, kinds = sibling_kinds(ps, t)
    at = ["page_id", "parent_id"]
    mine = members.join(t, ["page_id", "node_id"], "left_semi").select(*at, F.col("kind").alias("x"), F.col("node_id").alias("target_id"))
    others = members.filter(~F.col("skipped")).select(*at, F.col("kind").alias("y"), "node_id")
    pairs = mine.hint("merge").join(similar_kinds(kinds), [*at, "x"]).join(others, [*at, "y"]).select("page_id", "target_id", "node_id")
    alone = t.select("page_id", F.col("node_id").alias("target_id"), "node_id")
    own = alone.join(members.filter(~F.col("skipped")).select("page_id", "node_id"), ["page_id", "node_id"], "left_anti").select("page_id", "target_id", "node_id")
    return cut_lineage(pairs.unionByName(own), "similar")


def group_sizes(ps, targets: DataFrame, sample: int | None = None, leaf_cap: int | None = None) -> DataFrame:
    """(page_id, node_id, size, leaves): for each target how many similar
    siblings there are and their mean leaves (A01), from the sums of each kind:
    what is counted grows with the siblings, not with their pairs. ``sample``:
    the mean is that of the first so many members only."""
    t = targets.select("page_id", "node_id").distinct()
    members, kinds = sibling_kinds(ps, t)
    at = ["page_id", "parent_id"]
    shown = members.filter(~F.col("skipped"))
    lv = leaf_counts(ps.nodes, shown.select("page_id", F.col("node_id").alias("root_id")), leaf_cap).withColumnRenamed("root_id", "node_id")
    per = shown.join(lv, ["page_id", "node_id"])
    if sample is not None:  # no more of a kind can be among the first of any group
        nth = F.row_number().over(Window.partitionBy(*at, "kind").orderBy("node_id"))
        per = per.withColumn("_n", nth).filter(F.col("_n") <= sample).drop("_n")
        x = similar_kinds(kinds).join(per.withColumnRenamed("kind", "y"), [*at, "y"])
        first = F.row_number().over(Window.partitionBy(*at, "x").orderBy("node_id"))
        mean = x.withColumn("_n", first).filter(F.col("_n") <= sample).groupBy(*at, "x").agg(F.avg("leaves").alias("leaves"))
        size = similar_kinds(kinds).join(kinds.select(*at, F.col("kind").alias("y"), "n"), [*at, "y"]).groupBy(*at, "x").agg(F.sum("n").alias("size"))
        of_kind = size.join(mean, [*at, "x"])
    else:
        sums = per.groupBy(*at, "kind").agg(F.sum("leaves").alias("s"), F.count(F.lit(1)).alias("n")).withColumnRenamed("kind", "y")
        of_kind = similar_kinds(kinds).join(sums, [*at, "y"]).groupBy(*at, "x").agg(F.sum("n").alias("size"), (F.sum("s") / F.sum("n")).alias("leaves"))
    mine = members.join(t, ["page_id", "node_id"], "left_semi").filter(~F.col("skipped")).select(*at, F.col("kind").alias("x"), "node_id")
    return mine.hint("merge").join(of_kind, [*at, "x"]).select("page_id", "node_id", "size", "leaves")


# -- J09 ---------------------------------------------------------------------------------------------
def header_names(ps, cells: DataFrame) -> DataFrame:
    """Table header name for (row, el) pairs: row must be a TR; the
    nearest td/th around el inside the row; header row = first thead row,
    else the first other row of the table having a direct th; name = header
    cell at the same cell index, cleaned.
    cells: (page_id, row, el) -> (page_id, row, el, header)"""
    from .tree import closest

    nodes = ps.nodes
    c = cells.join(nodes.select("page_id", F.col("node_id").alias("el"), "anc"), ["page_id", "el"])
    cell = closest(nodes, c.select("page_id", F.col("el").alias("target_id"), "anc"), F.col("tag").isin("td", "th"))
    # what there is for each cell, row or table is joined by sort and merge: it grows with the pages
    c = c.join(cell.withColumnRenamed("target_id", "el").withColumnRenamed("match_id", "cell").hint("merge"), ["page_id", "el"])
    rowinfo = nodes.select("page_id", F.col("node_id").alias("row"), F.col("tag").alias("row_tag"), F.col("anc").alias("row_anc"))
    c = c.join(rowinfo, ["page_id", "row"]).filter(F.col("row_tag") == "tr")
    c = c.filter(F.array_contains("anc", F.col("row")) & (F.col("cell") > F.col("row")))  # the cell is inside the row
    tab = closest(nodes, c.select("page_id", F.col("row").alias("target_id"), F.col("row_anc").alias("anc")).distinct(),
                  F.col("tag") == "table")
    c = c.join(tab.withColumnRenamed("target_id", "row").withColumnRenamed("match_id", "table").hint("merge"), ["page_id", "row"])
    # cell index within its row (td/th only)
    cells_all = nodes.filter(F.col("tag").isin("td", "th")).select("page_id", F.col("parent_id").alias("tr"), "node_id")
    cells_all = cells_all.withColumn("ci", F.row_number().over(Window.partitionBy("page_id", "tr").orderBy("node_id")) - 1)
    c = c.join(cells_all.select("page_id", F.col("node_id").alias("cell"), "ci"), ["page_id", "cell"])
    trs = nodes.filter(F.col("tag") == "tr").select("page_id", F.col("node_id").alias("tr"), "parent_id", "anc", "child_tags")
    sect = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("sect"))
    trs = trs.join(sect, ["page_id", "parent_id"])
    tables = c.select("page_id", "table").distinct()
    # each row belongs to its nearest table: rows of nested tables are not the outer one's
    own = closest(nodes, trs.select("page_id", F.col("tr").alias("target_id"), "anc"), F.col("tag") == "table")
    trs = trs.join(own.select("page_id", F.col("target_id").alias("tr"), F.col("match_id").alias("table")).hint("merge"), ["page_id", "tr"])
    tr_t = trs.select("page_id", "tr", "sect", "child_tags", "table").join(tables.hint("merge"), ["page_id", "table"])
    head = tr_t.groupBy("page_id", "table").agg(
        F.min(F.when(F.col("sect") == "thead", F.col("tr"))).alias("thead_tr"))
    c = c.join(head.hint("merge"), ["page_id", "table"], "left")
    # the first header-bearing row other than the row itself is among the first two
    th = tr_t.filter(F.array_contains("child_tags", "th"))
    nth_th = th.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "table").orderBy("tr"))).filter(F.col("k") <= 2)
    two = nth_th.groupBy("page_id", "table").agg(F.min("tr").alias("th1"), F.max("tr").alias("th2"))
    th_tr = F.when(F.col("th1") != F.col("row"), F.col("th1")).when(F.col("th2") != F.col("row"), F.col("th2"))
    c = c.join(two.hint("merge"), ["page_id", "table"], "left").withColumn("hdr", F.coalesce("thead_tr", th_tr))
    c = c.filter(F.col("hdr").isNotNull() & (F.col("hdr") != F.col("row")))
    hc = cells_all.select("page_id", F.col("tr").alias("hdr"), "ci", F.col("node_id").alias("hcell"))
    c = c.join(hc, ["page_id", "hdr", "ci"])
    c = c.join(nodes.select("page_id", F.col("node_id").alias("hcell"), "t_start", "t_end"), ["page_id", "hcell"])
    # each header cell's text once, whatever the number of its column's cells
    names = with_text(ps, cut_lineage(c.select("page_id", "hcell", "t_start", "t_end").distinct(), "header-cells"))
    names = names.select("page_id", "hcell", clean(F.col("raw_text")).alias("header"))
    return c.join(names.hint("merge"), ["page_id", "hcell"]).select("page_id", "row", "el", "header")


# -- L01 / N04 / L05 ------------------------------------------------------------------------------
def detect_lists(ps, targets: DataFrame, level: int | None = None, sample: int | None = None, leaf_cap: int | None = None) -> DataFrame:
    """From one example element per row of ``targets`` find the
    repeating row. Candidates are the target's ancestors below body (level 0
    = the target). Levels with >= 2 similar siblings are candidates; "cell"
    levels (mean leaves of the members, or of the first ``sample``, <= 1.2) lose unless nothing
    else repeats; the largest group wins, the lowest level on ties (N04). An
    explicit valid ``level`` overrides. A target that is body/html gives no row.
    -> (page_id, target_id, level, levels, max_level, row_id, ..., row_selector, steps)"""
    nodes = ps.nodes
    body = nodes.filter((F.col("tag") == "body") & (F.col("depth") == 1)).select("page_id", F.col("node_id").alias("body_id"))
    t = targets.select("page_id", F.col("node_id").alias("target_id")).join(
        nodes.select("page_id", F.col("node_id").alias("target_id"), "anc", "depth"), ["page_id", "target_id"]).join(body, "page_id")
    chain = t.select("page_id", "target_id", "depth", "body_id", F.posexplode("anc").alias("pos", "node_id"))
    chain = chain.filter(F.col("pos") > 1).withColumn("lvl", F.col("depth") - F.col("pos")).filter(F.col("node_id") != F.col("body_id"))
    max_level = chain.groupBy("page_id", "target_id").agg(F.max("lvl").alias("max_level"))
    chain = cut_lineage(chain)
    sizes = group_sizes(ps, chain.select("page_id", "node_id"), sample, leaf_cap)
    cands = cut_lineage(chain.join(sizes.filter(F.col("size") >= 2), ["page_id", "node_id"]))
    cands = cands.withColumn("cell", F.col("leaves") <= rules.CELL_LEAVES_MAX)
    levels = cands.groupBy("page_id", "target_id").agg(F.array_sort(F.collect_list("lvl")).alias("levels"),
                                                      F.max((~F.col("cell")).cast("int")).alias("any_row"))
    cands = cands.join(levels.select("page_id", "target_id", "any_row"), ["page_id", "target_id"])
    pool = cands.filter((F.col("any_row") == 0) | ~F.col("cell"))
    w = Window.partitionBy("page_id", "target_id").orderBy(F.desc("size"), "lvl")
    best = pool.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1).select("page_id", "target_id", F.col("lvl").alias("best"))
    out = max_level.join(levels.drop("any_row"), ["page_id", "target_id"], "left").join(best, ["page_id", "target_id"], "left")
    chosen = F.lit(level) if level is not None else F.lit(None)
    out = out.withColumn("level", F.when(chosen.isNotNull() & (chosen >= 0) & (chosen <= F.col("max_level")), chosen)
                         .otherwise(F.coalesce("best", F.lit(0))).cast("int"))
    out = out.withColumn("levels", F.coalesce("levels", F.array().cast("array<int>")))
    row = chain.select("page_id", "target_id", "lvl", F.col("node_id").alias("row_id"))
    out = out.join(row, (out.page_id == row.page_id) & (out.target_id == row.target_id) & (out.level == row.lvl)).drop(
        row.page_id).drop(row.target_id).drop("lvl")
    out = cut_lineage(out)
    # row selector for the chosen row's similar-sibling group
    grp = similar_siblings(ps, out.select("page_id", F.col("row_id").alias("node_id")))
    mem = grp.join(nodes.select("page_id", "node_id", "parent_id", "tag", "classes", "sem", "grp", "child_tags"), ["page_id", "node_id"])
    mem = mem.withColumn("bucket", F.col("target_id").cast("string"))
    g = (mem.groupBy("page_id", "parent_id", "bucket").agg(F.count(F.lit(1)).alias("size"))
         .join(mem.filter(F.col("node_id") == F.col("target_id")).select(
             "page_id", "parent_id", "bucket", F.col("node_id").alias("first_id"), F.col("tag").alias("row_tag"),
             F.col("classes").alias("row_cls"), F.col("sem").alias("row_sem"), F.col("grp").alias("row_grp"),
             F.col("child_tags").alias("row_kids")), ["page_id", "parent_id", "bucket"]))
    rs = row_selectors(ps, g, mem.select("page_id", "parent_id", "bucket", "node_id", "tag", "classes", "child_tags"))
    rs = rs.select("page_id", F.col("first_id").alias("row_id"), "row_selector", row_steps().alias("steps"), "row_tag", "row_classes", "has_child", "parent_id")
    return out.join(rs, ["page_id", "row_id"], "left").select(
        "page_id", "target_id", "level", "levels", "max_level", "row_id", "parent_id", "row_tag", "row_classes", "has_child", "row_selector", "steps")


def shift_level(levels: Column, level: Column, max_level: Column, wider: bool) -> Column:
    """Next candidate level up (else +1, <= max) or down (else -1, >= 0)."""
    if wider:
        nxt = F.array_min(F.filter(levels, lambda x: x > level))
        return F.coalesce(nxt, F.least(level + 1, max_level))
    prv = F.array_max(F.filter(levels, lambda x: x < level))
    return F.coalesce(prv, F.greatest(level - 1, F.lit(0)))


# -- L15 --------------------------------------------------------------------------------------------
def column_for(ps, rows: DataFrame, picks: DataFrame, existing: list[str] | None = None) -> DataFrame:
    """L15 + A09: a column from one picked element: img -> src; form field ->
    value; no text -> src if it holds an img, else href if inside a link;
    else text. The row is the first row containing the element (a pick in no
    row is an error); the selector is relative to it (L10); the name is made
    free against ``existing`` ('Price' -> 'Price 2'); ``filled`` counts the
    rows whose value is not empty (A09), ``n_rows`` all rows.
    rows: (page_id, list_rank, row_id, row_ord); picks: (page_id, node_id)
    -> (page_id, node_id, row_id, name, attr, sel, steps, sample, filled, n_rows)"""
    from .columns import guess_names, name_hints, relative_selectors
    from .extract import apply_columns, node_values

    nodes = ps.nodes
    p = picks.select("page_id", "node_id").join(nodes.select("page_id", "node_id", "anc", "tag", "t_start", "t_end"), ["page_id", "node_id"])
    ex = p.select("page_id", "node_id", F.explode("anc").alias("row_id"))
    pr = ex.join(rows.select("page_id", "list_rank", "row_id", "row_ord"), ["page_id", "row_id"]).groupBy("page_id", "node_id").agg(
        F.min_by(F.struct("row_id", "list_rank"), "row_ord").alias("r")).select("page_id", "node_id", "r.row_id", "r.list_rank")
    outside = p.join(pr, ["page_id", "node_id"], "left_anti").select("page_id", "node_id").first()
    if outside is not None:
        raise ValueError(f"the picked element is in no row: page {outside.page_id}, node {outside.node_id}")
    p = with_text(ps, p.join(pr, ["page_id", "node_id"]))
    txt = clean(F.col("raw_text"))
    has_img = nodes.filter(F.col("tag") == "img").select("page_id", F.explode("anc").alias("node_id")).distinct().withColumn("has_img", F.lit(True))
    in_link = nodes.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).select("page_id", F.col("node_id").alias("a_id"))
    p = p.join(has_img, ["page_id", "node_id"], "left")
    lk = p.select("page_id", "node_id", F.explode("anc").alias("a_id")).join(in_link, ["page_id", "a_id"]).select(
        "page_id", "node_id").distinct().withColumn("in_link", F.lit(True))
    p = p.join(lk, ["page_id", "node_id"], "left")
    attr = (F.when(F.col("tag") == "img", "src").when(F.col("tag").isin("input", "select", "textarea"), "value")
            .when((txt == "") & F.coalesce("has_img", F.lit(False)), "src")
            .when((txt == "") & F.coalesce("in_link", F.lit(False)), "href").otherwise("text"))
    p = p.withColumn("attr", attr)
    v = node_values(ps, p.select("page_id", "node_id", "row_id", "list_rank", "attr"))
    v = v.join(nodes.select("page_id", "node_id", "tag"), ["page_id", "node_id"])
    hints = name_hints(ps, v.select("page_id", F.col("node_id").alias("el"), F.col("row_id").alias("row")))
    v = v.join(hints.withColumnRenamed("el", "node_id").withColumnRenamed("row", "row_id"), ["page_id", "node_id", "row_id"], "left")
    v = guess_names(v.withColumn("header", F.lit(None).cast("string")).withColumn("sample", F.col("value")))
    taken = F.array(*[F.lit(x) for x in (existing or [])]).cast("array<string>")
    free = F.filter(F.sequence(F.lit(2), F.size(taken) + 2), lambda k: ~F.array_contains(taken, F.concat(F.col("guess"), F.lit(" "), k.cast("string"))))
    name = F.when(F.array_contains(taken, F.col("guess")), F.concat(F.col("guess"), F.lit(" "), F.element_at(free, 1).cast("string"))).otherwise(F.col("guess"))
    depth = nodes.select("page_id", "node_id", "depth")
    v = v.join(depth, ["page_id", "node_id"]).join(depth.select("page_id", F.col("node_id").alias("row_id"), F.col("depth").alias("row_depth")), ["page_id", "row_id"])
    v = cut_lineage(v.withColumn("name", name))
    at = ["page_id", "list_rank", "row_id", "node_id"]
    v = v.join(relative_selectors(ps, v.select(*at, "row_depth", "depth")), at)
    # Each pick is a column of its own, tried in every row of its list
    cols = v.withColumn("col_ord", F.row_number().over(Window.partitionBy("page_id", "list_rank").orderBy("node_id")))
    cells = apply_columns(ps, rows.select("page_id", "list_rank", "row_id", "row_ord"), cols.select("page_id", "list_rank", "col_ord", "name", "steps", "attr"))
    col = ["page_id", "list_rank", "col_ord"]
    filled = cells.groupBy(*col).agg(F.count_if(F.col("value") != "").alias("filled"))
    n_rows = rows.groupBy("page_id", "list_rank").agg(F.count(F.lit(1)).alias("n_rows"))
    out = cols.join(filled, col, "left").join(n_rows, ["page_id", "list_rank"])
    return out.select("page_id", "node_id", "row_id", "name", "attr", "sel", "steps", F.col("value").alias("sample"),
                      F.coalesce("filled", F.lit(0)).alias("filled"), "n_rows")


# -- J07 for arbitrary pairs / L02 ----------------------------------------------------------------
def similar_pairs(ps, pairs: DataFrame) -> DataFrame:
    """J07 for any (page_id, x, y): same tag; if either has group classes
    they must share one; empty signatures: both empty, or x has group
    classes; else Jaccard >= 0.34 (asymmetric in x). -> (+ sim)."""
    nodes = ps.nodes
    xs = pairs.select("page_id", F.col("x").alias("node_id")).unionByName(pairs.select("page_id", F.col("y").alias("node_id"))).distinct()
    sig = signatures_for(nodes, xs)
    info = nodes.select("page_id", "node_id", "tag", "grp").join(sig, ["page_id", "node_id"])
    ix = info.select("page_id", F.col("node_id").alias("x"), F.col("tag").alias("tx"), F.col("grp").alias("gx"), F.col("sig").alias("sx"))
    iy = info.select("page_id", F.col("node_id").alias("y"), F.col("tag").alias("ty"), F.col("grp").alias("gy"), F.col("sig").alias("sy"))
    j = pairs.join(ix, ["page_id", "x"]).join(iy, ["page_id", "y"])
    sim = (F.col("x") == F.col("y")) | _similar(*(F.col(c) for c in ("tx", "gx", "sx", "ty", "gy", "sy")))
    return j.select(*pairs.columns, sim.alias("sim"))


def _common_classes(nodes: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """A02 for groups given as (key..., row_id, member_id): semantic classes of
    the row every member has, else group classes every member has; first 3 in
    the row's order -> (key..., row_id, common)."""
    m = rows.join(nodes.select("page_id", F.col("node_id").alias("member_id"), F.col("classes").alias("mc")), ["page_id", "member_id"])
    size = rows.groupBy(*key, "row_id").agg(F.countDistinct("member_id").alias("size"))
    has = m.select(*key, "row_id", "member_id", F.explode(F.array_distinct("mc")).alias("c")).groupBy(*key, "row_id", "c").agg(
        F.countDistinct("member_id").alias("n"))
    allc = has.join(size, [*key, "row_id"]).filter(F.col("n") == F.col("size")).groupBy(*key, "row_id").agg(F.collect_set("c").alias("all_have"))
    r = size.join(nodes.select("page_id", F.col("node_id").alias("row_id"), "sem", "grp"), ["page_id", "row_id"]).join(allc, [*key, "row_id"], "left")
    r = r.withColumn("all_have", F.coalesce("all_have", F.array().cast("array<string>")))
    s = F.filter("sem", lambda c: F.array_contains(F.col("all_have"), c))
    g = F.filter("grp", lambda c: F.array_contains(F.col("all_have"), c))
    return r.select(*key, "row_id", F.slice(F.when(F.size(s) > 0, s).otherwise(g), 1, 3).alias("common"))


def detect_lists_pairs(ps, pairs: DataFrame) -> DataFrame:
    """Rows from two examples (page_id, a_id, b_id).

    Same element, nested examples or no common ancestor -> L01 on the first.
    Otherwise the row level comes from L01 on the first example, clamped below
    the lowest common ancestor; the second row is the ancestor of the second
    example at that level if similar, else its first similar ancestor, else
    its first same-tag ancestor. Rows with one parent -> L04 on the union of
    both sibling groups. Otherwise equal-length, equal-tag paths below the LCA
    merge step by step (common classes; nth only when class-less and equal),
    else 'lca row' descendant form; if the result misses either row, the
    'lca row' form with the classes both rows share.
    -> (page_id, a_id, b_id, level, levels, max_level, row_selector, steps, branch)"""
    from .select import Matcher
    from ..schema import STEPS

    nodes = ps.nodes
    info = nodes.select("page_id", "node_id", "anc")
    p = (pairs.join(info.select("page_id", F.col("node_id").alias("a_id"), F.col("anc").alias("anc_a")), ["page_id", "a_id"])
         .join(info.select("page_id", F.col("node_id").alias("b_id"), F.col("anc").alias("anc_b")), ["page_id", "b_id"]))
    nested = (F.col("a_id") == F.col("b_id")) | F.array_contains("anc_b", F.col("a_id")) | F.array_contains("anc_a", F.col("b_id"))
    p = p.withColumn("nested", nested).withColumn("lca", F.array_max(F.array_intersect("anc_a", "anc_b")))
    from .tree import path_between

    p = p.withColumn("chain1", F.reverse(path_between(F.col("anc_a"), F.col("lca")))).withColumn(
        "chain2", F.reverse(path_between(F.col("anc_b"), F.col("lca"))))
    p = cut_lineage(p.withColumn("max_level", F.size("chain1") - 1))
    single = detect_lists(ps, p.select("page_id", F.col("a_id").alias("node_id")).distinct()).select(
        "page_id", F.col("target_id").alias("a_id"), F.col("level").alias("single_level"), F.col("row_selector").alias("single_sel"), F.col("steps").alias("single_steps"),
        F.struct("levels", "max_level").alias("single_at"))
    p = p.join(single, ["page_id", "a_id"], "left")
    p = p.withColumn("level", F.greatest(F.lit(0), F.least(F.coalesce("single_level", "max_level"), F.col("max_level"))))
    p = p.withColumn("r1", F.try_element_at(F.col("chain1"), F.col("level") + 1))
    two = p.filter(~F.col("nested"))
    c2 = two.select("page_id", "a_id", "b_id", "r1", "level", F.posexplode("chain2").alias("k", "c"))
    sp = similar_pairs(ps, c2.select("page_id", F.col("r1").alias("x"), F.col("c").alias("y")).distinct())
    c2 = c2.join(sp.withColumnRenamed("x", "r1").withColumnRenamed("y", "c"), ["page_id", "r1", "c"])
    tags = nodes.select("page_id", "node_id", "tag", "parent_id")
    c2 = c2.join(tags.select("page_id", F.col("node_id").alias("c"), F.col("tag").alias("ctag")), ["page_id", "c"]).join(
        tags.select("page_id", F.col("node_id").alias("r1"), F.col("tag").alias("rtag")), ["page_id", "r1"])
    pick = c2.groupBy("page_id", "a_id", "b_id").agg(
        F.max(F.when((F.col("k") == F.col("level")) & F.col("sim"), F.col("c"))).alias("at_level"),
        F.min_by(F.when(F.col("sim"), F.col("c")), F.when(F.col("sim"), F.col("k"))).alias("first_sim"),
        F.min_by(F.when(F.col("ctag") == F.col("rtag"), F.col("c")), F.when(F.col("ctag") == F.col("rtag"), F.col("k"))).alias("first_tag"))
    two = cut_lineage(two.join(pick, ["page_id", "a_id", "b_id"], "left").withColumn("r2", F.coalesce("at_level", "first_sim", "first_tag")))
    # rows with one parent: L04 on the union of both similar-sibling groups
    two = two.join(tags.select("page_id", F.col("node_id").alias("r1"), F.col("parent_id").alias("p1")), ["page_id", "r1"]).join(
        tags.select("page_id", F.col("node_id").alias("r2"), F.col("parent_id").alias("p2")), ["page_id", "r2"], "left")
    key = ["page_id", "a_id", "b_id"]
    sg = similar_siblings(ps, two.select("page_id", F.col("r1").alias("node_id")).unionByName(
        two.filter(F.col("r2").isNotNull()).select("page_id", F.col("r2").alias("node_id"))).distinct())
    g1 = two.select(*key, "r1", "r2").join(sg.withColumnRenamed("target_id", "r1"), ["page_id", "r1"]).select(*key, "r1", F.col("node_id").alias("member_id"))
    g2 = two.filter(F.col("r2").isNotNull()).select(*key, "r1", "r2").join(sg.withColumnRenamed("target_id", "r2"), ["page_id", "r2"]).select(
        *key, "r1", F.col("node_id").alias("member_id"))
    both = two.select(*key, "r1", F.col("r1").alias("member_id")).unionByName(
        two.filter(F.col("r2").isNotNull()).select(*key, "r1", F.col("r2").alias("member_id")))
    group = cut_lineage(g1.unionByName(g2).unionByName(both).distinct().withColumnRenamed("r1", "row_id"))
    common = _common_classes(nodes, group, key)
    pair_common = _common_classes(nodes, both.withColumnRenamed("r1", "row_id"), key).withColumnRenamed("common", "pair_common")
    two = two.join(common.withColumnRenamed("row_id", "r1"), [*key, "r1"], "left").join(pair_common.withColumnRenamed("row_id", "r1"), [*key, "r1"], "left")
    cont = unique_selectors(ps, two.select("page_id", F.col("lca").alias("node_id")).unionByName(
        two.select("page_id", F.col("p1").alias("node_id"))).distinct())
    two = two.join(cont.select("page_id", F.col("node_id").alias("lca"), F.col("selector").alias("lca_sel"), F.col("steps").alias("lca_steps")), ["page_id", "lca"], "left")
    two = two.join(cont.select("page_id", F.col("node_id").alias("p1"), F.col("selector").alias("p1_sel"), F.col("steps").alias("p1_steps")), ["page_id", "p1"], "left")
    # merged path below the lca: per position (tag, classes common to both, nth when class-less and equal)
    pp = two.select(*key, "r1", "r2", "anc_a", "anc_b", "lca", "common",
                    path_between(F.col("anc_a"), F.col("lca")).alias("pa"))
    anc_b2 = nodes.select("page_id", F.col("node_id").alias("r2"), F.col("anc").alias("anc_r2"))
    pp = pp.join(anc_b2, ["page_id", "r2"], "left").withColumn("pb", path_between(F.col("anc_r2"), F.col("lca")))
    pa_end = F.array_position("pa", F.col("r1"))
    pp = pp.withColumn("pa", F.slice("pa", 1, pa_end.cast("int")))
    st = pp.select(*key, "pa", "pb", F.posexplode("pa").alias("i", "n1")).withColumn("n2", F.try_element_at(F.col("pb"), F.col("i") + 1))
    nn = nodes.select("page_id", "node_id", "tag", "classes", "sem", "grp", "nth", "nth_count")
    st = st.join(nn.select("page_id", F.col("node_id").alias("n1"), F.col("tag").alias("t1"), F.col("sem").alias("s1"), F.col("grp").alias("g1"),
                           F.col("nth").alias("i1"), F.col("nth_count").alias("k1")), ["page_id", "n1"])
    st = st.join(nn.select("page_id", F.col("node_id").alias("n2"), F.col("tag").alias("t2"), F.col("classes").alias("c2"),
                           F.col("nth").alias("i2")), ["page_id", "n2"], "left")
    cc_s = F.filter("s1", lambda c: F.array_contains(F.coalesce(F.col("c2"), F.array().cast("array<string>")), c))
    cc_g = F.filter("g1", lambda c: F.array_contains(F.coalesce(F.col("c2"), F.array().cast("array<string>")), c))
    st = st.withColumn("cls", F.slice(F.when(F.size(cc_s) > 0, cc_s).otherwise(cc_g), 1, 3))
    st = st.withColumn("nthv", F.when((F.size("cls") == 0) & (F.col("k1") > 1) & (F.col("i1") == F.col("i2")), F.col("i1")))
    mg = st.groupBy(*key).agg(
        F.min((F.col("t1") == F.coalesce(F.col("t2"), F.lit(""))).cast("int")).alias("tags_eq"),
        F.max(F.size("pa")).alias("la"), F.max(F.size("pb")).alias("lb"),
        F.array_sort(F.collect_list(F.struct("i", "t1", "cls", "nthv")), lambda l, r: F.when(l["i"] < r["i"], -1).when(l["i"] > r["i"], 1).otherwise(0)).alias("parts"))
    two = two.join(mg, key, "left")
    sel_step = lambda t, cls, nth, comb: make_step(tag=t, comb=comb, classes=cls, nth=nth)
    rtag = tags.select("page_id", F.col("node_id").alias("r1"), F.col("tag").alias("row_tag"))
    two = two.join(rtag, ["page_id", "r1"])
    row_part = F.concat(css_escape(F.col("row_tag")), F.array_join(F.transform("common", lambda c: F.concat(F.lit("."), css_escape(c))), ""))
    merged_ok = (F.col("tags_eq") == 1) & (F.col("la") == F.col("lb"))
    parts_css = F.transform("parts", lambda x: F.concat(css_escape(x["t1"]), F.array_join(F.transform(x["cls"], lambda c: F.concat(F.lit("."), css_escape(c))), ""),
                                                        F.when(x["nthv"].isNotNull(), F.concat(F.lit(":nth-of-type("), x["nthv"].cast("string"), F.lit(")"))).otherwise(F.lit(""))))
    merged_css = F.concat(F.col("lca_sel"), F.lit(" > "), F.array_join(F.concat(F.slice(parts_css, 1, F.greatest(F.size(parts_css) - 1, F.lit(0))), F.array(row_part)), " > "))
    desc_css = F.concat(F.col("lca_sel"), F.lit(" "), row_part)
    merged_steps = F.concat(F.col("lca_steps"), F.concat(
        F.transform(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: sel_step(x["t1"], x["cls"], x["nthv"], "child")),
        F.array(sel_step(F.col("row_tag"), F.col("common"), None, "child"))))
    desc_steps = F.concat(F.col("lca_steps"), F.array(sel_step(F.col("row_tag"), F.col("common"), None, "desc")))
    same_parent = F.col("p1") == F.col("p2")
    # rows of one parent: L04 of the union, header rows and the like left out by ':has()'
    bucket = F.concat_ws("-", "a_id", "b_id")
    alike = two.filter(same_parent).select(*key, bucket.alias("bucket"))
    mem = group.join(alike, key).join(nodes.select("page_id", F.col("node_id").alias("member_id"), "parent_id", "tag", "classes", "child_tags"), ["page_id", "member_id"])
    mem = cut_lineage(mem.select("page_id", "parent_id", "bucket", "row_id", F.col("member_id").alias("node_id"), "tag", "classes", "child_tags"))
    first = nodes.select("page_id", F.col("node_id").alias("first_id"), F.col("tag").alias("row_tag"), F.col("classes").alias("row_cls"),
                         F.col("sem").alias("row_sem"), F.col("grp").alias("row_grp"), F.col("child_tags").alias("row_kids"))
    per = mem.groupBy("page_id", "parent_id", "bucket").agg(F.countDistinct("node_id").alias("size"), F.first("row_id").alias("first_id")).join(first, ["page_id", "first_id"])
    of_parent = row_selectors(ps, per, mem.drop("row_id")).select("page_id", "bucket", F.col("row_selector").alias("sp_css"), row_steps().alias("sp_steps"))
    two = two.withColumn("bucket", bucket).join(of_parent, ["page_id", "bucket"], "left").drop("bucket")
    two = two.withColumn("branch", F.when(F.col("r2").isNull(), "single").when(same_parent, "same_parent").when(merged_ok, "merged").otherwise("lca_desc"))
    two = two.withColumn("cand_sel", F.when(F.col("branch") == "same_parent", F.col("sp_css")).when(F.col("branch") == "merged", merged_css).otherwise(desc_css))
    two = two.withColumn("cand_steps", F.when(F.col("branch") == "same_parent", F.col("sp_steps")).when(F.col("branch") == "merged", merged_steps.cast(STEPS))
                         .otherwise(desc_steps.cast(STEPS)))
    two = cut_lineage(two)
    # both rows must be matched
    chk = two.filter(F.col("branch") != "single")
    roots = nodes.filter(F.col("parent_id").isNull()).select("page_id", F.col("node_id").alias("scope_id"))
    scopes = chk.select(*key).join(roots, "page_id")
    m = Matcher(ps).match(scopes, chk.select(*key, F.col("cand_steps").alias("steps")), key, ["a_id", "b_id"], include_scope=True)
    ok = m.join(chk.select(*key, "r1", "r2"), key).groupBy(*key).agg(
        (F.max((F.col("node_id") == F.col("r1")).cast("int")) + F.max((F.col("node_id") == F.col("r2")).cast("int"))).alias("hits"))
    two = two.join(ok, key, "left")
    fallback = F.concat(F.col("lca_sel"), F.lit(" "), css_escape(F.col("row_tag")),
                        F.array_join(F.transform("pair_common", lambda c: F.concat(F.lit("."), css_escape(c))), ""))
    fallback_steps = F.concat("lca_steps", F.array(sel_step(F.col("row_tag"), F.col("pair_common"), None, "desc"))).cast(STEPS)
    single, hit = F.col("branch") == "single", F.coalesce(F.col("hits"), F.lit(0)) == 2
    two = two.withColumns({"row_selector": F.when(single, F.col("single_sel")).when(hit, F.col("cand_sel")).otherwise(fallback),
                           "steps": F.when(single, F.col("single_steps")).when(hit, F.col("cand_steps")).otherwise(fallback_steps),
                           "levels": F.sequence(F.lit(0), F.col("max_level"))})
    cols = [*key, "level", "levels", "max_level", "row_selector", "steps", "branch"]
    alone = p.filter(F.col("nested")).select(*key, "level", F.col("single_at.levels").alias("levels"), F.col("single_at.max_level").alias("max_level"),
                                             F.col("single_sel").alias("row_selector"), F.col("single_steps").alias("steps"), F.lit("single").alias("branch"))
    return two.select(*cols).unionByName(alone)
