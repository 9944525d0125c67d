"""List inference: leaf counts (A01), unique selectors (L06), container / row selectors (L04), find all lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import rules
from ..functions.selectors import css_escape, css_string
from ..schema import STEPS
from ..session import cut_lineage
from .select import distinct_matches, make_step


# -- A01 ------------------------------------------------------------------------
def leaf_counts(nodes: DataFrame, roots: DataFrame, cap: int | None = None, key: str = "root_id") -> DataFrame:
    """Value-bearing leaves under each root (img or usable link +1, a
    non-blank direct text +1), skipped subtrees cut off; at most ``cap`` if given.
    roots: (page_id, key[, other]) -> (page_id, key, leaves)."""
    leaf = nodes.select(
        "page_id", "anc", "skip_depth",
        ((F.col("tag") == "img") | F.col("usable_a")).cast("int") + F.col("has_text").cast("int"),
    ).toDF("page_id", "anc", "skip_depth", "w").filter(F.col("w") > 0)
    ex = leaf.select("page_id", "skip_depth", "w", F.posexplode("anc").alias("rdepth", key))
    r = roots.select("page_id", key).distinct()
    j = ex.join(r, ["page_id", key]).filter(F.col("skip_depth") < F.col("rdepth"))
    s = j.groupBy("page_id", key).agg(F.sum("w").alias("n"))
    return r.join(s, ["page_id", key], "left").select(
        "page_id", key, F.least(F.coalesce(F.col("n"), F.lit(0)), F.lit(cap)).cast("int").alias("leaves"))  # least() skips a null cap


# -- L06 phase 1 ----------------------------------------------------------------
def model_attrs(n_attr_names: Column, attrs: Column) -> Column:
    """L07 attribute parts: allowed names, non-empty values, in attribute
    order -> ARRAY<STRUCT<n, v>>."""
    ok = F.filter(n_attr_names, lambda a: a.rlike(rules.MODEL_ATTR) & (F.length(attrs[a]) > 0))
    return F.transform(ok, lambda a: F.struct(a.alias("n"), attrs[a].alias("v")))


def target_candidates(nodes: DataFrame) -> DataFrame:
    """L06 phase-1 candidates of each node, in priority order:
    stable id, test attrs, name attrs, each semantic class, <= 3 semantic
    classes, weak attrs, <= 4 utility classes, bare tag.
    -> (page_id, node_id, prio, css, strong, step)
    The CSS text is rendered once per exploded candidate, not per branch."""
    nodes = nodes.withColumn("_ma", model_attrs(F.col("attr_names"), F.col("attrs")))  # asked for four times below
    ma = F.col("_ma")
    sem = F.col("sem")
    util = F.filter(F.col("grp"), lambda c: ~F.array_contains(F.col("sem"), c))
    no_s = F.lit(None).cast("string")

    def cand(kind, n, v, cs, strong):
        return F.struct(F.lit(kind).alias("kind"), n.alias("n"), v.alias("v"), cs.alias("cs"), F.lit(strong).alias("strong"))

    empty_cs = F.array().cast("array<string>")

    def attr_cands(names, strong):
        return F.transform(F.filter(ma, lambda p: p["n"].isin(*names)),
                           lambda p: cand("attr", p["n"], p["v"], empty_cs, strong))

    et = "array<struct<kind:string,n:string,v:string,cs:array<string>,strong:boolean>>"
    cands = F.concat(
        F.when(C.is_stable_id(F.col("id")), F.array(cand("id", no_s, F.col("id"), empty_cs, True))).otherwise(F.array().cast(et)),
        attr_cands(rules.TEST_ATTRS, True),
        attr_cands(rules.NAME_ATTRS, True),
        F.transform(sem, lambda c: cand("class", no_s, no_s, F.array(c), True)),
        F.when(F.size(sem) > 1, F.array(cand("class", no_s, no_s, F.slice(sem, 1, 3), True))).otherwise(F.array().cast(et)),
        attr_cands(rules.WEAK_ATTRS, False),
        F.when(F.size(util) > 0, F.array(cand("class", no_s, no_s, F.slice(util, 1, 4), False))).otherwise(F.array().cast(et)),
        F.array(cand("tag", no_s, no_s, empty_cs, False)),
    )
    ex = nodes.select("page_id", "node_id", "tag", F.posexplode(cands).alias("prio", "c"))
    k = F.col("c.kind")
    step = make_step(tag=F.col("tag"), id=F.when(k == "id", F.col("c.v")), classes=F.col("c.cs"),
                     attrs=F.when(k == "attr", F.create_map(F.col("c.n"), F.col("c.v"))).otherwise(F.create_map().cast("map<string,string>")))
    return ex.select("page_id", "node_id", "prio", render_candidate(F.col("tag"), k, F.col("c.n"), F.col("c.v"), F.col("c.cs")).alias("css"),
                     F.col("c.strong").alias("strong"), step.alias("step"))


def render_candidate(tag: Column, kind: Column, n: Column, v: Column, cs: Column) -> Column:
    """L08 for one candidate: tag + (#id | [attr="v"] | .c1.c2...)."""
    return F.concat(
        css_escape(tag),
        F.when(kind == "id", F.concat(F.lit("#"), css_escape(v)))
        .when(kind == "attr", F.concat(F.lit("["), n, F.lit("="), css_string(v), F.lit("]")))
        .otherwise(F.array_join(F.transform(cs, lambda c: F.concat(F.lit("."), css_escape(c))), "")),
    )


def unique_selectors(ps, targets: DataFrame) -> DataFrame:
    """Short unique CSS selector per target node, all targets at once.

    1. The first of the target's candidates that matches one element only.
    2. The candidate with the fewest matches under one strong candidate of an
       ancestor, the nearest ancestor and its first candidate winning.
    3. The indexed path from the closest ancestor with a stable id that is
       unique in its page (else from body), less the ancestors and then the
       positions that it can do without (``prune``).

    Distinct selectors of a page are matched once, whatever the number of
    targets that ask for them. html / body map to themselves.
    -> (page_id, node_id, selector, steps, phase); steps are never null"""
    nodes, key = ps.nodes, ["page_id", "node_id"]
    t = cut_lineage(targets.select(*key).distinct(), "targets")
    tn = nodes.join(t, key, "left_semi")
    top = F.col("tag").isin("html", "body") & (F.col("depth") <= 1)
    special = tn.filter(top).select(*key, F.col("tag").alias("selector"), F.array(make_step(tag=F.col("tag"))).cast(STEPS).alias("steps"), F.lit(0).alias("phase"))

    cands = cut_lineage(target_candidates(tn.filter(~top)), "candidates")
    sels = cands.select("page_id", F.lit(0).alias("scope_id"), "css", F.array("step").cast(STEPS).alias("steps"))
    counted = cands.join(distinct_matches(ps, sels, True).select("page_id", "css", "matches"), ["page_id", "css"])
    # the fewest matches first: one, if any candidate is unique
    best = counted.groupBy(*key).agg(F.min_by(F.struct("css", "step", "matches"), F.struct("matches", "prio")).alias("b"))
    best = cut_lineage(best.select(*key, "b.*"), "best")
    alone = best.filter("matches = 1")
    out = special.unionByName(alone.select(*key, F.col("css").alias("selector"), F.array("step").cast(STEPS).alias("steps"), F.lit(1).alias("phase")))
    rest = best.filter("matches > 1")
    if rest.isEmpty():
        return cut_lineage(out, "unique")
    under = cut_lineage(under_ancestors(ps, rest), "under")
    out = out.unionByName(under.withColumn("phase", F.lit(2)))
    left = rest.select(*key).join(under, key, "left_anti")
    if not left.isEmpty():
        out = out.unionByName(prune(ps, indexed_paths(ps, left)).withColumn("phase", F.lit(3)))
    return cut_lineage(out, "unique")


def under_ancestors(ps, rest: DataFrame) -> DataFrame:
    """L06 phase 2: rest (page_id, node_id, css, step), the best candidate of
    targets that it does not single out -> (page_id, node_id, selector, steps)
    for those whom a strong candidate of an ancestor singles out."""
    nodes, key = ps.nodes, ["page_id", "node_id"]
    up = rest.select(*key, "css", "step").join(nodes.select(*key, "anc", "depth"), key)
    up = up.select(*key, "css", "step", "depth", F.posexplode("anc").alias("pos", "anc_id")).filter("pos >= 1 and pos < depth")
    anc = nodes.join(up.select("page_id", F.col("anc_id").alias("node_id")).distinct(), key, "left_semi")
    strong = target_candidates(anc).filter("strong").select("page_id", F.col("node_id").alias("anc_id"), F.col("prio").alias("a_prio"),
                                                            F.col("css").alias("a_css"), F.col("step").alias("a_step"))
    # the semi join above is taken to be as small as the elements' file
    strong = strong.hint("merge")
    near = F.col("pos") == F.col("depth") - 1
    both = up.join(strong, ["page_id", "anc_id"]).select(
        *key, "pos", "a_prio", F.concat("a_css", F.when(near, " > ").otherwise(" "), "css").alias("css"),
        F.array("a_step", F.col("step").withField("comb", F.when(near, "child").otherwise("desc"))).cast(STEPS).alias("steps"))
    both = cut_lineage(both, "under-ancestors")
    once = distinct_matches(ps, both.withColumn("scope_id", F.lit(0)), True).filter("matches = 1").select("page_id", "css")
    return both.join(once, ["page_id", "css"]).groupBy(*key).agg(
        F.min_by(F.struct(F.col("css").alias("selector"), "steps"), F.struct(-F.col("pos"), "a_prio")).alias("s")).select(*key, "s.*")


def indexed_paths(ps, targets: DataFrame) -> DataFrame:
    """L06 phase 3: (page_id, node_id, path): the elements from the closest
    ancestor with a stable id that is unique in its page (else from body) down
    to the node, as structs (css text and its position's, tag, id of the first,
    the first two semantic classes of the others, nth-of-type where there are
    several)."""
    nodes, key = ps.nodes, ["page_id", "node_id"]
    t = nodes.join(targets.select(*key), key).select("page_id", F.col("node_id").alias("target_id"), F.posexplode("anc").alias("pos", "node_id")).filter("pos >= 1")
    ids = nodes.filter(F.col("id") != "").groupBy("page_id", "id").agg(F.count(F.lit(1)).alias("idn"))
    tag, stable = css_escape(F.col("tag")), F.col("stable")
    info = nodes.select(*key, "tag", "id", F.slice("sem", 1, 2).alias("classes"), F.when(F.col("nth_count") > 1, F.col("nth")).alias("nth"), C.is_stable_id(F.col("id")).alias("stable"))
    # each element's text once, not once for each path and try
    info = info.withColumns({"first": F.when(stable, F.concat(tag, F.lit("#"), css_escape(F.col("id")))).otherwise(tag),
                             "css": F.concat(tag, F.array_join(F.transform("classes", lambda c: F.concat(F.lit("."), css_escape(c))), "")),
                             "place": F.when(F.col("nth").isNotNull(), F.concat(F.lit(":nth-of-type("), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.lit(""))})
    info = info.join(ids, ["page_id", "id"], "left")
    # where no element has an id the join above goes, and the elements' size is their file's again
    chain = t.join(info.hint("merge"), key)
    anchors = F.max(F.when(stable & (F.col("idn") == 1) & (F.col("node_id") != F.col("target_id")), F.col("pos")))
    el = F.struct("pos", "tag", F.when(stable, F.col("id")).alias("id"), "classes", "nth", "first", "css", "place")
    # as many elements as the page is deep
    per = chain.groupBy("page_id", "target_id").agg(F.sort_array(F.collect_list(el)).alias("els"), F.coalesce(anchors, F.lit(1)).alias("anchor"))
    path = F.transform(F.filter("els", lambda e: e["pos"] >= F.col("anchor")), lambda e, i: F.struct(
        F.when(i == 0, e["first"]).otherwise(e["css"]).alias("css"), e["place"].alias("place"), e["tag"].alias("tag"), F.when(i == 0, e["id"]).alias("id"),
        F.when(i == 0, F.array().cast("array<string>")).otherwise(e["classes"]).alias("classes"), e["nth"].alias("nth")))
    return per.select("page_id", F.col("target_id").alias("node_id"), path.alias("path"))


def _path_selector(path: Column, on, counted) -> tuple[Column, Column]:
    """CSS text and steps of the elements of ``path`` that are ``on``, with
    the positions of those that are ``counted`` (both asked by index)."""
    every = F.transform(path, lambda e, i: F.struct(
        e.alias("e"), on(i).alias("on"), counted(i).alias("counted"), ((i > 0) & on(F.greatest(i - 1, F.lit(0)))).alias("child")))
    kept = F.filter(every, lambda x: x["on"])
    css = F.transform(kept, lambda x, k: F.concat(
        F.when(k == 0, "").when(x["child"], " > ").otherwise(" "), x["e"]["css"], F.when(x["counted"], x["e"]["place"]).otherwise(F.lit(""))))
    steps = F.transform(kept, lambda x, k: make_step(
        tag=x["e"]["tag"], comb=F.when((k > 0) & x["child"], "child").otherwise("desc"), id=x["e"]["id"], classes=x["e"]["classes"], nth=F.when(x["counted"], x["e"]["nth"])))
    return F.array_join(css, ""), steps.cast(STEPS)


def _end_selector(path: Column, counted=None) -> tuple[Column, Column]:
    """CSS text and steps of all elements of ``path``."""
    on = (lambda i: F.lit(True)) if counted is None else counted
    css = F.array_join(F.transform(path, lambda e, i: F.concat(e["css"], F.when(on(i), e["place"]).otherwise(F.lit("")))), " > ")
    steps = F.transform(path, lambda e, i: make_step(tag=e["tag"], comb=F.when(i == 0, "desc").otherwise("child"), id=e["id"], classes=e["classes"], nth=F.when(on(i), e["nth"])))
    return css, steps.cast(STEPS)


def _state_selector(gone=None, what: str = "") -> tuple[Column, Column]:
    """CSS text and steps of (path, on, counted) without what is ``gone``."""
    at = {c: (lambda i, c=c: F.get(F.col(c), i) & ~gone(i) if c == what else F.get(F.col(c), i)) for c in ("on", "counted")}
    some = _path_selector(F.col("path"), at["on"], at["counted"])
    if what == "on":
        return some
    # most paths have no ancestor left out in the middle
    every = _end_selector(F.col("path"), at["counted"])
    return tuple(F.when(~F.array_contains("on", False), x).otherwise(y) for x, y in zip(every, some, strict=True))


def _tried(ps, tries: DataFrame, n: str, selector: tuple[Column, Column]) -> DataFrame:
    """The ``selector`` of each of ``tries``, which are told apart by ``n``
    -> (page_id, node_id, n, fits): whether it matches one node only."""
    css, steps = selector
    tries = cut_lineage(tries.select("page_id", "node_id", n, F.lit(0).alias("scope_id"), css.alias("css"), steps.alias("steps")), "tries")
    m = distinct_matches(ps, tries, True).select("page_id", "css", "matches")
    return tries.join(m, ["page_id", "css"], "left").select("page_id", "node_id", n, (F.coalesce("matches", F.lit(0)) <= 1).alias("fits"))


def prune(ps, paths: DataFrame) -> DataFrame:
    """Leaves out of each path, from the top, every ancestor and then every
    position without which it still matches one node only.

    A selector with less in it matches no fewer nodes. So the ancestors that go
    before the first that is needed are those above the path's shortest end
    that matches one node; ends are tried from the short ones, which like
    elements share, in rounds that double their length. What cannot go by
    itself cannot go at all: of the rest of the path each part is tried alone,
    and only where several can go they are tried together (``_less``).
    paths: (page_id, node_id, path) -> (page_id, node_id, selector, steps)"""
    key = ["page_id", "node_id"]
    whole = cut_lineage(paths, "paths")
    shortest, low, high = [], 0, 2
    while True:
        # the whole path is what remains if no end of it will do
        tries = whole.filter(F.size("path") - 1 > low)
        if shortest:
            tries = tries.join(shortest[-1].filter("n is null").select(*key), key, "left_semi")
        if tries.isEmpty():
            break
        tries = tries.withColumn("n", F.explode(F.sequence(F.lit(low + 1), F.least(F.lit(high), F.size("path") - 1))))
        tried = _tried(ps, tries, "n", _end_selector(F.slice("path", -F.col("n"), F.col("n"))))
        shortest.append(cut_lineage(tried.groupBy(*key).agg(F.min(F.when(F.col("fits"), F.col("n"))).alias("n")), "ends"))
        low, high = high, 2 * high + 2
    state = whole
    if shortest:
        ends = shortest[0].filter("n is not null")
        for more in shortest[1:]:
            ends = ends.unionByName(more.filter("n is not null"))
        n = F.coalesce("n", F.size("path"))
        state = whole.join(ends.hint("merge"), key, "left").select(*key, F.slice("path", -n, n).alias("path"))
    state = cut_lineage(state.withColumns({"on": F.transform("path", lambda e: F.lit(True)), "counted": F.transform("path", lambda e: e["nth"].isNotNull())}), "paths")
    for what in ("on", "counted"):
        state = _less(ps, state, what)
    css, steps = _state_selector()
    return state.select(*key, css.alias("selector"), steps.alias("steps"))


def _less(ps, state: DataFrame, what: str) -> DataFrame:
    """``state`` (page_id, node_id, path, on, counted) less the ancestors
    (``what`` is on) or positions (counted) that can go, from the top. The last
    element stays, and the first, which has proved to be needed; positions may
    go everywhere that is left."""
    key, columns = ["page_id", "node_id"], state.columns
    places = F.sequence(F.lit(0), F.size("path") - 1)
    may = F.filter(places if what == "counted" else F.slice(places, 2, F.greatest(F.size("path") - 2, F.lit(0))), lambda i: F.get("on", i) & F.get(F.col(what), i))

    tries = state.withColumn("i", F.explode(may))
    if tries.isEmpty():
        return state
    free = _tried(ps, tries, "i", _state_selector(lambda i: i == F.col("i"), what)).filter("fits").groupBy(*key).agg(F.sort_array(F.collect_list("i")).alias("may"))
    state = state.join(free.hint("merge"), key, "left").withColumn("may", F.coalesce("may", F.array().cast("array<int>")))
    # the first of them goes
    state = cut_lineage(state.withColumn(what, F.transform(what, lambda x, i: x & (i != F.coalesce(F.get("may", F.lit(0)), F.lit(-1))))).withColumn("at", F.lit(1)), "paths")
    several = state.filter("size(may) > 1")
    if several.isEmpty():
        return state.select(*columns)
    done, state = state.filter("size(may) <= 1"), several
    while True:
        tries = state.filter(F.size("may") > F.col("at")).withColumn("last", F.explode(F.sequence(F.col("at"), F.size("may") - 1)))
        if tries.isEmpty():
            break
        # all prefixes of what could go at once; the next round goes on behind the first part that is needed
        gone = F.slice("may", F.col("at") + 1, F.col("last") - F.col("at") + 1)
        tried = _tried(ps, tries, "last", _state_selector(lambda i: F.array_contains(gone, i), what))
        needed = tried.groupBy(*key).agg(F.min(F.when(~F.col("fits"), F.col("last"))).alias("needed"))
        end = F.coalesce("needed", F.size("may"))
        gone = F.slice("may", F.col("at") + 1, F.greatest(end - F.col("at"), F.lit(0)))
        state = cut_lineage(state.join(needed, key, "left").withColumn(what, F.transform(what, lambda x, i: x & ~F.array_contains(gone, i)))
                            .withColumn("at", F.greatest(F.col("at"), end + 1)).drop("needed"), "paths")
    return done.unionByName(state).select(*columns)


# -- L03 / L04 / T04 ---------------------------------------------------------------
def _in_nav(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """J05 for the nav test: closest nav/header/footer/[role=navigation|menu|menubar]."""
    from .tree import closest

    pred = F.col("tag").isin(*rules.NAV_TAGS) | F.col("attrs")["role"].isin(*rules.NAV_ROLES)
    t = targets.select("page_id", F.col("node_id").alias("target_id"), "anc")
    return closest(nodes, t, pred).select("page_id", F.col("target_id").alias("parent_id"), F.lit(True).alias("in_nav"))


def find_lists(ps, limit: int | None = None, scan_max: int | None = None, sample: int | None = None, leaf_cap: int | None = None,
               score_leaves: float | None = None) -> DataFrame:
    """L03 + T04: every repeating structure of every page, best first, with
    distinct row selectors. By default nothing is cut; a caller may ask for at
    most ``limit`` lists per page, parents among the first ``scan_max``
    elements, leaves from the first ``sample`` members counted up to
    ``leaf_cap``, and scores from at most ``score_leaves`` leaves.

    -> (page_id, list_rank, parent_id, row_tag, row_classes, has_child,
        row_selector, row_count, score, score_raw)"""
    nodes = ps.nodes
    body = nodes.filter((F.col("tag") == "body") & (F.col("depth") == 1)).select(
        "page_id", F.col("node_id").alias("body_id"), F.col("end_id").alias("body_end"))
    parents = (
        nodes.filter((F.col("n_children") >= 3) & ~F.col("skipped") & ~F.col("tag").isin("select", "optgroup"))
        .join(body, "page_id")
        .filter((F.col("node_id") > F.col("body_id")) & (F.col("node_id") <= F.col("body_end"))
                & (F.lit(scan_max is None) | (F.col("node_id") - F.col("body_id") <= F.lit(scan_max or 0))) & ~F.col("hidden"))
        .select("page_id", F.col("node_id").alias("parent_id"), "anc")
    )
    bucket = F.concat(
        F.col("tag"), F.lit("|"),
        F.coalesce(F.try_element_at(F.col("sem"), F.lit(1)), F.array_join(F.slice(F.col("grp"), 1, 2), ".")),
    )
    kids = (nodes.filter(~F.col("skipped") & F.col("parent_id").isNotNull())
            .join(parents.select("page_id", "parent_id"), ["page_id", "parent_id"], "left_semi")
            .select("page_id", "parent_id", "node_id", "tag", "classes", "sem", "grp", "child_tags", bucket.alias("bucket")))
    wg = Window.partitionBy("page_id", "parent_id", "bucket")
    kids = kids.withColumn("size", F.count(F.lit(1)).over(wg)).filter(F.col("size") >= 3)
    kids = cut_lineage(kids.withColumn("k", F.row_number().over(wg.orderBy("node_id"))))
    members = (kids if sample is None else kids.filter(F.col("k") <= sample)).select("page_id", "parent_id", "bucket", F.col("node_id").alias("root_id"))
    lv = leaf_counts(nodes, members, leaf_cap)
    mean = members.join(lv, ["page_id", "root_id"]).groupBy("page_id", "parent_id", "bucket").agg(
        F.avg("leaves").alias("leaves"))
    groups = (kids.filter(F.col("k") == 1)
              .select("page_id", "parent_id", "bucket", "size", F.col("node_id").alias("first_id"),
                      F.col("tag").alias("row_tag"), F.col("classes").alias("row_cls"), F.col("sem").alias("row_sem"),
                      F.col("grp").alias("row_grp"), F.col("child_tags").alias("row_kids"))
              .join(mean, ["page_id", "parent_id", "bucket"]).filter(F.col("leaves") >= 2))
    groups = cut_lineage(groups, "groups")  # read twice: leaves are counted once
    nav = _in_nav(nodes, parents.join(groups.select("page_id", "parent_id").distinct(), ["page_id", "parent_id"], "left_semi")
                  .withColumnRenamed("parent_id", "node_id"))
    groups = groups.join(nav, ["page_id", "parent_id"], "left").withColumn(
        "score_raw", F.col("size") * F.least(F.col("leaves"), F.lit(score_leaves).cast("double"))
        * F.when(F.col("in_nav"), F.lit(0.25)).otherwise(F.lit(1.0)))
    groups = cut_lineage(groups)
    groups = cut_lineage(row_selectors(ps, groups, kids))
    # Best first, distinct row selectors
    w1 = Window.partitionBy("page_id", "row_selector").orderBy(F.desc("score_raw"), "parent_id", "first_id")
    g = groups.withColumn("r1", F.row_number().over(w1)).filter(F.col("r1") == 1)
    w2 = Window.partitionBy("page_id").orderBy(F.desc("score_raw"), "parent_id", "first_id")
    g = g.withColumn("list_rank", F.row_number().over(w2))
    if limit is not None:
        g = g.filter(F.col("list_rank") <= limit)
    return g.select(
        "page_id", "list_rank", "parent_id", "bucket", "row_tag", "row_classes", "has_child", "row_selector", "container_steps",
        F.col("size").cast("bigint").alias("row_count"),
        F.floor(F.col("score_raw") + 0.5).cast("bigint").alias("score"), "score_raw", "first_id",
    )


def row_selectors(ps, groups: DataFrame, kids: DataFrame) -> DataFrame:
    """Container unique selector ' > ' row tag + common classes (first 3
    in the row's order: semantic ones every member has, else group ones);
    class-less rows that also match outsiders get ':has(> t)' for the first
    child tag all members have and no outsider has."""
    gk = ["page_id", "parent_id", "bucket"]
    members = kids.select(*gk, "node_id", "tag", "classes", "child_tags")
    cls = members.select(*gk, "node_id", F.explode(F.array_distinct("classes")).alias("c"))
    cnt = cls.groupBy(*gk, "c").agg(F.count(F.lit(1)).alias("n"))
    common = cnt.join(groups.select(*gk, "size"), gk).filter(F.col("n") == F.col("size")).groupBy(*gk).agg(
        F.collect_set("c").alias("all_have"))
    g = groups.join(common, gk, "left").withColumn("all_have", F.coalesce("all_have", F.array().cast("array<string>")))
    sem_c = F.filter("row_sem", lambda c: F.array_contains(F.col("all_have"), c))
    grp_c = F.filter("row_grp", lambda c: F.array_contains(F.col("all_have"), c))
    g = g.withColumn("row_classes", F.slice(F.when(F.size(sem_c) > 0, sem_c).otherwise(grp_c), 1, 3))
    # outsiders: other children of the container with the same tag
    same_tag = (ps.nodes.select("page_id", "parent_id", "node_id", "tag", "classes", "child_tags")
                .join(g.filter(F.size("row_classes") == 0).select("page_id", "parent_id", "bucket", F.col("row_tag").alias("tag")),
                      ["page_id", "parent_id", "tag"]))
    outs = same_tag.join(members.select(*gk, "node_id"), [*gk, "node_id"], "left_anti")
    n_out = outs.groupBy(*gk).agg(F.count(F.lit(1)).alias("n_out"))
    # candidate child tags: distinct child tags of the first row, in order
    ct = g.filter(F.size("row_classes") == 0).select(*gk, "size", F.posexplode("row_kids").alias("ti", "t"))
    mem_has = members.select(*gk, F.explode("child_tags").alias("t")).groupBy(*gk, "t").agg(F.count(F.lit(1)).alias("m"))
    out_has = outs.select(*gk, F.explode(F.array_distinct("child_tags")).alias("t")).groupBy(*gk, "t").agg(F.count(F.lit(1)).alias("o"))
    ok = (ct.join(mem_has, [*gk, "t"]).join(out_has, [*gk, "t"], "left")
          .filter((F.col("m") == F.col("size")) & F.col("o").isNull())
          .groupBy(*gk).agg(F.min_by("t", "ti").alias("has_t")))
    g = g.join(n_out, gk, "left").join(ok, gk, "left")
    g = g.withColumn("has_child", F.when((F.size("row_classes") == 0) & (F.coalesce("n_out", F.lit(0)) > 0), F.col("has_t")))
    g = cut_lineage(g)
    cont = unique_selectors(ps, g.select("page_id", F.col("parent_id").alias("node_id"))).select(
        "page_id", F.col("node_id").alias("parent_id"), F.col("selector").alias("container_selector"),
        F.col("steps").alias("container_steps"))
    g = g.join(cont, ["page_id", "parent_id"], "left")
    part = F.concat(css_escape(F.col("row_tag")),
                    F.array_join(F.transform("row_classes", lambda c: F.concat(F.lit("."), css_escape(c))), ""))
    return g.withColumn("row_selector", F.concat(
        F.col("container_selector"), F.lit(" > "), part,
        F.when(F.col("has_child").isNotNull(), F.concat(F.lit(":has(> "), css_escape(F.col("has_child")), F.lit(")"))).otherwise(F.lit(""))))


def row_steps() -> Column:
    """Steps of a row selector from container_steps, row_tag, row_classes and
    has_child."""
    return F.concat("container_steps", F.array(make_step(tag=F.col("row_tag"), comb="child", classes=F.col("row_classes"), has_child=F.col("has_child")))).cast(STEPS)


def list_rows(ps, lists: DataFrame) -> DataFrame:
    """Rows a row selector matches: children of the container with the row
    tag, all common classes and (if set) a child of the has-child tag.
    -> (page_id, list_rank, row_id, row_ord)"""
    n = ps.nodes.select("page_id", "parent_id", F.col("node_id").alias("row_id"), "tag", "classes", "child_tags")
    j = lists.select("page_id", "list_rank", "parent_id", "row_tag", "row_classes", "has_child").join(n, ["page_id", "parent_id"])
    j = j.filter((F.col("tag") == F.col("row_tag"))
                 & (F.size(F.array_except("row_classes", "classes")) == 0)
                 & (F.col("has_child").isNull() | F.array_contains("child_tags", F.col("has_child"))))
    w = Window.partitionBy("page_id", "list_rank").orderBy("row_id")
    return j.select("page_id", "list_rank", "row_id", F.row_number().over(w).alias("row_ord"))
