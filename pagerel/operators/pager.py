"""Pagination as data (G01-G06) and stable page changes.

The reference clicks through pages one at a time; here the pages are
already a table, so "following the next link" is a join from a page's
resolved next-link url to the stored page with that url, and chains grow by
joining links that span ever more steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clean, fnv1a36, match_text
from ..functions.urls import absolutize
from ..session import cut_lineage
from .tree import closest, with_text


def clickable(nodes_cols=None) -> Column:
    """CLICKABLE: a, button, [role=button|link], input[type=submit|button],
    [onclick], [tabindex]."""
    a = F.col("attrs")
    return (F.col("tag").isin(*rules.CLICKABLE_TAGS) | a["role"].isin(*rules.CLICKABLE_ROLES)
            | ((F.col("tag") == "input") & a["type"].isin(*rules.CLICKABLE_INPUT_TYPES))
            | a["onclick"].isNotNull() | a["tabindex"].isNotNull())


def is_disabled(ps) -> DataFrame:
    """Disabled attribute of a form control, aria-disabled=true, or 'disabled' as a class
    word (isolated or as a -/_ suffix part) on the element or its 2 nearest
    ancestors -> (page_id, node_id, disabled)."""
    nodes = ps.nodes
    own = ((F.col("attrs")["disabled"].isNotNull() & F.col("tag").isin(*rules.FORM_CONTROLS))
           | F.coalesce(F.col("attrs")["aria-disabled"] == "true", F.lit(False)))
    cls_hit = nodes.filter(F.coalesce(F.col("attrs")["class"], F.lit("")).rlike(rules.DISABLED_CLASS)).select("page_id", F.col("node_id").alias("hit"))
    up = nodes.select("page_id", "node_id", F.posexplode(F.reverse("anc")).alias("dist", "hit")).filter(F.col("dist") <= 2)
    by_cls = up.join(cls_hit, ["page_id", "hit"], "left_semi").select("page_id", "node_id").distinct().withColumn("c", F.lit(True))
    # where nothing has such a class the join goes, and the elements' size is their file's again
    return nodes.select("page_id", "node_id", own.alias("o")).join(by_cls, ["page_id", "node_id"], "left").hint("merge").select(
        "page_id", "node_id", (F.col("o") | F.coalesce("c", F.lit(False))).alias("disabled"))


def describe_targets(ps, picks: DataFrame) -> DataFrame:
    """The nearest clickable around each pick, its unique selector, its
    text, aria-label and rel -> target struct columns."""
    from .lists import unique_selectors

    nodes = ps.nodes
    p = picks.select("page_id", F.col("node_id").alias("target_id")).join(
        nodes.select("page_id", F.col("node_id").alias("target_id"), "anc"), ["page_id", "target_id"])
    cl = closest(nodes, p, clickable())
    t = p.join(cl, ["page_id", "target_id"], "left").select("page_id", "target_id", F.coalesce("match_id", "target_id").alias("node_id"))
    sel = unique_selectors(ps, t.select("page_id", "node_id"))
    info = nodes.select("page_id", "node_id", "attrs", "t_start", "t_end")
    mt = match_text(F.col("raw_text"))
    return with_text(ps, t.join(sel, ["page_id", "node_id"]).join(info, ["page_id", "node_id"])).select(
        "page_id", F.col("target_id").alias("pick_id"), "node_id", "selector",
        mt.alias("text"),
        F.coalesce(F.col("attrs")["aria-label"], F.lit("")).alias("aria"),
        F.coalesce(F.col("attrs")["rel"], F.lit("")).alias("rel"))


def _clickable_hits(ps, selector_hits: DataFrame) -> DataFrame:
    """Each hit of a recorded selector, or the nearest clickable around it."""
    sh = selector_hits.select("page_id", "node_id").join(ps.nodes.select("page_id", "node_id", "anc"), ["page_id", "node_id"])
    ck = closest(ps.nodes, sh.select("page_id", F.col("node_id").alias("target_id"), "anc"), clickable())
    return sh.join(ck.withColumnRenamed("target_id", "node_id"), ["page_id", "node_id"], "left").select(
        "page_id", F.coalesce("match_id", "node_id").alias("node_id"))


def resolve_targets(ps, targets: DataFrame, selector_hits: DataFrame | None = None) -> DataFrame:
    """Find the pager target on each page, in order: selector match
    (mapped to its clickable, first visible) whose text/aria agrees or when
    none is recorded; any visible clickable with the same text/aria
    (lower-cased); the selector match anyway; same rel token;
    a[rel~=next]; a/button whose text (or aria-label) is a next word.
    targets: (page_id, text, aria, rel); selector_hits: (page_id, node_id)
    matches of the recorded selector. -> (page_id, node_id, rank)"""
    nodes = ps.nodes
    # only what can be a target is read for its text
    rel = F.col("attrs")["rel"]
    able = clickable() | F.col("tag").isin("a", "button") | (F.coalesce(rel, F.lit("")) != "")
    info = nodes.filter(~F.col("hidden")).select("page_id", "node_id", "tag", "attrs", "anc", "t_start", "t_end")
    meant = info.filter(able)
    if selector_hits is not None:
        meant = meant.unionByName(info.filter(~able).join(_clickable_hits(ps, selector_hits), ["page_id", "node_id"], "left_semi"))
    mt = match_text(F.col("raw_text"))
    el = with_text(ps, meant).select("page_id", "node_id", "tag", "attrs", "anc", F.lower(mt).alias("lt"),
                                     F.lower(F.coalesce(F.col("attrs")["aria-label"], F.lit(""))).alias("la"), mt.alias("mt"))
    el = cut_lineage(el, "pager-candidates")
    t = targets.select("page_id", F.lower(F.coalesce("text", F.lit(""))).alias("tt"),
                       F.lower(F.coalesce("aria", F.lit(""))).alias("ta"), F.coalesce("rel", F.lit("")).alias("tr"))
    j = el.join(t, "page_id")
    same = ((F.col("tt") != "") & (F.col("lt") == F.col("tt"))) | ((F.col("ta") != "") & (F.col("la") == F.col("ta")))
    recorded = (F.col("tt") != "") | (F.col("ta") != "")
    cands = []
    if selector_hits is not None:
        bysel = j.join(_clickable_hits(ps, selector_hits), ["page_id", "node_id"], "left_semi")
        first = bysel.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))).filter(F.col("r") == 1).drop("r")
        cands.append(first.filter(~recorded | same).select("page_id", "node_id", F.lit(1).alias("rank")))
        cands.append(first.select("page_id", "node_id", F.lit(3).alias("rank")))
    j2 = j.filter(clickable())
    cands.append(j2.filter(recorded & same).select("page_id", "node_id", F.lit(2).alias("rank")))
    rel_tokens = F.split(F.coalesce(F.col("attrs")["rel"], F.lit("")), r"\s+")
    cands.append(j.filter((F.col("tr") != "") & F.array_contains(rel_tokens, F.regexp_replace("tr", '"', ""))).select(
        "page_id", "node_id", F.lit(4).alias("rank")))
    cands.append(j.filter((F.col("tag") == "a") & F.array_contains(rel_tokens, "next")).select("page_id", "node_id", F.lit(5).alias("rank")))
    word = F.when(F.col("mt") != "", F.col("mt")).otherwise(F.coalesce(F.col("attrs")["aria-label"], F.lit("")))
    cands.append(j.filter(F.col("tag").isin("a", "button") & word.rlike(rules.NEXT_WORDS)).select("page_id", "node_id", F.lit(6).alias("rank")))
    u = cands[0]
    for c in cands[1:]:
        u = u.unionByName(c)
    w = Window.partitionBy("page_id").orderBy("rank", "node_id")
    return u.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1).drop("r")


def target_state(ps, targets: DataFrame, selector_hits: DataFrame | None = None) -> DataFrame:
    """Per page: found, disabled, label."""
    res = resolve_targets(ps, targets, selector_hits)
    dis = is_disabled(ps)
    info = res.select("page_id", "node_id").join(ps.nodes.select("page_id", "node_id", "t_start", "t_end"), ["page_id", "node_id"])
    lab = with_text(ps, info).select("page_id", "node_id", match_text(F.col("raw_text")).alias("label"))
    # labels and states are as many as the pages: not for the driver to hold
    r = res.join(dis, ["page_id", "node_id"], "left").join(lab.hint("merge"), ["page_id", "node_id"], "left")
    return targets.select("page_id").distinct().join(r.hint("merge"), "page_id", "left").select(
        "page_id", F.col("node_id").isNotNull().alias("found"), F.coalesce("disabled", F.lit(False)).alias("disabled"),
        F.coalesce("label", F.lit("")).alias("label"), "node_id")


def page_signatures(ps, rows: DataFrame) -> DataFrame:
    """Url | row count | hash of the first row's text | hash of the last
    row's text. rows: (page_id, row_id)."""
    r = rows.select("page_id", F.col("row_id").alias("node_id")).join(ps.nodes.select("page_id", "node_id", "t_start", "t_end"), ["page_id", "node_id"])
    # the text of the first and of the last row only
    ends = r.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("t_start", "t_end"), "node_id").alias("a"), F.max_by(F.struct("t_start", "t_end"), "node_id").alias("b"))
    ends = cut_lineage(ends, "row-ends")
    both = ends.select("page_id", F.explode(F.array(F.struct(F.lit("first").alias("which"), "a.*"), F.struct(F.lit("last").alias("which"), "b.*"))).alias("e")).select("page_id", "e.*")
    text = with_text(ps, both).groupBy("page_id").pivot("which", ["first", "last"]).agg(F.first(clean(F.col("raw_text"))))
    g = ends.select("page_id", "n").join(text, "page_id")
    out = ps.info.select("page_id", "url").join(g, "page_id", "left").select(
        "page_id", "url", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        fnv1a36(F.coalesce("first", F.lit(""))).alias("fp_first"), fnv1a36(F.coalesce("last", F.lit(""))).alias("fp_last"))
    return out.withColumn("sig", F.concat_ws("|", "url", F.col("n").cast("string"), "fp_first", "fp_last"))


def _walked(starts: DataFrame, ways: DataFrame, max_pages: int | None) -> DataFrame:
    """(start_id, step, page_id): the pages that ``ways`` (page_id, next_id)
    lead to from each start, each with the first step that reaches it."""
    jump = ways
    known = cut_lineage(starts.select(F.col("page_id").alias("start_id"), F.lit(1).cast("bigint").alias("step"), "page_id").distinct())
    span, n = 1, known.count()
    while max_pages is None or span < max_pages:
        further = known.join(jump, "page_id").select("start_id", (F.col("step") + span).alias("step"), F.col("next_id").alias("page_id"))
        if max_pages is not None:
            further = further.filter(F.col("step") <= max_pages)
        # a page that comes again belongs to a round trip: its first step counts
        known = cut_lineage(known.unionByName(further).groupBy("start_id", "page_id").agg(F.min("step").alias("step")).select("start_id", "step", "page_id"))
        before, n = n, known.count()
        if n == before:
            break
        hop = jump.select(F.col("page_id").alias("next_id"), F.col("next_id").alias("then"))
        jump, span = cut_lineage(jump.join(hop, "next_id").select("page_id", F.col("then").alias("next_id"))), span * 2
    return known


def _walked_over(known: DataFrame, ways: DataFrame, max_pages: int | None) -> DataFrame:
    """Pages that some start leads to, also beyond the limit of pages."""
    if max_pages is None:
        return known.select("page_id").distinct()
    return _walked(known.filter("step = 1").select("page_id"), ways, None).select("page_id").distinct()


def ring_starts(ring: DataFrame) -> DataFrame:
    """(page_id): the smallest page of each ring of ``ring`` (page_id,
    next_id), where every page lies on one: labels of pages 1, 2, 4, ... steps
    ahead are taken over where they are smaller, log2 of the longest ring's
    length times, until every page has its next one's label."""
    at = cut_lineage(ring.select("page_id", "next_id", F.col("page_id").alias("label")))
    steps = ring
    while True:
        ahead = at.select(F.col("page_id").alias("next_id"), F.col("next_id").alias("then"), F.col("label").alias("other"))
        at = cut_lineage(at.join(ahead, "next_id").select("page_id", F.col("then").alias("next_id"), F.least("label", "other").alias("label")))
        label = at.select("page_id", "label")
        unlike = steps.join(label, "page_id").join(label.select(F.col("page_id").alias("next_id"), F.col("label").alias("other")), "next_id").filter("label <> other")
        if unlike.isEmpty():
            return label.filter("page_id = label").select("page_id")


def page_chain(ps, next_links: DataFrame, starts: DataFrame | None, sigs: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Follow resolved next links through the stored pages from each
    start page (None: from every page that no next link leads to), at most
    ``max_pages`` pages. next_links: (page_id, href, disabled) for pages where
    a target was found; sigs: (page_id, n, sig). Stop reasons: 'limit', 'not
    found', 'disabled', 'not stored', 'unchanged', 'no rows', 'seen'.

    A set-based job: links that 1, 2, 4, ... steps span are joined with
    themselves, and the chains known so far are extended by as many steps, so
    chains of n pages take log2(n) rounds. A chain that comes back to one of
    its pages ends there. Rings that no start leads to are walked from their
    smallest page (where ``starts`` is None), once round. -> (start_id, step, page_id, reason on the last step)"""
    pages = ps.info.select("page_id", "url", "base")
    # each of these is as long as the pages: joined by sort and merge
    nl = next_links.join(pages.hint("merge"), "page_id").select("page_id", absolutize(F.col("href"), F.col("base")).alias("next_url"), "disabled")
    # of pages with the same url the first counts
    by_url = pages.groupBy(F.col("url").alias("next_url")).agg(F.min("page_id").alias("next_id"))
    s = sigs.select("page_id", "n", "sig")
    at = pages.select("page_id").join(s.hint("merge"), "page_id", "left").join(nl.hint("merge"), "page_id", "left").join(by_url.hint("merge"), "next_url", "left")
    at = at.join(s.select(F.col("page_id").alias("next_id"), F.col("sig").alias("next_sig")).hint("merge"), "next_id", "left")
    at = cut_lineage(at.select("page_id", "next_id", F.when(F.coalesce("n", F.lit(0)) == 0, "no rows").when(F.col("next_url").isNull(), "not found")
                               .when(F.col("disabled"), "disabled").when(F.col("next_id").isNull(), "not stored")
                               .when((F.col("next_id") == F.col("page_id")) | (F.col("next_sig") == F.col("sig")), "unchanged").alias("reason")))
    ways = at.filter(F.col("reason").isNull()).select("page_id", "next_id")
    if starts is not None:
        known = _walked(starts.select("page_id"), ways, max_pages)
    else:
        known = _walked(at.select("page_id").join(ways.select(F.col("next_id").alias("page_id")), "page_id", "left_anti"), ways, max_pages)
        # what no start leads to lies on rings; each is walked from its smallest page
        ring = cut_lineage(ways.join(_walked_over(known, ways, max_pages), "page_id", "left_anti"), "rings")
        if not ring.isEmpty():
            known = known.unionByName(_walked(ring_starts(ring), ring, max_pages))
    last = known.groupBy("start_id").agg(F.max("step").alias("step")).withColumn("_last", F.lit(True))
    out = known.join(last.hint("merge"), ["start_id", "step"], "left").join(at.select("page_id", F.col("reason").alias("why")), "page_id", "left")
    end = F.when(F.col("step") == F.lit(max_pages), F.coalesce("why", F.lit("limit"))).otherwise(F.coalesce("why", F.lit("seen")))
    return out.select("start_id", "step", "page_id", F.when(F.col("_last"), end).alias("reason"))


def stable_changes(snapshots: DataFrame, key: str = "url", ts: str = "seen_at", sig: str = "sig", count: str = "n") -> DataFrame:
    """A snapshot is stable when it has rows and equals the poll right
    before it; it counts as a change when it differs from the last stable
    state before it, or from the first poll if there is none."""
    w = Window.partitionBy(key).orderBy(ts)
    s = snapshots.withColumn("prev", F.lag(sig).over(w)).withColumn("_first", F.first(sig).over(w))
    stable = s.filter((F.col(count) > 0) & (F.col(sig) == F.col("prev")))
    state = F.coalesce(F.lag(sig).over(w), F.col("_first"))
    return stable.withColumn("_state", state).filter(F.col(sig) != F.col("_state")).drop("_state", "_first")
