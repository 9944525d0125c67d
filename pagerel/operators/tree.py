"""The element table and its tree relations.

Tree questions become equi-joins: ``anc`` (root..self ids) explodes into
the closure table, so "is an ancestor of" is a join on (page_id, anc_id)
instead of a range join. Every join key starts with ``page_id`` and
continues with a node id, so one very large page still spreads over many
shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions.urls import absolutize
from ..sources.shred import BLOCK, drop_page_cols, page_sources, page_texts, shred


def usable_href(attrs: Column) -> Column:
    """href present and not '#...' / 'javascript:'."""
    h = attrs["href"]
    return h.isNotNull() & (h != "") & ~h.rlike(r"(?i)^\s*(?:#|javascript:)")


class PageSet:
    """Pages shredded once and reused by every operator, as tables in the
    shared checkpoint folder: ``nodes`` (one row per element, N01 included),
    ``texts`` (page_id, block, text: the text streams in blocks), ``info``
    (url and resolved base url) and, made when first asked for, ``elements``
    (what selectors can ask of an element, and its join keys), ``chains``
    (the same of its ancestors) and ``sources``."""

    def __init__(self, pages: DataFrame):
        from ..session import cut_lineage

        self._given = pages
        # their sources are read twice at most: to be parsed, and for slices of them
        self.pages = cut_lineage(pages.drop("html"), "pages")
        full = shred(pages).select(
            "*",
            C.semantic_classes(F.col("classes")).alias("sem"),
            C.group_classes(F.col("classes")).alias("grp"),
            ((F.col("tag") == "a") & usable_href(F.col("attrs"))).alias("usable_a"),
        )
        # the HTML is parsed once, and no plan repeats the class-kind lambdas
        full = cut_lineage(full, "nodes")
        self.nodes = drop_page_cols(full)
        self.texts = cut_lineage(page_texts(full), "texts")
        info = full.filter("node_id = 0").select("page_id", "base_href").join(self.pages.select("page_id", "url"), "page_id")
        self.info = info.select("page_id", "url", F.when(F.col("base_href").isNotNull(), absolutize(F.col("base_href"), F.col("url")))
                                .otherwise(F.col("url")).alias("base"))
        self._made: dict = {}
        self._ids_differ: bool | None = None

    def _once(self, name: str, make) -> DataFrame:
        from ..session import cut_lineage

        if name not in self._made:
            self._made[name] = cut_lineage(make(), name)
        return self._made[name]

    def has(self, name: str) -> bool:
        return name in self._made

    @property
    def elements(self) -> DataFrame:
        from .select import keyed_elements

        return self._once("elements", lambda: keyed_elements(self.nodes, self.ids_differ))

    @property
    def ids_differ(self) -> bool:
        """Whether no two pages have one page_id."""
        if self._ids_differ is None:
            self._ids_differ = self.pages.filter("page_id is not null").groupBy("page_id").count().filter("count > 1").isEmpty()
        return self._ids_differ

    @property
    def chains(self) -> DataFrame:
        from .select import chains_of, with_element

        return self._once("chains", lambda: chains_of(self.elements if self.has("elements") else with_element(self.nodes)))

    @property
    def sources(self) -> DataFrame:
        return self._once("sources", lambda: page_sources(self._given))


def sliced(blocks: DataFrame, df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """``df`` (page_id, <start>, <end>, ...) with ``name``: the characters from
    start to end of its page's stream ``blocks`` (page_id, block, text).

    Most slices lie in one block and meet it by (page_id, block); those that
    span several are put together once for each distinct slice. A very long
    page is many keys, and no slice carries more of it than its own."""
    s, e = F.col(start), F.col(end)
    at = df.withColumns({"_b0": F.floor(s / BLOCK).cast("int"), "_b1": F.floor(F.greatest(s, e - 1) / BLOCK).cast("int")})
    cut = lambda b: F.substring("_text", F.greatest(s - b * BLOCK, F.lit(0)) + 1, F.least(e, (b + 1) * BLOCK) - F.greatest(s, b * BLOCK))
    block = blocks.withColumnRenamed("text", "_text")
    one = at.filter("_b0 = _b1").join(block.withColumnRenamed("block", "_b0"), ["page_id", "_b0"], "left")
    one = one.withColumn(name, F.coalesce(F.when(e > s, cut(F.col("_b0"))), F.lit("")))
    long = at.filter("_b0 < _b1")
    parts = long.select("page_id", start, end, "_b0", "_b1").distinct().withColumn("block", F.explode(F.sequence("_b0", "_b1")))
    parts = parts.join(block, ["page_id", "block"]).groupBy("page_id", start, end).agg(
        F.array_sort(F.collect_list(F.struct("block", cut(F.col("block")).alias("t")))).alias("ts"))
    parts = parts.select("page_id", start, end, F.array_join(F.transform("ts", lambda x: x["t"]), "").alias(name))
    many = long.join(parts, ["page_id", start, end], "left").withColumn(name, F.coalesce(name, F.lit("")))
    return one.select(*df.columns, name).unionByName(many.select(*df.columns, name))


def with_text(ps: PageSet, df: DataFrame, name: str = "raw_text") -> DataFrame:
    """``df`` (page_id, t_start, t_end, ...) with the raw text of each
    element, its slice of the page's text stream (subtree texts are contiguous
    in document order)."""
    return sliced(ps.texts, df, "t_start", "t_end", name)


def closure(nodes: DataFrame, cols=(), include_self: bool = True) -> DataFrame:
    """J01 closure: one row per (ancestor, node) pair with the distance.
    Filter ``nodes`` to the rows of interest *before* calling: the output is
    sum(depth) rows."""
    c = nodes.select("page_id", "node_id", "depth", *cols, F.posexplode("anc").alias("apos", "anc_id"))
    c = c.withColumn("dist", F.col("depth") - F.col("apos")).drop("apos")
    if not include_self:
        c = c.filter(F.col("dist") > 0)
    return c


def ancestors(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The chain body..element (html excluded) of each target, as rows
    (page_id, target_id, level_from_top, node columns)."""
    t = targets.select("page_id", F.col("node_id").alias("target_id"))
    tgt = t.join(nodes.select("page_id", F.col("node_id").alias("target_id"), "anc"), ["page_id", "target_id"])
    ex = tgt.select("page_id", "target_id", F.posexplode("anc").alias("pos", "node_id")).filter(F.col("pos") >= 1)
    chain = ex.join(nodes, ["page_id", "node_id"]).withColumn("level", F.col("pos") - 1).drop("pos")
    return chain


def closest(nodes: DataFrame, targets: DataFrame, pred: Column, key: str = "target_id") -> DataFrame:
    """Nearest ancestor-or-self of each target that satisfies ``pred``
    -> (page_id, key, match_id). Closure join + max_by(depth)."""
    t = targets.select("page_id", F.col(key), "anc")
    ex = t.select("page_id", key, F.posexplode("anc").alias("d", "node_id"))
    hits = ex.join(nodes.filter(pred).select("page_id", "node_id"), ["page_id", "node_id"], "left_semi")
    return hits.groupBy("page_id", key).agg(F.max_by("node_id", "d").alias("match_id"))


def lca(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lowest common ancestor of (a_id, b_id) pairs: the deepest shared
    entry of both ancestor arrays (preorder ids grow along a chain)."""
    a = nodes.select("page_id", F.col("node_id").alias("a_id"), F.col("anc").alias("anc_a"))
    b = nodes.select("page_id", F.col("node_id").alias("b_id"), F.col("anc").alias("anc_b"))
    j = pairs.join(a, ["page_id", "a_id"]).join(b, ["page_id", "b_id"])
    return j.select("page_id", "a_id", "b_id", F.array_max(F.array_intersect("anc_a", "anc_b")).alias("lca_id"))


def path_between(anc: Column, ancestor_id: Column) -> Column:
    """Ids strictly below ``ancestor_id`` down to the element itself."""
    pos = F.array_position(anc, ancestor_id)
    return F.slice(anc, (pos + 1).cast("int"), (F.size(anc) - pos).cast("int"))


def signatures(nodes: DataFrame) -> DataFrame:
    """Structure signature per element: child tags and child>grandchild
    tags, as a sorted set -> (page_id, node_id, sig)."""
    kids = nodes.select("page_id", F.col("parent_id").alias("node_id"), "tag", "child_tags").filter(
        F.col("node_id").isNotNull())
    items = kids.select(
        "page_id", "node_id",
        F.concat(F.array("tag"), F.transform("child_tags", lambda g: F.concat(F.col("tag"), F.lit(">"), g))).alias("it"),
    ).select("page_id", "node_id", F.explode("it").alias("s"))
    sig = items.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_set("s")).alias("sig"))
    return nodes.select("page_id", "node_id").join(sig, ["page_id", "node_id"], "left").select(
        "page_id", "node_id", F.coalesce("sig", F.array().cast("array<string>")).alias("sig"))


def neighbourhood(nodes: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """Per target the previous / next element sibling, its index and
    sibling count, and its children (the first ``most`` if given, and how many
    more there are)."""
    w = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    sib = nodes.select(
        "page_id", "node_id", "parent_id",
        F.lag("node_id").over(w).alias("prev_id"), F.lead("node_id").over(w).alias("next_id"),
        (F.row_number().over(w) - 1).alias("index"),
    )
    t = targets.select("page_id", "node_id").join(sib, ["page_id", "node_id"])
    par = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("n_children").alias("sibling_count"))
    t = t.join(par, ["page_id", "parent_id"], "left")
    kids = (nodes if most is None else nodes.filter(F.col("sib_ord") <= most)).select(
        "page_id", F.col("parent_id").alias("node_id"), F.struct("sib_ord", "node_id", "tag").alias("k"))
    kid_lists = kids.join(targets.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi").groupBy(
        "page_id", "node_id").agg(F.array_sort(F.collect_list("k")).alias("children"))
    cnt = nodes.select("page_id", "node_id", "n_children")
    return (t.join(kid_lists, ["page_id", "node_id"], "left").join(cnt, ["page_id", "node_id"])
            .withColumn("more_children", F.greatest(F.col("n_children") - F.lit(most), F.lit(0)) if most is not None else F.lit(0)))
