"""Selector matching as joins.

A selector is an array of steps (``schema.STEP``), and steps are data: every
scope row may carry its own, so one job evaluates different selectors for
different pages, rows or columns. All steps of all selectors are resolved
together, whatever their number and the depth of the pages:

1. The *last* step of each selector meets the nodes that carry its most
   selective feature, by (page_id, feature); inside a scope, by (page_id, scope,
   feature) over the ancestors of these nodes only.
2. The other steps are looked for in the chain of the node's ancestors, one
   array per parent element (``PageSet.chains``): going down the chain, bit j of
   a number says whether steps 0..j end at the element (``here``) or at it or
   above (``seen``); a child step asks the parent's bits, a descendant step all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_text

MOST_STEPS = 62  # bits of a number
KEY_CHARS = 64  # of an attribute's value in a key
PARENT = "\n"  # between a key and the parent's feature


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _pairs(attrs: Column) -> Column:
    """A map as sorted 'name=value' strings."""
    return F.array_sort(F.transform(F.map_entries(attrs), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def place_key(tag: Column, nth: Column) -> Column:
    return F.concat(F.lit("n:"), nth.cast("string"), F.lit(":"), tag)


def step_key(s: Column) -> Column:
    """The join key of a step: its most selective feature."""
    classes, attrs = _strings(s["classes"]), _strings(_pairs(s["attrs"]))
    return (
        F.when(F.coalesce(s["id"], F.lit("")) != "", F.concat(F.lit("i:"), s["id"]))
        .when(s["nth"].isNotNull() & s["tag"].isNotNull(), place_key(s["tag"], s["nth"]))
        .when(F.size(classes) > 0, F.concat(F.lit("c:"), F.try_element_at(classes, F.lit(1))))
        .when(F.size(attrs) > 0, F.concat(F.lit("a:"), F.left(F.try_element_at(attrs, F.lit(1)), F.lit(KEY_CHARS))))
        .when(s["tag"].isNotNull(), F.concat(F.lit("t:"), s["tag"]))
        .otherwise(F.lit("*"))
    )


def near_key(steps: Column) -> Column:
    """The join key of the last step of ``steps``; with the parent's feature,
    if it is a child's, so that the cells of a column meet in their row only."""
    key, above = step_key(F.element_at(steps, -1)), F.try_element_at(steps, F.lit(-2))
    told = (F.element_at(steps, -1)["comb"] == "child") & above["tag"].isNotNull() & key.rlike("^[tnc]:")
    parent = F.when(above["nth"].isNotNull(), place_key(above["tag"], above["nth"])).otherwise(F.concat(F.lit("t:"), above["tag"]))
    return F.when(told, F.concat(key, F.lit(PARENT), parent)).otherwise(key)


def key_kind(key: Column) -> Column:
    """What sort of feature a key names, and of the parent if it names one."""
    parent = F.when(key.rlike("^[tnc]:"), F.regexp_extract(key, PARENT + "([tn])", 1)).otherwise("")
    return F.concat(F.left(key, F.lit(1)), parent)


def told_by_key(steps: Column) -> Column:
    """Does ``near_key`` say all that ``steps`` (with pairs) ask for in a page?"""
    def plain(s: Column) -> Column:
        return s["tag"].isNotNull() & (F.coalesce(s["id"], F.lit("")) == "") & (F.size(_strings(s["classes"])) == 0) & (F.size(s["pairs"]) == 0) & s["has_child"].isNull() & s["text"].isNull()

    last = F.element_at(steps, -1)
    above = F.when(F.size(steps) == 2, (last["comb"] == "child") & plain(F.try_element_at(steps, F.lit(-2)))).otherwise(F.size(steps) == 1)
    return F.coalesce(plain(last) & above, F.lit(False))


def own_keys() -> Column:
    """Every feature of an element that a step can be keyed on."""
    return F.concat(
        F.array(F.concat(F.lit("t:"), F.col("tag")), F.lit("*"), place_key(F.col("tag"), F.col("nth"))),
        F.transform("classes", lambda c: F.concat(F.lit("c:"), c)),
        F.when(F.col("id") != "", F.array(F.concat(F.lit("i:"), F.col("id")))).otherwise(F.array().cast("array<string>")),
        F.array_distinct(F.transform(_pairs(F.col("attrs")), lambda a: F.concat(F.lit("a:"), F.left(a, F.lit(KEY_CHARS))))),
    )


def node_keys(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, anc, key) for every feature a step can be keyed on."""
    return nodes.select("page_id", "node_id", "anc", F.explode(own_keys()).alias("key"))


def keyed_elements(nodes: DataFrame, near: bool) -> DataFrame:
    """``with_element`` with each element's ``keys`` and, if asked for, those
    of them that are told apart by the parent's features (see ``near_key``);
    no two elements may have one number then."""
    out = with_element(nodes.withColumn("keys", own_keys()), keep=("keys",))
    none = F.array().cast("array<string>")
    if not near:
        return out.withColumn("near", none)
    features = lambda el: (F.concat(F.lit("t:"), el["tag"]), place_key(el["tag"], el["nth"]))
    above = nodes.filter("n_children > 0").select("page_id", F.col("node_id").alias("parent_id"), F.array(*features(nodes)).alias("above"))
    ends = [F.concat(F.lit(PARENT), F.get("above", F.lit(i))) for i in (0, 1)]
    classes = F.flatten(F.transform("el.classes", lambda c: F.array(*[F.concat(F.lit("c:"), c, e) for e in ends])))
    # the root has no parent
    near = F.when(F.col("above").isNotNull(), F.concat(F.array(*[F.concat(f, e) for f in features(F.col("el")) for e in ends]), classes)).otherwise(none)
    return out.join(above.hint("merge"), ["page_id", "parent_id"], "left").withColumn("near", near).drop("above")


def with_element(nodes: DataFrame, text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` as (page_id, node_id, parent_id, depth, n_children, anc, el):
    what a step can ask of an element; its match text only if asked for."""
    own = F.col("mtext") if text else F.lit(None).cast("string")
    el = F.struct("tag", "id", "classes", _pairs(F.col("attrs")).alias("pairs"), "nth", "child_tags", own.alias("text"))
    return nodes.select("page_id", "node_id", "parent_id", "depth", "n_children", "anc", el.alias("el"), *keep)


def step_holds(s: Column, el: Column) -> Column:
    """Does element ``el`` satisfy step ``s``?"""
    return F.coalesce(
        (s["tag"].isNull() | (el["tag"] == s["tag"]))
        & ((F.coalesce(s["id"], F.lit("")) == "") | (el["id"] == s["id"]))
        & ((F.size(_strings(s["classes"])) == 0) | (F.size(F.array_except(_strings(s["classes"]), el["classes"])) == 0))
        & ((F.size(_strings(s["pairs"])) == 0) | (F.size(F.array_except(_strings(s["pairs"]), el["pairs"])) == 0))
        & (s["nth"].isNull() | (el["nth"] == s["nth"]))
        & (s["has_child"].isNull() | F.array_contains(el["child_tags"], s["has_child"]))
        & (s["text"].isNull() | (el["text"] == s["text"])), F.lit(False))


def chains_of(elements: DataFrame) -> DataFrame:
    """(page_id, parent_id, chain): for each element with children the
    elements from the root down to it, as structs of their depth and ``el``."""
    up = elements.filter("n_children > 0").select("page_id", F.col("node_id").alias("parent_id"), F.posexplode("anc").alias("pos", "node_id"))
    met = up.join(elements.select("page_id", "node_id", "el"), ["page_id", "node_id"])
    return met.groupBy("page_id", "parent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "el"))).alias("chain"))


def _bit(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), j)


def _has(bits: Column, j: Column) -> Column:
    """Bit ``j`` of ``bits``; there is none below 0."""
    return F.when(j < 0, F.lit(False)).otherwise(F.getbit(bits, F.greatest(j, F.lit(0))) == 1)


def chain_holds(steps: Column, chain: Column, below: Column) -> Column:
    """Do all steps but the last lie in the part of ``chain`` under depth
    ``below`` (-1: the whole chain, whose first step may be anywhere), so that
    the last step's combinator leads to the chain's end?"""
    upper = F.slice(steps, 1, F.size(steps) - 1)
    zero = F.lit(0).cast("bigint")

    def down(acc: Column, e: Column) -> Column:
        def ends_here(s: Column, j: Column) -> Column:
            first = (s["comb"] != "child") | (below < 0) | (e["pos"] == below + 1)
            after = F.when(s["comb"] == "child", _has(acc["here"], j - 1)).otherwise(_has(acc["seen"], j - 1))
            return F.when(F.when(j == 0, first).otherwise(after) & step_holds(s, e["el"]), _bit(j)).otherwise(zero)

        here = F.aggregate(F.transform(upper, ends_here), zero, lambda a, b: a + b)
        return F.struct(acc["seen"].bitwiseOR(here).alias("seen"), here.alias("here"))

    inside = F.filter(chain, lambda e: e["pos"] > below)
    end = F.aggregate(inside, F.struct(zero.alias("seen"), zero.alias("here")), down)
    last, child = F.size(steps) - 2, F.element_at(steps, -1)["comb"] == "child"
    # of two steps, a child's looks at the parent only
    parent, s = F.try_element_at(chain, F.lit(-1)), F.get(steps, F.lit(0))
    two = (parent["pos"] > below) & ((s["comb"] != "child") | (below < 0) | (parent["pos"] == below + 1)) & step_holds(s, parent["el"])
    whole = F.when(child, _has(end["here"], last)).otherwise(_has(end["seen"], last))
    return F.coalesce(F.when(child & (F.size(steps) == 2), two).otherwise(whole), F.lit(False))


def with_pairs(steps: Column) -> Column:
    """Steps with their attributes as 'name=value' strings."""
    return F.transform(steps, lambda s: s.withField("pairs", _strings(_pairs(s["attrs"]))))


class Matcher:
    """Evaluates step arrays over one ``PageSet``."""

    def __init__(self, ps):
        self.ps = ps

    def _elements(self, keys: DataFrame | None) -> DataFrame:
        """Elements, with the match text of those that a text step may mean."""
        nodes = self.ps.nodes
        if keys is None:
            return self.ps.elements if self.ps.has("elements") else with_element(nodes)
        from .tree import with_text

        meant = node_keys(nodes).join(keys, ["page_id", "key"], "left_semi").select("page_id", "node_id").distinct()
        meant = with_text(self.ps, nodes.join(meant, ["page_id", "node_id"], "left_semi").select("page_id", "node_id", "t_start", "t_end"))
        texts = meant.select("page_id", "node_id", match_text(F.col("raw_text")).alias("mtext"))
        return with_element(nodes.join(texts, ["page_id", "node_id"], "left"), text=True)

    def match(self, scopes: DataFrame, sels: DataFrame, sel_key: list[str], carry: list[str] = (), include_scope: bool = False,
              texts: bool | None = None) -> DataFrame:
        """scopes: (page_id, scope_id, *carry), no two rows alike; sels:
        (*sel_key, steps), where ``sel_key`` is among page_id, scope_id and
        ``carry`` and names one selector. Returns the matches (page_id,
        scope_id, *carry, node_id). The first step matches strict descendants
        of the scope; a document-level selector (``include_scope``, the scope
        being the root) may match the root too. ``texts``: whether any step
        asks for text (None: looked for)."""
        own = ["page_id", "scope_id", *carry]
        return self.match_asked(scopes.select(*own).join(sels.select(*sel_key, "steps"), sel_key), list(carry), include_scope, texts)

    def match_asked(self, asked: DataFrame, carry: list[str], include_scope: bool = False, texts: bool | None = None) -> DataFrame:
        """``match`` of selectors that come with their scopes: (page_id,
        scope_id, *carry, steps)."""
        from ..session import cut_lineage

        nodes, own = self.ps.nodes, ["page_id", "scope_id", *carry]
        stored = self.ps.has("elements")
        near = stored and self.ps.ids_differ
        too_long = F.raise_error(F.lit(f"a selector has more than {MOST_STEPS} steps")).cast("boolean")
        asked = asked.filter(F.when(F.size("steps") > MOST_STEPS, too_long).otherwise(F.size("steps") > 0))
        asked = asked.select(*own, with_pairs(F.col("steps")).alias("steps"))
        # read several times below
        asked = cut_lineage(asked.withColumns({"key": near_key(F.col("steps")) if near else step_key(F.element_at("steps", -1)),
                                               "told": told_by_key(F.col("steps")) if near and include_scope else F.lit(False)}), "asked")
        keys = None
        if texts is None or texts:
            each = asked.select("page_id", F.explode("steps").alias("s")).filter(F.col("s.text").isNotNull())
            if texts or not each.isEmpty():
                keys = each.select("page_id", step_key(F.col("s")).alias("key")).distinct()
        # a few kinds of keys each: of elements only these are dealt out
        said = {r["told"]: r for r in asked.groupBy("told").agg(F.max(F.size("steps")).alias("longest"), F.sort_array(F.collect_set(key_kind(F.col("key")))).alias("kinds")).collect()}

        def met_by_key(some: DataFrame, kinds: list[str], wanted: list[str]) -> DataFrame:
            if stored:
                keyed = self.ps.elements.select("page_id", "node_id", "anc", F.explode(F.concat("keys", "near") if any(len(k) > 1 for k in kinds) else "keys").alias("key"))
                keyed = keyed.filter(key_kind(F.col("key")).isin(kinds))
            else:
                keyed = node_keys(nodes)
            # told apart by a number first: quicker to sort than like page_ids
            by = ["_hash", "page_id", "key"]
            some, keyed = (x.withColumn("_hash", F.xxhash64("page_id", "key")) for x in (some, keyed))
            if include_scope:
                return some.join(keyed.drop("anc"), by).drop("_hash").withColumn("below", F.lit(-1)).select(*wanted, "node_id")
            keyed = keyed.join(some.select(*by).distinct(), by, "left_semi")
            inner = keyed.select("page_id", "node_id", "key", (F.size("anc") - 1).alias("self"), F.posexplode("anc").alias("below", "scope_id"))
            return some.drop("_hash").join(inner.filter("below < self").drop("self"), ["page_id", "scope_id", "key"]).select(*wanted, "node_id")

        sure = None
        if True in said:  # what the key tells is not looked for again
            sure = met_by_key(asked.filter("told").select(*own, "key"), said[True]["kinds"], own)
            if False not in said:
                return sure
        longest, kinds = (said[False]["longest"], said[False]["kinds"]) if said else (0, [])
        asked = asked.filter("not told").drop("told")
        met = met_by_key(asked, kinds, [*own, "steps", "below"])
        elements = self._elements(keys)
        last = F.element_at("steps", -1)
        met = met.join(elements.select("page_id", "node_id", "parent_id", "depth", "el"), ["page_id", "node_id"]).filter(step_holds(last, F.col("el")))
        # one step has nothing to look for above, but a child of the scope
        alone = (last["comb"] != "child") | (F.col("below") < 0) | (F.col("depth") == F.col("below") + 1)
        if longest <= 1:  # all have one step: no chain is read
            met = met.filter(alone)
        else:
            met = met.withColumn("parent_id", F.when(F.size("steps") > 1, F.col("parent_id")))
            chains = self.ps.chains if keys is None else chains_of(elements)
            met = met.join(chains, ["page_id", "parent_id"], "left")
            met = met.filter(F.when(F.size("steps") == 1, alone).otherwise(chain_holds(F.col("steps"), F.col("chain"), F.col("below"))))
        met = met.select(*own, "node_id")
        return met if sure is None else sure.unionByName(met)


def distinct_matches(ps, sels: DataFrame, include_scope: bool) -> DataFrame:
    """How many nodes each distinct selector matches: sels (page_id, scope_id,
    css, steps), rows with the same css being the same selector ->
    (page_id, scope_id, css, matches, last_id). Like elements ask alike, so
    what is matched does not grow with the number of those that ask. Asked
    again and again, so the keys of the elements are stored."""
    key = ["page_id", "scope_id", "css"]
    each = sels.groupBy(*key).agg(F.first("steps").alias("steps"))
    ps.elements  # noqa: B018
    m = Matcher(ps).match_asked(each, ["css"], include_scope, texts=False)
    return m.groupBy(*key).agg(F.count(F.lit(1)).alias("matches"), F.max("node_id").alias("last_id"))


def steps_lit(steps: list[dict]) -> Column:
    """A driver-side selector as a literal ``ARRAY<STEP>`` column."""
    from ..schema import STEPS

    def one(st):
        attrs = st.get("attrs") or {}
        amap = (F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), F.lit(v))]) if attrs
                else F.create_map().cast("map<string,string>"))
        return F.struct(
            F.lit(st.get("comb", "desc")).alias("comb"), F.lit(st.get("tag")).cast("string").alias("tag"),
            F.lit(st.get("id")).cast("string").alias("id"),
            F.array(*[F.lit(c) for c in st.get("classes") or []]).cast("array<string>").alias("classes"),
            amap.alias("attrs"), F.lit(st.get("nth")).cast("int").alias("nth"),
            F.lit(st.get("text")).cast("string").alias("text"),
            F.lit(st.get("has_child")).cast("string").alias("has_child"),
        )

    return F.array(*[one(s) for s in steps]).cast(STEPS)


def make_step(tag=None, comb="desc", id=None, classes=None, attrs=None, nth=None, has_child=None) -> Column:
    """A step from columns; what is not given is not asked for."""
    no = F.lit(None).cast("string")
    return F.struct(
        (comb if isinstance(comb, Column) else F.lit(comb)).alias("comb"), (no if tag is None else tag).alias("tag"), (no if id is None else id).alias("id"),
        (F.array().cast("array<string>") if classes is None else classes).alias("classes"),
        (F.create_map().cast("map<string,string>") if attrs is None else attrs).alias("attrs"),
        (F.lit(None) if nth is None else nth).cast("int").alias("nth"), no.alias("text"), (no if has_child is None else has_child).alias("has_child"))


def select_nodes(ps, steps: list[dict]) -> DataFrame:
    """all nodes of all pages matching a selector (driver-side steps).
    Empty selector -> no rows."""
    if not steps:
        return ps.nodes.select("page_id", "node_id").limit(0)
    validate_steps(steps)
    scopes = ps.nodes.filter(F.col("parent_id").isNull()).select("page_id", F.col("node_id").alias("scope_id"))
    # keyed by page, so no selector is one key for all pages
    m = Matcher(ps).match(scopes, scopes.select("page_id", steps_lit(steps).alias("steps")), ["page_id"], include_scope=True,
                          texts=any(s.get("text") is not None for s in steps))
    return m.select("page_id", "node_id")


def validate_steps(steps: list[dict]) -> None:
    """Early error for a bad selector, before any scan (like the reference's
    'Invalid selector')."""
    for s in steps:
        if s.get("comb") not in ("desc", "child"):
            raise ValueError(f"Invalid selector: bad combinator {s.get('comb')!r}")
        if s.get("nth") is not None and int(s["nth"]) < 1:
            raise ValueError("Invalid selector: nth-of-type must be >= 1")


def validate(ps, selectors: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """how each selector does on its page: (page_id, sel, steps) ->
    (page_id, sel, matches, rows_with, n_rows, status). Without ``rows``
    (page_id, row_id) it is looked for in the whole page: 'unique', '0' or
    'n matches'. With them it is looked for inside each row, and the status is
    'n of m rows'. Selectors without steps match nothing."""
    if rows is None:
        scopes = selectors.select("page_id", F.lit(0).alias("scope_id"), "sel")
        hits = Matcher(ps).match(scopes, selectors.select("page_id", "sel", "steps"), ["page_id", "sel"], ["sel"], include_scope=True)
        n = hits.groupBy("page_id", "sel").agg(F.count(F.lit(1)).alias("matches"))
        out = selectors.select("page_id", "sel").join(n.hint("merge"), ["page_id", "sel"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
        none = F.lit(None).cast("bigint")
        status = F.when(F.col("matches") == 1, "unique").when(F.col("matches") == 0, "0").otherwise(F.concat(F.col("matches").cast("string"), F.lit(" matches")))
        return out.select("page_id", "sel", "matches", none.alias("rows_with"), none.alias("n_rows"), status.alias("status"))
    per = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"))
    scopes = rows.select("page_id", F.col("row_id").alias("scope_id")).join(selectors.select("page_id", "sel"), "page_id")
    hits = Matcher(ps).match(scopes, selectors.select("page_id", "sel", "steps"), ["page_id", "sel"], ["sel"])
    n = hits.groupBy("page_id", "sel", "scope_id").agg(F.count(F.lit(1)).alias("n")).groupBy("page_id", "sel").agg(
        F.sum("n").alias("matches"), F.count(F.lit(1)).alias("rows_with"))
    # a row for each page: not for the driver to hold
    out = selectors.select("page_id", "sel").join(n.hint("merge"), ["page_id", "sel"], "left").join(per.hint("merge"), "page_id", "left").na.fill(0, ["matches", "rows_with", "n_rows"])
    return out.withColumn("status", F.concat(F.col("rows_with").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows")))
