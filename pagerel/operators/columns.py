"""Column inference: data nodes (L11), relative selectors (L10), column
statistics (A03), column choice (A04), names (L12, L13, N02), and the
composition detect_columns (L14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.selectors import css_escape, css_string
from ..functions.text import value_kind
from ..schema import STEPS
from ..session import cut_lineage
from .select import distinct_matches, make_step


def img_url_raw(attrs: Column) -> Column:
    """P06 for an img element's own attributes (before absolutising): a lazy
    attribute wins when src is empty or a data: url; else src; else the first
    srcset entry."""
    raw = F.coalesce(attrs["src"], F.lit(""))
    lazy = F.coalesce(*[F.when(F.coalesce(attrs[a], F.lit("")) != "", attrs[a])
                        for a in ("data-src", "data-lazy-src", "data-original", "data-lazy")])
    srcset = F.coalesce(F.when(F.coalesce(attrs["srcset"], F.lit("")) != "", attrs["srcset"]),
                        F.when(F.coalesce(attrs["data-srcset"], F.lit("")) != "", attrs["data-srcset"]))
    first_set = F.regexp_extract(F.trim(F.split(srcset, ",").getItem(0)), r"^(\S*)", 1)
    return (F.when(lazy.isNotNull() & ((raw == "") | raw.startswith("data:")), lazy)
            .when(raw != "", raw)
            .when(srcset.isNotNull(), first_set)
            .otherwise(F.lit("")))


def data_nodes(ps, rows: DataFrame) -> DataFrame:
    """Value-bearing descendants of each row in document order.

    img -> src (stop); form field -> value (stop); usable link -> href and go
    on; text container -> text (stop); own text -> ownText (go on). Skipped
    subtrees, hidden elements and everything below a stop node are cut off
    with depth comparisons against the shredder's inherited depths.
    rows: (page_id, list_rank, row_id, ...) -> (+ node_id, attr, ord, n_data)"""
    n = ps.nodes
    is_img = n["tag"] == "img"
    is_field = n["tag"].isin("input", "select", "textarea")
    # a textarea's text and a select's options are values too
    field_val = (F.when(n["tag"] == "textarea", F.when(n["t_end"] > n["t_start"], F.lit("x")).otherwise(F.lit("")))
                 .when(n["tag"] == "select", F.when(n["n_children"] > 0, F.lit("x")).otherwise(F.lit("")))
                 .otherwise(F.coalesce(n["attrs"]["value"], F.lit(""))))
    first = (F.when(is_img & (img_url_raw(n["attrs"]) != ""), F.lit("src"))
             .when(is_field & (F.coalesce(n["attrs"]["type"], F.lit("")) != "hidden") & (field_val != ""), F.lit("value"))
             .when(n["usable_a"], F.lit("href")))
    second = (F.when(is_img | is_field, F.lit(None).cast("string"))
              .when(n["text_container"], F.lit("text"))
              .when(n["own_text"] != "", F.lit("ownText")))
    cand = n.select("page_id", "node_id", "anc", "depth", "skip_depth", "stop_depth", "hidden",
                    F.array_compact(F.array(
                        F.when(first.isNotNull(), F.struct(F.lit(0).alias("sub"), first.alias("attr"))),
                        F.when(second.isNotNull(), F.struct(F.lit(1).alias("sub"), second.alias("attr"))),
                    )).alias("emits")).filter(F.size("emits") > 0)
    ex = cand.select("page_id", "node_id", "depth", "skip_depth", "stop_depth", "hidden", "emits",
                     F.posexplode("anc").alias("row_depth", "row_id"))
    r = rows.select("page_id", "list_rank", "row_id", "row_ord")
    j = ex.join(r, ["page_id", "row_id"])
    j = j.filter((F.col("skip_depth") < F.col("row_depth")) & (F.col("stop_depth") < F.col("row_depth"))
                 & ((F.col("node_id") == F.col("row_id")) | ~F.col("hidden")))
    j = j.select("page_id", "list_rank", "row_id", "row_ord", "node_id", "row_depth", "depth",
                 F.explode("emits").alias("e")).select("*", "e.sub", "e.attr").drop("e")
    w = Window.partitionBy("page_id", "list_rank", "row_id")
    return (j.withColumn("ord", F.row_number().over(w.orderBy("node_id", "sub")) - 1)
            .withColumn("n_data", F.count(F.lit(1)).over(w)))


def _rel_candidates(nodes: DataFrame) -> Column:
    """L10 simple candidates of a node, in order: test/semantic attributes
    (no 3-digit run), each semantic class, <= 3 semantic classes,
    tag.class for each semantic class, bare tag.
    -> ARRAY<STRUCT<tag, kind, cs, n, v>>"""
    attrs = F.col("attrs")
    names = F.filter(F.array(*[F.lit(a) for a in rules.REL_ATTRS]),
                     lambda a: attrs[a].isNotNull() & (attrs[a] != "")
                     & ~attrs[a].rlike("[0-9]{3,}"))
    no = F.lit(None).cast("string")

    def c(tag, kind, cs=None, n=None, v=None):
        return F.struct(tag.alias("tag"), F.lit(kind).alias("kind"),
                        (cs if cs is not None else F.array().cast("array<string>")).alias("cs"),
                        (n if n is not None else no).alias("n"), (v if v is not None else no).alias("v"))

    sem = F.col("sem")
    et = "array<struct<tag:string,kind:string,cs:array<string>,n:string,v:string>>"
    return F.concat(
        F.transform(names, lambda a: c(no, "attr", n=a, v=attrs[a])),
        F.transform(sem, lambda s: c(no, "class", cs=F.array(s))),
        F.when(F.size(sem) > 1, F.array(c(no, "class", cs=F.slice(sem, 1, 3)))).otherwise(F.array().cast(et)),
        F.transform(sem, lambda s: c(F.col("tag"), "class", cs=F.array(s))),
        F.array(c(F.col("tag"), "tag")),
    )


def _candidate(c: Column) -> tuple[Column, Column]:
    """CSS text and step of one simple candidate."""
    css = F.concat(F.coalesce(css_escape(c["tag"]), F.lit("")),
                   F.when(c["kind"] == "attr", F.concat(F.lit("["), c["n"], F.lit("="), css_string(c["v"]), F.lit("]")))
                   .otherwise(F.array_join(F.transform(c["cs"], lambda x: F.concat(F.lit("."), css_escape(x))), "")))
    attrs = F.when(c["kind"] == "attr", F.create_map(c["n"], c["v"])).otherwise(F.create_map().cast("map<string,string>"))
    return css, make_step(tag=c["tag"], classes=c["cs"], attrs=attrs)


def _tail_step() -> tuple[Column, Column]:
    """One element of a child path: tag, first two semantic classes and
    nth-of-type where there are several, as CSS text and step."""
    cs, nth = F.slice("sem", 1, 2), F.when(F.col("nth_count") > 1, F.col("nth"))
    css = F.concat(css_escape(F.col("tag")), F.array_join(F.transform(cs, lambda x: F.concat(F.lit("."), css_escape(x))), ""),
                   F.when(nth.isNotNull(), F.concat(F.lit(":nth-of-type("), nth.cast("string"), F.lit(")"))).otherwise(F.lit("")))
    return css, make_step(tag=F.col("tag"), comb="child", classes=cs, nth=nth)


def relative_selectors(ps, dn: DataFrame) -> DataFrame:
    """Selector of each data node relative to its row: the first that
    matches exactly that node among the row's descendants, of its simple
    candidates; else of those of its ancestors inside the row, the lowest
    first, with the child path down to the node; else the full child path
    ('> a > b:nth-of-type(2)'). The row itself gets ''.

    Both kinds are one match each over all nodes and levels; a row's distinct
    selectors are matched once, however many of its nodes ask for them.
    dn: (page_id, list_rank, row_id, node_id, row_depth, depth)
    -> (page_id, list_rank, row_id, node_id, sel, steps)"""
    nodes = ps.nodes
    key = ["page_id", "list_rank", "row_id", "node_id"]
    pairs = cut_lineage(dn.select(*key, "row_depth", "depth").distinct(), "data-nodes")
    inner = pairs.filter("node_id <> row_id")
    # candidates and path steps of each element of interest, once
    chain = inner.join(nodes.select("page_id", "node_id", "anc"), ["page_id", "node_id"]).select(
        *key, "row_depth", "depth", F.posexplode("anc").alias("pos", "p_id")).filter("pos > row_depth")
    info = nodes.select("page_id", F.col("node_id").alias("p_id"), "tag", "attrs", "sem", "nth", "nth_count")
    info = info.join(chain.select("page_id", "p_id").distinct(), ["page_id", "p_id"], "left_semi")
    made = F.transform(_rel_candidates(info), lambda c: F.struct(*(x.alias(n) for n, x in zip(("css", "step"), _candidate(c)))))
    tail_css, tail = _tail_step()
    info = cut_lineage(info.select("page_id", "p_id", made.alias("cands"), F.struct(tail_css.alias("css"), tail.alias("step")).alias("tail")), "elements")

    def first_unique(cands: DataFrame) -> DataFrame:
        """The first by ``prio`` of those that match their node only."""
        cands = cut_lineage(cands, "relative")
        n = distinct_matches(ps, cands.withColumnRenamed("row_id", "scope_id"), False).withColumnRenamed("scope_id", "row_id")
        ok = cands.join(n, ["page_id", "row_id", "css"]).filter((F.col("matches") == 1) & (F.col("last_id") == F.col("node_id")))
        return cut_lineage(ok.groupBy(*key).agg(F.min_by(F.struct(F.col("css").alias("sel"), "steps"), "prio").alias("s")).select(*key, "s.*"), "chosen")

    own = inner.join(info.withColumnRenamed("p_id", "node_id"), ["page_id", "node_id"])
    own = own.select(*key, F.posexplode("cands").alias("i", "c")).select(*key, F.struct(F.lit(0).alias("up"), "i").alias("prio"), "c.css", F.array("c.step").cast(STEPS).alias("steps"))
    found = first_unique(own)
    left = inner.join(found, key, "left_anti")
    path = chain.join(left.select(*key), key, "left_semi").join(info, ["page_id", "p_id"])
    # as many entries as the row is deep
    path = path.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "cands", "tail")),
                                               lambda l, r: F.when(l["pos"] < r["pos"], -1).when(l["pos"] > r["pos"], 1).otherwise(0)).alias("p"))
    path = cut_lineage(path, "paths")
    n = F.size("p")
    levels = path.filter(n > 1).withColumn("up", F.explode(F.sequence(F.lit(1), n - 1)))
    below = F.slice("p", n - F.col("up") + 1, F.col("up"))
    levels = levels.select(*key, "up", below.alias("below"), F.posexplode(F.get("p", n - F.col("up") - 1)["cands"]).alias("i", "c"))
    anchored = levels.select(*key, F.struct("up", "i").alias("prio"),
                             F.concat(F.col("c.css"), F.lit(" > "), F.array_join(F.transform("below", lambda x: x["tail"]["css"]), " > ")).alias("css"),
                             F.concat(F.array("c.step"), F.transform("below", lambda x: x["tail"]["step"])).cast(STEPS).alias("steps"))
    higher = first_unique(anchored)
    full = path.join(higher, key, "left_anti").select(
        *key, F.concat(F.lit("> "), F.array_join(F.transform("p", lambda x: x["tail"]["css"]), " > ")).alias("sel"),
        F.transform("p", lambda x: x["tail"]["step"]).cast(STEPS).alias("steps"))
    row = pairs.filter("node_id = row_id").select(*key, F.lit("").alias("sel"), F.array().cast(STEPS).alias("steps"))
    return found.unionByName(higher).unionByName(full).unionByName(row)


def guess_names(stats: DataFrame) -> DataFrame:
    """Table header (J09) -> hint (L13) -> tag rule
    -> value kind (P14); href adds ' URL' unless it says link/url, src adds
    ' Image' unless image-like. stats needs tag, attr, hint, sample."""
    tag = F.col("tag")
    base = (
        F.when(F.coalesce(F.col("header"), F.lit("")) != "", F.col("header"))
        .when(F.coalesce(F.col("hint"), F.lit("")) != "", F.col("hint"))
        .when(tag.rlike("^h[1-6]$"), "Title")
        .when(tag == "img", "Image")
        .when(tag == "a", F.when(F.col("attr") == "href", "Link").otherwise("Link Text"))
        .when(tag == "time", "Date")
        .when(tag == "button", "Button")
        .otherwise(value_kind(F.col("sample")))
    )
    return stats.withColumn("base", base).withColumn(
        "guess",
        F.when((F.col("attr") == "href") & ~F.col("base").rlike(rules.HREF_NOT_URL_NAME), F.concat(F.col("base"), F.lit(" URL")))
        .when((F.col("attr") == "src") & ~F.col("base").rlike(rules.SRC_IMAGE_NAME), F.concat(F.col("base"), F.lit(" Image")))
        .otherwise(F.col("base")),
    ).drop("base")


def dedupe_names(df: DataFrame, part: list[str], order: str, name: str = "guess", out: str = "name") -> DataFrame:
    """The 2nd "Price" becomes "Price 2" (suffix style, no collision check)."""
    w = Window.partitionBy(*part, name).orderBy(order)
    k = F.row_number().over(w)
    return df.withColumn(out, F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" "), k.cast("string"))))


def detect_columns(ps, rows: DataFrame, sample: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """L14 = L11 -> L10 -> A03 -> A04 -> L12 over all rows of every (page,
    list), or its first ``sample``; all columns, or the first ``most``.
    Returns (columns, data nodes).
    columns: (page_id, list_rank, col_ord, name, sel, steps, attr, fill, sample, n_rows)"""
    from .extract import node_values

    srows = rows if sample is None else rows.filter(F.col("row_ord") <= sample)
    n_sample = srows.groupBy("page_id", "list_rank").agg(F.count(F.lit(1)).alias("n_rows"))
    from ..session import cut_lineage

    dn = cut_lineage(data_nodes(ps, srows))
    rel = cut_lineage(relative_selectors(ps, dn))
    d = dn.join(rel, ["page_id", "list_rank", "row_id", "node_id"])
    # Per row keep the first occurrence of each (selector, attr) key
    w = Window.partitionBy("page_id", "list_rank", "row_id", "sel", "attr").orderBy("ord")
    d = d.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k")
    d = d.withColumn("pos", F.when(F.col("n_data") > 1, F.col("ord") / (F.col("n_data") - 1)).otherwise(F.lit(0.0)))
    vals = node_values(ps, d.select("page_id", "list_rank", "row_id", "row_ord", "node_id", "attr", "sel", "ord", "pos", "steps"),
                       attr_col="attr")
    keyc = ["page_id", "list_rank", "sel", "attr"]
    first_seen = Window.partitionBy(*keyc).orderBy("row_ord", "ord")
    vals = vals.withColumn("_r", F.row_number().over(first_seen))
    stats = vals.groupBy(*keyc).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("pos").alias("pos_sum"),
        F.min_by(F.struct("row_ord", "ord"), "_r").alias("first"),
        F.min_by("node_id", "_r").alias("el"),
        F.min_by("row_id", "_r").alias("row"),
        F.min_by("steps", "_r").alias("steps"),
        F.min_by(F.when(F.col("value") != "", F.col("value")), F.when(F.col("value") != "", F.col("_r"))).alias("first_nonempty"),
        F.min_by(F.col("value"), F.col("_r")).alias("first_value"),
    )
    stats = cut_lineage(stats.join(n_sample, ["page_id", "list_rank"]))
    # Enough rows, ordered by mean position (ties: first seen)
    min_count = F.when(F.col("n_rows") <= 2, F.lit(1)).otherwise(
        F.greatest(F.lit(2), F.ceil(F.col("n_rows") * rules.COLUMN_MIN_FILL)))
    ch = stats.filter(F.col("count") >= min_count).withColumn("mean_pos", F.col("pos_sum") / F.col("count"))
    wo = Window.partitionBy("page_id", "list_rank").orderBy("mean_pos", "first.row_ord", "first.ord")
    ch = ch.withColumn("col_ord", F.row_number().over(wo))
    if most is not None:
        ch = ch.filter(F.col("col_ord") <= most)
    # names: hint from the element and up to 2 ancestors inside the row
    ch = cut_lineage(ch.join(ps.nodes.select("page_id", F.col("node_id").alias("el"), "tag"), ["page_id", "el"]), "chosen-columns")
    ch = ch.join(name_hints(ps, ch.select("page_id", "el", "row")), ["page_id", "el", "row"], "left")
    # a table's header cell names its column
    from .explorer import header_names

    trs = ps.nodes.filter(F.col("tag") == "tr").select("page_id", F.col("node_id").alias("row"))
    cells = cut_lineage(ch.select("page_id", "row", "el").distinct().join(trs, ["page_id", "row"], "left_semi"))
    if cells.isEmpty():  # no list of table rows: nothing to look up
        ch = ch.withColumn("header", F.lit(None).cast("string"))
    else:
        headers = header_names(ps, cells).groupBy("page_id", "row", "el").agg(F.max("header").alias("header"))
        ch = ch.join(headers, ["page_id", "row", "el"], "left")
    ch = ch.withColumn("sample", F.coalesce("first_nonempty", F.lit("")))
    ch = guess_names(ch)
    ch = dedupe_names(ch, ["page_id", "list_rank"], "col_ord")
    cols = ch.select(
        "page_id", "list_rank", "col_ord", "name", "sel", "steps",
        F.col("attr"),
        F.floor(F.col("count") / F.greatest(F.col("n_rows"), F.lit(1)) * 100 + 0.5).cast("int").alias("fill"),
        "sample", "n_rows",
    )
    return cols, dn


def humanize(t: Column) -> Column:
    """Readable name from a token: part after the last '__', '--...'
    dropped, camelCase / '-' / '_' split, digits and 'js' dropped, '' when
    all words are generic, last 3 words, abbreviations expanded, title case."""
    x = F.element_at(F.split(t, "__"), -1)
    x = F.regexp_replace(x, "--.*$", "")
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(x, r"[-_\s]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~w.rlike("(?i)^js$"))
    abbr = F.create_map(*[v for k, full in rules.ABBREVIATIONS.items() for v in (F.lit(k), F.lit(full))])
    titled = F.transform(F.slice(words, -3, 3), lambda w: F.coalesce(
        abbr[F.lower(w)], F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.right(w, F.length(w) - 1)))))
    all_generic = F.forall(words, lambda w: w.rlike(rules.GENERIC_WORDS))
    return (F.when(F.size(words) == 0, F.lit(""))
            .when(all_generic, F.lit(""))
            .otherwise(F.array_join(F.when(F.size(words) >= 3, titled).otherwise(
                F.transform(words, lambda w: F.coalesce(abbr[F.lower(w)], F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.right(w, F.length(w) - 1)))))), " ")))


def name_hints(ps, targets: DataFrame) -> DataFrame:
    """For the element and up to 2 ancestors inside the row: itemprop,
    test attributes, semantic classes (through P15); first non-empty.
    targets: (page_id, el, row) -> (page_id, el, row, hint)"""
    nodes = ps.nodes
    t = targets.join(nodes.select("page_id", F.col("node_id").alias("el"), "anc"), ["page_id", "el"])
    ex = t.select("page_id", "el", "row", F.posexplode(F.reverse("anc")).alias("dist", "node_id")).filter(F.col("dist") <= 2)
    # stop at the row: ancestors at or above the row do not count
    rd = nodes.select("page_id", F.col("node_id").alias("row"), F.col("depth").alias("row_depth"))
    ex = ex.join(rd, ["page_id", "row"]).join(nodes.select("page_id", "node_id", "depth", "attrs", "sem"), ["page_id", "node_id"])
    ex = ex.filter(F.col("depth") > F.col("row_depth"))
    toks = F.concat(
        F.array(F.struct(F.lit(0).alias("k"), F.col("attrs")["itemprop"].alias("tok"))),
        F.array(*[F.struct(F.lit(i + 1).alias("k"), F.col("attrs")[a].alias("tok")) for i, a in enumerate(rules.TEST_ATTRS)]),
        F.transform("sem", lambda c, i: F.struct((i + 100).alias("k"), c.alias("tok"))),
    )
    tk = ex.select("page_id", "el", "row", "dist", F.explode(toks).alias("t")).filter(
        F.col("t.tok").isNotNull() & (F.col("t.tok") != ""))
    tk = tk.withColumn("h", humanize(F.col("t.tok"))).filter(F.col("h") != "")
    return tk.groupBy("page_id", "el", "row").agg(F.min_by("h", F.struct("dist", "t.k")).alias("hint"))
