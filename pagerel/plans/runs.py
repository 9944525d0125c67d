"""Queries on runs and stores, and on pages rendered from the customer table,
with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import explorer, pager, recipes, run, store
from ..operators.select import Matcher
from ..operators.tree import PageSet
from ..operators.viewer import export_view, written_lines
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import tokens as K
from ..streaming.incremental import stream_run
from .derived import CUSTOMERS, customer_pages, customer_recipes


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark, d) -> PageSet:
    from .catalog import derived_pages

    return derived_pages(spark, d)


def _folder(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _data_rows(ps) -> DataFrame:
    return ps.nodes.filter((F.col("tag") == "tr") & F.array_contains("child_tags", "td"))


# -- similar siblings and lists from examples -------------------------------------------
def q_j07(spark, d):
    """How many of a page's pairs of table rows are similar, either way round."""
    ps = _pages(spark, d)
    tr = ps.nodes.filter("tag = 'tr'").select("page_id", "parent_id", "node_id")
    pairs = tr.select("page_id", "parent_id", F.col("node_id").alias("x")).join(tr.select("page_id", "parent_id", F.col("node_id").alias("y")), ["page_id", "parent_id"])
    sim = explorer.similar_pairs(ps, pairs.select("page_id", "x", "y"))
    return sim.groupBy("page_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("sim").alias("similar"))


def q_j08(spark, d):
    """Sizes of the groups of similar siblings, by tag."""
    ps = _pages(spark, d)
    t = ps.nodes.filter(F.col("tag").isin("tr", "td", "th", "li", "tbody"))
    sizes = explorer.group_sizes(ps, t.select("page_id", "node_id"))
    return sizes.join(t.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).groupBy("page_id", "tag", "size").agg(F.count(F.lit(1)).alias("n"))


def _matched(ps, found: DataFrame, key: list[str]) -> DataFrame:
    """How many rows of its page each selector of ``found`` matches."""
    scopes = found.select(*key, F.lit(0).alias("scope_id"))
    m = Matcher(ps).match(scopes, found.select(*key, "steps"), key, [k for k in key if k != "page_id"], include_scope=True, texts=False)
    return m.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))


def q_l01(spark, d):
    """Rows found from the first data cell of each table: the header row is
    none of them."""
    ps = _pages(spark, d)
    first = ps.nodes.filter("tag = 'td'").groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    found = cut_lineage(explorer.detect_lists(ps, first))
    return found.join(_matched(ps, found.select("page_id", "target_id", "steps"), ["page_id", "target_id"]), ["page_id", "target_id"]).select(
        "page_id", F.col("level").cast("bigint").alias("level"), "row_selector", "n_rows")


def q_l02(spark, d):
    """The same from the first cell of the first and of the last data row."""
    ps = _pages(spark, d)
    cell = ps.nodes.filter("tag = 'td' and sib_ord = 1").groupBy("page_id").agg(F.min("node_id").alias("a_id"), F.max("node_id").alias("b_id"))
    found = cut_lineage(explorer.detect_lists_pairs(ps, cell.filter("a_id < b_id")))
    key = ["page_id", "a_id", "b_id"]
    return found.join(_matched(ps, found.select(*key, "steps"), key), key).select(
        "page_id", F.col("level").cast("bigint").alias("level"), F.col("max_level").cast("bigint").alias("max_level"), "row_selector", "branch", "n_rows")


# -- chains and runs ------------------------------------------------------------------------
def _chains(ps, max_pages=None) -> DataFrame:
    t = ps.pages.select("page_id", F.lit("Onward").alias("text"), F.lit("").alias("aria"), F.lit("next").alias("rel"))
    res = pager.resolve_targets(ps, t).join(ps.nodes.select("page_id", "node_id", F.col("attrs")["href"].alias("href")), ["page_id", "node_id"])
    nl = res.join(pager.is_disabled(ps), ["page_id", "node_id"]).select("page_id", "href", "disabled")
    rows = _data_rows(ps).select("page_id", F.col("node_id").alias("row_id"))
    return pager.page_chain(ps, nl, None, pager.page_signatures(ps, rows).select("page_id", "n", "sig"), max_pages)


def q_g06_rings(spark, d):
    """Chains of sites whose last page leads to the first."""
    return _chains(PageSet(customer_pages(spark, d, ring=True)))


def _run_recipes(spark, d, max_pages: int) -> DataFrame:
    r = customer_recipes(spark, d)
    p = r.schema["pagination"].dataType
    paged = F.struct(F.lit("next").alias("type"), F.lit(None).cast(p["target"].dataType).alias("target"), F.lit(max_pages).alias("max_pages"),
                     F.lit(0).alias("delay_ms"), F.lit(20000).alias("timeout_ms"))
    options = F.struct(F.lit(True).alias("dedupe"), F.lit(True).alias("append"), (F.col("name") == "table").alias("page_url"))
    return recipes.normalize_recipes(r.withColumns({"pagination": paged, "options": options}))


def _run(spark, d):
    ps = _pages(spark, d)
    return run.run_recipes(ps, _run_recipes(spark, d, 3), _chains(ps))


def _named(source):
    return F.split(source, "@")[0].alias("recipe")


def q_a08(spark, d):
    """What each of the first three pages of each site adds, by recipe."""
    _, rep = _run(spark, d)
    start = F.split("source", "@")[2].cast("bigint").alias("start_id")
    return rep.select(_named("source"), start, "page_ord", "rows_seen", "rows_new", F.col("total").cast("bigint").alias("total"), F.col("pages").cast("bigint").alias("pages"), "reason")


def q_l17(spark, d):
    """The rows of that run, the table's with their page's url."""
    new, _ = _run(spark, d)
    return new.select(_named("source"), F.split("source", "@")[2].cast("bigint").alias("start_id"), "page_ord", F.col("row_ord").cast("bigint").alias("row_ord"),
                      F.array_join(F.transform("cells", lambda c: F.concat(c["name"], F.lit("="), c["value"])), "|").alias("cells"))


def q_u02(spark, d):
    """A second run over the same pages, appended to what the first one left:
    nothing enters; then one that replaces it."""
    ps, r = _pages(spark, d), _run_recipes(spark, d, 3)
    chains = _chains(ps)
    new, _ = run.run_recipes(ps, r, chains)
    first = cut_lineage(run.after_run(None, new))
    again, _ = run.run_recipes(ps, r, chains, stored=first)
    other = r.withColumn("options", F.col("options").withField("append", F.lit(False)))
    replaced, _ = run.run_recipes(ps, other, chains, stored=first)
    datasets = [("first", first), ("appended", run.after_run(first, again)), ("replaced", run.after_run(first, replaced))]
    out = None
    for what, ds in datasets:
        one = ds.groupBy(_named("source")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "recipe", "n")
        out = one if out is None else out.unionByName(one)
    return out


def q_u03(spark, d):
    """Orders, shown ten more at a time on a growing page of each priority:
    every snapshot has the last thirty, from the third on with the customer."""
    o = _read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    o = run.numbered(o, "o_orderpriority", ["o_orderkey"], "nth").withColumn("p", F.floor((F.col("nth") - 1) / 10))
    at = o.withColumn("snapshot", F.explode(F.sequence(F.col("p"), F.col("p") + 2)))
    cell = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
    cells = F.array(cell("Order", "o_orderkey"), cell("Status", "o_orderstatus"))
    shown = at.select(F.col("o_orderpriority").alias("source"), F.col("snapshot").alias("page_ord"), (F.col("nth") - 10 * F.greatest(F.col("snapshot") - 2, F.lit(0))).alias("row_ord"),
                      F.when(F.col("snapshot") >= 2, F.concat(cells, F.array(cell("Customer", "o_custkey")))).otherwise(cells).alias("cells"))
    out = run.merge_snapshots(shown, ["Order", "Status"])
    value = lambda n: F.coalesce(F.get(F.filter("cells", lambda c: c["name"] == n), F.lit(0))["value"], F.lit(""))
    return out.select("source", F.col("row_no").cast("bigint").alias("row_no"), value("Order").alias("order_key"), value("Customer").alias("customer"))


# -- stores and files ----------------------------------------------------------------------
def q_s14(spark, d):
    """Customers replaced by themselves once more, then suppliers appended, who
    have another column."""
    at = _folder(spark, "dataset")
    cu = _read(spark, d, "customer").select(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"))
    store.save(cu, at, "replace", attrs={"Name": "href"}, meta={"host": "a"})
    store.save(cu, at, "replace", attrs={"Name": "href"}, meta={"host": "b"})
    store.save(_read(spark, d, "supplier").select(F.col("s_name").alias("Name"), F.col("s_nationkey").alias("Nation")), at, meta={"pages": "2"})
    ds, meta = store.load(spark, at)
    modes = ",".join(f"{f.name}:{f.metadata['attr']}" for f in ds.schema.fields)
    return ds.select("Name", "Segment", "Nation", F.lit(modes).alias("modes"), F.lit(",".join(f"{k}={v}" for k, v in sorted(meta.items()))).alias("meta"))


def _file(spark, d, kind):
    at = _folder(spark, f"export-{kind}")
    cu = _read(spark, d, "customer").select(F.col("c_mktsegment").alias("Segment"), F.concat(F.col("c_name"), F.lit(', "x"\tz')).alias("Name, quoted"), F.col("c_custkey").alias("=Key"))
    export_view(cu, at, ["Segment", "Name, quoted", "=Key"], q="building", order=["Name, quoted"], kind=kind)
    return written_lines(spark, at, "\r\n" if kind == "csv" else "\n")


def q_v05_csv(spark, d):
    return _file(spark, d, "csv")


def q_v05_tsv(spark, d):
    return _file(spark, d, "tsv")


def q_s03_stream(spark, d):
    return K.tokens(_read(spark, d, "pages")).select("page_id", F.col("ord").cast("bigint").alias("ord"), "kind", "value", F.col("start").cast("bigint").alias("start"))


def q_s03_titles(spark, d):
    return K.titles_and_links(K.tokens(_read(spark, d, "pages"))).select("page_id", "kind", "href", "text")


# -- streams and recipes ------------------------------------------------------------------
def q_w01(spark, d):
    """Pages land in two files and then once more; at most two pages a recipe."""
    at = _folder(spark, "w01")
    pages = customer_pages(spark, d)
    pages.filter("page_id % 2 = 1").coalesce(1).write.parquet(f"{at}/landing")
    for part in ("page_id % 2 = 0", "page_id > 0"):
        r = _run_recipes(spark, d, 3)
        rows, log = stream_run(spark, f"{at}/landing", r, f"{at}/sink", f"{at}/progress", max_pages=2)
        pages.filter(part).coalesce(1).write.mode("append").parquet(f"{at}/landing")
    rows, log = stream_run(spark, f"{at}/landing", r, f"{at}/sink", f"{at}/progress", max_pages=2)
    used = log.filter("reason = ''").groupBy("id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_rows").cast("bigint").alias("rows_seen"))
    n = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows_new"))
    return used.join(n, "id", "left").select(_named("id"), F.split("id", "@")[1].alias("host"), "pages", "rows_seen", F.coalesce("rows_new", F.lit(0)).alias("rows_new"))


def q_r03(spark, d):
    """The link column read as text from the second cell, by every recipe that has it."""
    from ..operators.select import steps_lit
    from ..schema import css, step

    r = recipes.normalize_recipes(customer_recipes(spark, d))
    edits = r.filter("name = 'table'").select("id", F.lit("Link").alias("name"), F.lit("text").alias("attr"), F.lit(None).cast("string").alias("attr_name"),
                                              steps_lit(css(("child", step("td", nth=2)))).alias("steps"))
    edited = recipes.edit_reads(r, edits)
    cells = run.recipe_extract(_pages(spark, d), edited.filter("name = 'table'"))
    return cells.filter("name = 'Link'").select("page_id", F.col("row_ord").cast("bigint").alias("row_ord"), "value")


def q_r04(spark, d):
    """Recipes without rows, without a way on, and whole ones."""
    r = _run_recipes(spark, d, 3)
    none = F.col("row_steps").cast(r.schema["row_steps"].dataType)
    broken = r.withColumn("row_steps", F.when(F.col("name") == "text", F.slice(none, 1, 0)).otherwise(F.col("row_steps")))
    broken = broken.withColumn("pagination", F.when(F.col("name") == "keys", F.col("pagination").withField("type", F.lit("loadmore")))
                               .when(F.col("name") == "table", F.col("pagination").withField("type", F.lit("none"))).otherwise(F.col("pagination")))
    return recipes.check_recipes(broken).groupBy("name", "reason").agg(F.count(F.lit(1)).alias("n"))


def q_t05(spark, d):
    """Each site's own recipes in order, and all recipes in order."""
    ps = _pages(spark, d)
    r = recipes.normalize_recipes(customer_recipes(spark, d))
    from ..functions.urls import host_of

    return recipes.recipe_list(r, ps.pages.select(host_of(F.col("url")).alias("host")).distinct()).select("host", "id", F.col("place").cast("bigint").alias("place"))


QUERIES = {
    "J07_similar_pairs": q_j07, "J08_similar_groups": q_j08, "L01_customer_rows": q_l01, "L02_customer_rows": q_l02, "G06_rings": q_g06_rings,
    "A08_customer_runs": q_a08, "L17_run_rows": q_l17, "U02_run_modes": q_u02, "U03_merge_snapshots": q_u03, "S14_dataset_store": q_s14,
    "V05_csv_file": q_v05_csv, "V05_tsv_file": q_v05_tsv, "S03_token_stream": q_s03_stream, "S03_titles_links": q_s03_titles,
    "W01_stream_recipes": q_w01, "R03_edit_reads": q_r03, "R04_reasons": q_r04, "T05_recipe_list": q_t05,
}

_PER_PAGE = f"{CUSTOMERS}, n AS (SELECT page_id, count(*) AS k FROM cu GROUP BY page_id)"
_RUN = f"""{CUSTOMERS}, pg AS (
  SELECT c_nationkey, p, max(p) OVER (PARTITION BY c_nationkey) AS last, CAST(c_nationkey AS BIGINT) * 100000 + 1 AS start_id, count(*) AS k,
         count(*) FILTER (c_mktsegment = 'BUILDING') AS b FROM cu GROUP BY c_nationkey, p),
s AS (SELECT *, CASE WHEN p = last THEN 'disabled' WHEN p = 3 THEN 'limit' END AS reason,
             CASE WHEN b > 0 AND coalesce(sum(b) OVER (PARTITION BY c_nationkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS fresh FROM pg WHERE p <= 3)"""
_STREAM = f"""{CUSTOMERS}, pg AS (SELECT c_nationkey, p, count(*) AS k, count(*) FILTER (c_mktsegment = 'BUILDING') AS b FROM cu GROUP BY c_nationkey, p),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p % 2 = 0, p) AS nth FROM pg) WHERE nth <= 2),
h AS (SELECT 'n' || c_nationkey || '.example' AS host, count(*) AS pages, sum(k) AS k, sum(b) AS b FROM u GROUP BY c_nationkey)"""
_TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>|</?[a-z][^>]*>|[^<]+|<"

ORACLES = {
    "J07_similar_pairs": f"WITH {_PER_PAGE} SELECT page_id, (k + 1) * (k + 1) AS pairs, k * k + 1 AS similar FROM n",
    # the header row is alone; of a row's cells the first two are alike, the third holds the link
    "J08_similar_groups": f"""WITH {_PER_PAGE}, g AS (
  SELECT page_id, 'tr' AS tag, CAST(1 AS BIGINT) AS size, CAST(1 AS BIGINT) AS n FROM n UNION ALL SELECT page_id, 'tr', k, k FROM n
  UNION ALL SELECT page_id, 'th', 3, 3 FROM n UNION ALL SELECT page_id, 'tbody', 1, 1 FROM n UNION ALL SELECT page_id, 'li', k, k FROM n
  UNION ALL SELECT page_id, 'td', 2, 2 * k FROM n UNION ALL SELECT page_id, 'td', 1, k FROM n)
SELECT page_id, tag, size, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY page_id, tag, size""",
    # a single data row has no like: then the cells of it are the rows
    "L01_customer_rows": f"""WITH {_PER_PAGE} SELECT page_id, CAST(CASE WHEN k > 1 THEN 1 ELSE 0 END AS BIGINT) AS level,
  CASE WHEN k > 1 THEN 'tbody > tr:has(> td)' ELSE 'tr:nth-of-type(2) > td' END AS row_selector, CASE WHEN k > 1 THEN k ELSE 3 END AS n_rows FROM n""",
    "L02_customer_rows": f"""WITH {_PER_PAGE} SELECT page_id, CAST(1 AS BIGINT) AS level, CAST(1 AS BIGINT) AS max_level, 'tbody > tr:has(> td)' AS row_selector, 'same_parent' AS branch, k AS n_rows FROM n WHERE k > 1""",
    "G06_rings": f"""WITH {CUSTOMERS}, m AS (SELECT c_nationkey, p, page_id, max(p) OVER (PARTITION BY c_nationkey) AS last FROM (SELECT DISTINCT c_nationkey, p, page_id FROM cu))
SELECT CAST(c_nationkey AS BIGINT) * 100000 + 1 AS start_id, CAST(p AS BIGINT) AS step, page_id, CASE WHEN p = last THEN CASE WHEN last = 1 THEN 'unchanged' ELSE 'seen' END END AS reason FROM m""",
    "A08_customer_runs": f"""WITH {_RUN}, r AS (
  SELECT 'table' AS recipe, start_id, p, k AS seen, k AS new, reason FROM s UNION ALL SELECT 'keys', start_id, p, k, k, reason FROM s
  UNION ALL SELECT 'text', start_id, p, b, fresh, reason FROM s)
SELECT recipe, start_id, CAST(p AS BIGINT) AS page_ord, seen AS rows_seen, CAST(new AS BIGINT) AS rows_new, CAST(sum(new) OVER w AS BIGINT) AS total,
       CAST(count(*) OVER w AS BIGINT) AS pages, reason FROM r WINDOW w AS (PARTITION BY recipe, start_id ORDER BY p)""",
    "L17_run_rows": f"""WITH {_RUN}, c AS (SELECT *, CAST(c_nationkey AS BIGINT) * 100000 + 1 AS start_id, row_number() OVER (PARTITION BY page_id, c_mktsegment ORDER BY c_custkey) AS nth_b FROM cu WHERE p <= 3)
SELECT 'table' AS recipe, start_id, CAST(p AS BIGINT) AS page_ord, row_ord,
       'Name=' || c_name || '|Link=https://n' || c_nationkey || '.example/c/' || c_custkey || '|Page URL=https://n' || c_nationkey || '.example/list?p=' || p AS cells FROM c
UNION ALL SELECT 'keys', start_id, p, row_ord, 'Key=k' || c_custkey || '|Markup=<b>' || c_name || '</b> at sea|Own=at sea' FROM c
UNION ALL SELECT 'text', c.start_id, c.p, nth_b, 'Segment=BUILDING' FROM c JOIN s USING (c_nationkey, p) WHERE c_mktsegment = 'BUILDING' AND nth_b = 1 AND fresh = 1""",
    "U02_run_modes": f"""WITH {_RUN}, k AS (SELECT 'table' AS recipe, CAST(sum(k) AS BIGINT) AS n FROM s UNION ALL SELECT 'keys', sum(k) FROM s UNION ALL SELECT 'text', sum(fresh) FROM s)
SELECT what, recipe, n FROM k, (SELECT unnest(['first', 'appended', 'replaced']) AS what)""",
    "U03_merge_snapshots": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth FROM orders)
SELECT o_orderpriority AS source, nth AS row_no, CAST(o_orderkey AS VARCHAR) AS order_key, CASE WHEN nth > 20 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS customer FROM o""",
    "S14_dataset_store": """SELECT c_name AS "Name", c_mktsegment AS "Segment", '' AS "Nation", 'Name:href,Segment:text,Nation:text' AS modes, 'host=b,pages=2' AS meta FROM customer
UNION ALL SELECT s_name, '', CAST(s_nationkey AS VARCHAR), 'Name:href,Segment:text,Nation:text', 'host=b,pages=2' FROM supplier""",
    "V05_csv_file": """WITH v AS (SELECT c_mktsegment || ',"' || c_name || ', ""x""' || chr(9) || 'z",' || c_custkey AS line, row_number() OVER (ORDER BY c_name) + 1 AS line_no
  FROM customer WHERE contains(lower(c_mktsegment), 'building'))
SELECT CAST(1 AS BIGINT) AS line_no, chr(65279) || 'Segment,"Name, quoted",''=Key' AS line UNION ALL SELECT line_no, line FROM v""",
    "V05_tsv_file": """WITH v AS (SELECT c_mktsegment || chr(9) || c_name || ', "x" z' || chr(9) || c_custkey AS line, row_number() OVER (ORDER BY c_name) + 1 AS line_no
  FROM customer WHERE contains(lower(c_mktsegment), 'building'))
SELECT CAST(1 AS BIGINT) AS line_no, 'Segment' || chr(9) || 'Name, quoted' || chr(9) || '''=Key' AS line UNION ALL SELECT line_no, line FROM v""",
    "S03_token_stream": f"""WITH t AS (SELECT page_id, unnest(l) AS source, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS l FROM pages)),
k AS (SELECT *, CASE WHEN source[1:4] = '<!--' THEN 'comment' WHEN regexp_matches(lower(source), '^<(script|style)([^a-z0-9_]|$)') THEN 'raw' WHEN source[1:2] = '<!' THEN 'declaration'
  WHEN regexp_matches(source, '^</[A-Za-z]') THEN 'close' WHEN regexp_matches(source, '^<[A-Za-z]') THEN 'open' ELSE 'text' END AS kind FROM t)
SELECT page_id, CAST(ord AS BIGINT) AS ord, kind, CASE kind WHEN 'text' THEN source WHEN 'comment' THEN '' WHEN 'declaration' THEN '' ELSE lower(regexp_extract(source, '^</?([A-Za-z][^\\s/>]*)', 1)) END AS value,
       CAST(coalesce(sum(length(source)) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k""",
    "S03_titles_links": r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*')) AS x FROM pages)
SELECT page_id, 'link' AS kind, regexp_extract(x, 'href="([^"]*)"', 1) AS href, regexp_extract(x, '>([^<]*)$', 1) AS text FROM a
UNION ALL SELECT page_id, 'title', '', regexp_extract(html, '<title>([^<]*)', 1) FROM pages WHERE contains(html, '<title>')""",
    "W01_stream_recipes": f"""WITH {_STREAM} SELECT 'table' AS recipe, host, pages, CAST(k AS BIGINT) AS rows_seen, CAST(k AS BIGINT) AS rows_new FROM h
UNION ALL SELECT 'keys', host, pages, k, k FROM h UNION ALL SELECT 'text', host, pages, b, CASE WHEN b > 0 THEN 1 ELSE 0 END FROM h""",
    "R03_edit_reads": f"WITH {CUSTOMERS} SELECT page_id, row_ord, c_mktsegment AS value FROM cu",
    "R04_reasons": """WITH h AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer)
SELECT 'table' AS name, '' AS reason, n FROM h UNION ALL SELECT 'keys', 'needs_load_more_target', n FROM h UNION ALL SELECT 'text', 'needs_rows_and_columns', n FROM h""",
    "T05_recipe_list": """WITH h AS (SELECT DISTINCT 'n' || c_nationkey || '.example' AS host FROM customer), r AS (SELECT host, name, name || '@' || host AS id FROM h, (SELECT unnest(['keys', 'table', 'text']) AS name))
SELECT host, id, row_number() OVER (PARTITION BY host ORDER BY name, id) AS place FROM r UNION ALL SELECT NULL, id, row_number() OVER (ORDER BY name, id) FROM r""",
}


# -- more of the element relations, on the same pages ------------------------------------------
def q_p03(spark, d):
    """Own texts of items, names, cells and links."""
    ps = _pages(spark, d)
    own = explorer.own_texts(ps).join(ps.nodes.filter(F.col("tag").isin("li", "b", "td", "a")).select("page_id", "node_id", "tag"), ["page_id", "node_id"])
    return own.groupBy("page_id", "tag", "own_text").agg(F.count(F.lit(1)).alias("n"))


def q_j01(spark, d):
    """The chain of tags above each name."""
    from ..operators.tree import ancestors

    ps = _pages(spark, d)
    chain = ancestors(ps.nodes, ps.nodes.filter("tag = 'b'").select("page_id", "node_id"))
    per = chain.groupBy("page_id", "target_id").agg(F.array_sort(F.collect_list(F.struct("level", "tag"))).alias("c"))
    return per.groupBy("page_id", F.array_join(F.transform("c", lambda x: x["tag"]), ">").alias("chain")).agg(F.count(F.lit(1)).alias("n"))


def q_j05(spark, d):
    """The closest table row of each link, as the place of that row."""
    from ..operators.tree import closest

    ps = _pages(spark, d)
    links = ps.nodes.filter("tag = 'a'").select("page_id", F.col("node_id").alias("target_id"), "anc")
    met = closest(ps.nodes, links, F.col("tag") == "tr").withColumnRenamed("match_id", "node_id")
    return met.join(ps.nodes.select("page_id", "node_id", "nth"), ["page_id", "node_id"]).select("page_id", F.col("nth").cast("bigint").alias("row_place"))


def q_j06(spark, d):
    """Structure signatures of table rows and items."""
    from ..operators.tree import signatures

    ps = _pages(spark, d)
    sig = signatures(ps.nodes).join(ps.nodes.filter(F.col("tag").isin("tr", "li")).select("page_id", "node_id", "tag"), ["page_id", "node_id"])
    return sig.groupBy("page_id", "tag", F.array_join("sig", ",").alias("sig")).agg(F.count(F.lit(1)).alias("n"))


def q_g03(spark, d):
    """Elements that are disabled: the way on from the last page."""
    return pager.is_disabled(_pages(spark, d)).groupBy("page_id").agg(F.count_if("disabled").alias("n_disabled"))


def q_g04(spark, d):
    """The state of each page's way on, found by its text."""
    ps = _pages(spark, d)
    t = ps.pages.select("page_id", F.lit("ONWARD").alias("text"), F.lit("").alias("aria"), F.lit("").alias("rel"))
    return pager.target_state(ps, t).select("page_id", "found", "disabled", "label")


QUERIES.update({"P03_own_texts": q_p03, "J01_ancestors": q_j01, "J05_closest": q_j05, "J06_signatures": q_j06, "G03_customer_disabled": q_g03, "G04_target_state": q_g04})
ORACLES.update({
    "P03_own_texts": f"""WITH {CUSTOMERS}, t AS (SELECT page_id, 'li' AS tag, 'at sea' AS own_text FROM cu UNION ALL SELECT page_id, 'b', c_name FROM cu UNION ALL SELECT page_id, 'td', c_name FROM cu
  UNION ALL SELECT page_id, 'td', c_mktsegment FROM cu UNION ALL SELECT page_id, 'td', '' FROM cu UNION ALL SELECT page_id, 'a', 'open' FROM cu UNION ALL SELECT DISTINCT page_id, 'a', 'Onward' FROM cu)
SELECT page_id, tag, own_text, count(*) AS n FROM t GROUP BY page_id, tag, own_text""",
    "J01_ancestors": f"WITH {CUSTOMERS} SELECT page_id, 'body>ul>li>b' AS chain, count(*) AS n FROM cu GROUP BY page_id",
    "J05_closest": f"WITH {CUSTOMERS} SELECT page_id, row_ord + 1 AS row_place FROM cu",
    "J06_signatures": f"""WITH {CUSTOMERS}, n AS (SELECT page_id, count(*) AS k FROM cu GROUP BY page_id)
SELECT page_id, 'tr' AS tag, 'td,td>a' AS sig, k AS n FROM n UNION ALL SELECT page_id, 'tr', 'th', 1 FROM n UNION ALL SELECT page_id, 'li', 'b', k FROM n""",
    "G03_customer_disabled": f"""WITH {CUSTOMERS}, m AS (SELECT DISTINCT page_id, p, max(p) OVER (PARTITION BY c_nationkey) AS last FROM cu)
SELECT page_id, CAST(CASE WHEN p = last THEN 1 ELSE 0 END AS BIGINT) AS n_disabled FROM m""",
    "G04_target_state": f"""WITH {CUSTOMERS}, m AS (SELECT DISTINCT page_id, p, max(p) OVER (PARTITION BY c_nationkey) AS last FROM cu)
SELECT page_id, true AS found, p = last AS disabled, 'Onward' AS label FROM m""",
})


def q_p09(spark, d):
    """Stable classes: what names an element for good, and what only may."""
    n = _pages(spark, d).nodes
    each = n.select("page_id", F.explode(F.concat(F.transform("sem", lambda c: F.struct(F.lit("semantic").alias("kind"), c.alias("class"))),
                                                  F.transform("grp", lambda c: F.struct(F.lit("group").alias("kind"), c.alias("class"))))).alias("c"))
    return each.groupBy("page_id", "c.kind", "c.class").agg(F.count(F.lit(1)).alias("n"))


def q_f04(spark, d):
    """Rows with a data cell, and rows with a header cell."""
    from ..operators.select import select_nodes
    from ..schema import css, step

    ps, out = _pages(spark, d), None
    for t in ("td", "th"):
        one = select_nodes(ps, css(("desc", step("tr", has_child=t)))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).select("page_id", F.lit(t).alias("child"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def q_f07(spark, d):
    """Formatting elements and text containers."""
    return explorer.formatting_flags(_pages(spark, d)).groupBy("page_id").agg(F.count_if("formatting").alias("formatting"), F.count_if("text_container").alias("containers"))


def q_j03(spark, d):
    """Paths from the table body to each link in it."""
    from ..operators.tree import path_between

    n = _pages(spark, d).nodes
    body = n.filter("tag = 'tbody'").select("page_id", F.col("node_id").alias("top"))
    path = n.filter("tag = 'a'").join(body, "page_id").filter(F.array_contains("anc", F.col("top")))
    path = path.select("page_id", F.col("node_id").alias("link"), F.posexplode(path_between(F.col("anc"), F.col("top"))).alias("i", "node_id")).join(n.select("page_id", "node_id", "tag"), ["page_id", "node_id"])
    per = path.groupBy("page_id", "link").agg(F.array_sort(F.collect_list(F.struct("i", "tag"))).alias("p"))
    return per.groupBy("page_id", F.array_join(F.transform("p", lambda x: x["tag"]), ">").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def q_l05(spark, d):
    """One level wider and one narrower than the rows found from a cell."""
    ps = _pages(spark, d)
    first = ps.nodes.filter("tag = 'td'").groupBy("page_id").agg(F.min("node_id").alias("node_id"))
    found = explorer.detect_lists(ps, first)
    shift = lambda wider: explorer.shift_level(F.col("levels"), F.col("level"), F.col("max_level"), wider).cast("bigint")
    return found.select("page_id", F.col("level").cast("bigint").alias("level"), shift(True).alias("wider"), shift(False).alias("narrower"))


def _models(spark, d, tag):
    ps = _pages(spark, d)
    return explorer.selector_parts(ps, ps.nodes.filter(F.col("tag") == tag).select("page_id", "node_id"))


def q_l07(spark, d):
    """Tags, classes and positions that a list's and its items' selectors may use."""
    m = _models(spark, d, "li")
    parts = m.select("page_id", "level", F.explode("parts").alias("p")).filter(F.col("p.k").isin("tag", "class", "nth"))
    return parts.groupBy("page_id", F.col("level").cast("bigint").alias("level"), "p.k", "p.v").agg(F.count(F.lit(1)).alias("n"))


def q_l08(spark, d):
    """Names by their text, as XPath; items by tag and place under the list, as CSS."""
    on = lambda kinds: F.transform("parts", lambda p: p.withField("on", p["k"].isin(*kinds)))
    names = _models(spark, d, "b").withColumn("parts", on(("tag", "text")))
    items = _models(spark, d, "li").withColumn("on", F.col("level") >= 1).withColumn("parts", F.when(F.col("level") == 1, on(("class",))).otherwise(on(("tag", "nth"))))
    out = [explorer.render_model(m, ["page_id", "target_id"]).select("page_id", "selector") for m in (names, items)]
    return out[0].unionByName(out[1])


def q_n03(spark, d):
    """Brands of the parts of a size, made unique in the order of keys."""
    part = _read(spark, d, "part").select("p_size", "p_partkey", "p_brand")
    return D.ensure_unique_names(part, ["p_size"], "p_partkey", "p_brand").select("p_size", "p_partkey", "unique_name")


def q_r02(spark, d):
    """Recipes after one kind is renamed, one deleted and one added."""
    r = recipes.normalize_recipes(customer_recipes(spark, d))
    changed = r.filter("name = 'keys'").withColumn("name", F.lit("items"))
    new = r.filter("name = 'table'").withColumns({"id": F.concat(F.lit("new-"), "id"), "name": F.lit("copy")})
    out = recipes.delete_recipes(recipes.upsert_recipes(r, changed.unionByName(new)), r.filter("name = 'text'").select("id"))
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def q_g01(spark, d):
    """What is kept of each link in the tables as a pager target."""
    ps = _pages(spark, d)
    picks = ps.nodes.filter("tag = 'a'").select("page_id", "node_id")
    return pager.describe_targets(ps, picks).select("page_id", "selector", "text", "aria", "rel")


def q_g02(spark, d):
    """Which rule finds the way on where its text is another one by now."""
    ps = _pages(spark, d)
    t = ps.pages.select("page_id", F.lit("Further").alias("text"), F.lit("").alias("aria"), F.when(F.col("page_id") % 2 == 0, "next").otherwise("").alias("rel"))
    res = pager.resolve_targets(ps, t).join(ps.nodes.select("page_id", "node_id", F.col("attrs")["href"].alias("href")), ["page_id", "node_id"])
    return res.select("page_id", F.col("rank").cast("bigint").alias("rank"), "href")


QUERIES.update({
    "P09_stable_classes": q_p09, "F04_has_child": q_f04, "F07_text_containers": q_f07, "J03_paths_between": q_j03, "L05_shift_level": q_l05, "L07_selector_parts": q_l07,
    "L08_render": q_l08, "N03_unique_names": q_n03, "R02_save_delete": q_r02, "G01_describe_targets": q_g01, "G02_resolve_targets": q_g02})
ORACLES.update({
    "P09_stable_classes": f"WITH {_PER_PAGE} SELECT page_id, unnest(['semantic', 'group']) AS kind, 'keys' AS class, CAST(1 AS BIGINT) AS n FROM n",
    "F04_has_child": f"WITH {_PER_PAGE} SELECT page_id, 'td' AS child, k AS n FROM n UNION ALL SELECT page_id, 'th', 1 FROM n",
    # names are formatting; the title, header cells, two cells, the link, the item and the name of a customer, and the way on hold text
    "F07_text_containers": f"WITH {_PER_PAGE} SELECT page_id, k AS formatting, 5 + 5 * k AS containers FROM n",
    "J03_paths_between": f"WITH {_PER_PAGE} SELECT page_id, 'tr>td>a' AS path, k AS n FROM n",
    "L05_shift_level": f"""WITH {_PER_PAGE} SELECT page_id, CAST(CASE WHEN k > 1 THEN 1 ELSE 0 END AS BIGINT) AS level,
  CAST(CASE WHEN k > 1 THEN 2 ELSE 1 END AS BIGINT) AS wider, CAST(0 AS BIGINT) AS narrower FROM n""",
    "L07_selector_parts": f"""WITH {_PER_PAGE} SELECT page_id, CAST(0 AS BIGINT) AS level, 'tag' AS k, 'body' AS v, k AS n FROM n UNION ALL SELECT page_id, 1, 'tag', 'ul', k FROM n
UNION ALL SELECT page_id, 1, 'class', 'keys', k FROM n UNION ALL SELECT page_id, 2, 'tag', 'li', k FROM n
UNION ALL SELECT cu.page_id, 2, 'nth', CAST(row_ord AS VARCHAR), 1 FROM cu JOIN n USING (page_id) WHERE k > 1""",
    "L08_render": f"""WITH {_PER_PAGE} SELECT page_id, '//b[normalize-space(.)=''' || c_name || ''']' AS selector FROM cu
UNION ALL SELECT cu.page_id, '.keys > li' || CASE WHEN k > 1 THEN ':nth-of-type(' || row_ord || ')' ELSE '' END FROM cu JOIN n USING (page_id)""",
    "N03_unique_names": """SELECT p_size, p_partkey, p_brand || CASE WHEN i > 1 THEN ' ' || i ELSE '' END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS i FROM part)""",
    "R02_save_delete": """WITH h AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer) SELECT unnest(['table', 'items', 'copy']) AS name, n, n AS ids FROM h""",
    "G01_describe_targets": f"""WITH {_PER_PAGE} SELECT page_id, 'a[href="/c/' || c_custkey || '"]' AS selector, 'open' AS text, '' AS aria, '' AS rel FROM cu
UNION ALL SELECT page_id, 'a[rel="next"]', 'Onward', '', 'next' FROM n""",
    "G02_resolve_targets": f"""WITH {CUSTOMERS}, m AS (SELECT DISTINCT page_id, p FROM cu)
SELECT page_id, CAST(CASE WHEN page_id % 2 = 0 THEN 4 ELSE 5 END AS BIGINT) AS rank, '?p=' || (p + 1) AS href FROM m""",
})
