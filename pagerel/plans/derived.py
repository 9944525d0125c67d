"""Pages that Spark renders from the customer table, so that operators meet
tables with header rows, attributes, links and pagers, and the expected result
is the table itself: each nation is a site, its customers are listed five to a
page, and each page leads to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.select import steps_lit
from ..schema import RECIPE, css, step

PER_PAGE = 5


def customer_pages(spark: SparkSession, sf_dir: str, ring: bool = False) -> DataFrame:
    """(page_id, url, html); page_id = nation * 100000 + page number. The last
    page's way on is disabled, or leads to the first (``ring``)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    c = c.withColumn("p", F.floor(nth / PER_PAGE).cast("int") + 1)
    row = F.concat(F.lit("<tr><td>"), "c_name", F.lit("</td><td>"), "c_mktsegment", F.lit('</td><td><a href="/c/'), F.col("c_custkey").cast("string"), F.lit('">open</a></td></tr>'))
    item = F.concat(F.lit('<li data-key="k'), F.col("c_custkey").cast("string"), F.lit('"><b>'), "c_name", F.lit("</b> at sea</li>"))
    pages = c.groupBy("c_nationkey", "p").agg(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("row"), item.alias("item")))).alias("x"))
    last = F.max("p").over(Window.partitionBy("c_nationkey"))
    pages = pages.withColumn("last", last)
    on = F.concat(F.lit('<a rel="next" href="?p='), (F.col("p") % F.col("last") + 1 if ring else F.col("p") + 1).cast("string"), F.lit('"'), F.when((F.col("p") == F.col("last")) & F.lit(not ring), F.lit(' class="disabled"')).otherwise(F.lit("")), F.lit(">Onward</a>"))
    html = F.concat(F.lit("<html><head><title>Customers</title></head><body><table><tbody><tr><th>Customer</th><th>Segment</th><th>Account</th></tr>"),
                    F.array_join(F.transform("x", lambda v: v["row"]), ""), F.lit('</tbody></table><ul class="keys">'),
                    F.array_join(F.transform("x", lambda v: v["item"]), ""), F.lit("</ul>"), on, F.lit("</body></html>"))
    return pages.select((F.col("c_nationkey").cast("bigint") * 100000 + F.col("p")).alias("page_id"),
                        F.concat(F.lit("https://n"), F.col("c_nationkey").cast("string"), F.lit(".example/list?p="), F.col("p").cast("string")).alias("url"), html.alias("html"))


def _recipe(hosts: DataFrame, rid: str, row: list[dict], cols: list[tuple]) -> DataFrame:
    made = F.array(*[F.struct(F.lit(n).alias("name"), steps_lit(s).alias("steps"), F.lit(a).alias("attr"), F.lit(an).alias("attr_name")) for n, s, a, an in cols])
    out = hosts.select(F.concat(F.lit(rid + "@"), "host").alias("id"), F.lit(rid).alias("name"), "host", steps_lit(row).alias("row_steps"), made.alias("columns"))
    return out.withColumns({f: F.lit(None).cast(RECIPE[f].dataType) for f in ("pagination", "options")})


def customer_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recipes for every site: the table, the list, and building firms' names by a text step."""
    hosts = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".example")).alias("host")).distinct()
    cell = lambda n: css(("child", step("td", nth=n)))
    table = _recipe(hosts, "table", css(("desc", step("tr", has_child="td"))), [("Name", cell(1), "text", ""), ("Link", cell(3), "href", "")])
    keys = _recipe(hosts, "keys", css(("desc", step("ul", classes=["keys"])), ("child", step("li"))),
                   [("Key", [], "attr", "data-key"), ("Markup", [], "html", ""), ("Own", [], "ownText", "")])
    text = _recipe(hosts, "text", css(("desc", step("td", text="BUILDING"))), [("Segment", [], "text", "")])
    return table.unionByName(keys).unionByName(text)


#: Customers with their page, as DuckDB sees them.
CUSTOMERS = ("cu AS (SELECT *, CAST(c_nationkey AS BIGINT) * 100000 + nth // 5 + 1 AS page_id, nth % 5 + 1 AS row_ord, nth // 5 + 1 AS p FROM "
             "(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer))")
DERIVED_ORACLES = {
    # 12 elements beside the customers; each customer is a table row of 3 cells and a link, and an item; all of a row's
    # need their place, an item's text too, and the header's cells; one page's only item is the list's only child
    "L06_every_node": f"""WITH {CUSTOMERS}, n AS (SELECT page_id, count(*) AS k FROM cu GROUP BY page_id)
SELECT page_id, 12 + 7 * k AS n_nodes, 12 + 7 * k AS n_unique, CAST(0 AS BIGINT) AS n_without, CASE WHEN k = 1 THEN 8 ELSE 4 + 6 * k END AS n_paths FROM n""",
    "L06_cell_selectors": f"""WITH {CUSTOMERS}, n AS (SELECT page_id, row_ord, count(*) OVER (PARTITION BY page_id) AS k FROM cu)
SELECT page_id, CASE WHEN k = 1 THEN '' ELSE 'tr:nth-of-type(' || (row_ord + 1) || ') > ' END || 'td:nth-of-type(' || j || ')' AS selector
FROM n, (SELECT unnest([1, 2, 3]) AS j)""",
    "F09_validate_in_rows": f"""WITH {CUSTOMERS}, n AS (SELECT page_id, count(*) AS k FROM cu GROUP BY page_id)
SELECT page_id, 'td' AS sel, 3 * k AS matches, k AS rows_with, k + 1 AS n_rows, k || ' of ' || (k + 1) || ' rows' AS status FROM n
UNION ALL SELECT page_id, 'a', k, k, k + 1, k || ' of ' || (k + 1) || ' rows' FROM n
UNION ALL SELECT page_id, 'th', CAST(3 AS BIGINT), CAST(1 AS BIGINT), k + 1, '1 of ' || (k + 1) || ' rows' FROM n""",
    "J10_several_recipes": f"""WITH {CUSTOMERS}, b AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY c_custkey) AS row_ord, c_mktsegment FROM cu WHERE c_mktsegment = 'BUILDING')
SELECT 'table' AS recipe, page_id, row_ord, 'Name' AS name, c_name AS value FROM cu
UNION ALL SELECT 'table', page_id, row_ord, 'Link', 'https://n' || c_nationkey || '.example/c/' || c_custkey FROM cu
UNION ALL SELECT 'keys', page_id, row_ord, 'Key', 'k' || c_custkey FROM cu
UNION ALL SELECT 'keys', page_id, row_ord, 'Markup', '<b>' || c_name || '</b> at sea' FROM cu
UNION ALL SELECT 'keys', page_id, row_ord, 'Own', 'at sea' FROM cu
UNION ALL SELECT 'text', page_id, row_ord, 'Segment', 'BUILDING' FROM b""",
    "S04_recipe_round_trip": """SELECT host, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM
  (SELECT DISTINCT 'n' || c_nationkey || '.example' AS host FROM customer), (SELECT unnest(['table', 'keys', 'text']) AS name) GROUP BY host""",
    "F03_text_steps": f"WITH {CUSTOMERS} SELECT page_id, count(*) AS n FROM cu WHERE c_mktsegment = 'BUILDING' GROUP BY page_id",
    "J09_header_names": f"""WITH {CUSTOMERS} SELECT page_id, unnest(['Customer', 'Segment', 'Account']) AS header, count(*) AS n FROM cu GROUP BY page_id""",
    "G06_customer_chains": f"""WITH {CUSTOMERS}, m AS (SELECT c_nationkey, p, page_id, max(p) OVER (PARTITION BY c_nationkey) AS last FROM (SELECT DISTINCT c_nationkey, p, page_id FROM cu))
SELECT CAST(c_nationkey AS BIGINT) * 100000 + 1 AS start_id, CAST(p AS BIGINT) AS step, page_id, CASE WHEN p = last THEN 'disabled' END AS reason FROM m""",
}
