from pyspark.sql import functions as F

from conftest import node_id
from pagerel.operators import dataset as D
from pagerel.operators.pager import is_disabled, resolve_targets, stable_changes


def test_disabled_controls(ps):
    d = {r.node_id: r.disabled for r in is_disabled(ps).filter(F.col("page_id") == 6).collect()}
    ids = {r.id: r.node_id for r in ps.nodes.filter(F.col("page_id") == 6).collect() if r.id}
    assert [d[ids[k]] for k in ["k1", "k2", "k3", "k4", "k5"]] == [True, True, True, False, False]


def test_pager_found_again_by_text(ps):
    spark = ps.nodes.sparkSession
    t = spark.createDataFrame([(4, "Onward", "", ""), (5, "Onward", "", "")], "page_id bigint, text string, aria string, rel string")
    got = {r.page_id: r.node_id for r in resolve_targets(ps, t).collect()}
    for pid in (4, 5):
        a = [r for r in ps.nodes.filter((F.col("page_id") == pid) & (F.col("tag") == "a")).orderBy("node_id").collect()]
        assert got[pid] == a[-1].node_id


def test_merge_grows_schema(spark):
    a = spark.createDataFrame([("1", "2"), ("3", "4")], "A string, B string")
    b = spark.createDataFrame([("x", "y")], "B string, C string")
    m = D.merge(a, b).collect()
    assert [tuple(r) for r in m] == [("1", "2", ""), ("3", "4", ""), ("", "x", "y")]


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "b"), (0, 5, "a")], "page_ord int, row_ord int, v string")
    got = sorted(tuple(r) for r in D.dedupe(df, ["v"]).collect())
    assert got == [(0, 5, "a"), (2, 1, "b")]


def test_new_rows_against_stored(spark):
    st = spark.createDataFrame([("a",), ("b",)], "k string")
    inc = spark.createDataFrame([("b",), ("c",)], "k string")
    assert [r.k for r in D.new_rows(inc, st, ["k"]).collect()] == ["c"]
    assert D.new_rows(inc, st.withColumnRenamed("k", "z"), ["k"]).count() == 2


def test_unique_names(spark):
    df = spark.createDataFrame([(1, 1, "Price"), (1, 2, "Price"), (1, 3, " "), (1, 4, "Price 2"), (1, 5, "Price")],
                               "rid int, o int, name string")
    got = [r.unique_name for r in D.ensure_unique_names(df, ["rid"], "o").orderBy("o").collect()]
    assert got == ["Price", "Price 2", "Column 3", "Price 2 2", "Price 3"]


def test_row_numbers_distributed(spark):
    df = spark.range(1000).repartition(7).withColumn("k", (F.col("id") * 7919) % 1000)
    rn = D.row_numbers(df, ["k"]).orderBy("k").collect()
    assert [r.row_no for r in rn] == list(range(1, 1001))


def test_compact(spark):
    df = spark.createDataFrame([(5,), (1234,), (1000,), (15000,)], "n long")
    assert [r[0] for r in df.select(D.compact(F.col("n"))).collect()] == ["5", "1.2k", "1k", "15k"]


def test_stable_changes(spark):
    s = spark.createDataFrame([("u", 1, "a", 1), ("u", 2, "b", 1), ("u", 3, "b", 1), ("u", 4, "b", 1), ("u", 5, "c", 0)],
                              "url string, seen_at int, sig string, n int")
    assert [r.seen_at for r in stable_changes(s).collect()] == [3]
    back = spark.createDataFrame([("u", i, x, 1) for i, x in enumerate("aabaaccbbac")], "url string, seen_at int, sig string, n int")
    assert [(r.seen_at, r.sig) for r in stable_changes(back).orderBy("seen_at").collect()] == [(6, "c"), (8, "b")]


def test_unique_names_against_the_rule(spark):
    """Families of names with numbers of their own, blanks and equal places."""
    import random

    rng = random.Random(5)
    pool = ["A", "A 2", "A 2 2", "A 3", " A ", "", None, "Column 2", "Column 4", "B", "A  2", "7", "A x"]
    rows = [(g, rng.randint(1, 40), rng.choice(pool)) for g in (1, 2, None) for _ in range(60)]
    want = []
    for g in (1, 2, None):
        taken = []
        for _, o, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            base = (n or "").strip(" ") or f"Column {len(taken) + 1}"
            k = 2
            while base in taken and f"{base} {k}" in taken:
                k += 1
            taken.append(f"{base} {k}" if base in taken else base)
            want.append((g, o, taken[-1]))
    df = spark.createDataFrame(rows, "g int, o int, name string")
    got = [tuple(r) for r in D.ensure_unique_names(df, ["g"], "o").collect()]
    by = lambda r: (r[0] or 0, *r[1:])
    assert sorted(got, key=by) == sorted(want, key=by)


def test_unique_names_of_a_large_group(spark):
    """Many rows of one name, and of one with numbers, are no quadratic work."""
    import time

    n = 20000
    df = spark.range(n).selectExpr("1 AS g", "id AS o", "CASE WHEN id % 3 = 0 THEN 'A' WHEN id = 7 THEN 'B 2' ELSE 'B' END AS name")
    t = time.time()
    got = {r.unique_name for r in D.ensure_unique_names(df, ["g"], "o").collect()}
    assert len(got) == n and time.time() - t < 60


def test_large_tables_of_few_bytes_are_not_broadcast(spark):
    """Many like rows make a small file: its size says nothing of the driver's memory."""
    from pagerel.session import MOST_BROADCAST, cut_lineage

    many = cut_lineage(spark.range(MOST_BROADCAST + 1).selectExpr("id", "'x' AS a"))
    few = cut_lineage(spark.range(9).selectExpr("id", "'y' AS b"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = many.filter("a = 'x'").join(many.select("id").distinct(), "id")
    assert "Broadcast" not in plan(joined) and joined.count() == MOST_BROADCAST + 1
    assert "BroadcastHashJoin" in plan(few.join(few.select("id"), "id"))


def _merged_pages(spark, monkeypatch):
    """Pages whose tables all count as large, and the plan that each cut was written by."""
    from pagerel import session
    from pagerel.operators.tree import PageSet

    plans: dict = {}
    monkeypatch.setattr(session, "MOST_BROADCAST", -1)
    monkeypatch.setattr(session, "WATCHERS", [lambda what, df: plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString())])
    html = "<html><body><table><tbody>" + "".join(f"<tr><td>n{i}</td><td><a href='/c/{i}'>open</a></td></tr>" for i in range(3)) + "</tbody></table><ul class='keys'><li>a</li><li>b</li></ul></body></html>"
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", html) for i in range(3)], "page_id bigint, url string, html string")
    return PageSet(pages), plans


def test_semi_joined_elements_are_not_broadcast(spark, monkeypatch):
    """A semi join loses what is known of its left side's rows."""
    from pagerel.operators.explorer import group_sizes, similar_siblings
    from pagerel.operators.lists import unique_selectors

    ps, plans = _merged_pages(spark, monkeypatch)
    li = ps.nodes.filter("tag = 'li'").select("page_id", "node_id")
    assert [tuple(r) for r in similar_siblings(ps, li).groupBy("page_id").count().orderBy("page_id").collect()] == [(0, 4), (1, 4), (2, 4)]
    sizes = group_sizes(ps, li)
    assert {r["size"] for r in sizes.collect()} == {2}
    assert "BroadcastHashJoin" not in sizes._jdf.queryExecution().executedPlan().toString()
    assert unique_selectors(ps, ps.nodes.filter("tag = 'li'")).filter("selector = '.keys > li:nth-of-type(1)' or phase = 3").count() > 0
    for what in ("siblings", "similar", "under-ancestors"):
        assert "SortMergeJoin" in plans[what] and "BroadcastHashJoin" not in plans[what], what


def test_elements_are_not_broadcast_where_a_join_with_nothing_goes(spark, monkeypatch):
    """At run time a join with an empty side or a union with one is left out."""
    import re

    from pagerel.operators.extract import apply_columns
    from pagerel.operators.select import steps_lit
    from pagerel.schema import css, step

    ps, _ = _merged_pages(spark, monkeypatch)
    final = lambda df: df._jdf.queryExecution().executedPlan().toString()
    links = spark.createDataFrame([(i, "x") for i in range(3)], "page_id bigint, x string").join(
        ps.nodes.filter("tag = 'a'").select("page_id", "node_id"), "page_id")
    off = links.join(is_disabled(ps), ["page_id", "node_id"])
    assert [r.disabled for r in off.collect()] == [False] * 9
    assert "BroadcastHashJoin" not in final(off)
    rows = ps.nodes.filter("tag = 'tr'").select("page_id", F.lit(1).alias("list_rank"), F.col("node_id").alias("row_id"), F.col("sib_ord").alias("row_ord"))
    cols = ps.pages.select("page_id", F.lit(1).alias("list_rank"), F.lit(1).alias("col_ord"), F.lit("Name").alias("name"), steps_lit(css(("child", step("td", nth=1)))).alias("steps"), F.lit("text").alias("attr"))
    cells = apply_columns(ps, rows, cols)
    assert sorted(r.value for r in cells.collect()) == sorted(["n0", "n1", "n2"] * 3)
    assert not re.search(r"BroadcastHashJoin \[page_id#\d+L?, list_rank#\d+, col_ord#\d+, row_ord", final(cells))


def test_tables_as_long_as_the_pages_are_not_broadcast(spark, monkeypatch):
    """A row for each page or table: below Spark's limit one by one, but growing with the pages."""
    from pagerel.operators.explorer import header_names
    from pagerel.operators.pager import page_chain, target_state
    from pagerel.operators.select import select_nodes, steps_lit, validate
    from pagerel.schema import css, step

    ps, plans = _merged_pages(spark, monkeypatch)
    final = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = select_nodes(ps, css(("desc", step("tr")))).withColumnRenamed("node_id", "row_id")
    sels = ps.pages.select("page_id", F.lit("td").alias("sel"), steps_lit(css(("child", step("td")))).alias("steps"))
    met = validate(ps, sels, rows)
    assert {r.status for r in met.collect()} == {"3 of 3 rows"}
    state = target_state(ps, ps.pages.select("page_id", F.lit("OPEN").alias("text"), F.lit("").alias("aria"), F.lit("").alias("rel")))
    assert [r.label for r in state.collect()] == ["open"] * 3
    cells = ps.nodes.filter("tag = 'td'").select("page_id", F.col("parent_id").alias("row"), F.col("node_id").alias("el"))
    headers = header_names(ps, cells)
    assert headers.count() == 0  # no row has header cells
    links = spark.createDataFrame([(i, f"/{i + 1}", False) for i in range(3)], "page_id bigint, href string, disabled boolean")
    sigs = spark.createDataFrame([(i, 3, f"s{i}") for i in range(3)], "page_id bigint, n bigint, sig string")
    chain = page_chain(ps, links, None, sigs)
    assert sorted((r.start_id, r.step, r.page_id, r.reason) for r in chain.collect()) == [(0, 1, 0, None), (0, 2, 1, None), (0, 3, 2, "not stored")]
    for df in (met, state, headers):
        assert "BroadcastHashJoin" not in final(df)
    assert plans["header-cells"].count("BroadcastHashJoin") == 0
