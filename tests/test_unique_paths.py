"""Unique selectors of pages whose cells need their places: what is tried and
what is looked for stays small."""

import pytest
from pyspark.sql import functions as F

from pagerel import session
from pagerel.operators.lists import unique_selectors
from pagerel.operators.select import Matcher, near_key, steps_lit
from pagerel.operators.tree import PageSet
from pagerel.schema import css, step

ROWS = 30
PAGE = "<html><body><div><table><tbody>" + "".join(f"<tr><td>{i}</td><td><b>x</b></td></tr>" for i in range(ROWS)) + "</tbody></table></div></body></html>"


def pageset(spark, ids=(1,)):
    return PageSet(spark.createDataFrame([(i, f"https://a.example/{i}", PAGE) for i in ids], "page_id bigint, url string, html string"))


@pytest.fixture(scope="module")
def table(spark):
    return pageset(spark)


def test_ends_of_paths_are_tried_from_the_short_ones(table):
    """A cell is told apart by its row: no longer end of its path is tried,
    and each position once."""
    tried = []
    watch = lambda what, df: what == "tries" and tried.extend(df.select("css", F.size("steps").alias("n")).collect())
    session.WATCHERS.append(watch)
    try:
        got = {r.selector for r in unique_selectors(table, table.nodes.filter("tag = 'td'")).collect()}
    finally:
        session.WATCHERS.remove(watch)
    assert got == {f"tr:nth-of-type({i + 1}) > td:nth-of-type({j})" for i in range(ROWS) for j in (1, 2)}
    assert max(r.n for r in tried) == 2 and len(tried) <= 4 * 2 * ROWS


def test_cells_meet_in_their_row_only(table):
    """A step under a placed parent is not looked for in all rows."""
    sels = table.pages.select("page_id", F.explode(F.sequence(F.lit(1), F.lit(ROWS))).alias("i"))
    two = steps_lit(css(("desc", step("tr", nth=1)), ("child", step("td", nth=2))))
    sels = sels.withColumn("steps", F.transform(two, lambda s, k: s.withField("nth", F.when(k == 0, F.col("i")).otherwise(s["nth"]))))
    keyed = table.elements.select("page_id", "node_id", F.explode(F.concat("keys", "near")).alias("key"))
    assert sels.withColumn("key", near_key(F.col("steps"))).join(keyed, ["page_id", "key"]).count() == ROWS
    m = Matcher(table).match(sels.select("page_id", F.lit(0).alias("scope_id"), "i"), sels, ["page_id", "i"], ["i"], include_scope=True, texts=False)
    place = table.nodes.select("page_id", "node_id", "tag", "nth")
    assert {(r.i, r.tag, r.nth) for r in m.join(place, ["page_id", "node_id"]).collect()} == {(i + 1, "td", 2) for i in range(ROWS)} and m.count() == ROWS


def test_pages_that_come_twice_are_looked_through_in_full(spark):
    """Two elements by one number: no key tells what a step asks for."""
    ps = pageset(spark, (1, 1, 2))
    got = {(r.page_id, r.node_id): r.selector for r in unique_selectors(ps, ps.nodes).collect()}
    assert not ps.ids_differ and len(got) == ps.nodes.select("page_id", "node_id").distinct().count()
    once = {r.node_id: r.selector for r in unique_selectors(pageset(spark), ps.nodes.filter("page_id = 2").withColumn("page_id", F.lit(1).cast("bigint"))).collect()}
    assert {n: s for (p, n), s in got.items() if p == 2} == once
