"""What the list, column and recipe queries share is worked out once."""

import contextlib

import pytest
from pyspark.sql import functions as F

from fixtures import BASE, boat_tiles, tide_table
from pagerel import session
from pagerel.operators.extract import node_values, recipe_extract
from pagerel.operators.lists import find_lists
from pagerel.operators.recipes import normalize_recipes
from pagerel.operators.select import Matcher, steps_lit
from pagerel.operators.tree import PageSet
from pagerel.schema import RECIPE, css, step


@pytest.fixture(scope="module")
def own(spark):
    return PageSet(spark.createDataFrame([(1, BASE, boat_tiles()), (2, BASE, tide_table())], "page_id bigint, url string, html string"))


@contextlib.contextmanager
def plans():
    """(what, optimized plan) of each table stored inside."""
    seen = []
    watch = lambda what, df: seen.append((what, df._jdf.queryExecution().optimizedPlan()))
    session.WATCHERS.append(watch)
    try:
        yield seen
    finally:
        session.WATCHERS.remove(watch)


def test_selectors_of_one_step_read_no_chains(spark):
    ps = PageSet(spark.createDataFrame([(1, BASE, boat_tiles())], "page_id bigint, url string, html string"))
    scopes = spark.createDataFrame([(1, 0)], "page_id bigint, scope_id int")
    one = scopes.select("page_id", steps_lit(css(("desc", step("h2")))).alias("steps"))
    assert Matcher(ps).match(scopes, one, ["page_id"], include_scope=True).count() == 5 and "chains" not in ps._made
    two = scopes.select("page_id", steps_lit(css(("desc", step("h2")), ("child", step("a")))).alias("steps"))
    assert Matcher(ps).match(scopes, two, ["page_id"], include_scope=True).count() == 5 and "chains" in ps._made
    # a child step alone asks for children of its scope
    body = ps.nodes.filter("tag = 'body'").select("page_id", F.col("node_id").alias("scope_id"))
    child = body.select("page_id", steps_lit(css(("child", step("main")))).alias("steps"))
    assert Matcher(ps).match(body, child, ["page_id"]).count() == 1
    assert Matcher(ps).match(body, child.withColumn("steps", steps_lit(css(("child", step("h2"))))), ["page_id"]).count() == 0


def test_values_meet_the_elements_once(own):
    cells = own.nodes.filter("tag in ('h2', 'section', 'img', 'td')").select(
        "page_id", "node_id", F.when(F.col("tag") == "section", "href").when(F.col("tag") == "img", "src").otherwise("text").alias("attr"))
    with plans() as seen:
        got = node_values(own, cells).groupBy("attr", "value").count().collect()
    values = {(r.attr, r.value): r["count"] for r in got}
    assert values["href", "https://harbour.example/boats/b2"] == 1 and values["src", "https://harbour.example/shots/b5.png"] == 1
    assert values["text", "Cutter 3"] == 1 and values["text", "Dover"] == 1 and sum(values.values()) == 5 + 5 + 5 + 12
    assert [w for w, _ in seen].count("cells") == 1
    # texts and urls are joined to stored cells, not to cells joined to the elements anew each time
    assert max(p.collectLeaves().size() for w, p in seen if w == "read") <= 16


def test_leaves_of_lists_are_counted_once(own):
    with plans() as seen:
        assert find_lists(own).filter("page_id = 1 and list_rank = 1").first().row_count == 5
    assert sum(p.toString().count("posexplode(anc") for _, p in seen if "rdepth" in p.toString()) == 1


def test_recipes_of_a_page_are_numbered_once(own, spark):
    r = [("b", "boats", "harbour.example", css(("desc", step("section"))), [("Boat", css(("desc", step("h2"))), "text", ""), ("Link", css(("desc", step("a"))), "href", "")], None, None),
         ("a", "names", "harbour.example", css(("desc", step("h2"))), [("Name", [], "text", "")], None, None)]
    recipes = normalize_recipes(spark.createDataFrame(r, RECIPE))
    with plans() as seen:
        cells = recipe_extract(own, recipes).collect()
    assert sorted(c.value for c in cells if c.id == "b" and c.name == "Boat") == [f"Cutter {i}" for i in range(1, 6)] and len(cells) == 15
    assert [w for w, _ in seen].count("page-recipes") == 1
    assert sum("row_number() windowspecdefinition(page_id" in p.toString() and "name#" in p.toString() for w, p in seen if w in ("asked", "cells")) == 0
