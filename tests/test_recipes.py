"""Recipes on pages, value modes, picked columns, models and pager targets."""

import pytest
from pyspark.sql import functions as F

from conftest import node_id
from fixtures import BASE
from pagerel.operators.explorer import column_for, render_model, selector_parts
from pagerel.operators.extract import apply_columns, node_values, recipe_extract
from pagerel.operators.lists import find_lists, list_rows
from pagerel.operators.pager import resolve_targets, target_state
from pagerel.operators.recipes import normalize_recipes, pages_for, read_recipes, write_recipes
from pagerel.operators.select import select_nodes, steps_lit
from pagerel.operators.viewer import natural_sort, page
from pagerel.schema import RECIPE, css, step
from pagerel.sources.sinks import column_letter, column_widths, csv_lines


def recipe(spark, rid, row, cols):
    """cols: (name, steps, attr, attr_name)."""
    made = F.array(*[F.struct(F.lit(n).alias("name"), steps_lit(s).alias("steps"), F.lit(a).alias("attr"), F.lit(an).alias("attr_name")) for n, s, a, an in cols])
    base = spark.range(1).select(F.lit(rid).alias("id"), F.lit(rid).alias("name"), F.lit("harbour.example").alias("host"), steps_lit(row).alias("row_steps"), made.alias("columns"))
    for f in ("pagination", "options"):
        base = base.withColumn(f, F.lit(None).cast(RECIPE[f].dataType))
    return normalize_recipes(base)


@pytest.fixture(scope="module")
def recipes(spark):
    tiles = recipe(spark, "tiles", css(("desc", step("section", classes=["boat-tile"]))),
                   [("Boat", css(("desc", step("h2"))), "text", ""), ("Picture", css(("desc", step("img"))), "src", ""), ("Alt", css(("desc", step("img"))), "attr", "alt")])
    gear = recipe(spark, "gear", css(("desc", step("ol", classes=["gear"])), ("child", step("li"))), [("Gear", [], "text", "")])
    onward = recipe(spark, "onward", css(("desc", step("a", text="Onward"))), [("Link", [], "href", ""), ("Label", [], "outerHtml", "")])
    return tiles.unionByName(gear).unionByName(onward)


def test_recipes_of_one_host_stay_apart(ps, recipes):
    cells = recipe_extract(ps, recipes).filter("page_id = 1").collect()
    by = lambda rid, name: [r.value for r in sorted(cells, key=lambda r: r.row_ord) if r.id == rid and r.name == name]
    assert by("tiles", "Boat") == [f"Cutter {i}" for i in range(1, 6)]
    assert by("tiles", "Picture") == [f"https://harbour.example/shots/b{i}.png" for i in range(1, 6)]
    assert by("tiles", "Alt") == [f"Boat {i}" for i in range(1, 6)]
    assert by("gear", "Gear") == ["radar", "raft", "horn"] * 5
    assert by("onward", "Link") == [f"{BASE}?leaf=2"]
    assert by("onward", "Label") == ['<a class="onward" rel="next" href="?leaf=2">Onward</a>']
    assert len(cells) == 15 + 15 + 2


def test_text_step_selects_by_text(ps):
    hits = select_nodes(ps, css(("desc", step("a", text="Onward")))).filter("page_id in (1, 4, 5)")
    assert sorted(r.page_id for r in hits.collect()) == [1, 4, 5]


def test_recipes_survive_a_round_trip(spark, recipes, tmp_path):
    write_recipes(recipes, f"{tmp_path}/out")
    back = read_recipes(spark, f"{tmp_path}/out")
    strip = lambda df: sorted(str(r.asDict(True) | {"id": ""}) for r in df.collect())
    assert back.count() == 3 and strip(back) == strip(recipes)
    doc = recipes.select(F.to_json(F.struct(F.collect_list(F.struct("name", "host", "row_steps", "columns")).alias("recipes")), {"pretty": "true"}).alias("j")).first().j
    (tmp_path / "one.json").write_text(doc)
    assert doc.count("\n") > 5 and read_recipes(spark, f"{tmp_path}/one.json").count() == 3
    (tmp_path / "array.json").write_text('[{"name": "x", "row_steps": [{"comb": "desc", "tag": "li"}]},\n {"recipe": {"name": "y", "columns": [{"name": "c"}]}}]')
    assert {r.name for r in read_recipes(spark, f"{tmp_path}/array.json").collect()} == {"x", "y"}
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(ValueError):
        read_recipes(spark, f"{tmp_path}/none.json")


def test_value_modes(ps):
    spark = ps.nodes.sparkSession
    ids = {r.id: r.node_id for r in ps.nodes.filter("page_id = 8 and id <> ''").collect()}
    want = {("way", "href", ""): "https://harbour.example/chart/9?z=4", ("late", "src", ""): "https://harbour.example/shots/far.png", ("due", "attr", "datetime"): "2031-02-03",
            ("rich", "html", ""): "a <b>bold</b> move", ("rich", "outerHtml", ""): '<div id="rich">a <b>bold</b> move</div>', ("rich", "text", ""): "a bold move",
            ("rich", "ownText", ""): "a move", ("memo", "value", ""): "two\nlines", ("pick", "value", ""): "Ketch"}
    cells = spark.createDataFrame([(8, ids[i], m, a) for i, m, a in want], "page_id bigint, node_id int, attr string, attr_name string")
    got = {(r.node_id, r.attr): r.value for r in node_values(ps, cells, attr_name_col="attr_name").collect()}
    assert got == {(ids[i], m): v for (i, m, _), v in want.items()}
    with pytest.raises(Exception, match="unknown value mode"):
        node_values(ps, cells.withColumn("attr", F.lit("colour")), attr_name_col="attr_name").collect()


def test_column_from_a_picked_element(ps):
    spark = ps.nodes.sparkSession
    rows = list_rows(ps, find_lists(ps).filter("page_id = 1 and list_rank = 1"))
    flag = node_id(ps, 1, F.array_contains("classes", "flag"))[0]
    rate = node_id(ps, 1, F.array_contains("classes", "day-rate"))[1]
    got = {r.node_id: r for r in column_for(ps, rows, spark.createDataFrame([(1, flag), (1, rate)], "page_id bigint, node_id int"), ["Day Rate"]).collect()}
    assert (got[flag].filled, got[flag].n_rows, got[flag].sel, got[flag].sample) == (1, 5, ".flag", "Booked")
    assert (got[rate].filled, got[rate].name, got[rate].attr, got[rate].sample) == (5, "Day Rate 2", "text", "EUR 30.50")
    with pytest.raises(ValueError):
        column_for(ps, rows, spark.createDataFrame([(1, 0)], "page_id bigint, node_id int"))


def test_selector_model_renders(ps):
    spark = ps.nodes.sparkSession
    load = node_id(ps, 7, F.array_contains("classes", "load"))[0]
    model = selector_parts(ps, spark.createDataFrame([(7, load)], "page_id bigint, node_id int"))
    assert render_model(model, ["page_id", "target_id"]).first().selector == "span.load"
    on = model.withColumn("on", F.col("tag").isin("main", "span")).withColumn("parts", F.transform("parts", lambda p: p.withField("on", p["k"].isin("tag", "id") | ((p["k"] == "text") & (p["v"] == "9")))))
    assert render_model(on, ["page_id", "target_id"]).first().selector == "//main[@id='deck']//span[normalize-space(.)='9']"


def test_pager_by_recorded_selector(ps):
    spark = ps.nodes.sparkSession
    t = spark.createDataFrame([(4, "", "", ""), (5, "nothing like it", "", "")], "page_id bigint, text string, aria string, rel string")
    hits = select_nodes(ps, css(("desc", step("ol", classes=["leaves"])), ("child", step("li")), ("child", step("a"))))
    got = {r.page_id: r["rank"] for r in resolve_targets(ps, t, hits).collect()}
    assert got == {4: 1, 5: 3}
    assert {(r.page_id, r.found, r.label) for r in target_state(ps, t, hits).collect()} == {(4, True, "1"), (5, True, "1")}


def test_nothing_is_cut(spark):
    """60 columns, a column from row 41 on, and 12 lists on one page."""
    from pagerel.operators.columns import detect_columns
    from pagerel.operators.tree import PageSet

    rows = "".join("<tr>" + "".join(f'<td class="f{chr(97 + c // 10)}{chr(97 + c % 10)}">{r}.{c}</td>' for c in range(60)) + ('<td class="late">z</td>' if r > 40 else "") + "</tr>" for r in range(60))
    lists = "".join(f'<div class="shelf{chr(97 + i)}">' + f'<p class="book{chr(97 + i)}"><a href="/x">t</a><b class="by">w</b></p>' * 4 + "</div>" for i in range(12))
    big = PageSet(spark.createDataFrame([(1, "https://a.example/", f"<table><tbody>{rows}</tbody></table>"), (2, "https://a.example/2", lists)], "page_id bigint, url string, html string"))
    assert find_lists(big).filter("page_id = 2").count() == 12
    cols, _ = detect_columns(big, list_rows(big, find_lists(big).filter("page_id = 1 and list_rank = 1")))
    assert cols.count() == 61


def test_numbers_letters_names_and_pages(spark):
    long = ["9" * 45 + "1", "9" * 45 + "2", "1" + "0" * 50, "2", "010"]
    df = spark.createDataFrame([(x,) for x in long], "`U.S. price` string")
    assert [r[0] for r in natural_sort(df, "U.S. price").collect()] == ["2", "010", long[0], long[1], long[2]]
    assert csv_lines(df, ["U.S. price"]).count() == 5
    assert column_widths(df.withColumnRenamed("U.S. price", "O'Neil"), ["O'Neil"]).first().width == 53
    letters = spark.createDataFrame([(i,) for i in (0, 25, 26, 701, 702, 18277, 18278)], "i long").select(column_letter(F.col("i"))).collect()
    assert [r[0] for r in letters] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    last = page(spark.range(25).select(F.col("id").alias("k")), ["k"], 99, 10)
    assert [r.k for r in last.orderBy("k").collect()] == [20, 21, 22, 23, 24]


def test_pages_for_pairs_hosts(ps, recipes):
    assert pages_for(recipes, ps.pages).count() == 27
