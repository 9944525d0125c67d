from pyspark.sql import functions as F

from conftest import node_id
from pagerel.operators.columns import detect_columns
from pagerel.operators.explorer import detect_lists, header_names, similar_siblings, xpaths
from pagerel.operators.extract import apply_columns, wide
from pagerel.operators.lists import find_lists, list_rows, unique_selectors


def test_find_lists_ranks_grid_above_menus(ps):
    fl = find_lists(ps).filter(F.col("page_id") == 1).orderBy("list_rank").collect()
    assert fl[0].row_selector == "div.quay > section.boat-tile"
    assert fl[0].row_count == 5
    assert fl[0].score > max(r.score for r in fl[1:]) if len(fl) > 1 else True


def test_detect_columns_product_grid(ps):
    fl = find_lists(ps).filter((F.col("page_id") == 1) & (F.col("list_rank") == 1))
    rows = list_rows(ps, fl)
    cols, _ = detect_columns(ps, rows)
    c = cols.orderBy("col_ord").collect()
    names = [r.name for r in c]
    assert "Boat Name" in names and "Day Rate" in names and "Remarks" in names, names
    assert any("image" in n.lower() or "shot" in n.lower() for n in names), names
    assert "Flag" not in names
    cells = apply_columns(ps, rows, cols)
    w = wide(cells, names).orderBy("row_ord").collect()
    assert [r["Day Rate"] for r in w] == ["EUR 15.50", "EUR 30.50", "EUR 45.50", "EUR 60.50", "EUR 75.50"]
    assert w[3]["Boat Name"] == "Cutter 4"
    assert w[0]["Remarks"] == "Sleeps up to 2"


def test_detect_list_from_title_click(ps):
    titles = ps.nodes.filter((F.col("page_id") == 1) & (F.col("tag") == "h2")).orderBy("node_id").collect()
    a_ids = [r.node_id + 1 for r in titles]
    tg = ps.nodes.sparkSession.createDataFrame([(1, a_ids[2])], "page_id bigint, node_id int")
    res = detect_lists(ps, tg).collect()[0]
    assert res.row_selector == "div.quay > section.boat-tile", res
    assert len(res.levels) >= 1


def test_table_header_rows_and_names(ps):
    tds = node_id(ps, 2, F.col("tag") == "td")
    tg = ps.nodes.sparkSession.createDataFrame([(2, tds[4])], "page_id bigint, node_id int")
    res = detect_lists(ps, tg).collect()[0]
    rows = list_rows(ps, ps.nodes.sparkSession.createDataFrame(
        [(2, 1, res.parent_id, res.row_tag, res.row_classes, res.has_child)],
        "page_id bigint, list_rank int, parent_id int, row_tag string, row_classes array<string>, has_child string"))
    assert rows.count() == 4, res.row_selector
    assert ":has(> td)" in res.row_selector
    cols, _ = detect_columns(ps, rows)
    cells = apply_columns(ps, rows, cols)
    names = [r.name for r in cols.orderBy("col_ord").collect()]
    hdr = header_names(ps, rows.select("page_id", F.col("row_id").alias("row"), (F.col("row_id") + 2).alias("el")))
    assert sorted(r.header for r in hdr.collect()) == ["Height"] * 4
    assert names == ["Station", "Height", "Moon"]
    w = wide(cells, names).orderBy("row_ord").collect()
    assert [w[1][n] for n in names] == ["Dover", "642", "full"]


def test_three_sections_single_example(ps):
    names = node_id(ps, 3, F.array_contains("classes", "code"))
    tg = ps.nodes.sparkSession.createDataFrame([(3, names[0])], "page_id bigint, node_id int")
    res = detect_lists(ps, tg).collect()[0]
    assert res.row_tag == "div" and res.row_classes == ["slot"]


def test_unique_selectors_preferred_forms(ps):
    ids = {}
    for r in ps.nodes.filter(F.col("page_id") == 7).collect():
        ids[(r.tag, r.id, tuple(r.classes), tuple(sorted(r.attrs.items())))] = r.node_id
    want = [i for (tag, _id, cls, attrs), i in ids.items()
            if (tag == "input") or (tag == "button") or (tag == "main") or (tag == "span" and "load" in cls)]
    tg = ps.nodes.sparkSession.createDataFrame([(7, i) for i in want], "page_id bigint, node_id int")
    got = {r.selector for r in unique_selectors(ps, tg).collect()}
    assert 'input[name="vessel"]' in got
    assert 'button[data-qa="send-log"]' in got
    assert "main#deck" in got


def test_similar_siblings_and_xpath(ps):
    li = node_id(ps, 7, F.col("tag") == "li")
    b = node_id(ps, 7, F.col("tag") == "i")
    tg = ps.nodes.sparkSession.createDataFrame([(7, b[0])], "page_id bigint, node_id int")
    assert xpaths(ps, tg).first().xpath == "//*[@id='logbook']/ol/li[2]/i"
    sib = similar_siblings(ps, ps.nodes.sparkSession.createDataFrame([(7, li[0])], "page_id bigint, node_id int"))
    assert sib.count() >= 1


def test_two_examples_in_different_sections(ps):
    from pagerel.operators.explorer import detect_lists_pairs

    names = node_id(ps, 3, F.array_contains("classes", "code"))
    spark = ps.nodes.sparkSession
    pairs = spark.createDataFrame([(3, names[0], names[5])], "page_id bigint, a_id int, b_id int")
    r = detect_lists_pairs(ps, pairs).collect()[0]
    from pagerel.operators.select import Matcher  # noqa: F401
    assert r.branch in ("merged", "lca_desc"), r
    assert r.row_selector in ("body > section.zone > div.slots > div.slot", "body div.slot"), r


def test_anchored_relative_selector(ps):
    fl = find_lists(ps).filter((F.col("page_id") == 1) & (F.col("list_rank") == 1))
    rows = list_rows(ps, fl)
    cols, _ = detect_columns(ps, rows)
    sels = {r.name: r.sel for r in cols.collect()}
    assert sels["Boat Name"] == ".boat-name > a", sels
