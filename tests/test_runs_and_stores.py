"""Similar kinds, chains with rings, runs, snapshots, stores, tokens and
exports on small inputs, against plain evaluation."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagerel.operators import explorer, pager, run, store
from pagerel.operators.tree import PageSet
from pagerel.operators.viewer import export_view, written_lines
from pagerel.sources.tokens import titles_and_links, tokens

KINDS = "page_id bigint, parent_id int, kind string, tag string, grp array<string>, sig array<string>, n bigint"
CELLS = "array<struct<name:string,value:string>>"


def similar(x, y):
    if x[0] != y[0] or ((x[1] or y[1]) and not set(x[1]) & set(y[1])):
        return False
    if not x[2] or not y[2]:
        return bool(x[1]) or (not x[2] and not y[2])
    return len(set(x[2]) & set(y[2])) / len(set(x[2]) | set(y[2])) >= 0.34


def test_similar_kinds_against_all_pairs(spark):
    rng = random.Random(3)
    rows, seen = {}, set()
    for page in range(4):
        for i in range(60):
            sig = tuple(sorted(rng.sample("abcdefgh", rng.choice([0, 1, 2, 3, 5, 8]))))
            kind = (rng.choice(["li", "tr"]), tuple(sorted(rng.sample("xyz", rng.choice([0, 0, 1, 2])))), sig)
            if (page, kind) not in seen:  # kinds are distinct
                rows[page, f"k{i}"] = kind
                seen.add((page, kind))
    frame = spark.createDataFrame([(p, 1, k, t, list(g), list(s), 1) for (p, k), (t, g, s) in rows.items()], KINDS)
    got = {(r.page_id, r.x, r.y) for r in explorer.similar_kinds(frame).collect()}
    assert got == {(p, a, b) for (p, a), x in rows.items() for (q, b), y in rows.items() if p == q and (a == b or similar(x, y))}


def test_very_many_like_siblings(spark):
    """What is made grows with the siblings, not with their pairs."""
    n = 20_000
    html = "<ul>" + "<li><a href='/x'>t</a></li>" * n + "<li>odd</li></ul>"
    ps = PageSet(spark.createDataFrame([(1, "https://a.example/", html)], "page_id bigint, url string, html string"))
    li = ps.nodes.filter("tag = 'li'").select("page_id", "node_id")
    start = time.time()
    members, kinds = explorer.sibling_kinds(ps, li)
    assert kinds.count() == 2 and members.count() == n + 1 and explorer.similar_kinds(kinds).count() == 2
    sizes = {(r["size"], r.n) for r in explorer.group_sizes(ps, li).groupBy("size").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(n, n), (1, 1)} and time.time() - start < 120


def chained(spark, links, n_rows=None):
    """page_chain over pages p whose link leads to links[p] (None: nowhere)."""
    ids = sorted(set(links) | {v for v in links.values() if v})
    html = "<p>x</p>"
    ps = PageSet(spark.createDataFrame([(p, f"https://a.example/{p}", html) for p in ids], "page_id bigint, url string, html string"))
    nl = spark.createDataFrame([(p, f"/{v}", False) for p, v in links.items() if v], "page_id bigint, href string, disabled boolean")
    sigs = spark.createDataFrame([(p, (n_rows or {}).get(p, 1), f"s{p}") for p in ids], "page_id bigint, n bigint, sig string")
    return lambda most=None: sorted((r.start_id, r.step, r.page_id, r.reason) for r in pager.page_chain(ps, nl, None, sigs, most).collect())


def test_rings_are_walked_once_from_their_smallest_page(spark):
    walk = chained(spark, {7: 5, 5: 9, 9: 7, 1: 2, 2: 3, 3: None, 20: 21, 21: 20, 30: 31, 31: 32, 32: 31})
    want = [(1, 1, 1, None), (1, 2, 2, None), (1, 3, 3, "not found"), (5, 1, 5, None), (5, 2, 9, None), (5, 3, 7, "seen"), (20, 1, 20, None), (20, 2, 21, "seen"),
            (30, 1, 30, None), (30, 2, 31, None), (30, 3, 32, "seen")]
    assert walk() == sorted(want)
    assert walk(2) == sorted([(1, 1, 1, None), (1, 2, 2, "limit"), (5, 1, 5, None), (5, 2, 9, "limit"), (20, 1, 20, None), (20, 2, 21, "limit"), (30, 1, 30, None), (30, 2, 31, "limit")])


def rows_of(spark, rows, names=("A", "B"), **more):
    frame = spark.createDataFrame([(s, p, i, [(n, v) for n, v in zip(names, vs)]) for s, p, i, vs in rows], f"source string, page_ord bigint, row_ord bigint, cells {CELLS}")
    return frame.withColumns({k: F.lit(v) for k, v in more.items()})


def test_which_rows_enter_and_the_report(spark):
    rows = [("a", 1, 1, ["x", "1"]), ("a", 1, 2, ["x", "1"]), ("a", 2, 1, ["x", "1"]), ("a", 2, 2, ["y", None]), ("a", 3, 1, ["z", "9"]), ("b", 1, 1, ["x", "1"])]
    frame = rows_of(spark, rows, n_key=2, dedupe=True, append=True)
    places = lambda df: sorted((r.source, r.page_ord, r.row_ord) for r in df.collect())
    assert places(run.enter(frame)) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("b", 1, 1)]
    stored = spark.createDataFrame([("a", [("A", "z"), ("B", "9"), ("C", "")]), ("b", [("A", "x")])], f"source string, cells {CELLS}")
    entered = run.enter(frame, stored)  # b's dataset has no column B: nothing counts as seen
    assert places(entered) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]
    assert places(run.enter(rows_of(spark, rows, n_key=2, dedupe=True, append=False), None)) == places(run.enter(frame))
    assert len(places(run.enter(rows_of(spark, rows, n_key=2, dedupe=False, append=True), stored))) == 6
    assert places(run.enter(rows_of(spark, rows, n_key=1, dedupe=True, append=True))) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("b", 1, 1)]
    pages = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, None), ("a", 4, "no rows"), ("b", 1, "disabled")], "source string, page_ord bigint, reason string")
    got = sorted((tuple(r) for r in run.report(frame, entered, pages).collect()), key=str)
    assert got == [("a", 1, 2, 1, 1, 1, None), ("a", 2, 2, 1, 2, 2, None), ("a", 3, 1, 0, 2, 3, None), ("a", 4, 0, 0, 2, 4, "no rows"), ("b", 1, 1, 1, 1, 1, "disabled")]


def test_running_totals_of_one_large_group(spark):
    frame = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.col("id").alias("o"), (F.col("id") % 3).alias("v"))
    got = {(r.g, r.o): r.t for r in run.running_totals(frame.repartition(6), "g", ["o"], "v", "t").collect()}
    total, seen = {}, {}
    for r in frame.orderBy("o").collect():
        total[r.g] = total.get(r.g, 0) + r.v
        seen[r.g, r.o] = total[r.g]
    assert got == seen


def test_snapshots_of_a_growing_page(spark):
    """Each row once, in the order of the page, as it was seen first."""
    snaps = [("s", 1, i, [str(i), "a"]) for i in range(1, 4)] + [("s", 2, i, [str(i), "a"]) for i in range(1, 7)] + [("s", 3, i - 2, [str(i), "b" if i == 4 else "a"]) for i in range(3, 9)]
    out = run.merge_snapshots(rows_of(spark, snaps), ["A"]).orderBy("row_no").collect()
    assert [(r.row_no, r.cells[0].value, r.page_ord) for r in out] == [(i, str(i), 1 if i <= 3 else 2 if i <= 6 else 3) for i in range(1, 9)]
    assert run.merge_snapshots(rows_of(spark, snaps)).count() == 9  # the row that changed is another one
    names = run.columns_of(rows_of(spark, snaps).unionByName(rows_of(spark, [("s", 4, 1, ["1", "2"])], ("A", "C")))).orderBy("col_ord").collect()
    assert [r.name for r in names] == ["A", "B", "C"]


def test_store_versions(spark, tmp_path):
    at = str(tmp_path / "ds")
    ds, meta = store.load(spark, at)
    assert ds.count() == 0 and not ds.columns and meta == {}
    first = spark.createDataFrame([("1", None), ("2", "b")], "a string, `b c` string")
    assert store.save(first, at, attrs={"a": "href"}, meta={"host": "x"}) == 1
    assert store.save(spark.createDataFrame([(3, "z")], "a int, d string"), at, attrs={"a": "src", "d": "html"}, meta={"pages": "1"}) == 2
    ds, meta = store.load(spark, at)
    assert sorted(map(tuple, ds.collect())) == [("1", "", ""), ("2", "b", ""), ("3", "", "z")] and meta == {"host": "x", "pages": "1"}
    assert [(f.name, f.metadata["attr"]) for f in ds.schema.fields] == [("a", "href"), ("b c", "text"), ("d", "html")]
    # a part without its manifest is no part of the dataset; one who has begun to read goes on
    first.write.parquet(f"{at}/parts/half")
    store.save(first.limit(1), at, "replace")
    assert ds.count() == 3 and store.load(spark, at)[0].count() == 1 and store.load(spark, at)[0].columns == ["a", "b c"]
    store.clear(spark, at)
    assert store.load(spark, at)[0].count() == 0 and store.manifest(spark, at).version == 4
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store._commit(spark, at, 4, [], [], {})
    with pytest.raises(ValueError):
        store.save(first, at, "overwrite")


def test_tokens_put_together_are_the_source(spark):
    pages = [(1, "<!DOCTYPE html><title>A &amp; b</title><!-- <a href=x> --><SCRIPT>if (a<b) '</p>'</SCRIPT ><A class=k HREF='/y z'>go</A>< p <b>x<a href=q></a>"), (2, ""), (3, None), (4, "no tags < at all")]
    out = tokens(spark.createDataFrame(pages, "page_id bigint, html string"))
    rows = out.orderBy("page_id", "ord").collect()
    for key, html in pages:
        mine = [r for r in rows if r.page_id == key]
        assert "".join(r.source for r in mine) == (html or "")
        assert all(html[r.start : r.start + len(r.source)] == r.source for r in mine)
    assert [r.kind for r in rows if r.page_id == 1][:6] == ["declaration", "open", "text", "close", "comment", "raw"]
    got = [(r.kind, r.href, r.text) for r in titles_and_links(out).orderBy("page_id", "ord").collect()]
    assert got == [("title", "", "A &amp; b"), ("link", "/y z", "go"), ("link", "q", "")]


@pytest.mark.parametrize("kind,end", [("csv", "\r\n"), ("tsv", "\n")])
def test_export_files_are_the_sorted_view(spark, tmp_path, kind, end):
    df = spark.range(500).select(F.concat(F.lit("row "), F.col("id")).alias("name"), F.lit("k").alias("other")).repartition(7)
    at = str(tmp_path / kind)
    export_view(df, at, ["name", "other"], q="ROW 1", order=["name"], kind=kind)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / kind).glob("part-*"))).decode()
    want = sorted((i for i in range(500) if str(i).startswith("1")))
    head = "﻿name,other" if kind == "csv" else "name\tother"
    sep = "," if kind == "csv" else "\t"
    assert whole == "".join(x + end for x in [head, *(f"row {i}{sep}k" for i in want)])
    lines = written_lines(spark, at, end).orderBy("line_no").collect()
    assert [r.line for r in lines][1:] == [f"row {i}{sep}k" for i in want] and [r.line_no for r in lines] == list(range(1, len(want) + 2))
