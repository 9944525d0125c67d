"""Selector matching, unique and relative selectors, and text slices against
plain evaluation over the collected nodes."""

import random

import pytest
from pyspark.sql import functions as F

from pagerel.operators.lists import find_lists, target_candidates, unique_selectors
from pagerel.operators.select import Matcher, select_nodes, steps_lit, validate
from pagerel.operators.tree import PageSet, with_text
from pagerel.schema import css, step

PLAIN = "".join(f"<tr><td>r{i}</td><td><a href='/x{i}'>go {i}</a></td></tr>" for i in range(4))
PAGES = [
    (1, "https://a.example/", f"<html><body><div><table>{PLAIN}</table></div><div><table>{PLAIN}</table><p>one</p><p>two <b>x</b></p></div></body></html>"),
    (2, "https://a.example/2", "<html><body><div id='main'><ul><li>a</li><li>b</li></ul></div><div class='side'><ul><li>a</li></ul><section><ul><li class='pick'>q</li></ul></section></div>"
                               "<div class='side'><section><ul><li class='pick'>z</li><li class='pick'>y</li></ul></section></div></body></html>"),
    (3, "https://b.example/", "<html><body><div><div><div><span>1</span></div><div><span>2</span></div></div><div><div><span>3</span></div></div></div>"
                              "<p class='note'>" + "long text " * 1500 + "<em>end</em></p></body></html>"),
    (4, "https://b.example/e", ""),
]


@pytest.fixture(scope="module")
def plain(spark):
    return PageSet(spark.createDataFrame(PAGES, "page_id bigint, url string, html string"))


@pytest.fixture(scope="module")
def tree(plain):
    return {(r.page_id, r.node_id): r for r in plain.nodes.collect()}


def fits(n, s):
    return ((s["tag"] is None or n.tag == s["tag"]) and (not s["id"] or n.id == s["id"]) and set(s["classes"] or []) <= set(n.classes)
            and all(n.attrs.get(k) == v for k, v in (s["attrs"] or {}).items()) and (s["nth"] is None or n.nth == s["nth"])
            and (s["has_child"] is None or s["has_child"] in n.child_tags))


def found(tree, page, steps, scope=None):
    """Nodes that the steps match, one step after the other."""
    here = [None if scope is None else scope]
    for i, s in enumerate(steps):
        after = set()
        for (p, k), n in tree.items():
            if p != page or not fits(n, s):
                continue
            for c in here:
                above = list(n.anc[:-1])
                if c is None or (above and above[-1] == c if s["comb"] == "child" else c in above):
                    after.add(k)
        here = sorted(after)
    return here


def some_steps(rng, tree, page):
    nodes = [n for (p, _), n in tree.items() if p == page]
    n = rng.choice(nodes)
    chain = [tree[page, a] for a in n.anc]
    pick = sorted(rng.sample(range(len(chain)), min(len(chain), rng.randrange(1, 5))))
    out = []
    for j, i in enumerate(pick):
        e = chain[i]
        adjacent = j > 0 and pick[j - 1] == i - 1
        out.append(step(tag=rng.choice([e.tag, None]), comb="child" if adjacent and rng.random() < 0.7 else "desc", id=rng.choice([e.id or None, None]),
                        classes=rng.choice([e.classes, []]), nth=rng.choice([e.nth, None]), attrs=dict(rng.sample(sorted(e.attrs.items()), min(1, len(e.attrs))))))
    return out


def test_many_selectors_in_one_job(spark, plain, tree):
    rng = random.Random(1)
    asked = [(i, page, some_steps(rng, tree, page)) for i in range(40) for page in [rng.choice([1, 2, 3])]]
    frame = None
    for i, page, steps in asked:
        row = spark.range(1).select(F.lit(page).cast("bigint").alias("page_id"), F.lit(0).alias("scope_id"), F.lit(i).alias("sel"), steps_lit(steps).alias("steps"))
        frame = row if frame is None else frame.unionByName(row)
    frame = frame.cache()
    m = Matcher(plain).match(frame.drop("steps"), frame, ["page_id", "sel"], ["sel"], include_scope=True)
    got = {}
    for r in m.collect():
        got.setdefault(r.sel, []).append(r.node_id)
    for i, page, steps in asked:
        assert sorted(got.get(i, [])) == found(tree, page, steps), steps


def test_inside_scopes(spark, plain, tree):
    sels = [css(("child", step("td"))), css(("desc", step("a"))), css(("child", step("td", nth=2)), ("child", step("a"))), css(("desc", step("tr")), ("desc", step("td")))]
    rows = [k for (p, k), n in tree.items() if p == 1 and n.tag in ("tr", "table")]
    for steps in sels:
        frame = spark.createDataFrame([(1, k) for k in rows], "page_id bigint, scope_id int").withColumn("steps", steps_lit(steps))
        got = {(r.scope_id, r.node_id) for r in Matcher(plain).match(frame.drop("steps"), frame, ["page_id", "scope_id"]).collect()}
        assert got == {(k, n) for k in rows for n in found(tree, 1, steps, scope=k)}


def plain_unique(tree, cands, page, node):
    """The same search, one selector after the other."""
    n = tree[page, node]
    if n.tag in ("html", "body"):
        return n.tag
    own, hits = cands[page, node], lambda steps: found(tree, page, steps)
    counts = [len(hits([c.step.asDict()])) for c in own]
    for c, k in zip(own, counts):
        if k == 1:
            return c.css
    best = own[min(range(len(own)), key=lambda i: (counts[i], i))]
    for a in reversed(n.anc[1:-1]):
        near = a == n.parent_id
        for c in cands[page, a]:
            if c.strong and len(hits([c.step.asDict(), {**best.step.asDict(), "comb": "child" if near else "desc"}])) == 1:
                return f"{c.css}{' > ' if near else ' '}{best.css}"
    chain = [tree[page, a] for a in n.anc[1:]]
    anchor = max([i for i, e in enumerate(chain[:-1]) if e.id and sum(x.id == e.id for (p, _), x in tree.items() if p == page) == 1], default=0)
    chain = chain[anchor:]
    on, nth = [True] * len(chain), [e.nth_count > 1 for e in chain]

    def made():
        steps, text, last = [], "", None
        for i, e in enumerate(chain):
            if on[i]:
                near = last == i - 1 and last is not None
                cs = [] if i == 0 else e.sem[:2]
                steps.append(step(tag=e.tag, comb="child" if near else "desc", id=e.id or None if i == 0 else None, classes=cs, nth=e.nth if nth[i] else None))
                text += (" > " if near else " " if steps[1:] else "") + e.tag + (f"#{e.id}" if i == 0 and e.id else "") + "".join(f".{c}" for c in cs) + (f":nth-of-type({e.nth})" if nth[i] else "")
                last = i
        return steps, text

    for flags, most in ((on, len(chain) - 1), (nth, len(chain))):
        for i in range(most):
            if on[i] and flags[i]:
                flags[i] = False
                flags[i] = len(hits(made()[0])) != 1
    return made()[1]


def test_unique_selectors_of_every_node(plain, tree):
    """Each matches its node only, and is what the search one by one finds."""
    cands = {}
    for r in target_candidates(plain.nodes).orderBy("page_id", "node_id", "prio").collect():
        cands.setdefault((r.page_id, r.node_id), []).append(r)
    rows = unique_selectors(plain, plain.nodes).collect()
    assert {(r.page_id, r.node_id) for r in rows} == set(tree) and len(rows) == len(tree)
    assert {r.phase for r in rows} == {0, 1, 2, 3}
    for r in rows:
        assert r.steps and found(tree, r.page_id, [s.asDict() for s in r.steps]) == [r.node_id], r
        assert r.selector == plain_unique(tree, cands, r.page_id, r.node_id), r


def test_lists_in_containers_without_classes_have_steps(plain):
    lists = find_lists(plain).collect()
    assert lists and all(r.container_steps and r.row_selector for r in lists)


def test_texts_over_several_blocks(plain, tree):
    rows = with_text(plain, plain.nodes.filter("page_id = 3")).collect()
    got = {r.node_id: r.raw_text for r in rows}
    long = "long text " * 1500 + "end"
    p = next(n for (page, _), n in tree.items() if page == 3 and n.tag == "p")
    assert got[p.node_id] == long and got[0] == "123" + long and got[p.node_id + 1] == "end"
    assert plain.texts.filter("page_id = 3").count() == -(-len(got[0]) // 4096)


def test_validate_with_and_without_rows(spark, plain):
    sels = spark.createDataFrame([(1, "td"), (1, "p"), (2, "p")], "page_id bigint, sel string")
    sels = sels.withColumn("steps", F.when(F.col("sel") == "td", steps_lit(css(("child", step("td"))))).otherwise(steps_lit(css(("desc", step("p"))))))
    assert {(r.page_id, r.sel): r.status for r in validate(plain, sels).collect()} == {(1, "td"): "16 matches", (1, "p"): "2 matches", (2, "p"): "0"}
    rows = select_nodes(plain, css(("desc", step("tr")))).filter("page_id = 1").withColumnRenamed("node_id", "row_id")
    got = {(r.page_id, r.sel): (r.matches, r.rows_with, r.n_rows) for r in validate(plain, sels.filter("page_id = 1"), rows).collect()}
    assert got == {(1, "td"): (16, 8, 8), (1, "p"): (0, 0, 8)}


def test_too_many_steps_is_an_error(spark, plain):
    with pytest.raises(Exception, match="more than 62 steps"):
        select_nodes(plain, css(*[("desc", step("div"))] * 63)).collect()
