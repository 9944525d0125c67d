from pyspark.sql import functions as F

from pagerel.sources.shred import shred_one


def test_script_text_creates_no_nodes_and_p_closes():
    b = shred_one(9, '<!DOCTYPE html><html><head><script>var s="</div>";</script></head><body><p>Alpha<p>Beta<b>gamma<p>Delta</body></html>')
    tags = [n.tag for n in b.nodes]
    assert tags == ["html", "head", "script", "body", "p", "p", "b", "p"]
    ps = [n for n in b.nodes if n.tag == "p"]
    assert all(n.parent.tag == "body" for n in ps)  # implied end tags
    assert "".join(b.text) == "AlphaBetagammaDelta"   # script text is not page text


def test_missing_html_body_and_tbody_are_added():
    b = shred_one(1, "<table><tr><td>a</td></tr></table>")
    assert [n.tag for n in b.nodes] == ["html", "head", "body", "table", "tbody", "tr", "td"]


def test_li_implied_close_and_void_elements():
    b = shred_one(1, "<ul><li>a<li>b<br>c</ul><img src=x><p>t")
    lis = [n for n in b.nodes if n.tag == "li"]
    assert len(lis) == 2 and all(n.parent.tag == "ul" for n in lis)
    img = [n for n in b.nodes if n.tag == "img"][0]
    assert img.parent.tag == "body"


def test_preorder_ids_and_subtree_ranges(ps):
    n = ps.nodes.filter(F.col("page_id") == 1).select("node_id", "end_id", "parent_id", "depth").collect()
    by = {r.node_id: r for r in n}
    for r in n:
        if r.parent_id is not None:
            p = by[r.parent_id]
            assert p.node_id < r.node_id <= p.end_id
            assert r.depth == p.depth + 1


def test_flags(ps):
    rows = {r.id: r for r in ps.nodes.filter(F.col("page_id") == 8).collect() if r.id}
    assert rows["gone"].hidden
    assert not rows["way"].hidden
    assert not rows["nb"].text_container
