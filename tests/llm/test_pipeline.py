"""The pipeline, stage by stage, against brute force; the registered queries."""

import random
from collections import Counter

import corpus_pipeline as P
import pytest
from pagerel.llm import mixing, toxicity
from pagerel.llm.queries import ORACLES, QUERIES
from test_near_duplicates import groups_slow, lines_slow, simhash_slow

import __spark_entry__ as E

BAD = ["dolt", "nitwit", "twerp", "lout"]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _th int, slot long"


def make(rng):
    word = lambda: "".join(rng.choices("bcdfgaeio", k=rng.randrange(2, 9)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    rows, marks, passage = [], [], text(5)
    for i in range(240):
        body = text(rng.randrange(1, 20))
        if i % 6 == 0:
            body += " " + rng.choice(BAD)
            marks.append((i, 1))
        elif i % 6 < 4:
            marks.append((i, 0))
        if i % 10 == 1:
            body += "\n" + passage
        rows.append([i, body])
    rows += [[300 + j, rows[j][1]] for j in (2, 3, 4, 3)] + [[300, rows[2][1]]]  # copies, and a repeated row
    rows += [[400 + j, rows[j][1].replace("b", "B")] for j in range(7, 40, 7)]
    rows += [[500, None], [501, ""], [None, "no id here"], [502, "one\ntwo\nthree\nfour\n" * 3]]
    return [(i, t, "en", f"src{(i or 0) % 5}" if i != 7 else None, len(t or ""), "r", 1, 2) for i, t in rows], marks


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, marks = make(random.Random(6))
    spark.createDataFrame(rows, EXTRA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def plain(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    start = docs.collect()
    frames = [docs]
    for name, stage in P.STAGES:
        out = stage(spark, frames[-1], sf_dir)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
        assert name == P.STAGES[-1][0] or out.columns == columns
    clean, lined, apart, mixed, packed = (f.collect() for f in frames[1:])

    toxic = {r.doc_id for r in start if any(b in (r.text or "") for b in BAD)}
    assert len(toxic) == 40
    assert plain(clean) == plain(r for r in start if r.doc_id not in toxic and (model.above(r.text) or [0])[0] < toxicity.REJECT)
    assert len(clean) >= len(start) - len(toxic) - 2

    want = lines_slow({(r.doc_id, r.text) for r in clean})
    assert plain(lined) == Counter((r.doc_id, want[r.doc_id][1]) for r in clean)
    assert all(r.n_chars == len(r.text) for r in lined if r.text is not None)

    prints = [simhash_slow(r.text) for r in lined]
    label = groups_slow(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    firsts = {min((r.doc_id is None, r.doc_id or 0) for r, x in zip(lined, label) if x == g) for g in set(label)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in apart) == sorted(firsts) and len(apart) < len(lined)

    copies = {r.doc_id: r._copies for r in mixing.mix(frames[3]).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({k: n for k, n in copies.items() if n})

    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)


def test_run_is_the_stages(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert len(rows) == P.run(spark, sf_dir).count() > 100
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 2


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = [n for n in E.queries() if n.startswith("op") and "_" in n]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries() and set(ORACLES) <= set(QUERIES)
