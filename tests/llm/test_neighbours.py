"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from pagerel.llm import neighbours


def exact(rows, queries, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = sorted(good)
    ids, data = np.array([i for i, _ in good]), np.array([np.float32(v).astype(float) for _, v in good])
    out = {}
    for q in sorted({i for i in ids.tolist() if i in queries}):
        d = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def run(spark, rows, k=10, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def random_rows(n, seed=0, clusters=0):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, 16))
    if clusters:
        data = 0.2 * data + 3 * rng.standard_normal((clusters, 16))[rng.integers(0, clusters, n)]
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_and_scores(spark, clusters):
    rows = random_rows(3000, clusters, clusters)
    got, want = run(spark, rows, block_rows=300, sample=900), exact(rows, range(0, 3000, 100), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.95 * 10 * len(want)
    score = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(score.get((q, i), s) - s) < 1e-12 for q in got for i, s in got[q])


def test_equal_vectors_ties_and_bad_rows(spark):
    rows = random_rows(500, 3)
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000 + i, rows[100][1]) for i in range(40)]
    rows += [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [1.0, None] + [1.0] * 14), (3400, [float("inf")] * 16),
             (3500, [1.0] * 3), (3600, []), (None, rows[9][1]), (5, rows[5][1])]
    got, want = run(spark, rows, block_rows=100, sample=400), exact(rows, range(0, 4000, 100), 10)
    for q in (1000, 1100, 1200, 2000, 100):  # ten equal vectors each, ties to the smaller id
        assert got[q] == want[q]
    assert got.keys() == want.keys()


def test_few_candidates_and_none(spark):
    rows = random_rows(4)
    assert run(spark, rows) == {0: [(i, pytest.approx(s)) for i, s in exact(rows, [0], 10)[0]]}
    assert run(spark, rows[:1]) == {} and run(spark, []) == {} and run(spark, [(0, None)]) == {}


def test_tree_places_its_points():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.standard_normal((500, 4)), np.zeros((200, 4))])
    tree = neighbours.Tree(points, 32)
    place = tree.place(points)
    assert all((place[leaf] == i).all() for i, leaf in enumerate(tree.leaves)) and sum(map(len, tree.leaves)) == 700


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-4)
