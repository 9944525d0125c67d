"""The quality classifier and the resampling against plain recomputation."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerel.llm import quality, resampling

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def walk(model, row):
    total = model.base
    for at in model.roots:
        while model.left[at] != at:
            at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
        total += model.value[at]
    return total


def test_flat_trees_against_walking_each(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    assert np.allclose(model.raw(x), [walk(model, row) for row in x])
    assert ((model.predict(x) >= 0.5) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize("depth", [1, 4])
def test_first_split_is_the_best_one(depth):
    """The root's split against all splits tried one by one."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, size=(300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=300) > 12).astype(float)
    model = quality.fit(x, y, trees=1, depth=depth, l2=1.0, least=2.0)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(f, t):
        low = x[:, f] <= t
        parts = [(g[s].sum() ** 2 / (h[s].sum() + 1), h[s].sum()) for s in (low, ~low)]
        return sum(a for a, _ in parts) if min(b for _, b in parts) >= 2 else 0

    best = max(((f, t) for f in range(3) for t in range(20)), key=lambda ft: gain(*ft))
    assert gain(model.feature[0], model.threshold[0]) == pytest.approx(gain(*best))


def test_held_out_accuracy_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) / len(out) > 0.95


def test_held_out_labels_are_never_read(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1) + ("!!" if i % 2 else "")) for i in range(400)], DOCS)
    held = lambda i: crc32(str(i).encode()) % 3 == 1
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, (i % 2) ^ (flip if held(i) else 0)) for i in range(400)], "doc_id long, quality int")
        scores.append({r.doc_id: r.score for r in quality.classify(docs, labels).collect()})
    assert scores[0] == scores[1] and len(scores[0]) == 400


def test_bound_holds_for_one_id_on_a_third_of_the_rows(spark):
    rows = [(7, f"text {i} of one id") for i in range(300)] + [(i, "a b " * i) for i in range(600)] + [(None, None), (2**53 + 1, "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(7, 1), (7, 0), *((i, i % 2) for i in range(600)), (None, 1), (9, 5)], "doc_id long, quality int")
    out = quality.classify(docs.withColumns({"score": F.lit(1), "lang": F.lit("x")}), labels, max_rows=50).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.lang == "x" for r in out)


def test_one_class_none_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.predicted for r in quality.classify(docs, ones).collect()} == {1}
    assert quality.classify(spark.createDataFrame([], DOCS), ones).count() == 0
    assert len(quality.statistics(None)) == len(quality.STATS) == len(quality.statistics("x " * 100_000))


def plain(rows, target, runs, buckets, percent, least, seed=2024):
    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(words), [crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    own, other = [grams(t) for _, t in rows], [grams(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in other for b in f)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for (key, _), (n, f) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([key, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    drawn = Counter(tuple(r[:2]) + tuple(r[3:]) + (i,) for i, r in enumerate(fit[: len(fit) * percent // 100], 1))
    rest = Counter(tuple(r[:2]) + tuple(r[3:]) + (None,) for r in fit[len(fit) * percent // 100 :] + [r for r in out if r[2] < least])
    return drawn + rest


@pytest.mark.parametrize("runs,size", [(1, 1 << 20), (3, 1 << 20), (3, 7)])
def test_draw_against_brute_force(spark, monkeypatch, runs, size):
    """Short segments cut texts between words, so runs go on over the cuts."""
    rng = random.Random(4)
    words = ["a", "B", "Zz9", "über", "x y", " ", "0", "-", "a\x00b", "q" * 30]
    body = lambda: rng.choice([" ", "  ", "\n", "\x00", "!"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 19, 20, 21, 60])))
    rows = [(i, body()) for i in range(200)] + [(None, body()), (None, None), (5, ""), (2**53 + 1, "a " * 30), (2**53 + 3, "a " * 30)]
    rows += [(77, "one hot text " * 9)] * 100
    target = [body() for _ in range(20)] + [None]
    monkeypatch.setattr(resampling.features, "__defaults__", (size,))
    out = resampling.resample(spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("x")), spark.createDataFrame([(t,) for t in target], "text string"),
                              runs=runs, buckets=97, percent=10, min_words=20)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()) == plain(rows, target, runs, 97, 10, 20)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], DOCS)
    assert resampling.resample(none, docs).count() == 0
    assert resampling.resample(docs, none, min_words=1, percent=100).first()["rank"] == 1
