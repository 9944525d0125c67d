"""Held-out accuracy of the severity model, and its cases."""

import random

import numpy as np
import pytest

from pagerel.llm import toxicity

MILD, STEMS = ["dolt", "nitwit", "twerp", "lout"], ["schurk", "misere", "brutal"]
ENDS = ["", "e", "en", "ung", "lich", "o", "as", "ment"]


def text(rng, bad):
    words = ["".join(rng.choices("bcdfgaeio", k=rng.randrange(2, 9))) for _ in range(rng.randrange(5, 200))]
    for _ in range(bad):
        words.insert(rng.randrange(len(words)), rng.choice([rng.choice(MILD), rng.choice(STEMS) + rng.choice(ENDS)]).capitalize() + rng.choice(["", ",", "!"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, text(rng, bad), int(bad > 0)) for i in range(900) for bad in [rng.choice([0] * 8 + [1, 3, 12])]]


@pytest.fixture(scope="module")
def model(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = [(i, t) for i, _, t in rows if i < 500] + [(3, None), (99999, 1), (4, 7)]
    return toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int").dropDuplicates(["doc_id"]))


def test_held_out(rows, model):
    held = [(model.above(t)[0] >= 0.5, bool(k)) for i, t, k in rows if i >= 500]
    caught = sum(a for a, b in held if b) / sum(b for _, b in held)
    wrong = sum(a for a, b in held if not b) / sum(not b for _, b in held)
    assert caught >= 0.95 and wrong <= 0.02


def test_severity_is_ordered(model):
    assert len(model.thresholds) == toxicity.GRADES and sorted(model.thresholds) == model.thresholds
    levels = [sum(model.above(t)) for t in ("just words", "just an twerp", "twerp dolt nitwit lout schurken misere brutalo")]
    assert levels == sorted(levels) and levels[0] < 0.5 and levels[2] > 2
    assert all(p >= q for p, q in zip(model.above("twerp dolt"), model.above("twerp dolt")[1:]))


def test_one_word_in_a_very_long_text_counts(model):
    assert model.above("fine " * 200_000 + "nitwit")[0] >= 0.5 > model.above("fine " * 200_000)[0]


def test_scores_of_odd_rows_and_clashing_columns(spark, model):
    rows = [(1, None, "a", 1.0), (2, "", "b", 2.0), (3, "TWERP, dolt!", "c", 3.0), (3, "TWERP, dolt!", "c", 3.0), (None, "\x00 12", "d", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _grades string, severity double")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and {r.doc_id for r in got if r.p_toxic >= 0.5} == {3}
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (7, None)]])
def test_nothing_to_learn(spark, marks):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {tuple(r) for r in toxicity.score(docs, model).select("severity", "p_toxic").collect()} == {(0.0, 0.0)}


def test_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    x = (rng.random((2000, 4)) < 0.3).astype(np.float32)
    z = x @ np.array([3.0, 2.0, 1.0, 0.0]) + rng.logistic(size=2000)
    w, t = toxicity.fit_ordinal(x, np.searchsorted([1.0, 3.0, 5.0], z), 3, steps=800)
    assert np.allclose(w, [3, 2, 1, 0], atol=0.4) and np.allclose(t, [1, 3, 5], atol=0.5)


def test_thousands_of_rare_insults(spark):
    """Each insult is in three fitted documents; held-out ones have one alone."""
    rng = random.Random(1)
    word = lambda lo, hi: "".join(rng.choices("bcdfghklmnprstaeiou", k=rng.randrange(lo, hi)))
    common, insults = [word(2, 9) for _ in range(3000)], sorted({word(7, 11) for _ in range(2000)})
    made = lambda *insult: " ".join([*rng.choices(common, k=rng.randrange(10, 60)), *insult, word(5, 9), word(5, 9)])
    rows = [(made(i), 1) for i in insults for _ in range(3)] + [(made(), 0) for _ in range(6000)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    missed = sum(model.above(made(i))[0] < 0.5 for i in insults) / len(insults)
    wrong = sum(model.above(made())[0] >= 0.5 for _ in range(2000)) / 2000
    assert missed <= 0.05 and wrong <= 0.05


@pytest.mark.parametrize("texts", [("", "fine words"), ("twerp", ""), ("", None)])
def test_one_side_without_words(spark, texts):
    docs = spark.createDataFrame([(k, texts[k % 2]) for k in range(8)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, 1 - k % 2) for k in range(8)], "doc_id long, toxic int"))
    assert all(0 <= r.p_toxic <= 1 for r in toxicity.score(docs, model).collect())
