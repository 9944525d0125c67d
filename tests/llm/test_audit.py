"""Filter interactions and the tries below them against brute force."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pagerel.llm import audit

DOCS = "doc_id long, text string, lang string"


def masks(rows):
    """(id, part, mask) counts, by comparing all pairs."""
    out = Counter()
    for key, text, part in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        m = (len(words) < 100) * 1 + (100 * len(set(words)) < 80 * len(words)) * 2 + (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) * 4
        m += any(c in "#$%&*|" for c in text) * 8
        m += any(k is not None and key is not None and k < key and (t or "") == text for k, t, _ in rows) * 16
        out[key, part or "", m] += 1
    return out


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    return Counter({(r.id, r.part, r["mask"]): r.n for r in audit.flagged(docs, **options).collect()})


def mixed(n=300, seed=3):
    rng = random.Random(seed)
    words = [rng.choice(["ab", "Ba", "É x", "cd|", "XY", "q"]) + str(i) for i in range(150)]
    bodies = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 99, 100, 101, 400]))) for _ in range(n // 3)]
    bodies += ["x" * 5000 + str(i) for i in range(5)] + ["x" * 5000, "", None, " ", "\t\n"]
    rows = [(rng.randrange(n), rng.choice(bodies), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    rows += [(2**53 + i, "far", "en") for i in (1, 3, 5)] + [(None, "far", "en"), (None, None, None)]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("cell_bytes", [1 << 25, 3000, 200])
def test_masks_against_all_pairs(spark, cell_bytes):
    """Small cells make prefixes grow and whole texts spread over several tries."""
    rows = mixed()
    assert found(spark, rows, cell_bytes=cell_bytes, trie_bytes=cell_bytes) == masks(rows)


def test_one_text_on_a_third_of_all_rows(spark):
    rows = [(i, "same text everywhere", "en") for i in range(400)] + [(i, f"text {i}", "en") for i in range(400, 1200)]
    assert found(spark, rows, cell_bytes=150, trie_bytes=100) == masks(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert audit.flagged(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.with_labels(audit.flagged(empty), labels)).count() == 0
    docs = spark.createDataFrame([(1, "a", "en")], DOCS).withColumns({c: F.lit("x") for c in ("id", "part", "mask", "cell", "n")})
    assert [tuple(r) for r in audit.flagged(docs).collect()] == [(1, "en", 1, 1)]


def test_orders_against_applying_them(spark):
    rng = random.Random(5)
    flags = [(i, rng.choice(["en", ""]), rng.randrange(32), 1) for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(0, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(flags, "id long, part string, mask int, n long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(audit.with_labels(frame, marks)).collect()}
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    want, share = {}, Counter()
    for part in ("en", ""):
        mine = [(k, m) for k, p, m, _ in flags if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(k, m) for k, m in left if m & bit]
                before = [x for x in mine if x not in left]
                left = [x for x in left if x not in gone]
                share[part, letter] += len(gone)
                want[part, order, step] = [len(left), len(gone), sum(m & bit > 0 for _, m in before), sum(m == bit for _, m in mine),
                                           sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
    assert got == {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_trie_holds_the_smallest_id():
    rng, trie, decided, least = random.Random(1), audit.Trie(), [], {}
    for _ in range(3000):
        text, key = bytes(rng.choices(b"ab", k=rng.randrange(9))), rng.randrange(1000)
        least[text] = min(key, least.get(text, key))
        trie.insert(key, "p", 1, text, None, decided)
    rows = list(trie.traverse(True))
    assert {t: k for k, _, _, _, t in rows} == least
    assert sum(n for *_, n, _ in rows) + sum(n for *_, n, _ in decided) == 3000
