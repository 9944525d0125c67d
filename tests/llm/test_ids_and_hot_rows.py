"""Ids above 2^53 beside none, ids or rows that a third of the table shares,
and sizes far from the usual ones."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagerel.llm import chunks, mixing, neighbours, packing, sharding, simhash, suffixes, toxicity

DOCS = "doc_id long, text string"
BIG = [2**53 + 1, 2**53 + 3, 2**53 + 5, 2**63 - 1, -(2**62) - 1]


def test_ids_come_back_whole(spark):
    passage = "a passage of well over fifty bytes that every document of the table has in it"
    rows = [(i, f"{passage} {k}") for k, i in enumerate(BIG)] + [(None, passage), (None, None)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    ids = Counter(i for i, _ in rows)
    assert Counter(r.doc_id for r in packing.pack(docs).collect()) == ids
    out = suffixes.remove_repeats(docs).collect()
    assert Counter(r.doc_id for r in out) == ids
    oldest = min(BIG)
    assert {r.doc_id for r in out if r.n_removed == 0} == {oldest, None} and all(r.n_removed >= 77 for r in out if r.doc_id not in (oldest, None))
    assert Counter(r.doc_id for r in chunks.compare_with_next(docs, ranges=2).collect()) == ids


def test_token_ids_are_those_of_the_json_file(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|endoftext|> z", " <|endoftext|>", "<|endoftext", "|>", "a b", "\n\n", "é日本", "  x", "1234", "it's", "\x00", "�"]
    texts = ["", "<|endoftext|>", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(200))]
    encode = packing.encoder("byte_bpe_50k")
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    plain, as_text = packing.encoder("byte_bpe_50k", marks_as_text=True), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    as_text.encode_special_tokens = True
    assert all(np.frombuffer(plain(t), "<u4").tolist() == as_text.encode(t, add_special_tokens=False).ids for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    want = {i: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(docs).collect()} == want


def next_slow(rows):
    """(id, next text) in the order of ids, none first, rows alike together."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    return Counter((k, chunks.edited(t, rows[(i + 1) % len(rows)][1])) for i, (k, t, _) in enumerate(rows))


@pytest.mark.parametrize("hot", ["id", "none", "row"])
def test_next_documents_where_a_third_is_alike(spark, hot):
    rng = random.Random(6)
    bodies = [" ".join(str(rng.random()) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    key = {"id": 77, "none": None, "row": 77}[hot]
    rows = [(rng.randrange(1000), b) for b in bodies[:200]] + [(key, bodies[7] if hot == "row" else b) for b in bodies[200:]]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    hashed = [(r.doc_id, r.text, r.h) for r in docs.select("*", F.xxhash64("text").alias("h")).collect()]
    out = chunks.compare_with_next(docs, ranges=12).collect()
    import hashlib

    want = Counter()
    for (k, other), n in next_slow(hashed).items():
        want[k, hashlib.sha256(other.encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == want
    if hot != "row":
        own = docs.select(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
        loads = [r["count"] for r in chunks.in_order(own, 12).groupBy("_range").count().collect()]
        assert max(loads) < 100


def test_labelled_id_on_a_third_of_the_rows(spark, monkeypatch):
    rows = [(7, f"nice day number {i}") for i in range(400)] + [(i, f"you vile {'scum' if i % 2 else 'friend'} {i}") for i in range(800)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")
    seen, kept = [], toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, what: (seen.append(out.count()) if what == "labelled" else None, out)[1] if [out := kept(df, what)] else None)
    model = toxicity.train(spark.createDataFrame(rows, DOCS), labels, max_rows=100)
    assert seen == [seen[0]] and 20 < seen[0] <= 100 and model.thresholds
    few = toxicity.train(spark.createDataFrame(rows, DOCS), labels, max_rows=900, max_bytes=2000)
    assert seen[1] <= 120 and isinstance(few, toxicity.OrdinalModel)


@pytest.mark.parametrize("kinds", [1, 3])
def test_few_distinct_vectors(spark, kinds):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(kinds, 8)).astype(float)
    rows = [(i, base[i % kinds].tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"), k=5, sample=10).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    for q in (0, 100, 200, 300):
        want = sorted((float(np.sqrt(((base[i % kinds] - base[q % kinds]) ** 2).sum())), i) for i in range(400) if i != q)[:5]
        assert got[q] == [i for _, i in want]


@pytest.mark.parametrize("shards,n", [(1000, 2500), (1000, 10), (3, 900)])
def test_many_shards_and_hot_ids(spark, shards, n):
    docs = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign(docs.withColumns({"slot": F.lit("x"), "rank": F.lit(1)}), shards=shards).collect()
    count = Counter(r._shard for r in rows)
    assert len(rows) == n and sum(count.values()) == n and None not in count
    assert max(count.values()) - (min(count.values()) if len(count) == shards else 0) <= 1 and {r.slot for r in rows} == {"x"}
    for shard in count:
        assert sorted(r._slot for r in rows if r._shard == shard) == list(range(count[shard]))


@pytest.mark.parametrize("kind", ["none", "one id", "one row"])
def test_mix_of_a_source_with_a_third_alike(spark, kind):
    rng = random.Random(3)
    key = {"none": None, "one id": 5, "one row": 5}[kind]
    rows = [(i, "w " * rng.randrange(1, 9), "a") for i in range(600)]
    rows += [(key, "same words here" if kind == "one row" else f"word {i} of it", "a") for i in range(300)]
    rows += [(1000 + i, "x y", "b") for i in range(900)]
    docs = spark.createDataFrame(rows, f"{DOCS}, source string")
    out = mixing.mix(docs, weights=(3, 4), share=1.5, max_rate=4.0).collect()
    assert len(out) == len(rows)
    for source in "ab":
        mine = [r for r in out if r.source == source]
        taken = sum(r._size * r._copies for r in mine)
        assert abs(taken - mine[0]._target) < 0.1 * mine[0]._target
    again = mixing.mix(docs.repartition(7), weights=(3, 4), share=1.5, max_rate=4.0).collect()
    assert Counter((r.doc_id, r._size, r._copies) for r in out) == Counter((r.doc_id, r._size, r._copies) for r in again)


def test_simhash_rows_of_a_hot_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    rows = [(i, "the same few words" if i % 3 else f"own text {i} {i * 7}") for i in range(90)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 90 and {r.component_id for r in out if r.doc_id % 3} == {1}
    assert all(r.component_id <= r.doc_id for r in out)
    assert json.dumps(sorted(r.doc_id for r in out)) == json.dumps(list(range(90)))
