"""The ring and the mix against brute force."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagerel.llm import mixing, sharding

DOCS = "doc_id long, text string"


def test_ring_shares_against_a_walk(spark):
    """Keys in ring order, each going clockwise to the first shard with room."""
    shards, slots = 5, 64
    rng = random.Random(1)
    owners = [r.shard for r in sharding.ring(spark, shards, slots, 4).orderBy("slot").collect()]
    assert len(owners) == slots and set(owners) == set(range(shards))
    loads = [rng.choice([0, 0, 3, 9]) for _ in owners]
    total = sum(loads)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    want, waiting = [], 0
    for step in range(2 * slots):
        waiting += loads[step] if step < slots else 0
        take = min(room[owners[step % slots]], waiting)
        room[owners[step % slots]] -= take
        waiting -= take
        if take:
            want.append((step, owners[step % slots], take))
    assert waiting == 0 and sum(room) == 0
    frame = spark.createDataFrame([(i, o, n) for i, (o, n) in enumerate(zip(owners, loads))], "slot long, shard int, n long")
    assert [tuple(r) for r in sharding.shares(frame, shards, slots).orderBy("step").collect()] == want


@pytest.mark.parametrize("n", [0, 1, 39, 40, 777])
def test_shards_are_even_and_slots_gapless(spark, n):
    docs = spark.createDataFrame([(i, "é" * (i % 7)) for i in range(n)], DOCS)
    rows = sharding.assign(docs, shards=40, slots=256, nodes=8).collect()
    count = Counter(r._shard for r in rows)
    assert len(rows) == n and (n == 0 or max(count.values()) - min([0] * (n < 40) + list(count.values())) <= 1)
    for shard in count:
        assert sorted(r._slot for r in rows if r._shard == shard) == list(range(count[shard]))


def test_shards_of_hot_null_and_clashing_rows(spark):
    rows = [(7, "same", "a", 1)] * 60 + [(None, None, "b", 2)] * 5 + [(i, "x" * i, "c", 3) for i in range(35)]
    docs = spark.createDataFrame(rows, f"{DOCS}, before string, _slot int")
    got = sharding.assign(docs, shards=4, slots=128, nodes=8).collect()
    assert Counter(r._shard for r in got) == {s: 25 for s in range(4)}
    assert {r._size for r in got if r.doc_id is None} == {16} and {r._crc for r in got if r.doc_id is None} == {0}
    assert {r._crc for r in got if r.before == "a"} == {zlib.crc32(b"same")} and {r.before for r in got} == {"a", "b", "c"}


def test_most_keys_stay_on_their_slot(spark):
    """Limited movement: with many virtual nodes little overflows."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    own = sharding.ring(spark, 40).withColumnRenamed("shard", "own")
    placed = sharding.assign(docs, shards=40).withColumn("slot", F.pmod(F.xxhash64(F.lit(sharding.SALT), "doc_id"), F.lit(sharding.SLOTS)))
    stayed = placed.join(own, "slot").filter("own = _shard").count()
    assert stayed > 0.8 * 20_000


def fill_slow(sizes, share=1.5, most=2.0):
    """Reshare the excess, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        for s in full or free:
            target[s] = most * sizes[s] if full else level * weight[s]
            left -= target[s] if full else 0
        free = free - full if full else set()
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing(spark, seed):
    rng = random.Random(seed)
    names = ["src1", "src10", "src2", "é", "\U0001f600", "￮", "", "Z", None][: 9 - seed]
    sizes = {s: rng.choice([0, 5, 100, 3000, 50_000]) for s in names}
    frame = spark.createDataFrame([(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()], "source string, _size long")
    got = {r._source: r.target for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(fill_slow(sizes))


def test_mix_of_words_copies_and_reruns(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("x" * rng.randrange(1, 4) for _ in range(rng.randrange(60))), rng.choice(["a", "b", "c", "d", None]), i) for i in range(3000)]
    rows += [(5000, None, "a", 1), (5001, " \t\n\x0b", "b", 2), (5002, "\xa0 one\x0ctwo\r\nthree ", "c", 3), (None, "null id", "d", 4)]
    docs = spark.createDataFrame(rows, f"{DOCS}, source string, _size int")
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(mixed) == len(rows) and mixed[5000]._size == 0 and mixed[5001]._size == 0 and mixed[5002]._size == 4
    taken, target = Counter(), {}
    for r in mixed.values():
        taken[r.source] += r._size * r._copies
        target[r.source] = r._target
        assert 0 <= r._copies <= 2
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: r._copies for k, r in mixed.items() if r._copies})
    assert sorted(map(str, mixing.emit(docs.repartition(7)).collect())) == sorted(map(str, out.collect()))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], f"{DOCS}, source string")
    assert {r._copies for r in mixing.mix(docs).collect()} == {0}
    assert mixing.emit(docs.limit(0)).count() == 0
