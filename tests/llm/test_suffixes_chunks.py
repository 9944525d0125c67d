"""Substring de-duplication and chunk fingerprints against brute force."""

import hashlib
import random

from pagerel.llm import chunks, suffixes


def repeats_slow(rows, n):
    first = {}
    for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - n + 1):
            first.setdefault(data[i : i + n], key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        if key is not None:
            for i in range(len(data) - n + 1):
                if first[data[i : i + n]] < key:
                    gone[i : i + n] = [True] * n
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((key, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def texts(rng):
    passage = "".join(rng.choices("abcdeé ", k=130))
    rows = []
    for i in range(60):
        own = "".join(rng.choices("abcdefgh é日", k=rng.choice([0, 10, 49, 60, 300])))
        at, x, y = rng.randrange(len(own) + 1), rng.randrange(60), rng.randrange(60, 131)
        rows.append((rng.randrange(1000), own[:at] + (passage[x:y] if i % 2 else "") + own[at:]))
    rows += [(rng.randrange(1000), rows[j][1]) for j in range(0, 20, 3)]
    rows += [(2000 + i, rows[5][1][: 40 + i] + "!" + rows[5][1][40 + i :]) for i in range(12)]
    return [*rows, (3000, "z" * 700), (3001, "z" * 300 + "y" + "z" * 55), (3002, "zy" * 60), (3003, "yz" * 60), (3004, None), (3005, ""),
            (None, passage), (None, passage), (3006, passage), (3007, passage), (3007, passage), (-5, passage[3:90])]


def test_substrings_against_brute_force(spark, tmp_path):
    rows = texts(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixes.remove_repeats(docs.withColumnRenamed("doc_id", "key"), id_col="key", shard_bytes=2500)
    got = sorted(((r.key, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str)
    assert got == sorted(repeats_slow(rows, 50), key=str)


def test_rows_of_one_id_and_of_none_spread_over_the_shards(spark):
    rng = random.Random(13)
    passage = "".join(rng.choices("abcdeé ", k=200))
    rows = [(key, passage[i % 90 : i % 90 + 70] + "".join(rng.choices("abcdefgh", k=60))) for i, key in enumerate([None, 7, None] * 60)]
    rows += [(i, passage[i % 50 :]) for i in range(60)] + [(7, passage)] * 30 + [(None, None)] * 30
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    loads = [r["count"] for r in suffixes.dealt(docs, 10).groupBy("shard").count().collect()]
    assert len(loads) == 10 and max(loads) < 2 * len(rows) / 10
    got = suffixes.remove_repeats(docs, id_col="id", shard_bytes=4000)
    got = sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str)
    assert got == sorted(repeats_slow(rows, 50), key=str)


def test_one_shard_other_lengths_segments_and_no_rows(spark, monkeypatch):
    rows = texts(random.Random(12))
    shard = suffixes.Shard([r[0] for r in rows], [r[1] for r in rows])
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    small = suffixes.Shard([r[0] for r in rows], [r[1] for r in rows])
    assert (shard.valid == small.valid).all()
    assert (shard.end - shard.start).sum() == (small.end - small.start).sum() == shard.valid.sum()
    assert set(shard.name.tolist()) == set(small.name.tolist())
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choices("ab cdefé日", k=rng.choice([0, 3, 31, 200, 3000])))) for i in range(40)]
    rows += [(1, None), (2, "x" * 200_000), (None, "none"), (4, rows[3][1]), (5, rows[3][1]), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in chunks.compare_with_next(docs, ranges=5).collect()]
    rank = {None: -1}
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: rank.get(r[0], r[0]))
    want = []
    for (key, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
        n = len(text) // 4
        other = text[: len(text) - n] + after[:n]
        a, b, c = map(chunks.chunk_set, (text, other, after))
        assert sum(e - s for s, e in zip([0, *chunks.boundaries(text.encode())], chunks.boundaries(text.encode()))) == len(text.encode())
        want.append((key, len(text), hashlib.sha256(other.encode()).hexdigest(), chunks.shown(a), chunks.shown(b), chunks.containment(a, b), chunks.containment(a, c)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chunks.compare_with_next(docs.limit(0)).count() == 0
    alone = chunks.compare_with_next(docs.filter("doc_id = 2")).first()
    assert alone.near_next == 1.0


def test_chunks_resist_a_shift():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghij ", k=20_000))
    moved = chunks.chunk_set(text[:5000] + "inserted words " + text[5000:])
    assert chunks.containment(chunks.chunk_set(text), moved) > 0.95
    assert chunks.containment(chunks.chunk_set(text), chunks.chunk_set(text[::-1])) == 0.0
    assert chunks.containment({}, {}) == 1.0 and chunks.containment({}, {1: 2}) == 0.0
    sizes = [n for n in chunks.chunk_set(text).values()]
    assert 60 < sum(sizes) / len(sizes) < 250


def test_gear_in_segments(monkeypatch):
    data = "".join(random.Random(6).choices("abcdef ", k=5000)).encode()
    whole = chunks.boundaries(data)
    monkeypatch.setattr(chunks, "SEGMENT", 100)
    assert chunks.boundaries(data) == whole and whole[-1] == len(data)
