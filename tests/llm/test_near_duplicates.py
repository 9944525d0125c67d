"""SimHash near-duplicates and line de-duplication against brute force."""

import random

import xxhash

from pagerel.llm import lines, simhash
from pagerel.llm.common import components

WORDS = [f"w{i}" for i in range(400)]


def simhash_slow(text, k=3):
    flat = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", flat) if w]
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_slow(values, linked):
    label = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if linked(a, b):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(25):
        words = rng.choices(WORDS, k=rng.choice([2, 30, 300, 900]))
        rows.append(" ".join(words))
        if i % 3 == 0:
            rows.append(rows[-1])
            for _ in range(3):
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(WORDS)
                rows.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return [*rows, None, "", " \t\n", "Éa É b\x0bc", "x " * 70_000, "one", "ONE"]


def test_fingerprints_and_components(spark):
    texts = corpus()
    docs = spark.createDataFrame([(100 + i, t, "extra", i) for i, t in enumerate(texts)], "doc_id long, text string, _fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [simhash_slow(t) for t in texts]
    assert [got[100 + i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    label = groups_slow(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert [got[100 + i].component_id for i in range(len(texts))] == [100 + x for x in label]
    assert len({tuple(sorted(x)) for x in label and [label]}) == 1 and len(set(label)) < len(label) - 8


def test_links_meet_at_one_and_two_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = base + [b ^ 1 << rng.randrange(64) for b in base] + [b ^ 3 << rng.randrange(63) for b in base] + [b ^ 7 << 3 for b in base] + [1 << 63, 0]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = dict(components(simhash.links(spark.createDataFrame([(p,) for p in signed], "_fp long"), 2)).collect())
    label = groups_slow(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    found = [root.get(p, p) for p in signed]
    assert all((label[i] == label[j]) == (found[i] == found[j]) for i in range(len(prints)) for j in range(len(prints)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(30)] + [(500, 500)]
    root = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert root == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(31)}}


def test_repeated_rows_null_ids_and_no_rows(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q r s t u")], schema)
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert rows == [(1, 1), (1, 1), (None, 1), (None, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def lines_slow(docs, n=3):
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        split, gone = (text.split("\n") if text is not None else []), set()
        for i in range(len(split) - n + 1):
            run = tuple(split[i : i + n])
            if any(x.strip(" \t\r\n") for x in run):
                if run in seen:
                    gone |= set(range(i, i + n))
                seen.add(run)
        out[key] = (gone, None if text is None else "\n".join(x for i, x in enumerate(split) if i not in gone))
    return out


def line_corpus():
    rng = random.Random(3)
    passage = [f"shared line {i}" for i in range(5)]
    rows = []
    for i in range(40):
        own = [rng.choice(["a", "b", "", f"own {rng.random()}"]) for _ in range(rng.randrange(12))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + passage[: rng.randrange(6)] + own[at:])))
    return [*rows, (50, None), (51, ""), (52, "\n\n\n\n\n\n"), (53, "\n\n\n\n"), (54, "x\ny"), (55, "x\ny"), (None, "\n".join(passage)),
            (56, "\n".join(["long"] * 20_000)), (57, rows[7][1]), (58, "shared line 0\r\nshared line 1\r\nz")]


def test_lines_against_brute_force(spark):
    rows = line_corpus()
    want = lines_slow(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.repeated_lines(docs).collect()}
    assert len(got) == len(rows)
    for key, (gone, kept) in want.items():
        assert {i for r in got[key]["_gone"] for i in range(r["first"], r["last"] + 1)} == gone, key
        assert got[key]["_kept"] == kept


def test_lines_keep_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(2, "a\nb\nc\nd", 1, "p"), (2, "a\nb\nc\nd", 2, "q"), (3, "z\na\nb\nc", 3, "r")], "doc_id long, text string, _gone int, pos string")
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(2, "a\nb\nc\nd", 1, "p"), (2, "a\nb\nc\nd", 2, "q"), (3, "z", 3, "r")]
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0
