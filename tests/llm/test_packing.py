"""Pieces against the library's own ids; the search's invariants."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagerel.llm import packing

ODD = ["", None, " ", "\n", "  a\n\n b \t", "it's'd I'LL  ²½ ①x\x85y", "日本 12 　​ ñandú 'ree", "a\r\nb", "a" * 3000, " \n\t ", "x  ", "word " * 9000, "é \U0001f600 \x00"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_hold_the_ids(spark, tokenizer):
    rng = random.Random(1)
    texts = [*ODD, "<|endoftext|> as text", *(" ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1500))) for _ in range(12))]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    got = defaultdict(list)
    for r in packing.pieces(docs).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = packing.cut(len(ids), 1024)
        assert sorted(got[i]) == [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)]


def test_cuts():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(11, 4) == [(0, 3), (3, 4), (7, 4)]


def legal(lengths, bin_of, offset, capacity):
    for b in set(bin_of.tolist()):
        inside = sorted((offset[i], lengths[i]) for i in np.flatnonzero(bin_of == b))
        at = 0
        for o, n in inside:
            assert o == at
            at += n
        assert at <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_search_is_legal_and_never_worse(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [1023, 300, 700, 512, 1000, 60][seed], 400)
    start = packing.best_fit(lengths, 1024)
    bin_of, offset = packing.pack_group(lengths, 1024)
    legal(lengths, bin_of, offset, 1024)
    assert len(set(bin_of.tolist())) <= len(start)


def test_search_finds_each_kind_of_step():
    def run(bins, capacity=10):
        flat = np.array([n for b in bins for n in b])
        at = iter(range(len(flat)))
        return len(packing.Search([[next(at) for _ in b] for b in bins], flat, capacity).run())

    assert run([[6, 2], [2]]) == 1  # move
    assert run([[5, 3], [6, 4], [3, 4, 1, 2], [2]]) == 3
    assert run([[6, 3], [7], [4]]) == 2  # one for one: 6 goes, 7 comes
    assert run([[7, 2], [4, 4], [3]]) == 2  # two for one at need


def steps_left(bins, n, capacity):
    """Bins between which a move or an exchange of at most two pieces for one
    raises the sum of squared fills, by trying all."""
    def some(b):
        return [(), *((i,) for i in b), *((i, j) for k, i in enumerate(b) for j in b[k + 1 :])]

    fill = [sum(n[i] for i in b) for b in bins]
    found = []
    for a, b in ((a, b) for a in range(len(bins)) for b in range(len(bins)) if a != b):
        for out in some(bins[a]):
            for back in some(bins[b]):
                gain = sum(n[i] for i in back) - sum(n[i] for i in out)
                if (len(out), len(back)) in {(0, 1), (1, 1), (1, 2), (2, 1)} and 0 < gain <= capacity - fill[a] and fill[b] < fill[a] + gain:
                    found.append((a, b, out, back))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_search_ends_at_a_local_optimum(seed):
    rng = np.random.default_rng(seed)
    if seed % 2:  # copies: few lengths, and more than 32 bins of one
        lengths = np.concatenate([np.repeat(rng.choice(np.arange(40, 101), 6, replace=False), 8), np.repeat(53, 40)])
        lengths = np.concatenate([lengths, rng.integers(15, 45, 20)])
    else:
        lengths = rng.integers(20, 70, 60)
    bins = packing.Search([[i] for i in range(len(lengths))], lengths, 101).run()
    left = steps_left(bins, lengths.tolist(), 101)
    assert not left or len(bins) == -(-int(lengths.sum()) // 101)


def test_partners_beyond_the_emptiest_bins_and_two_for_one():
    def filled(bins, capacity):
        flat = np.array([n for b in bins for n in b])
        at = iter(range(len(flat)))
        search = packing.Search([[next(at) for _ in b] for b in bins], flat, capacity)
        assert search.improve(0)
        return sorted(flat[search.bins[0]].tolist())

    # 4 + 4 come for 7, though 40 emptier bins hold nothing of use
    assert filled([[12, 7], [4, 4, 6], *[[11]] * 40], 20) == [4, 4, 12]
    # 8 comes for 3 + 4
    assert filled([[12, 3, 4], [8, 9]], 20) == [8, 12]


def test_exact_partition_is_found_from_a_bad_start():
    lengths = np.array([5, 5, 3, 7, 4, 6, 8, 2])
    bins = packing.Search([[i] for i in range(8)], lengths, 10).run()
    assert len(bins) == 4


def test_pack_whole(spark):
    rng = random.Random(3)
    rows = [(i, "tok " * rng.randrange(1, 1500)) for i in range(300)] + [(5, "same row")] * 40 + [(None, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(docs, group=150).toPandas()
    legal(out["length"].to_numpy(), out["sequence_id"].to_numpy(), out["offset"].to_numpy(), 1024)
    assert (out["doc_id"] == 5).sum() >= 41 and out["doc_id"].isna().sum() == 2
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 1024) + 6
    again = packing.pack(docs, group=150).toPandas()
    assert again["sequence_id"].nunique() == out["sequence_id"].nunique()
    assert packing.pack(docs.limit(0)).count() == 0
