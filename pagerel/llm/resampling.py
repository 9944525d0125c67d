"""Importance resampling towards a target distribution by hashed features.

Features are runs of 1 to ``runs`` consecutive words, counted by bucket of
their CRC-32 over the raw documents and over the target texts. A bucket's gain
is the log ratio of its two shares, a document's weight the mean gain of its
features, its score the weight plus Gumbel noise seeded by its id; the highest
scores are the draw (without replacement, in proportion to the weights).

Texts are taken batch by batch: joined with a separator sentinel, one regular
expression pass finds all words of the batch, ``searchsorted`` over the
sentinels gives each word's document, runs that cross a sentinel are masked
before ``bincount``. A batch is cut into segments between words, so a very
long text needs no more memory than others.

Only the table of ``buckets`` counts passes the driver. Texts are read twice
and never shuffled; the rank is a range sort of small rows.

Defined cases: null or blank text, and text without words, has no feature and
weight 0; gains are floored to thousandths, floors go down; a null id draws as
the id ''; rows may repeat, and each is drawn for itself (rows alike in id and
text have the same score); ranks are gapless; an empty target or an empty table
gives gains of the smoothed counts; extra columns stay, but for those with the
names of the results."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import ship, stored
from pagerel.operators.dataset import row_numbers

BUCKETS = 10_000
SEGMENT = 1 << 20  # bytes taken at a time
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
RESULTS = ["n_features", "n_words", "weight", "score", "rank"]


def segments(joined: bytes, size: int) -> Iterator[bytes]:
    """``joined`` cut before bytes that are no part of a word."""
    at = 0
    while at < len(joined):
        cut = BETWEEN.search(joined, at + size)
        end = cut.start() if cut else len(joined)
        yield joined[at:end]
        at = end


def features(texts: list[str | None], runs: int, buckets: int, size: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document, bucket, run length) arrays of all features of ``texts``."""
    # a NUL in a text is no part of a word, and neither is a blank
    joined = b"\0".join((t or "").encode().replace(b"\0", b" ") for t in texts).lower()
    doc, held = 0, []  # the document that a segment starts in, the words before it
    for part in segments(joined, size):
        tokens = held + TOKEN.findall(part)
        last = np.fromiter(map(crc32, tokens), np.uint32, len(tokens))
        mark = np.flatnonzero(last == crc32(b"\0"))
        mark = mark[[tokens[i] == b"\0" for i in mark.tolist()]] if len(mark) else mark
        at = doc + np.searchsorted(mark, np.arange(len(tokens)), "right")
        word = np.ones(len(tokens), bool)
        word[mark] = False
        for n in range(1, runs + 1):
            if n > 1:  # a run's CRC goes on from that of the run without its last word
                last = np.fromiter((crc32(b" " + t, c) for t, c in zip(tokens[n - 1 :], last.tolist())), np.uint32, max(0, len(tokens) - n + 1))
            first, end = np.arange(len(last)), np.arange(len(last)) + n - 1
            own = (at[first] == at[end]) & word[first] & word[end] & (end >= len(held))
            yield at[first][own], (last[own] % buckets).astype(np.int64), n
        held = tokens[len(tokens) - (runs - 1) :] if runs > 1 else []
        doc = int(at[-1]) - sum(t == b"\0" for t in held) if len(at) else doc


def batches_of(texts: Iterable[str | None], size: int = SEGMENT) -> Iterator[list[str | None]]:
    """Texts in lists of about ``size`` characters."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += len(text or "") + 1
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task sends a row per bucket at most."""
    ship(__name__)

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in frames:
            for some in batches_of(pdf["text"]):
                for _, bucket, _ in features(some, runs, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": seen.astype("int32"), "n": total[seen]})

    return docs.select(F.col(text).alias("text")).mapInPandas(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for table, frame in ((s, docs), (t, target)):
        for r in bucket_counts(frame, text, runs, buckets).collect():  # ``buckets`` rows at most
            table[r.bucket] = r.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", runs: int = 1) -> DataFrame:
    """``docs`` without ``text``, with n_features, n_words and weight."""
    ship(__name__)
    buckets = len(gain)

    @F.pandas_udf("struct<n: long, words: long, total: long>")
    def summed(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            rows = []
            for some in batches_of(texts):
                n, words, total = np.zeros((3, len(some)), np.int64)
                for doc, bucket, run in features(some, runs, buckets):
                    has = np.bincount(doc, minlength=len(some))
                    n += has
                    words += has if run == 1 else 0
                    total += np.bincount(doc, gain[bucket], len(some)).astype(np.int64)  # sums of whole numbers are exact
                rows.append(pd.DataFrame({"n": n, "words": words, "total": total}))
            yield pd.concat(rows) if rows else pd.DataFrame({"n": [], "words": [], "total": []}, dtype="int64")

    docs = docs.drop(*(c for c in RESULTS if c != text)).withColumn("_f", summed(F.col(text))).drop(text)
    mean = F.expr("if(_f.n = 0, 0L, (_f.total - pmod(_f.total, _f.n)) div _f.n)")
    return docs.withColumns({"n_features": F.col("_f.n"), "n_words": F.col("_f.words"), "weight": mean}).drop("_f")


def noise(seed: int, id_col: str):
    """Thousandths of a Gumbel draw from the first 32 bits of a SHA-256."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", runs: int = 1, buckets: int = BUCKETS,
             percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """``docs`` without ``text``, with n_features, n_words, weight, score and,
    for the ``percent`` of the documents of ``min_words`` or more that are
    drawn, ``rank``."""
    scored = weighted(docs, gains(docs, target, text, runs, buckets), text, runs)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(seed, id_col)), "scores")
    fit = F.col("n_words") >= min_words
    drawn = scored.filter(fit).count() * percent // 100
    # rows alike in all are told apart by a row number, so no range is one value
    ranked = row_numbers(scored.filter(fit).withColumn("_row", F.monotonically_increasing_id()),
                         [F.desc("score"), F.asc_nulls_last(id_col), "n_features", "weight", F.xxhash64("_row"), "_row"])
    rank = F.when(F.col("row_no") <= drawn, F.col("row_no"))
    ranked = ranked.withColumn("rank", rank).drop("row_no", "_row")
    return ranked.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("bigint")))
