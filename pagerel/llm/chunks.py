"""Document fingerprints from content-defined chunks.

A gear hash over the last 16 bytes sets the boundaries, with a strict test up
to the normal chunk size and a loose one after it, so sizes gather around the
normal one. A fingerprint is the set of chunk digests with their lengths:
text moved by an insertion keeps its chunks. Containment is the length of a
document's chunks that the other has, over the length of all its chunks.

Defined cases: null text is empty; the empty fingerprint is '', contained in
another empty one only; documents are ordered by id, null first, then by a
hash of the text; rows may repeat, and the next row is then alike; one
document alone is its own next; an empty table gives none; only the id and the
text are read, other columns have no part in the result. An id that a large
part of the rows has (or none) spreads over several ranges by the hash, and of
very many rows alike in id and text one is dealt, for all but the last are
followed by themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import ship, stored

SMALLEST, NORMAL, LARGEST = 32, 96, 512  # bytes
STRICT, LOOSE = 1 << (16 - 9), 1 << (16 - 5)  # a boundary in 512, in 32 places
SEGMENT = 1 << 20  # bytes hashed at a time
GEAR = np.random.default_rng(1).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """sum of GEAR[byte] << age over the last 16 bytes, at every position."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += older
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    whole, strict, loose = np.frombuffer(data, np.uint8), [], []
    for start in range(0, len(whole), SEGMENT):
        lead = min(start, 15)
        h = gear(whole[start - lead : start + SEGMENT])[lead:]
        strict.append(np.flatnonzero(h < STRICT) + start + 1)
        loose.append(np.flatnonzero(h < LOOSE) + start + 1)
    strict, loose = (np.concatenate(x) if x else np.zeros(0, int) for x in (strict, loose))
    ends, at, n = [], 0, len(whole)
    while n - at > SMALLEST:
        i = strict.searchsorted(at + SMALLEST)
        if i < len(strict) and strict[i] < at + NORMAL:
            at = int(strict[i])
        else:
            i = loose.searchsorted(at + NORMAL)
            at = min(n, at + LARGEST, int(loose[i]) if i < len(loose) else n)
        ends.append(at)
    return ends if at == n else [*ends, n]


def chunk_set(text: str) -> dict[int, int]:
    """Length by digest of the text's distinct chunks."""
    from xxhash import xxh3_64_intdigest

    data, at, found = text.encode(), 0, {}
    for end in boundaries(data):
        found[xxh3_64_intdigest(data[at:end])] = end - at
        at = end
    return found


def shown(chunks: dict[int, int]) -> str:
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the beginning of the
    next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (_none, _id, _text, _hash) as rows with (_range, _after), dealt
    over ranges of (id, hash) and sorted; the last row of each range, with
    ``_after`` set, is the first of the next range (after the last range: the
    first). Rows without id come first."""
    counts = docs.agg(F.count("*").alias("n"), F.count_if("_none").alias("none"),
                      F.percentile_approx(F.when(~F.col("_none"), F.col("_id")), [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("cuts")).first()
    cuts = np.sort(np.array(counts["cuts"] or [], np.int64))  # an id on many rows is there several times
    lead = -(-ranges * counts.none // max(1, counts.n))  # ranges of the rows without id

    @F.pandas_udf("int")
    def place(ids: pd.Series, none: pd.Series, hashes: pd.Series) -> pd.Series:
        keys, at = ids.to_numpy(np.int64), (hashes.to_numpy(np.int64) >> 32) + (1 << 31)
        low, high = np.searchsorted(cuts, keys), np.searchsorted(cuts, keys, "right")
        mine = lead + low + (at * (high - low + 1) >> 32)
        return pd.Series(np.where(none, at * lead >> 32, mine).astype(np.int32))

    docs = docs.withColumn("_range", place("_id", "_none", "_hash"))
    key = F.struct((~F.col("_none")).alias("some"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    first = docs.select("_range", key.alias("at")).groupBy("_range").agg(F.min("at").alias("at"))
    heads = sorted((r._range, r["at"]["some"], r["at"]["id"], r["at"]["hash"]) for r in first.collect())  # one row per range
    if not heads:
        return docs.withColumn("_after", F.lit(False))
    to = [(heads[i - 1][0], not some, id_, h) for i, (_, some, id_, h) in enumerate(heads)]
    to = docs.sparkSession.createDataFrame(to, "_to int, _none boolean, _id long, _hash long")
    heads = (docs.drop("_range").join(F.broadcast(to), ["_none", "_id", "_hash"]).withColumnRenamed("_to", "_range")
             .dropDuplicates(["_range"]))
    both = docs.withColumn("_after", F.lit(False)).unionByName(heads.withColumn("_after", F.lit(True)))
    n = len(cuts) + lead + 1
    return both.repartition(max(ranges, n), "_range").sortWithinPartitions("_range", "_after", "_id", "_hash")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how much of
    the document either, and the next document, contains. Texts are shuffled
    once, by ranges of ids; each task holds one batch and one row more."""
    ship(__name__)
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, body = F.col(id_col).cast("bigint"), F.coalesce(F.col(text), F.lit(""))
    # a null among whole numbers would make a batch's ids floats
    docs = docs.select(own.isNull().alias("_none"), F.coalesce(own, F.lit(0)).alias("_id"), body.alias("_text"), F.xxhash64(body).alias("_hash"))

    # rows alike in id and text that would make up half a range or more: 2 * ranges kinds at most
    same = ["_none", "_id", "_hash"]
    total = docs.count()
    many = docs.groupBy(*same).agg(F.count("*").alias("_times")).filter((F.col("_times") > 1) & (F.col("_times") * 2 * ranges >= total))
    many = stored(many, "repeated-rows")
    ones = docs.join(F.broadcast(many.drop("_times")), same, "left_anti")
    kinds = docs.join(F.broadcast(many), same).groupBy(*same, "_times").agg(F.first("_text").alias("_text"))
    kinds = stored(kinds, "repeated-texts")

    def against(key: int, none: bool, text_: str, chunks: dict[int, int], following: str, next_chunks: dict[int, int]) -> tuple:
        other = edited(text_, following)
        others = chunk_set(other)
        return (key, none, len(text_), hashlib.sha256(other.encode()).hexdigest(), shown(chunks), shown(others),
                containment(chunks, others), containment(chunks, next_chunks))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its next one
        for pdf in batches:
            rows = []
            for after, key, none, text_ in zip(pdf["_after"], pdf["_id"], pdf["_none"], pdf["_text"]):
                chunks = chunk_set(text_)
                if held is not None:
                    rows.append(against(*held, text_, chunks))
                held = None if after else (key, none, text_, chunks)
            yield pd.DataFrame(rows, columns=names)

    def compare_alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, none, text_, times in zip(pdf["_id"], pdf["_none"], pdf["_text"], pdf["_times"]):
                chunks = chunk_set(text_)
                rows.append((*against(key, none, text_, chunks, text_, chunks), times - 1))
            yield pd.DataFrame(rows, columns=[*names, "_times"])

    names = ["id", "none", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = "id long, none boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = in_order(ones.unionByName(kinds.drop("_times")), ranges).select("_range", "_after", "_id", "_none", "_text")
    alike = kinds.select("_id", "_none", "_text", "_times").mapInPandas(compare_alike, kind + ", _times long")
    alike = alike.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times"))).drop("_times")
    out = rows.mapInPandas(compare, kind).unionByName(alike)
    return out.select(F.when(~F.col("none"), F.col("id")).alias(id_col), *names[2:])
