"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly when their balls of radius
r meet, so every distinct fingerprint emits all variants within r = half the
allowed distance, and fingerprints meet on a shared variant. All fingerprints
at one variant are within 2r bits of each other: linking each to the smallest
of them keeps every component without emitting pairs.

Defined cases: null, empty or blank text has fingerprint 0 and links like any
other; text of fewer words than a shingle is one shingle; rows may repeat; a
null id takes part, but never names a component that has another id; extra columns
stay, but for those with the names of the results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import components, ship, stored

BITS = 64
CHUNK = 65536  # shingles hashed at a time
HOT = 1000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is 1 in over half the
    XXH64 (seed 42) values of the shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(shingle, len(words))
    runs = zip(*(islice(words, i, None) for i in range(k)))
    ones, total = np.zeros(BITS, np.int64), len(words) - k + 1
    while part := [xxh64_intdigest(b" ".join(run), 42) for run in islice(runs, CHUNK)]:
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without ``text``, with its fingerprint as a signed long ``_fp``."""
    ship(__name__)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="uint64").astype("int64")

    return docs.withColumn("_fp", simhash(F.col(text))).drop(text)


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``_fp`` that differ in at
    most ``max_bits`` (0 or 2) bits; enough of them to connect every such pair."""
    if max_bits not in (0, 2):
        raise ValueError("max_bits must be 0 or 2: the ball around a fingerprint has radius max_bits / 2, and is sent out whole")
    if max_bits == 0:
        return fps.select(F.col("_fp").alias("a"), F.col("_fp").alias("b")).limit(0)
    ball = fps.select("_fp", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("bit"))
    one = F.expr("if(bit < 64, shiftleft(1L, bit), 0L)")
    # a variant and the flipped bit give back the fingerprint: 64 flags and
    # one more hold all who meet at a variant, in a plain hash aggregate
    met = (ball.select(F.col("_fp").bitwiseXOR(one).alias("v"), one.alias("bit"))
           .groupBy("v").agg(F.bit_or("bit").alias("bits"), F.max((F.col("bit") == 0).cast("int")).alias("self"))
           .filter(F.bit_count("bits") + F.col("self") > 1))
    who = met.select("v", F.expr("filter(transform(sequence(0, 64), i -> if(i < 64, if(getbit(bits, i) = 1, v ^ shiftleft(1L, i), null),"
                                 " if(self = 1, v, null))), x -> x is not null)").alias("who"))
    return (who.select(F.explode("who").alias("a"), F.array_min("who").alias("b")).filter("a != b").distinct()
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` without ``text``, with ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable over links) and ``component_key``
    (one value per component). Other columns of ``docs`` come along; the
    names of the three, ``_fp`` and ``_n`` are taken."""
    fps = stored(fingerprints(docs.drop("fingerprint", "component_id", "component_key", "_fp", "_n"), text, shingle), "simhash")
    # copies fall together here, summed up before the shuffle
    distinct = stored(fps.groupBy("_fp").agg(F.min(id_col).alias("_id"), F.count("*").alias("_n")), "simhash-distinct")
    roots = stored(components(links(distinct, max_bits)).select(F.col("node").alias("_fp"), F.col("root").alias("component_key")), "roots")
    ids = roots.join(distinct, "_fp").groupBy("component_key").agg(F.min("_id").alias("component_id"))
    linked = roots.join(ids, "component_key")
    of = distinct.join(linked, "_fp", "left").select("_fp", "_n", F.when(F.col("component_key").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
                                                     F.coalesce("component_key", "_fp").alias("component_key"))
    of = stored(of, "simhash-of")
    # fingerprints on a thousandth of all rows or more, 1,000 at most, go to
    # the rows; the others' rows meet theirs in a shuffle without hot keys
    total = distinct.agg(F.sum("_n")).first()[0] or 0
    often, seldom = of.filter(F.col("_n") * HOT >= total).drop("_n"), of.filter(F.col("_n") * HOT < total).drop("_n")
    rows = fps.join(F.broadcast(often), "_fp").unionByName(fps.join(F.broadcast(often.select("_fp")), "_fp", "left_anti").join(seldom, "_fp"))
    return rows.withColumn("fingerprint", F.lpad(F.lower(F.hex("_fp")), 16, "0")).drop("_fp")
