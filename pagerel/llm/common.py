"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerel.session import ensure_checkpoint_dir


def ship(module_name: str) -> None:
    """Pickle a module's functions by value: executors need no installed package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, *but: str, **own: str) -> DataFrame:
    """The columns of ``docs`` (less ``but``) as one struct ``_row``, whatever
    their names, beside copies of some under an operator's own names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in but))
    return docs.select(row.alias("_row"), *(F.col(f"`{c}`").alias(n) for n, c in own.items()))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder and
    read it back: cuts the lineage, survives the loss of executors, and later
    scans read only the columns they need. The folder belongs to the job; its
    owner empties it when the job is over."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the
    smallest node of the component; every node of an edge has one row.

    Alternating large-star / small-star rounds (Kiveris et al. 2014). Each
    round is aggregates and joins on a node; the joins may be split by
    adaptive execution where one node has very many edges. Each round's edges
    are stored, so a lost executor costs one round at most."""
    edges = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = stored(small, "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    tree = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame):
    """A count and a sum over the whole edge set: equal between two rounds
    only if nothing has changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                           F.sum(F.col("b").cast("decimal(38,0)"))).first())
