"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, each source gets a target from its weight, and
its rate is target / size. A document is taken floor(rate) times, and once
more with probability equal to the fraction; the draw is a hash of a seed and
the document, so reruns agree.

Targets stop at ``max_rate`` times their source's size and the excess is
shared again by weight until none is above: sources are filled in the order
of size / weight, and a source is full where the level it would get is above
its limit.

Defined cases: null text has size 0 and is taken like any other; sources are
ordered by code point with null last; a source of size 0 has target 0 and its
documents are taken 0 times; a draw is of the id (null: ''), the text's MD5 and
a number among rows alike in both, so rows that share an id, or have none, are
drawn each for itself; an empty table gives none; extra columns stay, but for
those with the names of the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagerel.llm.common import carried, stored
from pagerel.operators.dataset import row_numbers

SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Words between ASCII white space: pieces left when the ends are cut."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(flat, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(F.size(F.split(flat, " +")).cast("bigint"))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, source: str = "source", size: str = "_size", weights: Sequence[float] = (5, 2, 1),
                   share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source. Documents are summed
    before the shuffle; what the windows see is one row per source."""
    per = sized.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    per = per.withColumn("_limit", F.col("source_size") * F.lit(float(max_rate)))
    fill = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    per = per.withColumn("_level", level)
    # the first source that its level does not fill sets the level of all
    # after it (of sources alike in limit / weight the first has the highest)
    per = per.withColumn("_open", -F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("_w"), (-F.col("_level")).alias("_down")))).over(every)["_down"])
    target = F.least(F.col("_limit"), F.coalesce(F.col("_open") * F.col("_w"), F.col("_limit")))
    return per.select("_source", "source_size", target.alias("target"))


def drawn_for(id_col: str, text: str) -> Column:
    """What a document's draw is made from: its id and its text's MD5."""
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))


def numbered(sized: DataFrame, keys: DataFrame) -> DataFrame:
    """``sized`` with ``_nth``, 1, 2, ... among rows with the same ``_key``.
    Only rows whose key repeats among ``keys`` are sorted, by ranges, so that a
    key on very many rows is no task's group."""
    again = stored(keys.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "repeated-keys")
    if again.isEmpty():
        return sized.withColumn("_nth", F.lit(1).cast("bigint"))
    once = sized.join(again, "_key", "left_anti").withColumn("_nth", F.lit(1).cast("bigint"))
    many = sized.join(again, "_key", "left_semi").withColumn("_row_id", F.monotonically_increasing_id())
    many = row_numbers(many, ["_key", F.xxhash64("_row_id"), "_row_id"])
    start = stored(many.groupBy("_key").agg(F.min("row_no").alias("_start")), "repeated-starts")
    many = many.join(start, "_key").withColumn("_nth", F.col("row_no") - F.col("_start") + 1)
    return once.unionByName(many.select(once.columns))


def mix_sized(sized: DataFrame, sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_rate: float = 2.0, seed: str = SEED) -> DataFrame:
    """``sized`` (_key, _source, _size and others) with ``_source_size``,
    ``_target`` and ``_copies``: how many times the mix takes the row.
    ``sizes``: the three columns of the same rows, stored."""
    per = source_targets(sizes, "_source", "_size", weights, share, max_rate)
    per = per.select(F.col("_source").isNull().alias("_none"), F.coalesce("_source", F.lit("")).alias("_name"),
                     F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    # a stored table's size is known: a few sources are broadcast by their
    # size, very many are joined by a shuffle
    per = stored(per, "targets")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    luck = draw(F.lit(seed), F.col("_key"), F.col("_nth").cast("string"))
    return (numbered(sized, sizes).withColumn("_none", F.col("_source").isNull()).withColumn("_name", F.coalesce("_source", F.lit("")))
            .join(per, ["_none", "_name"]).drop("_none", "_name")
            .withColumn("_copies", F.floor(rate) + (luck < rate - F.floor(rate)).cast("bigint")))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` without ``text``, with ``_size``, ``_source_size``, ``_target``
    and ``_copies``. Words are counted once: what is stored and read again are
    the rows without their texts."""
    own = carried(docs.drop("_size", "_source_size", "_target", "_copies"), text, _id=id_col, _text=text, _source=source)
    sized = own.select("_row", "_source", n_words(F.col("_text")).alias("_size"), drawn_for("_id", "_text").alias("_key"))
    sized = stored(sized, "sizes")
    return mix_sized(sized, sized, **options).select("_row.*", "_size", "_source_size", "_target", "_copies")


def emit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    own = carried(docs, _id=id_col, _text=text, _source=source)
    sized = own.select("_row", "_source", n_words(F.col("_text")).alias("_size"), drawn_for("_id", "_text").alias("_key"))
    every = F.explode(F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    sizes = stored(sized.select("_key", "_source", "_size"), "sizes")
    return mix_sized(sized, sizes, **options).withColumn("_copy", every).select("_row.*")
