"""Line de-duplication over overlapping windows of three lines.

Every run of three consecutive lines is hashed; a run that occurs more than
once keeps its first occurrence (smallest document id, then position), and
the lines covered by any later occurrence go. Overlapping runs merge, so a
long repeated passage goes as a whole.

Defined cases: null text has no lines and stays null; text of fewer than
three lines has no window and stays; windows of three blank lines don't
count; a null id comes before all others; rows alike in id and text are one
document and are treated alike; an emptied text is ''; extra columns stay, but
for those with the names of the results. Ids are integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerel.llm.common import carried

WINDOW = 3


def _windows(lines: Column, n: int) -> Column:
    """(position, two 64-bit hashes) of each run of ``n`` lines that isn't blank."""
    def run(i: Column) -> Column:
        text = F.array_join(F.slice(lines, i + 1, n), "\n")
        return F.struct(i.alias("pos"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"),
                        (F.trim(F.translate(text, "\n\r\t", "   ")) != "").alias("full"))

    every = F.when(F.size(lines) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - n, F.lit(0))), run))
    return F.filter(every, lambda w: w["full"])


def _runs(gone: Column) -> Column:
    """Maximal runs (first, last) of the sorted positions ``gone``."""
    starts = F.filter(gone, lambda p, i: (i == 0) | (F.get(gone, i - 1) != p - 1))
    ends = F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) != p + 1))
    return F.arrays_zip(starts.alias("first"), ends.alias("last"))


def _without(lines: Column, runs: Column) -> Column:
    """``lines`` less the positions in ``runs``: the slices between them."""
    def before(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["last"] + 1)
        end = F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["first"])
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), before))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``_kept`` (the lines that stay, joined again), ``_n_lines``
    and ``_gone`` (maximal runs (first, last), from 0, of the lines that go).

    Only hashes and positions are shuffled for the search; a run that occurs
    in very many documents is counted before its shuffle, and the join that
    finds its later occurrences may be split."""
    docs = docs.drop("_gone").withColumn("_lines", F.split(F.col(text), "\n")).withColumn("_th", F.xxhash64(text))
    at = docs.select(F.col(id_col).alias("_id"), "_th", F.explode(_windows(F.col("_lines"), window)).alias("w")).select("_id", "_th", "w.pos", "w.h1", "w.h2")
    here = F.struct("_id", "_th", "pos")
    firsts = (at.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last"))
              .filter(F.col("first") != F.col("last")).select("h1", "h2", "first"))
    later = at.join(firsts, ["h1", "h2"]).filter(here != F.col("first"))
    covered = (later.groupBy(F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).alias("_key"), "_th")
               .agg(F.collect_set("pos").alias("_from")))  # as many as the document has lines, at most
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("_from", lambda p: F.sequence(p, p + (window - 1))))))
    covered = covered.select("_none", "_key", "_th", gone.alias("_gone")).select("_none", "_key", "_th", _runs(F.col("_gone")).alias("_gone"))
    docs = docs.withColumn("_none", F.col(id_col).isNull()).withColumn("_key", F.coalesce(F.col(id_col), F.lit(0)))
    out = docs.join(covered, ["_none", "_key", "_th"], "left")
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(_without(F.col("_lines"), F.col("_gone")), "\n"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return (out.withColumn("_kept", kept).withColumn("_n_lines", F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")))
            .withColumn("_gone", F.coalesce("_gone", none)).drop("_lines", "_none", "_key", "_th"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the later occurrences gone from ``text``; same columns, same rows."""
    done = repeated_lines(carried(docs, text, doc_id=id_col, text=text), window=window)
    return done.select(*((F.col("_kept") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns))
