"""Incremental extraction with Structured Streaming.

Pages arrive as files; every micro-batch runs the same batch operators
(shred -> find lists -> detect columns -> extract) through ``foreachBatch``
and appends to a parquet sink; the sink is the dataset. Progress is kept in
the query checkpoint, so a restarted job resumes where it stopped."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import auto_extract
from ..operators.tree import PageSet
from ..session import ensure_checkpoint_dir

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def _extract_batch(sink: str):
    def run(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        ps = PageSet(batch)
        cells, _ = auto_extract(ps)
        (cells.select("page_id", F.col("row_ord").cast("bigint").alias("row_ord"), F.col("col_ord").cast("bigint").alias("col_ord"),
                      "name", "value")
         # an epoch that is run again replaces what it wrote before
         .write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}"))
    return run


def stream_extract(spark: SparkSession, source: str, sink: str, checkpoint: str, max_files: int = 1):
    """Extract every page file as it lands (availableNow drains the
    backlog and stops; a processing-time trigger would keep running)."""
    stream = spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (stream.writeStream.foreachBatch(_extract_batch(sink))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


LOG = "id STRING, page_id BIGINT, n_rows BIGINT, reason STRING"
ROWS = "id STRING, page_id BIGINT, row_ord BIGINT, cells ARRAY<STRUCT<name: STRING, value: STRING>>, n_key INT"


def _before(spark: SparkSession, folder: str, epoch_id: int, schema: str) -> DataFrame:
    """What other epochs have written; an epoch that runs again sees what it
    saw the first time, as epochs run one after the other."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/epoch=-1")
    return spark.read.schema(f"{schema}, epoch BIGINT").option("basePath", folder).parquet(folder).filter(F.col("epoch") < epoch_id).drop("epoch")


def _run_batch(recipes: DataFrame, sink: str, max_pages: int | None):
    def run(batch: DataFrame, epoch_id: int) -> None:
        from ..operators.extract import recipe_extract
        from ..operators.recipes import pages_for
        from ..operators.run import as_rows, enter, numbered
        from ..session import cut_lineage

        spark = batch.sparkSession
        log, stored = _before(spark, f"{sink}/pages", epoch_id, LOG), _before(spark, f"{sink}/rows", epoch_id, ROWS)
        batch = batch.dropDuplicates(["page_id"])
        visits = pages_for(recipes, batch).select("id", "page_id").join(log.select("id", "page_id"), ["id", "page_id"], "left_anti")
        visits = numbered(visits, "id", ["page_id"], "_nth").join(log.filter("reason = ''").groupBy("id").agg(F.count(F.lit(1)).alias("_used")), "id", "left")
        within = F.lit(True) if max_pages is None else F.coalesce("_used", F.lit(0)) + F.col("_nth") <= max_pages
        visits = cut_lineage(visits.select("id", "page_id", within.alias("used")), "visits")
        used = visits.filter("used").select("id", "page_id")
        ps = PageSet(batch.join(used.select("page_id").distinct(), "page_id", "left_semi"))
        cells = recipe_extract(ps, recipes).join(used, ["id", "page_id"], "left_semi")
        rows = as_rows(cells, ["id", "page_id", "row_ord"])
        how = recipes.select("id", F.size("columns").alias("n_key"), F.coalesce(F.col("options.dedupe"), F.lit(True)).alias("dedupe"))
        rows = rows.join(how, "id").select(F.col("id").alias("source"), F.col("page_id").alias("page_ord"), F.col("row_ord").cast("bigint").alias("row_ord"), "cells", "n_key", "dedupe",
                                           F.lit(True).alias("append"))
        rows = cut_lineage(rows, "run-rows")
        new = enter(rows, stored.select(F.col("id").alias("source"), "cells"))
        (new.select(F.col("source").alias("id"), F.col("page_ord").alias("page_id"), "row_ord", "cells", "n_key")
         .write.mode("overwrite").parquet(f"{sink}/rows/epoch={epoch_id}"))
        seen = rows.groupBy(F.col("source").alias("id"), F.col("page_ord").alias("page_id")).agg(F.count(F.lit(1)).alias("n_rows"))
        # the log is written last: pages count as used once their rows are there
        (visits.join(seen, ["id", "page_id"], "left").select("id", "page_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("used"), "").otherwise("limit").alias("reason"))
         .write.mode("overwrite").parquet(f"{sink}/pages/epoch={epoch_id}"))
    return run


def stream_run(spark: SparkSession, source: str, recipes: DataFrame, sink: str, checkpoint: str, max_pages: int | None = None,
               max_files: int = 1) -> tuple[DataFrame, DataFrame]:
    """W01 + W02 + W04: recipes (normalised) on pages as they land. Per recipe,
    a page is used once, at most ``max_pages`` pages are used over the whole run
    (the others are logged with reason 'limit'), and a row whose key the dataset
    has does not enter again. State is what the sink holds: its page log and its
    rows, read anew in each epoch, so restarts and replays add nothing.
    -> (rows, page log)"""
    stream = spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(source)
    q = (stream.writeStream.foreachBatch(_run_batch(recipes, sink, max_pages))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return _before(spark, f"{sink}/rows", 1 << 62, ROWS), _before(spark, f"{sink}/pages", 1 << 62, LOG)


def stream_dedupe(stream: DataFrame, keys: list[str], watermark_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """Seen keys over the whole run. Without an event-time column the
    state grows with the keys (as in the reference's single run); with a
    crawl time, ``dropDuplicatesWithinWatermark`` bounds it."""
    if watermark_col:
        return stream.withWatermark(watermark_col, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def stream_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered W01 query: stream the pages table through the extractor.
    Scratch folders live under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    run = os.path.join(base, "w01-" + uuid.uuid4().hex[:8])
    # pages "land" as several files (derived from the pages table by Spark)
    src = os.path.join(run, "landing")
    spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(2, "page_id").write.parquet(src)
    out = stream_extract(spark, src, os.path.join(run, "sink"), os.path.join(run, "ckpt"))
    return out.select("page_id", "row_ord", "col_ord", "name", "value")


# -- W03 / W04: keyed state -------------------------------------------------------
CHANGE_OUT = "key STRING, seen_at TIMESTAMP, sig STRING, n BIGINT"
CHANGE_STATE = "last STRING, pending STRING"


def _changes(key, pdfs, state):
    """Per key: emit a snapshot when its signature has rows, equals the poll
    right before it, and differs from the last stable one (N05's rule)."""
    import pandas as pd

    last, pending = (state.get if state.exists else (None, None))
    out = []
    # a key's polls of one batch may come in several chunks
    for r in pd.concat(list(pdfs)).sort_values("seen_at").itertuples(index=False):
        if last is None:
            last = r.sig  # the first poll is the state to start from
        if r.n > 0 and r.sig != last and r.sig == pending:
            out.append((key[0], r.seen_at, r.sig, r.n))
            last = r.sig
        pending = r.sig
    state.update((last, pending))
    if out:
        yield pd.DataFrame(out, columns=["key", "seen_at", "sig", "n"])


def stream_changes(snapshots: DataFrame, key: str = "url") -> DataFrame:
    """Change detection with keyed state (state = last stable signature
    and the previous poll), one state row per key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    from ..sources.shred import _ship_by_value

    _ship_by_value(__name__)
    s = snapshots.select(F.col(key).alias("key"), "seen_at", "sig", F.col("n").cast("bigint").alias("n"))
    return s.groupBy("key").applyInPandasWithState(_changes, CHANGE_OUT, CHANGE_STATE, "append", GroupStateTimeout.NoTimeout)


def page_budget(batch: DataFrame, sink_counts: DataFrame | None, max_pages: int, key: str = "host") -> DataFrame:
    """W04 inside ``foreachBatch``: keep at most ``max_pages`` pages per key
    across the run, counting what the sink already holds (row_number per key
    within the batch, offset by the stored count)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("page_id")
    b = batch.withColumn("_k", F.row_number().over(w))
    if sink_counts is not None:
        b = b.join(sink_counts.select(key, F.col("n").alias("_have")), key, "left")
    else:
        b = b.withColumn("_have", F.lit(0))
    return b.filter(F.coalesce("_have", F.lit(0)) + F.col("_k") <= max_pages).drop("_k", "_have")
