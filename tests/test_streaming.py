import os
import tempfile
import datetime as dt

from pyspark.sql import functions as F

from pagerel.streaming.incremental import page_budget, stream_changes


def test_stream_changes_keyed_state(spark):
    d = tempfile.mkdtemp(prefix="w03-", dir=spark.conf.get("spark.checkpoint.dir"))
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", t0 + dt.timedelta(seconds=i), s, n) for i, (s, n) in enumerate([("a", 1), ("b", 1), ("b", 1), ("b", 1), ("c", 0), ("c", 1)])]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "url string, seen_at timestamp, sig string, n int").write.parquet(os.path.join(d, "in", f"f{i}"))
    src = spark.readStream.schema("url string, seen_at timestamp, sig string, n int").option("maxFilesPerTrigger", 2).parquet(os.path.join(d, "in", "*"))
    q = (stream_changes(src).writeStream.format("memory").queryName("w03").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = [(r.sig, r.n) for r in spark.sql("select * from w03 order by seen_at").collect()]
    assert got == [("b", 1), ("c", 1)]


def test_page_budget(spark):
    b = spark.createDataFrame([("h", i) for i in range(1, 6)] + [("g", 9)], "host string, page_id int")
    have = spark.createDataFrame([("h", 3)], "host string, n int")
    got = sorted((r.host, r.page_id) for r in page_budget(b, have, 4).collect())
    assert got == [("g", 9), ("h", 1)]
