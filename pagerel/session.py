"""Session helpers: a local session for tests and the bench, and the shared
checkpoint folder used to cut lineage on long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pagerel") -> SparkSession:
    """Session for tests / bench on one machine. On a cluster the caller's
    session is used as-is; nothing here is required there."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="pagerel-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a local session,
    where driver and executors are one machine, may go without the setting
    and then gets a fresh scratch folder; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="pagerel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Rows of a table that the driver may hold to broadcast it.
MOST_BROADCAST = 20_000

#: Called with (what, frame) before each cut; the plan audit looks at the plans.
WATCHERS: list = []


def cut_lineage(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder and
    read it back. Later plans scan only the columns they need and survive the
    loss of executors. Small tables are broadcast by their size; files say
    little of the rows in them (millions of like rows are a few MB), so tables
    of more than ``MOST_BROADCAST`` rows are joined by sort and merge.
    The folder belongs to the job; its owner empties it when the job is over."""
    spark = df.sparkSession
    for watch in WATCHERS:
        watch(what, df)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if written.get["n"] > MOST_BROADCAST else table
