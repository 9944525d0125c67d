"""A dataset store. A dataset is a folder of Parquet parts and manifests,
one per version, written last: readers take the newest manifest, so they never
see half a write, and a replaced dataset's parts stay readable to those who
have begun. A column unknown so far is appended; in older rows it is ''. Two
writers of the same version: the second fails and may try again."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import named

COLUMN = T.StructType([T.StructField("name", T.StringType()), T.StructField("attr", T.StringType())])
MANIFEST = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("parts", T.ArrayType(T.StringType())),
    T.StructField("columns", T.ArrayType(COLUMN)), T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])


def manifest(spark: SparkSession, path: str) -> T.Row | None:
    """The newest manifest, or None where nothing is stored."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifests/*").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _commit(spark: SparkSession, path: str, version: int, parts: list[str], columns: list[tuple[str, str]], meta: dict[str, str]) -> None:
    row = spark.createDataFrame([(version, parts, columns, meta)], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/{version:012d}")


def save(df: DataFrame, path: str, mode: str = "append", attrs: dict[str, str] | None = None, meta: dict[str, str] | None = None) -> int:
    """Append ``df`` (its columns as strings, null as '') or 'replace' what is
    stored; ``attrs``: value modes of columns (default text; a known column
    keeps its own); ``meta`` is laid over the stored one. -> the version"""
    if mode not in ("append", "replace"):
        raise ValueError(f"mode must be append or replace, not {mode!r}")
    spark = df.sparkSession
    old = manifest(spark, path)
    keep = old if old is not None and mode == "append" else None
    part = f"parts/{uuid.uuid4().hex}"
    df.select(*(F.coalesce(named(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.parquet(f"{path}/{part}")
    columns = [(c.name, c.attr) for c in keep.columns] if keep else []
    known = {c for c, _ in columns}
    columns += [(c, (attrs or {}).get(c) or "text") for c in df.columns if c not in known]
    version = (old.version if old else 0) + 1
    _commit(spark, path, version, [*(keep.parts if keep else []), part], columns, {**(keep.meta if keep else {}), **(meta or {})})
    return version


def clear(spark: SparkSession, path: str) -> int:
    """An empty dataset without columns and meta."""
    old = manifest(spark, path)
    version = (old.version if old else 0) + 1
    _commit(spark, path, version, [], [], {})
    return version


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The dataset, every column a string with its value mode as ``attr`` in
    the field's metadata, and its meta."""
    now = manifest(spark, path)
    columns = [(c.name, c.attr) for c in now.columns] if now else []
    schema = T.StructType([T.StructField(c, T.StringType()) for c, _ in columns])
    if not now or not now.parts:
        return spark.createDataFrame([], schema), dict(now.meta) if now else {}
    # a part without a column reads as null there
    df = spark.read.schema(schema).parquet(*(f"{path}/{p}" for p in now.parts))
    return df.select(*(F.coalesce(named(c), F.lit("")).alias(c, metadata={"attr": a}) for c, a in columns)), dict(now.meta)
