"""The corpus pipeline: toxic documents go, repeated lines go, one document of
each group of near-duplicates stays, sources are mixed to target weights, and
the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns the columns of ``documents``; the last returns the packed
pieces. Extra columns come along through all stages but the last. Text that
line de-duplication empties is '' and counts as a near-duplicate of other
empty texts. ``n_chars`` follows the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagerel.llm import lines, mixing, packing, simhash, toxicity
from pagerel.llm.common import carried, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = toxicity.REJECT


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxicity is under REJECT, as they
    are; null or empty text is clean, and without labels all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(carried(docs, text="text"), model)
    return scored.filter(F.col("p_toxic") < REJECT).select("_row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has in a run of three;
    null text stays null, an emptied one is ''."""
    out = lines.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays; of rows alike
    in id and text one. Same columns; null text is empty, a row without id
    stays only where its group has no id."""
    text_hash = F.xxhash64("text").alias("_th")
    groups = simhash.near_duplicates(docs.select("doc_id", text_hash, "text"), shingle=3, max_bits=2)
    alike = (groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_key", "doc_id", "_th")
             .agg(F.count("*").alias("times")))
    stay = alike.groupBy("component_key").agg(F.min(F.struct("doc_id", "_th", "times")).alias("it"))
    key = lambda i: [i.isNull().alias("_none"), F.coalesce(i, F.lit(0)).alias("_key")]
    stay = stored(stay.select(*key(F.col("it.doc_id")), "it._th", "it.times"), "stay")
    rows = carried(docs, doc_id="doc_id", text="text").select("_row", *key(F.col("doc_id")), text_hash)
    same = ["_none", "_key", "_th"]
    once = rows.join(stay.filter("times = 1"), same, "left_semi")
    # repeated rows: each task sends one of a kind on
    many = rows.join(stay.filter("times > 1"), same, "left_semi").groupBy(*same).agg(F.first("_row").alias("_row"))
    return once.select("_row.*").unionByName(many.select("_row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them, 0 times or more; null source
    is a source, empty texts have no size and go by their source's rate."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place; every row is packed by itself,
    null text as the end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The model, the fingerprints and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
