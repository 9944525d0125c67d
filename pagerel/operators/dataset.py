"""Dataset algebra (U01-U03, A05-A10, N02, N03, S14) and distributed row
numbering.

A dataset is a DataFrame of STRING columns plus ordering columns
(``page_ord``, ``row_ord``). Missing values are '' (never null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.shred import _ship_by_value

ORDER = ["page_ord", "row_ord"]


def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Align by column name, append unknown columns, back-fill ''."""
    out = stored.unionByName(incoming, allowMissingColumns=True)
    strs = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
    return out.na.fill("", subset=strs)


def run_mode(stored: DataFrame | None, incoming: DataFrame, append: bool) -> DataFrame:
    """Replace (new run) or append (merge) the stored dataset."""
    return merge(stored, incoming) if (append and stored is not None) else incoming


def dedupe(df: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """Keep the first occurrence (by ``order``) of each key tuple.

    Done as a hash aggregate (min of the order struct per key, partial
    aggregation map-side) and a join back, not as a window over the key:
    a hot key never has to sit in one task."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(keys)]
    kd = df.select("*", *k)
    kcols = [f"_k{i}" for i in range(len(keys))]
    first = kd.groupBy(*kcols).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = first.select(*kcols, *[F.col("_first")[c].alias(c) for c in order])
    return kd.join(firsts, kcols + order, "left_semi").drop(*kcols)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key tuple is not in the stored data; if a key
    column is missing in the stored data nothing counts as seen."""
    if any(c not in stored.columns for c in keys):
        return incoming
    k_in = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(keys)]
    k_st = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(keys)]
    kcols = [f"_k{i}" for i in range(len(keys))]
    seen = stored.select(*k_st).distinct()
    return incoming.select("*", *k_in).join(seen, kcols, "left_anti").drop(*kcols)


def compact(n: Column) -> Column:
    """A10: compact figure: >= 10,000 -> '12k'; >= 1,000 -> '1.2k' ('.0'
    dropped); else the number."""
    k1 = F.regexp_replace(F.format_number(F.bround(n / 1000.0, 1), 1), r"\.0$", "")
    return (F.when(n >= 10000, F.concat(F.floor(n / 1000.0 + 0.5).cast("bigint").cast("string"), F.lit("k")))
            .when(n >= 1000, F.concat(k1, F.lit("k")))
            .otherwise(n.cast("string")))


def dataset_counts(df: DataFrame, data_cols: list[str]) -> DataFrame:
    """A10: rows, columns, compact rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(data_cols)).cast("bigint").alias("n_cols"), compact(F.col("n_rows")).alias("rows_compact"))


def dataset_meta(runs: DataFrame) -> DataFrame:
    """Per dataset (here: per host) pages counted, first source url and
    title (by page order), last host, updated time.
    runs: (dataset, page_ord, url, title, host, ts)"""
    return runs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("pages"),
        F.min_by("url", "page_ord").alias("source"),
        F.min_by("title", "page_ord").alias("title"),
        F.max_by("host", "page_ord").alias("host"),
        F.max("ts").alias("updated_at"),
    )


def _free_names(group):
    """N03's rule on rows (_g, _base) in their order: linear, as the numbers that
    a base can still take only grow."""
    taken, after, names = set(), {}, []
    for base in group["_base"]:
        name, k = base, after.get(base, 2)
        while name in taken:
            name, k = f"{base} {k}", k + 1
        after[base] = k
        taken.add(name)
        names.append(name)
    return group.assign(unique_name=names)


def ensure_unique_names(cols: DataFrame, part: list[str], order: str, name: str = "name") -> DataFrame:
    """Blank -> 'Column i'; a duplicate takes the smallest free number
    >= 2, in column order.

    Only names that are alike but for numbers at their end ('Price', 'Price 2',
    'Price 2 2') can meet. Where such a family has one name, its numbers are
    the rows' places, by a window. The rule is sequential only where it has
    several: these families are grouped and gone through once."""
    w = Window.partitionBy(*part).orderBy(order, name)
    blank = F.trim(F.coalesce(name, F.lit(""))) == ""
    base = F.when(blank, F.concat(F.lit("Column "), F.row_number().over(w).cast("string"))).otherwise(F.trim(name))
    named = cols.select(*part, F.col(order).alias("_o"), F.col(name).alias("_n"), base.alias("_base"))
    family = F.regexp_replace("_base", "( [0-9]+)+$", "")
    named = named.withColumn("_g", F.to_json(F.struct(*part, family.alias("_family"))))
    # min and max instead of a distinct count: combined where the rows lie
    several = named.groupBy("_g").agg((F.min("_base") != F.max("_base")).alias("_several"))
    named = cut_lineage(named.join(several, "_g"), "families")
    k = F.row_number().over(Window.partitionBy(*part, "_base").orderBy("_o", "_n"))
    single = named.filter(~F.col("_several")).withColumn("unique_name", F.when(k == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" "), k.cast("string"))))
    mixed = named.filter("_several").withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy("_o", "_n")))
    _ship_by_value(__name__)
    schema = "_g string, _i int, _base string, unique_name string"
    made = mixed.select("_g", "_i", "_base").groupBy("_g").applyInPandas(lambda g: _free_names(g.sort_values("_i")), schema)
    mixed = mixed.join(made.select("_g", "_i", "unique_name"), ["_g", "_i"])
    return single.select(*part, F.col("_o").alias(order), "unique_name").unionByName(mixed.select(*part, F.col("_o").alias(order), "unique_name"))


def row_numbers(df: DataFrame, order: list) -> DataFrame:
    """Global 1-based row number in ``order`` without a single-partition
    window: range-sort, count rows per partition, add partition offsets.
    The sorted rows are checkpointed once so both passes see one order."""
    sorted_df = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id())
    sorted_df = cut_lineage(sorted_df)
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, safe to broadcast
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offs = offs.fillna(0, subset=["_off"])
    out = sorted_df.join(F.broadcast(offs), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return out.withColumn("row_no", (F.col("_off") + local + 1).cast("bigint")).drop("_pid", "_mid", "_off")
