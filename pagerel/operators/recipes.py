"""Recipe tables.

A recipe is data (``schema.RECIPE``): row selector and column selectors are
step arrays, pagination and options are structs. Applying recipes to pages
is a join on the page host; selector evaluation is ``select.Matcher``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.urls import host_of
from ..schema import RECIPE, STEPS

# Why a recipe cannot run (own codes).
NEED_ROWS = "needs_rows_and_columns"
NEED_NEXT = "needs_next_target"
NEED_MORE = "needs_load_more_target"


def _pos_or(c: Column, default: int) -> Column:
    """JS ``Number(x) || default`` for an int column."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def normalize_recipes(df: DataFrame) -> DataFrame:
    """Defaults and clamps: type none / max_pages 10 / delay 800 ->
    invalid 0 / timeout 20000; unknown attr -> text; unknown pagination ->
    none; max_pages >= 1; delay >= 0; timeout >= 3000; a target without
    selector steps -> null; options default dedupe on, append off, page
    url off."""
    d = rules.RECIPE_DEFAULTS
    cols = F.transform(
        F.filter(F.coalesce(F.col("columns"), F.array()), lambda c: c.isNotNull()),
        lambda c: F.struct(
            F.coalesce(F.when(c["name"] != "", c["name"]), F.lit("Column")).alias("name"),
            F.coalesce(c["steps"], F.array().cast(STEPS)).alias("steps"),
            F.when(c["attr"].isin(*rules.VALUE_MODES), c["attr"]).otherwise(F.lit("text")).alias("attr"),
            F.coalesce(c["attr_name"], F.lit("")).alias("attr_name"),
        ))
    p = F.col("pagination")
    tgt = p["target"]
    target = F.when(tgt.isNull() | (F.size(F.coalesce(tgt["steps"], F.array())) == 0), F.lit(None)).otherwise(
        F.struct(tgt["steps"].alias("steps"), F.coalesce(tgt["text"], F.lit("")).alias("text"),
                 F.coalesce(tgt["aria"], F.lit("")).alias("aria"), F.coalesce(tgt["rel"], F.lit("")).alias("rel")))
    pag = F.struct(
        F.when(p["type"].isin(*rules.PAGINATION_TYPES), p["type"]).otherwise(F.lit("none")).alias("type"),
        target.alias("target"),
        F.greatest(F.lit(1), _pos_or(p["max_pages"], d["max_pages"])).cast("int").alias("max_pages"),
        F.greatest(F.lit(0), F.coalesce(p["delay_ms"], F.lit(d["delay_ms"]))).cast("int").alias("delay_ms"),
        F.greatest(F.lit(rules.TIMEOUT_MIN_MS), _pos_or(p["timeout_ms"], d["timeout_ms"])).cast("int").alias("timeout_ms"),
    )
    o = F.col("options")
    opts = F.struct(F.coalesce(o["dedupe"], F.lit(d["dedupe"])).alias("dedupe"),
                    F.coalesce(o["append"], F.lit(d["append"])).alias("append"),
                    F.coalesce(o["page_url"], F.lit(d["page_url"])).alias("page_url"))
    return df.select(
        F.col("id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("row_steps", F.array().cast(STEPS)).alias("row_steps"), cols.alias("columns"),
        F.when(F.col("pagination").isNull(), F.struct(F.lit("none").alias("type"), F.lit(None).cast(RECIPE["pagination"].dataType["target"].dataType).alias("target"),
                                                     F.lit(d["max_pages"]).alias("max_pages"), F.lit(d["delay_ms"]).alias("delay_ms"),
                                                     F.lit(d["timeout_ms"]).alias("timeout_ms"))).otherwise(pag).cast(RECIPE["pagination"].dataType).alias("pagination"),
        F.when(F.col("options").isNull(), F.struct(F.lit(d["dedupe"]).alias("dedupe"), F.lit(d["append"]).alias("append"),
                                                  F.lit(d["page_url"]).alias("page_url"))).otherwise(opts).alias("options"),
    )


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Import recipes from JSON: an array, {recipes: [...]},
    {recipe: ...} or a bare recipe, one document to a file (over any number
    of lines) or one to a line, as S05 writes them. Keeps those with a row
    selector or a column; gives each a new id; name <- name, host or
    'imported'. An import without any recipe is an error."""
    from pyspark.sql import types as T

    wrapper = T.StructType([T.StructField("recipes", T.ArrayType(RECIPE)), T.StructField("recipe", RECIPE)] + list(RECIPE.fields))
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("doc"))
    lines = F.filter(F.split("doc", "\r?\n"), lambda x: F.trim(x) != "")
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())
    docs = files.select(F.explode(F.when(by_line, lines).otherwise(F.array("doc"))).alias("doc"))
    docs = docs.select(F.explode(F.when(F.ltrim("doc").startswith("["), F.from_json("doc", T.ArrayType(wrapper)))
                                 .otherwise(F.array(F.from_json("doc", wrapper)))).alias("d")).select("d.*")
    bare = F.struct(*[F.col(f.name) for f in RECIPE.fields])
    one = docs.select(F.explode(F.coalesce(F.col("recipes"), F.when(F.col("recipe").isNotNull(), F.array(F.col("recipe"))),
                                           F.array(bare))).alias("r")).select("r.*")
    n = normalize_recipes(one).filter((F.size("row_steps") > 0) | (F.size("columns") > 0))
    n = n.withColumn("id", F.expr("uuid()")).withColumn(
        "name", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.when(F.col("host") != "", F.col("host")), F.lit("imported")))
    if n.isEmpty():
        raise ValueError("no_recipe: nothing to import")
    return n


def recipe_slug(name: Column, host: Column) -> Column:
    s = F.lower(F.coalesce(F.when(name != "", name), F.when(host != "", host), F.lit("recipe")))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit("recipe")).otherwise(s)


def export_recipes(df: DataFrame, version: int = 3) -> DataFrame:
    """One versioned JSON document per recipe, ids stripped from the
    recipe and its columns, plus the file slug."""
    rec = F.struct(*[F.col(f.name) for f in RECIPE.fields if f.name != "id"])
    doc = F.to_json(F.struct(F.lit(version).alias("version"), rec.alias("recipe")))
    return df.select(recipe_slug(F.col("name"), F.col("host")).alias("slug"), doc.alias("json"))


def write_recipes(df: DataFrame, path: str) -> None:
    export_recipes(df).select("json").write.mode("overwrite").text(path)


def upsert_recipes(recipes: DataFrame, changed: DataFrame) -> DataFrame:
    """Save / rename by id (replace rows with the same id, add new ones)."""
    return recipes.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(recipes.columns))


def delete_recipes(recipes: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete by id."""
    return recipes.join(ids.select("id"), "id", "left_anti")


def edit_columns(ds: DataFrame, recipes: DataFrame, edits: list[tuple[str, str | None]], keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Apply (old name -> new name | None to remove) edits, in the new
    order, to the dataset's columns and to every recipe's column array."""
    kept = [(o, n) for o, n in edits if n is not None]
    ds2 = ds.select(*keep, *[F.col(f"`{o}`").alias(n) for o, n in kept])
    order = F.create_map(*[x for i, (o, _) in enumerate(kept) for x in (F.lit(o), F.lit(i))])
    rename = F.create_map(*[x for o, n in kept for x in (F.lit(o), F.lit(n))])
    cols = F.filter("columns", lambda c: order[c["name"]].isNotNull())
    cols = F.array_sort(cols, lambda x, y: order[x["name"]] - order[y["name"]])
    rec2 = recipes.withColumn("columns", F.transform(cols, lambda c: c.withField("name", rename[c["name"]])))
    return ds2, rec2


def edit_reads(recipes: DataFrame, edits: DataFrame) -> DataFrame:
    """Change how columns are read. edits: (id, name, attr, attr_name,
    steps), null where a property stays; an unknown mode becomes text, and a
    mode other than 'attr' drops the attribute's name."""
    per = edits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("attr", "attr_name", "steps")))).alias("_by"))

    def edited(c: Column) -> Column:
        e = F.try_element_at(F.col("_by"), c["name"])
        mode = F.coalesce(e["attr"], c["attr"])
        mode = F.when(mode.isin(*rules.VALUE_MODES), mode).otherwise(F.lit("text"))
        new = (c.withField("attr", mode).withField("attr_name", F.when(mode == "attr", F.coalesce(e["attr_name"], c["attr_name"])).otherwise(F.lit("")))
               .withField("steps", F.coalesce(e["steps"], c["steps"])))
        return F.when(e.isNotNull(), new).otherwise(c)

    return recipes.join(per, "id", "left").withColumn("columns", F.when(F.col("_by").isNull(), F.col("columns")).otherwise(F.transform("columns", edited))).drop("_by")


def check_recipes(df: DataFrame) -> DataFrame:
    """Why a run cannot start ('' when it can)."""
    p = F.col("pagination")
    reason = (F.when((F.size("row_steps") == 0) | (F.size("columns") == 0), F.lit(NEED_ROWS))
              .when((p["type"] == "next") & p["target"].isNull(), F.lit(NEED_NEXT))
              .when((p["type"] == "loadmore") & p["target"].isNull(), F.lit(NEED_MORE))
              .otherwise(F.lit("")))
    return df.withColumn("reason", reason)


def pages_for(recipes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pair each recipe with the pages of its host; how the join runs is
    left to the optimizer, which knows or measures the recipes' size."""
    r = recipes.select("id", "name", F.lower(F.regexp_replace("host", r"^www\.", "")).alias("host"))
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"))
    return p.join(r, "host")


def recipe_list(recipes: DataFrame, hosts: DataFrame) -> DataFrame:
    """For each host its list of recipes: those of the host first, then
    the others, each by name. As every host's list ends with all recipes of
    other hosts, what is returned is the order itself: (host, id, place) of the
    host's own, and (id, place) of all by name with host null, to go on with.
    hosts: (host)"""
    r = recipes.select("id", "name", F.lower(F.regexp_replace("host", r"^www\.", "")).alias("host"))
    own = r.join(hosts.select("host").distinct(), "host").withColumn(
        "place", F.row_number().over(Window.partitionBy("host").orderBy("name", "id"))).select("host", "id", "place")
    from .dataset import row_numbers

    every = row_numbers(r.select("id", "name"), ["name", "id"]).select(F.lit(None).cast("string").alias("host"), "id", F.col("row_no").cast("int").alias("place"))
    return own.unionByName(every)


def rank_recipes(recipes: DataFrame, pages: DataFrame) -> DataFrame:
    """The default recipe of each page: the first same-host recipe by
    name, else the first recipe by name overall (rank 1 of the reference's
    list, which shows same-host recipes first)."""
    r = recipes.select("id", "name", F.lower(F.regexp_replace("host", r"^www\.", "")).alias("host"))
    per_host = r.groupBy("host").agg(F.min_by("id", F.struct("name", "id")).alias("host_id"))
    # the overall default is one aggregated value (a scalar), used as a literal
    any_id = r.agg(F.min_by("id", F.struct("name", "id"))).first()[0]
    p = pages.select("page_id", host_of(F.col("url")).alias("host")).join(per_host, "host", "left")
    return p.select("page_id", "host", F.coalesce("host_id", F.lit(any_id)).alias("recipe_id"),
                    F.col("host_id").isNotNull().alias("same_host"))
