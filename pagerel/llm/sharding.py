"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 4,096 slots, or four and more for each shard. Each shard puts
virtual nodes on it, the first where no other shard's first is, so that each
owns a slot, and a slot belongs to the next node clockwise. A key goes to its slot's shard;
where that is full, it continues clockwise to the next node whose shard is
not. Shards are bounded to counts at most one apart, so the balance is exact,
and only what overflows moves away from its own slot.

Keys are taken in ring order, so what a slot's shard takes are consecutive
ranks of that order. One pass over the counts of the slots gives every step's
share (bounded by the slots, whatever the data); a document needs no more
than its rank on the ring, which a range sort gives, so an id that very many
rows have (or none) is no task's group. All of it is DataFrame operations.

Defined cases: null text has size 16 and the CRC of nothing; a null id is a
key like any other; rows alike share their place on the ring, each has a slot
of its own in a shard; fewer rows than shards leave shards empty, and an empty
table all; extra columns stay, but for those with the names of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagerel.llm.common import carried, stored
from pagerel.operators.dataset import row_numbers

SLOTS = 4096
NODES = 64  # of each shard
SALT = "ring-1"


def ring(spark, shards: int, slots: int = SLOTS, nodes: int = NODES) -> DataFrame:
    """(slot, shard): the owner of each slot, the next node clockwise."""
    shard = F.col("id").cast("int")
    # a shard's first node: shards in a shuffled order, evenly round the ring
    first = spark.range(shards).select(shard.alias("shard"), (F.row_number().over(Window.orderBy(F.xxhash64(F.lit(SALT), "id"), "id")) - 1).alias("nth"))
    first = first.select("shard", F.expr(f"nth * {slots}L div {shards}").alias("slot"), F.lit(True).alias("own"), F.lit(0).cast("bigint").alias("hash"))
    more = (spark.range(shards).select(shard.alias("shard"), F.explode(F.sequence(F.lit(1), F.lit(nodes))).alias("node"))
            .withColumn("hash", F.xxhash64(F.lit(SALT), "shard", "node")).select("shard", F.pmod("hash", F.lit(slots)).alias("slot"), F.lit(False).alias("own"), "hash"))
    at = first.unionByName(more).groupBy("slot").agg(F.min_by("shard", F.struct(~F.col("own"), "hash")).alias("shard"))
    every = spark.range(slots).select(F.col("id").alias("slot")).join(at, "slot", "left")
    clockwise = Window.orderBy("slot")
    onward = F.first("shard", True).over(clockwise.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    wrap = F.first("shard", True).over(clockwise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return every.select("slot", F.coalesce(onward, wrap).alias("shard"))


def shares(loads: DataFrame, shards: int, slots: int) -> DataFrame:
    """(step, shard, n): going clockwise twice from slot 0, how many keys each
    step takes; ``loads`` has (slot, shard, n) of every slot. Keys wait in
    line: those that overflowed come before the slot's own."""
    row = loads.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "shard", "n"))), lambda s: F.struct(s["shard"].alias("shard"), s["n"].alias("n"))).alias("ring"),
                    F.sum("n").alias("total"))
    row = row.withColumn("free", F.expr(f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L))"))
    here = f"ring[i % {slots}].shard"
    take = f"least(acc.free[{here}], acc.waiting + if(i < {slots}, ring[i].n, 0L))"
    fold = f"""aggregate(sequence(0, {2 * slots - 1}),
      named_struct('free', free, 'waiting', 0L, 'taken', cast(array() as array<struct<step: int, shard: int, n: bigint>>)),
      (acc, i) -> if({take} = 0 and (i >= {slots} or ring[i].n = 0), acc, named_struct(
        'free', transform(acc.free, (f, s) -> if(s = {here}, f - {take}, f)),
        'waiting', acc.waiting + if(i < {slots}, ring[i].n, 0L) - {take},
        'taken', if({take} = 0, acc.taken, concat(acc.taken, array(named_struct('step', i, 'shard', {here}, 'n', {take})))))),
      acc -> acc.taken)"""
    return row.select(F.inline(F.expr(fold)))


def plan(keys: DataFrame, shards: int, slots: int = SLOTS, nodes: int = NODES) -> DataFrame:
    """(slot, before, parts): for every slot with keys the rank of its first
    key and the parts (from, n, shard, place) of the ring order that its keys
    fall into. As many rows as slots at most."""
    counts = keys.groupBy("slot").agg(F.count("*").alias("n"))
    loads = stored(ring(keys.sparkSession, shards, slots, nodes).join(counts, "slot", "left").fillna(0, ["n"]), "ring-loads")
    up_to = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("shard").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    parts = shares(loads, shards, slots).select(F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("from"), "n", "shard",
                                                F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("place"))
    starts = loads.filter("n > 0").select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # slots and parts on one line of ranks: a part meets the slot it starts
    # in, a slot the part that it starts in
    none = F.lit(None)
    part = F.struct("from", "n", "shard", "place")
    kind = "struct<from:bigint,n:bigint,shard:int,place:bigint>"
    line = (parts.select(F.col("from").alias("rank"), part.cast(kind).alias("part"), none.cast("struct<slot:bigint,before:bigint>").alias("own"))
            .unionByName(starts.select(F.col("before").alias("rank"), none.cast(kind).alias("part"), F.struct("slot", "before").alias("own"))))
    so_far = Window.orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.select(F.coalesce("own", F.last("own", True).over(so_far)).alias("own"), F.coalesce("part", F.last("part", True).over(so_far)).alias("part"))
    return met.groupBy("own.slot", "own.before").agg(F.collect_set("part").alias("parts"))


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 40, slots: int | None = None, nodes: int = NODES) -> DataFrame:
    """``docs`` without ``text``, with _size (bytes + 16), _crc (of the text),
    _shard and _slot (0, 1, ... in each shard)."""
    slots = slots or max(SLOTS, 1 << (4 * shards - 1).bit_length())
    kept = docs.drop("_size", "_crc", "_shard", "_slot")
    own = carried(kept, text, id=id_col, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    where = F.xxhash64(F.lit(SALT), F.col("id"))
    sized = own.select("_row", "id", F.pmod(where, F.lit(slots)).alias("slot"), (F.octet_length("text").cast("bigint") + 16).alias("size"), F.crc32("text").alias("crc"))
    sized = stored(sized, "ring-keys")
    planned = stored(plan(sized.select("slot"), shards, slots, nodes), "ring-plan").drop("before")
    # rows alike in all are told apart by a row number, so no range is one value
    numbered = row_numbers(sized.withColumn("nth", F.monotonically_increasing_id()), ["slot", where, "id", "crc", "size", F.xxhash64("nth"), "nth"])
    ranked = numbered.withColumn("rank", F.col("row_no") - 1).join(F.broadcast(planned), "slot")  # a row for each slot at most
    part = F.expr("filter(parts, p -> rank >= p.from and rank < p.from + p.n)[0]")
    return ranked.withColumn("part", part).select(
        "_row.*", F.col("size").alias("_size"), F.col("crc").alias("_crc"), F.col("part.shard").alias("_shard"),
        (F.col("part.place") + F.col("rank") - F.col("part.from")).alias("_slot"))
