"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots, bytes are summed per slot, and a slot-to-shard map says where a slot lives.
The map is a versioned table: a new version is written when shards are added or the load drifts, and only the slots it
edits move. The law that holds is `bytes`: slots go to shards heaviest first, each to the least loaded shard, so shard
sizes differ by less than one late, light slot.

Memory does not grow with the input: the map has one row per slot, whatever the table's size, and is the only thing
that one task sees whole. Numbers within a shard come from counts per slot and a number within the slot.

Defined results: a null text has size 1 (no bytes, plus one) and the CRC of nothing, 0; null ids are records like any
other; repeated rows are separate records; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saidso.session import materialize

SLOTS = 4096
#: Records of one id and text that stay in one slot.
COPIES = 16


def sized(docs: DataFrame, slots: int = SLOTS, copies: int = COPIES) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), text_crc32 and virtual slot of every record, written once.

    Records of one id and text lie in one slot, unless there are more than `copies` of them: those are numbered where they are
    read and hash with their numbers, so they go over all slots.
    """
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    sizes = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), crc.alias("text_crc32"))
    # The numbers are those of this one pass over the input, so it is written before anything is counted.
    sizes = materialize(sizes.withColumn("_row", F.monotonically_increasing_id()))
    again = sizes.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("n")).where(F.col("n") > copies)
    again = materialize(again.select(F.xxhash64("doc_id", "text_crc32").alias("_pair")).distinct())
    pair = F.xxhash64("doc_id", "text_crc32")
    marked = sizes.withColumn("_pair", pair).join(again.withColumn("_many", F.lit(True)), "_pair", "left")
    salted = F.when(F.col("_many"), F.xxhash64("_pair", "_row")).otherwise(F.col("_pair"))
    return materialize(marked.select("doc_id", "size", "text_crc32", F.pmod(salted, F.lit(slots)).cast("int").alias("vslot")))


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and records of each slot that has any."""
    return records.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def _add(loads: Column, shard: Column, size: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + size).otherwise(x))


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: slots by falling bytes, each to the shard with the fewest bytes so far."""
    heavy = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("w"), "vslot")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("out"))

    def place(state: Column, slot: Column) -> Column:
        shard = _lightest(state["loads"])
        return F.struct(_add(state["loads"], shard, -slot["w"]).alias("loads"), F.concat(state["out"], F.array(F.struct(slot["vslot"].alias("vslot"), shard.alias("shard")))).alias("out"))

    return loads.agg(F.aggregate(heavy, start, place, lambda s: s["out"]).alias("m")).select(F.lit(1).alias("version"), F.inline("m"))


def rebalanced(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version for `shards` shards, at least as many as now.

    Slots leave a shard only while it is above the new mean, and go only to the least loaded shard below the mean that
    they still fit into, heaviest slots first; every other slot stays. Slots without records keep their shard.
    """
    held = current.join(loads, "vslot", "left").select("version", "vslot", "shard", F.coalesce("slot_bytes", F.lit(0).cast("long")).alias("w"))
    slots = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("n"), "vslot", "shard")))
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    packed = held.agg((F.max("version") + 1).alias("version"), (F.sum("w") / shards).alias("mean"), slots.alias("slots"))
    packed = packed.where("slots[0] IS NOT NULL").withColumn("loads", F.aggregate("slots", zero, lambda loads, s: _add(loads, s["shard"], -s["n"])))
    start = F.struct("loads", "mean", F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("out"))

    def edit(state: Column, slot: Column) -> Column:
        size, to = -slot["n"], _lightest(state["loads"])
        moves = (F.get(state["loads"], slot["shard"]) - size >= state["mean"]) & (F.get(state["loads"], to) + size <= state["mean"])
        loads = F.when(moves, _add(_add(state["loads"], slot["shard"], slot["n"]), to, size)).otherwise(state["loads"])
        shard = F.when(moves, to).otherwise(slot["shard"])
        return F.struct(loads.alias("loads"), state["mean"].alias("mean"), F.concat(state["out"], F.array(F.struct(slot["vslot"].alias("vslot"), shard.alias("shard")))).alias("out"))

    return packed.select("version", F.inline(F.aggregate("slots", start, edit, lambda s: s["out"])))


def save_map(new: DataFrame, folder: str) -> None:
    """Add a version to the map kept in `folder`; older versions stay readable. Writing a version again replaces it."""
    new.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The named version of the map, the newest if none is named."""
    every = spark.read.parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select(F.col("version").cast("int").alias("version"), "vslot", "shard")


def placed(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """`records` with shard and slot, the place in the shard, gapless from 0: by virtual slot, then doc_id, checksum and size."""
    counts = slot_loads(records).join(mapping.select("vslot", "shard"), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("vslot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = records.withColumn("_n", F.row_number().over(within))
    # One row per slot, so the map is small at any input size.
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", F.col("_start") + F.col("_n") - 1).drop("_start", "_n")


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Every record with size, text_crc32, vslot, shard and slot, under a fresh map."""
    records = sized(docs, slots)
    return placed(records, first_map(slot_loads(records), shards))


def shard_by_map(docs: DataFrame, folder: str, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """`shard_documents` under the map kept in `folder`, with `next_shard`, where a record goes when one shard is added.

    A map that is there is used as it is; else version 1 is made for these records. The edited map is saved as the version after.
    """
    spark = docs.sparkSession
    records = sized(docs, slots)
    loads = materialize(slot_loads(records))
    try:
        current = load_map(spark, folder)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        made = materialize(first_map(loads, shards))
        if made.isEmpty():
            return placed(records, made).withColumn("next_shard", F.col("shard"))
        save_map(made, folder)
        current = load_map(spark, folder)
    current = materialize(current)
    save_map(rebalanced(current, loads, shards + 1), folder)
    grown = load_map(spark, folder).select("vslot", F.col("shard").alias("next_shard"))
    # One row per slot.
    return placed(records, current).join(F.broadcast(grown), "vslot", "left")
