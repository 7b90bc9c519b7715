"""Shards of near equal bytes through a fixed number of virtual slots.

A record is hashed to one of some thousand virtual slots for good. The bytes per
slot are aggregated, and a stored table, the slot map, says which shard a slot is
in. To rebalance, a new version of the map is written in which as few slots as
possible have moved; no record is hashed anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.numbered import numbered
from sievework.storage import materialise, scratch_path

# Bytes a record takes besides its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class ShardSettings:
    n_shards: int = 40
    # Virtual slots; never to be changed for a data set. Some 100 per shard.
    n_slots: int = 4096
    # A shard may exceed its even share by this before slots leave it.
    tolerance: float = 0.02


def records(df: DataFrame, id: str, text: str, settings: ShardSettings) -> DataFrame:
    """Id, size, checksum and virtual slot of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = df.select(
        F.col(id).alias("id"),
        (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
    )
    slot = F.pmod(F.xxhash64("id", "size", "crc"), F.lit(settings.n_slots)).cast("int")
    return sized.withColumn("virtual_slot", slot)


def slot_bytes(rows: DataFrame, settings: ShardSettings) -> DataFrame:
    """Bytes of every virtual slot, also of empty ones: `n_slots` rows."""
    filled = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    every = rows.sparkSession.range(settings.n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(filled, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes")
    )


def _assigned(slots: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """Put each slot, largest first, on the shard that is then the least loaded.
    `loads(shard, bytes)` is what shards hold already. The `n_slots` slots are one
    array, so this is one row however large the data is."""
    # Slots and loads as rows of one table, so that one aggregate makes the row.
    slot = F.struct((-F.col("bytes")).alias("minus"), "virtual_slot")
    load = F.struct("shard", "bytes")
    both = slots.select(slot.alias("slot"), F.lit(None).cast("struct<shard:int,bytes:bigint>").alias("load")).unionByName(
        loads.select(F.lit(None).cast("struct<minus:bigint,virtual_slot:int>").alias("slot"), load.alias("load"))
    )
    # Aggregates leave out nulls.
    row = both.agg(
        F.array_sort(F.collect_list("slot")).alias("queue"),
        F.map_from_entries(F.collect_list("load")).alias("held"),
    ).select(
        "queue", F.expr(f"transform(sequence(0, {n_shards - 1}), i -> coalesce(held[i], 0L))").alias("loads")
    )
    filled = row.select(
        F.expr(
            """
            aggregate(
              queue,
              named_struct('loads', loads, 'placed', cast(array() as array<struct<virtual_slot:int,bytes:bigint,shard:int>>)),
              (state, slot) -> named_struct(
                'loads', transform(state.loads, (x, i) ->
                  if(i = array_position(state.loads, array_min(state.loads)) - 1, x - slot.minus, x)),
                'placed', array_append(state.placed, named_struct(
                  'virtual_slot', slot.virtual_slot, 'bytes', -slot.minus,
                  'shard', cast(array_position(state.loads, array_min(state.loads)) - 1 as int)))),
              state -> state.placed)
            """
        ).alias("placed")
    )
    return filled.select(F.inline("placed"))


def first_map(slots: DataFrame, settings: ShardSettings) -> DataFrame:
    """Version 1 of the slot map."""
    none = slots.sparkSession.range(0).select(F.col("id").cast("int").alias("shard"), F.col("id").alias("bytes"))
    return _assigned(slots, none, settings.n_shards).withColumn("version", F.lit(1))


def rebalanced(slot_map: DataFrame, slots: DataFrame, settings: ShardSettings) -> DataFrame:
    """The next version of `slot_map` for the bytes `slots` hold now, or for
    another number of shards.

    A shard keeps its largest slots up to its even share; only what goes beyond,
    and the slots of shards that are gone, is placed anew.
    """
    old = slot_map.select("virtual_slot", "shard", "version").join(slots, "virtual_slot")
    total = slots.agg(F.sum("bytes")).first()[0] or 0
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    held = old.withColumn("upto", F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    share = total / settings.n_shards * (1 + settings.tolerance)
    judged = materialise(
        held.withColumn("stays", (F.col("upto") <= share) & (F.col("shard") < settings.n_shards)), "slots"
    )
    kept = judged.where("stays").select("virtual_slot", "bytes", "shard")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    moved = _assigned(judged.where("NOT stays").select("virtual_slot", "bytes"), loads, settings.n_shards)
    version = slot_map.agg(F.max("version")).first()[0] + 1
    return kept.unionByName(moved).withColumn("version", F.lit(version))


def write_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Store one version of the slot map beside the earlier ones and read it back."""
    slot_map.write.mode("append").partitionBy("version").parquet(folder)
    stored = slot_map.sparkSession.read.parquet(folder)
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest)


def shard(
    df: DataFrame, id: str = "doc_id", text: str = "text",
    settings: ShardSettings = ShardSettings(), map_folder: str | None = None,
) -> DataFrame:
    """Per row its id, `size`, `text_crc32`, `law`, `shard`, its place `slot` in
    the shard (gapless from 0), `grown_shard` (null) and `virtual_slot`. Runs jobs.

    The law is `bytes`: the sizes of the shards are near equal. A null text is an
    empty one; rows with a null id and repeated rows are records like any other. A text
    of any length is one record and is not cut.
    Other columns are not read, whatever their names; no rows give no rows.
    """
    spark = df.sparkSession
    rows = materialise(records(df, id, text, settings), "records")
    folder = map_folder or scratch_path(spark, "slot-map")
    slot_map = write_map(first_map(slot_bytes(rows, settings), settings), folder)
    # Broadcast: `n_slots` rows of 8 bytes.
    placed = rows.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    in_order = [F.col("virtual_slot"), F.col("id"), F.col("crc"), F.col("size")]
    return numbered(placed, "slot", in_order, ["shard"]).select(
        F.col("id").alias(id),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
