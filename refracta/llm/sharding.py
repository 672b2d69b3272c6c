"""Shards over fixed virtual slots, with a versioned slot-to-shard map.

Records are hashed into a fixed number of slots, bytes are summed per slot, and whole slots
are placed on shards. A rebalance edits the map: slots stay where they are as long as their
shard is within its fair share, and only the others move. The map has one row per slot and
version, so its size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refracta.functions.text import let
from refracta.llm.common import hash_number, small_side, text_or_empty
from refracta.operators.ordered import row_numbers
from refracta.session import cut_lineage, scratch_path

#: So many that two of the few largest records rarely meet in one slot.
SLOTS = 16384
BATCH = 128
OVERHEAD = 8  # bytes per record besides its text


def _all_slots(spark: SparkSession, slot_bytes: DataFrame, slots: int) -> DataFrame:
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(slot_bytes.select("virtual_slot", "bytes")), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes")
    )


def _placed(moving: Column, loads: Column) -> Column:
    """Largest slot first, each to the shard with the fewest bytes so far.

    Slots are placed a batch at a time, so that the growing map is copied once per batch."""
    nothing = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def put(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])) - 1

        def on(best: Column) -> Column:
            grown = F.transform(
                state["loads"], lambda load, at: F.when(at == best, load + slot["bytes"]).otherwise(load)
            )
            entry = F.struct(slot["virtual_slot"].alias("virtual_slot"), best.alias("shard"))
            return F.struct(grown.alias("loads"), F.concat(state["map"], F.array(entry)).alias("map"))

        return let(least.cast("int"), on)

    def put_batch(state: Column, batch: Column) -> Column:
        placed = F.aggregate(batch, F.struct(state["loads"].alias("loads"), nothing.alias("map")), put)
        return let(
            placed,
            lambda got: F.struct(got["loads"].alias("loads"), F.concat(state["map"], got["map"]).alias("map")),
        )

    starts = F.sequence(F.lit(0), F.floor(F.size(moving) / BATCH).cast("int"))
    batches = F.transform(starts, lambda k: F.slice(moving, k * BATCH + 1, F.lit(BATCH)))
    return F.aggregate(batches, F.struct(loads.alias("loads"), nothing.alias("map")), put_batch)["map"]


def rebalanced(
    slot_bytes: DataFrame, shards: int, current: DataFrame | None = None, slots: int = SLOTS
) -> DataFrame:
    """(virtual_slot, shard) for all slots, from ``slot_bytes`` (virtual_slot, bytes).

    Without a ``current`` map every slot is placed anew. With one, a shard keeps its largest
    slots up to the fair share of bytes; the rest, and slots of shards that no longer exist,
    go to the shards with the fewest bytes. Slots without rows count as 0 bytes. The work
    is on ``slots`` rows, whatever the number of records.
    """
    spark = slot_bytes.sparkSession
    every = _all_slots(spark, slot_bytes, slots)
    if current is None:
        held = every.withColumn("shard", F.lit(None).cast("int"))
    else:
        held = every.join(F.broadcast(current.select("virtual_slot", "shard")), "virtual_slot", "left")
    known = F.col("shard").between(0, shards - 1)
    in_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    held = held.withColumn("upto", F.sum("bytes").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    total = int(held.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    stays = F.coalesce(known & (F.col("upto") <= -(-total // shards)), F.lit(False))
    kept_bytes = [
        F.coalesce(F.sum(F.when(stays & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("bigint")
        for k in range(shards)
    ]
    entry = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes")
    one = held.agg(
        F.sort_array(F.collect_list(F.when(~stays, entry))).alias("moving"),
        F.collect_list(F.when(stays, F.struct("virtual_slot", "shard"))).alias("kept"),
        F.array(*kept_bytes).alias("loads"),
    )
    kept = F.col("kept").cast("array<struct<virtual_slot:int,shard:int>>")
    return one.select(F.inline(F.concat(kept, _placed(F.col("moving"), F.col("loads")))))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Write one version of the map; a version is written once and never changed."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(virtual_slot, shard) of one version."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``number`` that counts rows of one ``key`` from 0.

    Such rows are the same but for their place, so it does not matter which gets which number.
    Keys are counted before they move; only rows of repeated keys are sorted, by range, with
    their place as the last part of the order, so a key of any size is spread over ranges.
    """
    repeated = small_side(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    once = rows.join(repeated, "key", "left_anti").withColumn("number", F.lit(0).cast("bigint"))
    again = row_numbers(rows.join(repeated, "key", "left_semi"), ["place"], "number", ["key"])
    again = again.withColumn("number", (F.col("number") - 1).cast("bigint"))
    return once.unionByName(again.select(once.columns))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, key, number, virtual_slot) per row of ``docs``.

    ``key`` is the MD5 of doc_id and text, ``number`` counts the rows that are equal in both;
    together they choose the slot, so that repeats of a row are spread like any other rows.
    """
    text = text_or_empty()
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(key).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    slot = F.pmod(hash_number(F.lower(F.hex("key")), F.col("number")), F.lit(slots)).cast("int")
    return _numbered(cut_lineage(rows)).drop("place").withColumn("virtual_slot", slot)


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its shard, by equal bytes.

    size          UTF-8 bytes of the text (NULL: none) plus 8
    text_crc32    unsigned CRC-32 of the text (NULL: of no bytes)
    shard         0 .. shards - 1, by the slot map
    slot          place within the shard, from 0 without gaps
    virtual_slot  the fixed slot that the map places

    Shards differ by no more than the bytes of one slot. Equal texts are spread, whether they
    differ in doc_id or are the same row repeated, so no group of copies is in one shard. Rows
    equal in doc_id and text are interchangeable; reruns place as many of them in each shard.
    A NULL doc_id is placed by its text. Other columns are ignored, whatever
    their names. An empty table gives an empty table. The map is stored as version 1 under
    ``map_path`` (a fresh folder beside the checkpoints by default).
    """
    spark = docs.sparkSession
    rows = cut_lineage(slotted(docs, slots))
    slot_bytes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    path = map_path or scratch_path(spark, "slot-map")
    save_map(rebalanced(slot_bytes, shards, slots=slots), path, 1)
    placed = rows.join(F.broadcast(read_map(spark, path, 1)), "virtual_slot")
    order = ["virtual_slot", "key", "number"]
    numbered = row_numbers(placed, order, "place", ["shard"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
