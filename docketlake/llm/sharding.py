"""Sharding by fixed virtual slots and a versioned map from slots to shards.

A record's slot is a hash of its id and text, so it never changes. Bytes are summed per slot
(``slots`` rows, whatever the number of records), and the map says which shard owns a slot.
Version 0 deals slots out in turn; every rebalancing edits the last version by moving slots
from full to empty shards and stores the next one. Old versions stay readable.

A record weighs the UTF-8 bytes of its text plus one (a null text is empty). Ids and texts may
be null. Records equal in id and text share a slot. The table may be empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlake.llm.common import shared_dir

SLOTS = 8192


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(key: Column, crc: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, crc), F.lit(slots)).cast("int")


def slot_weights(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per virtual slot; at most as many entries as there are slots."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in sums.collect()}


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(owners: list[int], weights: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The map after moving slots, each time the one that best halves the gap between the
    fullest and the emptiest shard, until no move narrows a gap. Shards that have gone
    (numbers of ``shards`` and above) are emptied first."""
    owners, weigh = list(owners), lambda s: weights.get(s, (0, 0))[0]
    load, held = [0] * shards, [set() for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(owners):
        if shard < shards:
            load[shard] += weigh(slot)
            held[shard].add(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-weigh(s), s)):
        to = min(range(shards), key=lambda k: (load[k], k))
        owners[slot] = to
        load[to] += weigh(slot)
        held[to].add(slot)
    while True:
        full, empty = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[full] - load[empty]
        movable = [s for s in held[full] if 0 < weigh(s) < gap]
        if not movable:
            return owners
        slot = min(movable, key=lambda s: (abs(2 * weigh(s) - gap), s))
        held[full].remove(slot)
        held[empty].add(slot)
        owners[slot] = empty
        load[full] -= weigh(slot)
        load[empty] += weigh(slot)


def map_frame(spark: SparkSession, owners: list[int], weights: dict[int, tuple[int, int]]) -> DataFrame:
    """One row per slot: its shard, and where its rows begin among those of the shard."""
    begins, rows = {}, []
    for slot, shard in enumerate(owners):
        rows.append((slot, shard, begins.get(shard, 0)))
        begins[shard] = begins.get(shard, 0) + weights.get(slot, (0, 0))[1]
    return spark.createDataFrame(rows, "virtual_slot int, shard int, first_row long")


def store_map(spark: SparkSession, owners: list[int], weights: dict[int, tuple[int, int]], path: str, version: int) -> None:
    map_frame(spark, owners, weights).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, first_row long").parquet(f"{path}/version={version}")


def owners_of(spark: SparkSession, path: str, version: int) -> list[int]:
    return [r["shard"] for r in sorted(read_map(spark, path, version).collect(), key=lambda r: r["virtual_slot"])]


def shard_records(docs: DataFrame, shards: int, path: str, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each record with its size, text_crc32, virtual_slot, shard and slot (its place in the
    shard, gapless from 0). Stores versions 0 and 1 of the map below ``path``.

    Only ids and sizes are shuffled, once, by virtual slot; the map has ``slots`` rows and is broadcast.
    """
    spark = docs.sparkSession
    crc, of = text_crc(F.col(text)), F.col(key)
    records = docs.select(of.alias(key), record_bytes(F.col(text)).alias("size"), crc.alias("text_crc32"))
    records = records.withColumn("virtual_slot", slot_of(F.col(key), F.col("text_crc32"), slots))
    weights = slot_weights(records)
    owners = first_map(shards, slots)
    store_map(spark, owners, weights, path, 0)
    store_map(spark, rebalance(owners, weights, shards), weights, path, 1)
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")) - 1
    return (records.join(F.broadcast(read_map(spark, path, 1)), "virtual_slot")
            .withColumn("slot", F.col("first_row") + place).drop("first_row"))


def sharded(spark, docs):
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/slot-map-{uuid.uuid4().hex}"
    found = shard_records(docs.select("doc_id", "text"), 8, path)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_sharding(spark, sf_dir):
    return sharded(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shard_documents(spark, docs, sf_dir):
    """Pipeline stage: where every document goes."""
    return sharded(spark, docs)
