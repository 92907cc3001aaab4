"""Sharding by fixed virtual slots.

Records hash to one of a fixed number of slots; only the slot-to-shard map decides where a slot
lives. The map is a small versioned table: building it packs slots by their bytes, rebalancing edits
as few entries as the imbalance needs, and records never have to be hashed again.

``shard_documents`` uses it as a growing corpus does: a first part of the records packs version 0, the loads of all
records edit it to version 1, which places them.

Defined results: a null text has size 8 and crc32 0; a null ``doc_id`` hashes as the string
``null``; repeated rows each take their own place; only the size of a very long text is moved; an empty table gives an
empty result and a map in which every slot holds 0 bytes. Extra columns are ignored, whatever their names. Equal texts are
no unit: they are dealt by ``doc_id``, since one text may be a third of all rows; ``text_crc32`` names them.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty

N_SLOTS = 8192
OVERHEAD = 8


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """Virtual slot of a key: 32 bits of its md5, the same in every engine and release."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(n_slots)).cast("int")


def sized(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Narrow rows (doc_id, size, text_crc32, vslot): the text itself is never shuffled."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        slot_of(F.col("doc_id"), n_slots).alias("vslot"),
    )


def slot_loads(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot, and its bytes in the first part; partial sums leave at most one row per slot and task.

    The first part is the half of the records that another hash of the id names."""
    first = F.xxhash64("doc_id") >= 0
    return rows.groupBy("vslot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(first, F.col("size")).otherwise(0)).alias("before")
    )


def pack(loads: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Longest-processing-time packing: heaviest slot first, each to the lightest shard (lowest number on ties)."""
    heap = [(0, s) for s in range(n_shards)]
    owner = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda v: (-loads.get(v, 0), v)):
        total, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (total + loads.get(slot, 0), shard))
    return owner


def rebalance(owner: list[int], loads: dict[int, int], n_shards: int, tolerance: float = 0.02) -> list[int]:
    """Edit a map for new loads or a new shard count: move slots from the heaviest to the lightest shard
    until all are within ``tolerance`` of the mean or no move helps; all other slots stay."""
    owner = list(owner)
    totals = [0] * n_shards
    held: list[set[int]] = [set() for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(owner):
        if shard < n_shards:
            totals[shard] += loads.get(slot, 0)
            held[shard].add(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda v: (-loads.get(v, 0), v)):
        to = min(range(n_shards), key=lambda s: (totals[s], s))
        owner[slot] = to
        totals[to] += loads.get(slot, 0)
        held[to].add(slot)
    mean = sum(totals) / n_shards
    while True:
        src = max(range(n_shards), key=lambda s: (totals[s], -s))
        dst = min(range(n_shards), key=lambda s: (totals[s], s))
        if totals[src] <= mean * (1 + tolerance) and totals[dst] >= mean * (1 - tolerance):
            return owner
        gap = totals[src] - totals[dst]
        fits = [v for v in held[src] if 0 < loads.get(v, 0) < gap]
        if not fits:
            return owner
        want = min(totals[src] - mean, mean - totals[dst])
        slot = min(fits, key=lambda v: (abs(loads.get(v, 0) - want), v))
        held[src].remove(slot)
        held[dst].add(slot)
        owner[slot] = dst
        totals[src] -= loads[slot]
        totals[dst] += loads[slot]


class SlotMap:
    """The versioned map in a folder: each version is a table (slot, shard, bytes), written once."""

    def __init__(self, spark: SparkSession, path: str, n_slots: int = N_SLOTS):
        self.spark, self.path, self.n_slots = spark, path, n_slots

    def write(self, version: int, owner: list[int], loads: dict[int, int]) -> DataFrame:
        rows = [(v, s, int(loads.get(v, 0))) for v, s in enumerate(owner)]
        frame = self.spark.createDataFrame(rows, "vslot int, shard int, bytes long").coalesce(1)
        frame.write.mode("errorifexists").parquet(f"{self.path}/version={version:06d}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version:06d}").select("vslot", "shard", "bytes")

    def owner(self, version: int) -> list[int]:
        return [r.shard for r in sorted(self.read(version).collect())]  # n_slots rows, a constant

    def edit(self, version: int, loads: dict[int, int], n_shards: int, tolerance: float = 0.02) -> DataFrame:
        """Store the next version, edited for new loads or another shard count."""
        return self.write(version + 1, rebalance(self.owner(version), loads, n_shards, tolerance), loads)


def collect_loads(rows: DataFrame) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """Bytes, rows and the first part's bytes by slot on the driver: ``n_slots`` rows at most, whatever the input's size."""
    found = slot_loads(rows).collect()
    return {r.vslot: r.bytes for r in found}, {r.vslot: r.rows for r in found}, {r.vslot: r.before for r in found}


def assign(rows: DataFrame, owner: list[int], counts: dict[int, int]) -> DataFrame:
    """Add ``shard`` and ``slot``, the row's gapless place from 0 in its shard.

    A place is the slot's offset in its shard, known from the counts, plus the row's rank in its own
    slot, so that thousands of slots are ranked in parallel and no shard is gathered in one task.
    """
    spark = rows.sparkSession
    offset, ahead = {}, {}
    for v, s in enumerate(owner):
        offset[v] = ahead.get(s, 0)
        ahead[s] = offset[v] + counts.get(v, 0)
    table = spark.createDataFrame([(v, s, offset[v]) for v, s in enumerate(owner)], "vslot int, shard int, ahead long")
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(table), "vslot")  # n_slots rows of 16 bytes, a constant
        .withColumn("slot", (F.col("ahead") + F.col("rank") - 1).cast("long"))
        .drop("ahead", "rank")
    )


def shard_documents(
    docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, map_path: str | None = None, tolerance: float = 0.002
) -> DataFrame:
    """Shard ``docs`` by bytes: sizes of all shards are near equal. Stores versions 0 and 1 of the slot map."""
    spark = docs.sparkSession
    rows = sized(docs, n_slots)
    loads, counts, before = collect_loads(rows)
    slots = SlotMap(spark, map_path or scratch_path(spark, "slot-map"), n_slots)
    slots.write(0, pack(before, n_shards, n_slots), before)
    slots.edit(0, loads, n_shards, tolerance)
    return assign(rows, slots.owner(1), counts).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )
