"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, each slot's bytes are summed, and a versioned map says which shard
holds a slot. Rebalancing edits that map; no record changes its slot.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydromelt import session
from hydromelt.llm.common import table, utf8
from hydromelt.operators.joins import checked_broadcast

#: Slots of one map; the map is the only thing the driver holds, so this bounds it.
SLOTS = 8192
#: Rows alike in id and text that one slot may hold.
REPEATS = 64
#: Bytes counted for a record besides its text.
ID_BYTES = 8


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map, with the bytes each slot had when it was made."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]

    def loads(self) -> list[int]:
        found = [0] * self.shards
        for shard, size in zip(self.shard_of, self.bytes_of, strict=True):
            found[shard] += size
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as rows, to be stored: version, shards, virtual_slot, shard, bytes."""
        rows = [(self.version, self.shards, slot, shard, size)
                for slot, (shard, size) in enumerate(zip(self.shard_of, self.bytes_of, strict=True))]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int, bytes long")


def read_map(df: DataFrame, version: int | None = None) -> SlotMap:
    """A stored map: the given version, or else the newest."""
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    rows = df.where(F.col("version") == version).orderBy("virtual_slot").collect()  # bounded by SLOTS
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows), tuple(r["bytes"] for r in rows))


def virtual_slot(*keys: str | Column, slots: int = SLOTS) -> Column:
    """A record's slot: a hash of its keys, the same in every version of the map."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_bytes(df: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per slot of rows with ``virtual_slot`` and ``size``; empty slots count 0."""
    found = dict(df.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect())  # bounded by the slots
    return [found.get(slot, 0) for slot in range(slots)]


def build_map(bytes_of: list[int], shards: int, version: int = 1) -> SlotMap:
    """A first map: the largest remaining slot goes to the emptiest shard."""
    heap = [(0, 0, shard) for shard in range(shards)]
    shard_of = [0] * len(bytes_of)
    for slot in sorted(range(len(bytes_of)), key=lambda s: (-bytes_of[s], s)):
        size, count, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (size + bytes_of[slot], count + 1, shard))
    return SlotMap(version, shards, tuple(shard_of), tuple(bytes_of))


def rebalance(old: SlotMap, bytes_of: list[int] | None = None, shards: int | None = None,
              tolerance: float = 0.01) -> SlotMap:
    """The next version: slots leave the fullest shards for the emptiest until all are within ``tolerance`` of the mean.

    Only moved slots are edited. With more ``shards`` than before, the new ones start empty and fill up;
    with fewer, the slots of those that go are dealt to the rest.
    """
    sizes = list(bytes_of or old.bytes_of)
    shards = shards or old.shards
    held = defaultdict(list)
    loads = [0] * shards
    homeless = []
    for slot, shard in enumerate(old.shard_of):
        if shard < shards:
            held[shard].append(slot)
            loads[shard] += sizes[slot]
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sizes[s], s)):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        held[shard].append(slot)
        loads[shard] += sizes[slot]
    mean = sum(sizes) / shards
    while True:
        full, empty = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        if loads[full] - loads[empty] <= tolerance * mean:
            break
        room = loads[full] - loads[empty]
        fits = [s for s in held[full] if 0 < sizes[s] < room]  # a smaller one than the gap narrows it
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(sizes[s] - room / 2), s))
        held[full].remove(slot)
        held[empty].append(slot)
        loads[full] -= sizes[slot]
        loads[empty] += sizes[slot]
    shard_of = [0] * len(sizes)
    for shard, slots in held.items():
        for slot in slots:
            shard_of[slot] = shard
    return SlotMap(old.version + 1, shards, tuple(shard_of), tuple(sizes))


def spread_repeats(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot`` from ``key``, and for keys of more than ``REPEATS`` rows from ``row``, a number of the row, as well."""
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REPEATS).select(
        "key", F.lit(True).alias("often"))
    salt = F.when(F.col("often"), F.col("row")).otherwise(F.lit(0))
    return rows.join(checked_broadcast(often), "key", "left").withColumn("virtual_slot", virtual_slot(
        F.col("key"), salt, slots=slots)).drop("key", "row", "often")


def assign(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows with ``virtual_slot`` get ``shard`` and ``map_version`` by one stored version, sent along as its rows are fixed."""
    rows = stored.select("virtual_slot", "shard", F.col("version").alias("map_version"))
    return df.join(F.broadcast(rows), "virtual_slot")


def number(df: DataFrame, order: list[str]) -> DataFrame:
    """``slot``: each row's place within its shard, without gaps from 0.

    Rows are numbered inside their virtual slot; the counts of the shard's earlier virtual slots are added.
    """
    counts = df.groupBy("shard", "virtual_slot").agg(F.count(F.lit(1)).alias("n"))  # bounded by the slots
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("virtual_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order)) - 1
    return df.withColumn("inside", inside).join(F.broadcast(starts), "virtual_slot").withColumn(
        "slot", (F.col("start") + F.col("inside")).cast("long")).drop("inside", "start")


def shard_documents(df: DataFrame, shards: int, slots: int = SLOTS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row's shard so that shards hold nearly equal bytes.

    One row out per row in: doc_id, size, text_crc32, virtual_slot, shard, map_version, slot. Null texts count as
    empty, and very long ones whole; rows with a null id are spread by their text. Rows repeated more than ``REPEATS`` times
    are spread over all virtual slots, others that are repeated share one; each gets a place of its own.
    Other columns are ignored; an empty table gives no rows.
    """
    text = utf8(text_col)
    rows = session.stage(df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ID_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32")).withColumns({
            "key": F.xxhash64("doc_id", "text_crc32"), "row": F.monotonically_increasing_id()}), "shard-keys")
    rows = session.stage(spread_repeats(rows, slots), "shard-rows")
    stored = session.stage(build_map(slot_bytes(rows, slots), shards).frame(df.sparkSession), "slot-map")
    return number(assign(rows, stored), ["doc_id", "text_crc32", "size"])


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
