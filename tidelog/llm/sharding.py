"""Sharding over fixed virtual slots.

Records are hashed into SLOTS virtual slots, whose number never changes.  Bytes are added up for each slot, and a
map from slot to shard is drawn up from these sums: the largest slots first, each to the shard with the fewest
bytes.  The map is a versioned table; rebalancing edits it, moving little more than the bytes that
have to move, and writes the next version.  A record's shard is the map's entry for its slot, so no other record is looked at.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.llm.common import shared_folder, written

SLOTS, SHARDS, OVERHEAD = 8192, 40, 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot], and the version."""

    shard_of: tuple[int, ...]
    shards: int
    version: int = 1

    @staticmethod
    def build(sizes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """sizes: bytes of each slot that has any."""
        loads = [(0, s) for s in range(shards)]
        shard_of = [0] * slots
        for slot in sorted(range(slots), key=lambda i: (-sizes.get(i, 0), i)):
            load, shard = heapq.heappop(loads)
            shard_of[slot] = shard
            # A slot without bytes counts a little, so that such slots are dealt evenly too.
            heapq.heappush(loads, (load + max(1, sizes.get(slot, 0)), shard))
        return SlotMap(tuple(shard_of), shards)

    def loads(self, sizes: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, n in sizes.items():
            out[self.shard_of[slot]] += n
        return out

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """The next version for new sums, or for more or fewer shards: slots of shards that go, and the smallest slots of
        shards above the mean (if the number stays, by more than the tolerance), move to the lightest shards; all
        others stay."""
        shards = shards or self.shards
        shard_of, mean = list(self.shard_of), sum(sizes.values()) / shards
        own: list[list[int]] = [[] for _ in range(shards)]
        moving, loads, limit = [], [0] * shards, mean * (1 + tolerance * (shards == self.shards))
        for slot in sorted(range(len(shard_of)), key=lambda i: (-sizes.get(i, 0), i)):
            s = shard_of[slot]
            if s < shards and loads[s] + sizes.get(slot, 0) <= limit or s < shards and not own[s]:
                own[s].append(slot)
                loads[s] += sizes.get(slot, 0)
            else:
                moving.append(slot)
        heap = [(n, s) for s, n in enumerate(loads)]
        heapq.heapify(heap)
        for slot in moving:
            load, s = heapq.heappop(heap)
            shard_of[slot] = s
            heapq.heappush(heap, (load + max(1, sizes.get(slot, 0)), s))
        return replace(self, shard_of=tuple(shard_of), shards=shards, version=self.version + 1)

    def write(self, spark: SparkSession, path: str) -> None:
        """One row for each slot, under path/version=N."""
        rows = [(slot, shard, self.shards) for slot, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1).write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """That version, or the last one."""
        rows = spark.read.parquet(path)
        version = version or rows.agg(F.max("version")).first()[0]
        found = rows.filter(F.col("version") == version).orderBy("slot").collect()  # as many rows as slots
        return SlotMap(tuple(r.shard for r in found), found[0].shards, version)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot.  Size: UTF-8 bytes (null: none) plus OVERHEAD."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    crc = F.crc32(text).alias("text_crc32")
    size = (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size")
    return docs.select("doc_id", size, crc).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the record's place in its shard, gapless from 0), grown_shard,
    virtual_slot, map_version.

    The law is bytes: shards are of nearly equal size, as far as single records allow.  Rows of one text are not held
    together: doc_id is hashed with the text's checksum, so a group of copies, which may be a third of all rows, is spread
    over all slots.  grown_shard is null.  A
    place is the slot's first place, from the counts, plus the place in the slot by doc_id; so no task sorts
    more than a slot.  Null doc_ids and null texts are hashed like any others; equal rows share a slot.  An empty docs
    gives no rows.  Other columns are not read.  path: where the map's versions go (default: a new folder).
    """
    spark, path = docs.sparkSession, path or f"{shared_folder(docs.sparkSession)}/map"
    rows = written(records(docs, slots))
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # as many rows as slots
    placed = SlotMap.build({r.virtual_slot: r.bytes for r in sums}, shards, slots)
    placed.write(spark, path)
    counts, ahead, first = {r.virtual_slot: r.n for r in sums}, [0] * shards, []
    for slot, s in enumerate(placed.shard_of):
        first.append((slot, s, ahead[s]))
        ahead[s] += counts.get(slot, 0)
    table = spark.createDataFrame(first, "virtual_slot int, shard int, first long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(table), "virtual_slot")  # a row for each slot
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(placed.version).alias("map_version"))
