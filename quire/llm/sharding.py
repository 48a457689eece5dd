"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of virtual slots (thousands), bytes and rows are aggregated per slot,
and a small versioned slot-to-shard map says which shard holds a slot. Rebalancing edits the map only: no record is
hashed anew. The map has exactly ``slots`` entries whatever the data's size, so it is the only thing that reaches the
driver or is broadcast.

Defined results: a null id hashes the text instead, so many null ids don't share a slot; a null text has no bytes but
still the fixed overhead; repeated rows are all placed; empty tables give an all-balanced map and no rows; columns of
the input named like the result's are replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import scratch_path, shuffle_partitions

#: Virtual slots; a power of two far above any shard count in use.
SLOTS = 4096
#: Bytes that each record costs besides its text.
OVERHEAD = 8
#: Rows (of some 50 bytes) that a task ranks and writes at least, so that small inputs don't end in many tiny files.
ROWS_A_FILE = 20_000


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard_of[slot] for every virtual slot."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1
    moved: int = field(default=0, compare=False)

    @property
    def slots(self) -> int:
        return len(self.shard_of)

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row a slot; the version is in the folder's name."""
        rows = [(self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version beside the earlier ones."""
        self.frame(spark).coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map, or the latest."""
        if version is None:
            version = spark.read.parquet(path.rstrip("/")).agg(F.max("version")).first()[0]
        rows = spark.read.parquet(f"{path.rstrip('/')}/version={version}").orderBy("virtual_slot").collect()
        return cls(rows[0]["shards"], tuple(r["shard"] for r in rows), version)


def virtual_slot(key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    name = F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))
    return F.pmod(F.crc32(name.cast("binary")), F.lit(slots)).cast("int")


def record_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slot_loads(placed: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """(bytes, rows) of every slot. Partial sums per task, then at most one row a slot to the driver."""
    loads, rows = [0] * slots, [0] * slots
    for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        loads[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return loads, rows


def assign(loads: list[int], shards: int) -> SlotMap:
    """A first map: slots by falling load, each to the shard that holds least so far."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(loads)
    for slot in sorted(range(len(loads)), key=lambda k: (-loads[k], k)):
        held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (held + loads[slot], shard))
    return SlotMap(shards, tuple(shard_of))


def rebalance(old: SlotMap, loads: list[int], shards: int | None = None, slack: float = 0.02) -> SlotMap:
    """The next version of a map for new loads or another number of shards, moving few slots.

    Slots of removed shards move first. Then the fullest shard gives its best-fitting slot to the emptiest, as long as
    that narrows the gap between the two and it is more than slack of the mean. Slots that needn't move stay.
    """
    shards = shards or old.shards
    shard_of = list(old.shard_of)
    held = [0] * shards
    owned: list[list[int]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            held[shard] += loads[slot]
            owned[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda k: (-loads[k], k)):
        to = min(range(shards), key=lambda s: (held[s], s))
        shard_of[slot] = to
        held[to] += loads[slot]
        owned[to].append(slot)
    while True:
        low = min(range(shards), key=lambda s: (held[s], s))
        high = max(range(shards), key=lambda s: (held[s], -s))
        gap = held[high] - held[low]
        fits = [k for k in owned[high] if 0 < loads[k] < gap]
        if not fits or gap <= slack * sum(loads) / shards:
            break
        slot = min(fits, key=lambda k: (abs(gap / 2 - loads[k]), k))
        owned[high].remove(slot)
        owned[low].append(slot)
        held[high] -= loads[slot]
        held[low] += loads[slot]
        shard_of[slot] = low
    moved = sum(a != b for a, b in zip(old.shard_of, shard_of, strict=True))
    return SlotMap(shards, tuple(shard_of), old.version + 1, moved)


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """docs with their size, checksum and virtual slot; all in one scan without a shuffle."""
    return docs.withColumns({"size": record_size(text), "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), "virtual_slot": virtual_slot(key, text, slots)})


def shard(placed: DataFrame, slot_map: SlotMap, counts: list[int], order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """placed with shard and slot, a gapless position from 0 in the shard.

    A row's position is the number of rows in the shard's earlier virtual slots plus its rank in its own, so the sort
    runs per virtual slot and never per shard.
    """
    spark = placed.sparkSession
    before, base = [0] * slot_map.shards, []
    for slot, home in enumerate(slot_map.shard_of):
        base.append((slot, home, before[home]))
        before[home] += counts[slot]
    lookup = spark.createDataFrame(base, "virtual_slot int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    ranked = placed.drop("shard", "slot", "first", "map_version").withColumn("slot_rank", rank)
    return (
        ranked.join(F.broadcast(lookup), "virtual_slot")  # one row a virtual slot
        .withColumn("slot", F.col("first") + F.col("slot_rank") - 1)
        .withColumn("map_version", F.lit(slot_map.version))
        .drop("first", "slot_rank")
    )


def current_map(spark: SparkSession, path: str, loads: list[int], shards: int, slack: float = 0.02) -> SlotMap:
    """The latest map of a folder, after a first one is made where there is none and a next one where it is out of balance."""
    try:
        held = SlotMap.load(spark, path)
    except AnalysisException:  # no such folder yet
        assign(loads, shards).save(spark, path)
        return SlotMap.load(spark, path)
    fresh = rebalance(held, loads, shards, slack)
    if fresh.moved or fresh.shards != held.shards:
        fresh.save(spark, path)
        held = SlotMap.load(spark, path, fresh.version)
    return held


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """All documents in shards of near-equal bytes: doc_id, size, text_crc32, virtual_slot, shard, slot, map_version.

    maps: the folder of the map's versions, one in the shared folder if none is given.
    """
    spark = docs.sparkSession
    placed = place(docs.select("doc_id", "text"), slots=slots).drop("text")
    loads, counts = slot_loads(placed, slots)
    parts = min(shuffle_partitions(spark), sum(counts) // ROWS_A_FILE + 1)
    held = current_map(spark, maps or scratch_path(spark, "slot-maps"), loads, shards)
    return shard(placed, held, counts, ("doc_id", "text_crc32", "size")).coalesce(parts)
