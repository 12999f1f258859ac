"""Sharding over fixed virtual slots, with DataFrame functions only.

A text hashes to one of thousands of slots, so equal texts share one; only a group of equal texts larger than a shard's
share is dealt over all slots. Bytes are summed per slot, and a stored, versioned table maps slots to shards.
Filling that map, and editing it when a shard is added, works on the slot table alone, whose size is the fixed number of
slots and not the corpus.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import materialize, shared_dir, text_of

SLOTS = 4096
#: Rows are numbered within a slot and one of so many parts of it.
PARTS = 64
#: A group of equal texts is split only if it exceeds a shard's share of the bytes.
GROUP_SHARE = 1.0


@dataclass(frozen=True)
class SlotMap:
    """Version n of the map: `shard_of[slot]` for every slot."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def column(self, slot: str | Column) -> Column:
        """The shard of a slot column: a constant array, so no join and no shuffle."""
        text = ",".join(map(str, self.shard_of))
        return F.element_at(F.expr(f"cast(split('{text}', ',') AS array<int>)"), (F.col(slot) if isinstance(slot, str) else slot) + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the stored map."""
        rows = spark.range(len(self.shard_of)).select(F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), F.col("id").cast("int").alias("slot"))
        rows.withColumn("shard", self.column("slot")).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version; the newest if none is named."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = stored.where(F.col("version") == version).orderBy("slot").collect()  # one row per slot
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def slot_of(h: Column, n_slots: int = SLOTS) -> Column:
    return F.pmod(h, F.lit(n_slots)).cast("int")


def fill_map(slot_bytes: dict[int, int], n_shards: int, n_slots: int = SLOTS) -> SlotMap:
    """Version 1: the heaviest slots first, each to the shard with the fewest bytes (ties: fewer slots, smaller number)."""
    heap = [(0, 0, s) for s in range(n_shards)]
    shard_of = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-slot_bytes.get(s, 0), s)):
        load, count, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + slot_bytes.get(slot, 0), count + 1, shard))
    return SlotMap(1, n_shards, tuple(shard_of))


def grow_map(old: SlotMap, slot_bytes: dict[int, int]) -> SlotMap:
    """The next version, with one more shard: slots move only into it, each time the heaviest that fits from the shard
    with the most bytes, until no move brings the new shard nearer to an equal share."""
    new, share = old.n_shards, sum(slot_bytes.values()) / (old.n_shards + 1)
    shard_of, load = list(old.shard_of), [0.0] * (new + 1)
    held: list[list[tuple[int, int]]] = [[] for _ in range(new)]
    for slot, shard in enumerate(shard_of):
        load[shard] += slot_bytes.get(slot, 0)
        held[shard].append((slot_bytes.get(slot, 0), slot))
    for own in held:
        own.sort()
    while True:
        giver = max(range(new), key=lambda s: (load[s], -s))
        room = min(share - load[new], load[giver] - share)
        fits = [i for i, (size, _) in enumerate(held[giver]) if 0 < size <= room]
        if not fits:
            return replace(old, version=old.version + 1, n_shards=new + 1, shard_of=tuple(shard_of))
        size, slot = held[giver].pop(fits[-1])
        shard_of[slot] = new
        load[giver] -= size
        load[new] += size


def rebalance(spark: SparkSession, path: str, slot_bytes: dict[int, int]) -> SlotMap:
    """Add a shard to the newest stored map: the next version, stored beside it."""
    grown = grow_map(load_map(spark, path), slot_bytes)
    grown.save(spark, path)
    return grown


def large_groups(rows: DataFrame, slot_bytes: dict[int, int], limit: float, n_slots: int = SLOTS) -> list[int]:
    """Hashes in `rows` (text_hash, size) of more than `limit` bytes in all: total / limit of them at most. Only slots over
    the limit can hold one, so only their rows are grouped, and reduced before they move."""
    heavy = [slot for slot, size in slot_bytes.items() if size > limit]
    if not heavy:
        return []
    sums = rows.where(slot_of(F.col("text_hash"), n_slots).isin(heavy)).groupBy("text_hash").agg(F.sum("size").alias("bytes"))
    return [r["text_hash"] for r in sums.where(F.col("bytes") > limit).collect()]


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, group_share: float = GROUP_SHARE) -> DataFrame:
    """`id_col`, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, next_shard: one row per input row.

    Law `bytes`: the shards' sizes are as near equal as whole virtual slots allow. Equal texts go to one shard, but for
    groups of more than `group_share` of a shard's share of the bytes, whose rows are dealt by id. size: UTF-8 bytes of the
    text plus 1, a null text counting none. slot: the row's place in its shard, gapless from 0. grown_shard is null under
    this law; next_shard: where the row is once a shard has been added by editing the map.

    The map is stored at `map_path` (a new folder in the shared one by default) as version 1, read from there, and edited
    to version 2. Repeated rows and ids are kept, each in a place of its own. A null id is like any other. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    row = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id())))
    rows = materialize(rows.withColumn("row", row))
    bytes_of = lambda df: {r["virtual_slot"]: r["bytes"] for r in df.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}  # noqa: E731  # n_slots rows at most
    by_text = slot_of(F.col("text_hash"), n_slots)
    slot_bytes = bytes_of(rows.withColumn("virtual_slot", by_text))
    split = large_groups(rows, slot_bytes, group_share * sum(slot_bytes.values()) / n_shards, n_slots)
    if split:
        by_text = F.when(F.col("text_hash").isin(split), slot_of(F.col("row"), n_slots)).otherwise(by_text)
        slot_bytes = bytes_of(rows.withColumn("virtual_slot", by_text))
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    fill_map(slot_bytes, n_shards, n_slots).save(spark, path)
    slots = load_map(spark, path)
    grown = rebalance(spark, path, slot_bytes)
    placed = rows.withColumns({"virtual_slot": by_text, "part": F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")})
    counts = placed.groupBy("virtual_slot", "part").count().withColumn("shard", slots.column("virtual_slot"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))  # n_slots * PARTS rows at most
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("_id", "size", "text_crc32")) - 1
    numbered = placed.withColumn("place", place).join(F.broadcast(first), ["virtual_slot", "part"])
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"), grown.column("virtual_slot").alias("next_shard"))
