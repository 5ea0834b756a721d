"""Sharding by fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

import heapq
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from babelyard.llm.tables import materialise, scratch_root

Cell = tuple[int, int]


def plan_shards(cells: dict[Cell, int], n_shards: int) -> dict[Cell, int]:
    """Largest cell first, each to the shard that holds least so far."""
    heap = [(0, shard) for shard in range(n_shards)]
    plan = {}
    for cell, size in sorted(cells.items(), key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        plan[cell] = shard
        heapq.heappush(heap, (held + size, shard))
    return plan


def edit_plan(plan: dict[Cell, int], cells: dict[Cell, int], n_shards: int, slack: float = 0.02) -> dict[Cell, int]:
    """The next version of a map: cells stay where they are unless their shard is gone or holds
    more than its share plus slack; what must move goes, largest first, to the emptiest shard."""
    share = sum(cells.values()) / n_shards * (1 + slack)
    held, by_shard, moving = [0] * n_shards, {}, []
    for cell, size in cells.items():
        at = plan.get(cell, n_shards)
        if at < n_shards:
            held[at] += size
            by_shard.setdefault(at, []).append((size, cell))
        else:
            moving.append((size, cell))
    for shard, own in by_shard.items():
        for size, cell in sorted(own):
            if held[shard] <= share:
                break
            held[shard] -= size
            moving.append((size, cell))
    out = {c: s for c, s in plan.items() if c in cells and s < n_shards}
    heap = [(x, s) for s, x in enumerate(held)]
    heapq.heapify(heap)
    for size, cell in sorted(moving, key=lambda x: (-x[0], x[1])):
        x, shard = heapq.heappop(heap)
        out[cell] = shard
        heapq.heappush(heap, (x + size, shard))
    return out


class SlotMap:
    """Versions of a slot-to-shard map, one Parquet folder each: slot, sub, bytes, shard."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{scratch_root(spark)}/slot-map-{uuid.uuid4().hex}"

    def write(self, version: int, plan: dict[Cell, int], cells: dict[Cell, int], first: dict[Cell, int]) -> DataFrame:
        rows = [(slot, sub, cells[slot, sub], shard, first.get((slot, sub), 0)) for (slot, sub), shard in sorted(plan.items())]
        df = self.spark.createDataFrame(rows, "v_slot int, sub int, bytes long, shard int, first long").coalesce(1)
        df.write.parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("v_slot int, sub int, bytes long, shard int, first long").parquet(f"{self.path}/version={version}")


def shard_documents(
    docs: DataFrame, n_shards: int = 40, slots: int = 4096, parts_per_shard: int = 4, path: str | None = None, next_shards: int | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, sub, shard, slot, next_shard: every row's shard and its place there.

    A row's virtual slot is a hash of its text, so equal texts share a slot. A slot that holds more
    than 1 / parts_per_shard of a shard's fair share is dealt into sub-slots by a second hash of the text; a text that
    alone holds so much has a sub-slot of its own, and only one that holds more than a whole share is dealt further, by a
    number that each row is written with, so rows that share an id or have none are spread too. Slots and
    sub-slots are cells (at most slots and twice n_shards * parts_per_shard, so the map is small whatever
    the input), and version 1 of the map gives each cell a shard, largest first. With next_shards, version 2 is version 1 edited
    for that many shards, and next_shard says where a row lies then. `slot` counts the rows of a shard from 0.
    Null texts count as empty and hold 16 bytes; rows with a null doc_id are dealt like others;
    repeated rows take a place each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("v_slot"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "shard-rows",
    )
    by_slot = {r[0]: r[1] for r in rows.groupBy("v_slot").agg(F.sum("size")).collect()}  # at most `slots` rows
    total = sum(by_slot.values())
    limit, share = max(1, total // (n_shards * parts_per_shard)), max(1, total / n_shards)
    heavy = [s for s, x in by_slot.items() if x > limit]
    large = []
    if heavy:
        # as many slots, and as many texts in them, as can be over the limit: n_shards * parts_per_shard
        own = rows.where(F.col("v_slot").isin(heavy)).groupBy("v_slot", "text_hash").agg(F.sum("size").alias("bytes"))
        large = sorted((r[0], r[1], r[2]) for r in own.where(F.col("bytes") > limit).collect())
    split, texts = {s: max(1, math.ceil((x - sum(t[2] for t in large if t[0] == s)) / limit)) for s, x in by_slot.items()}, []
    after = dict(split)
    for s, text_hash, size in large:
        parts = math.ceil(size / limit) if size > share else 1
        texts.append((s, text_hash, after[s], parts))
        after[s] += parts
    # both bounded as said
    by_text = spark.createDataFrame(sorted(split.items()), "v_slot int, n_sub int")
    alone = spark.createDataFrame(texts, "v_slot int, text_hash long, at int, parts int")
    celled = rows.join(F.broadcast(by_text), "v_slot").join(F.broadcast(alone), ["v_slot", "text_hash"], "left")
    mixed = F.pmod(F.xxhash64("text_hash", F.lit(17)), F.col("n_sub"))
    celled = celled.withColumn("sub", F.coalesce(F.col("at") + F.pmod(F.xxhash64("number", F.lit(17)), F.col("parts")), mixed).cast("int"))
    stats = celled.groupBy("v_slot", "sub").agg(F.sum("size"), F.count("*")).collect()
    cells, counts = {(r[0], r[1]): r[2] for r in stats}, {(r[0], r[1]): r[3] for r in stats}
    plan = plan_shards(cells, n_shards)
    first, at = {}, [0] * n_shards
    for cell in sorted(plan):
        first[cell] = at[plan[cell]]
        at[plan[cell]] += counts[cell]
    store = SlotMap(spark, path)
    mapped = store.write(1, plan, cells, first).drop("bytes")
    if next_shards:
        later = store.write(2, edit_plan(plan, cells, next_shards), cells, {}).select("v_slot", "sub", F.col("shard").alias("next_shard"))
        mapped = mapped.join(F.broadcast(later), ["v_slot", "sub"])
    else:
        mapped = mapped.withColumn("next_shard", F.lit(None).cast("int"))
    return _numbered(celled.join(F.broadcast(mapped), ["v_slot", "sub"]), counts)


def _numbered(celled: DataFrame, counts: dict[Cell, int], rows: int = 100_000, most: int = 20_000) -> DataFrame:
    """Rows with their place in the shard: a cell's first place, and the place in the cell. A large cell is counted in chunks of about
    `rows` rows, each sorted by itself; there are at most as many chunks as cells and `most`."""
    rows = max(rows, -(-sum(counts.values()) // most))
    spark = celled.sparkSession
    chunks = spark.createDataFrame([(*cell, -(-n // rows)) for cell, n in sorted(counts.items())], "v_slot int, sub int, chunks int")
    chunked = celled.join(F.broadcast(chunks), ["v_slot", "sub"]).withColumn("chunk", F.pmod(F.xxhash64("number", F.lit(29)), F.col("chunks")).cast("int"))
    before, starts = 0, []
    last = None
    for slot, sub, chunk, n in sorted(tuple(r) for r in chunked.groupBy("v_slot", "sub", "chunk").count().collect()):
        before = before if (slot, sub) == last else 0
        starts.append((slot, sub, chunk, before))
        before, last = before + n, (slot, sub)
    offsets = spark.createDataFrame(starts, "v_slot int, sub int, chunk int, before long")
    place = F.row_number().over(Window.partitionBy("v_slot", "sub", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        chunked.join(F.broadcast(offsets), ["v_slot", "sub", "chunk"])
        .withColumn("slot", (F.col("first") + F.col("before") + place).cast("long"))
        .select("doc_id", "size", "text_crc32", F.col("v_slot").alias("virtual_slot"), "sub", "shard", "slot", "next_shard")
    )
