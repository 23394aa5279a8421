"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to slots of a ring. A slot belongs to the first virtual node at or after it. Slots are filled in ring order;
what a full shard can't take continues clockwise to the next shard with room. The plan needs one count for each of the
2^grid_bits slots, whatever the number of rows, and is the only thing that reaches the driver; rows then find their
shard and place by slot and rank, without moving their texts.

Law ``rows``: with no slack the capacities sum to the number of rows and differ by at most one, so the counts do, too.
With slack, capacities are (1 + slack) times the mean and fewer rows leave their first shard.

Edge cases: a null text counts as empty (size 1, crc32 of nothing); a null doc_id is a key like any other; equal texts
under different ids are different keys, so a hot group is spread and not kept together; texts are never moved, however long; repeated rows get places of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import MASK, table

SHARDS, VNODES, GRID_BITS = 16, 128, 14


def _hash(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def ring_nodes(shards: int, vnodes: int = VNODES, grid_bits: int = GRID_BITS) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node in ring order; a shard's nodes depend on that shard alone."""
    at = [(_hash(_hash(s) ^ v), s) for s in range(shards) for v in range(vnodes)]
    return sorted((h >> (64 - grid_bits), s) for h, s in at)


def plan(
    counts: dict[int, int], capacity: list[int], vnodes: int = VNODES, grid_bits: int = GRID_BITS
) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, rank after the last, shard, place of the first) pieces for the slots' row counts."""
    if sum(counts.values()) > sum(capacity):
        raise ValueError("the shards hold fewer rows than there are")
    nodes = ring_nodes(len(capacity), vnodes, grid_bits)
    used = [0] * len(capacity)
    pieces, node = [], 0
    for slot in sorted(counts):
        while node < len(nodes) and nodes[node][0] < slot:
            node += 1
        rank, at = 0, node
        while rank < counts[slot]:
            shard = nodes[at % len(nodes)][1]
            take = min(counts[slot] - rank, capacity[shard] - used[shard])
            if take:
                pieces.append((slot, rank, rank + take, shard, used[shard]))
                rank, used[shard] = rank + take, used[shard] + take
            at += 1
    return pieces


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(
    docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, grid_bits: int = GRID_BITS, slack: float = 0.0
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).withColumn("_key", F.xxhash64("doc_id", "text_crc32"))
    rows = rows.withColumn("_slot", F.shiftrightunsigned("_key", 64 - grid_bits).cast("int"))
    counts = {r["_slot"]: r["n"] for r in rows.groupBy("_slot").agg(F.count("*").alias("n")).collect()}
    pieces = plan(counts, capacities(sum(counts.values()), shards, slack), vnodes, grid_bits)
    planned = docs.sparkSession.createDataFrame(
        pieces, "_slot int, _from long, _to long, shard int, _place long"
    )  # at most one piece for each slot and one more for each shard
    ranked = rows.withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy("_slot").orderBy("_key", "doc_id", "text_crc32", "size")) - F.lit(1),
    )
    return ranked.join(
        F.broadcast(planned),
        (ranked["_slot"] == planned["_slot"])
        & (ranked["_rank"] >= planned["_from"])
        & (ranked["_rank"] < planned["_to"]),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_place") + F.col("_rank") - F.col("_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERY = {"op8_bounded_ring_sharding": query}
ORACLE: dict[str, str] = {}
