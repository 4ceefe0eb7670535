"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many arcs of the ring; a row belongs to the arc that its key's hash falls into. A
shard takes at most its bound. What an arc holds beyond its part of the bound continues clockwise
to the next shards with room, so loads are balanced and only overflowing rows leave their own shard.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import durable

VIRTUAL_NODES = 128
_RING_BITS = 62


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes, ascending, and their shards. A shard's nodes don't depend on the other shards."""
    places = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(f"shard {shard} node {node}".encode(), digest_size=8).digest()
            places.append((int.from_bytes(digest, "big") >> (64 - _RING_BITS), shard))
    places.sort()
    return np.array([p for p, _ in places], np.int64), np.array([s for _, s in places], np.int64)


def bounds(total: int, shards: int, headroom: float) -> list[int]:
    """How much each shard may take: equal parts of the total times 1 + headroom, at most one apart."""
    room = max(total, int(total * (1 + headroom)))
    return [room // shards + (s < room % shards) for s in range(shards)]


def fill(loads: list[int], owner: list[int], most: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which part of each arc's load, in key order, each shard takes.

    A shard over its bound takes from each of its arcs in proportion; the rest walks on clockwise.
    """
    own = [0] * len(most)
    for arc, shard in enumerate(owner):
        own[shard] += loads[arc]
    taken = [loads[a] if own[s] <= most[s] else loads[a] * most[s] // own[s] for a, s in enumerate(owner)]
    room = list(most)
    for arc, shard in enumerate(owner):
        room[shard] -= taken[arc]
    for arc, shard in enumerate(owner):  # what rounding down left of a full shard's bound
        more = min(room[shard], loads[arc] - taken[arc])
        taken[arc] += more
        room[shard] -= more
    parts = [(arc, 0, taken[arc], owner[arc]) for arc in range(len(owner)) if taken[arc]]
    walking: deque[tuple[int, int]] = deque()
    for lap in range(2):
        for arc, shard in enumerate(owner):
            while walking and room[shard]:
                of, begin = walking.popleft()
                end = min(loads[of], begin + room[shard])
                parts.append((of, begin, end, shard))
                room[shard] -= end - begin
                if end < loads[of]:
                    walking.appendleft((of, end))
            if lap == 0 and taken[arc] < loads[arc]:
                walking.append((arc, taken[arc]))
    return parts


def assign(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", balance: str = "rows",
    headroom: float = 0.0, virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 length of the text (null: 0) plus 8. With ``balance`` "rows" a shard's bound counts
    rows, and without headroom the counts are at most one apart; with "bytes" it counts sizes, and a
    shard exceeds its bound by less than one row. Slots are gapless from 0 in each shard.

    Only loads per arc come to the driver (shards * virtual_nodes numbers). Rows are ranked inside
    their arc by key hash, id, text checksum and size, which also decides among repeated ids; equal rows
    are interchangeable. A null id is a key like any other. Texts aren't shuffled; other columns aren't read.
    """
    if balance not in ("rows", "bytes"):
        raise ValueError(f"balance is rows or bytes, not {balance}")
    spark = docs.sparkSession
    places, owner = ring(shards, virtual_nodes)
    told = spark.sparkContext.broadcast(places)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc = np.searchsorted(told.value, np.asarray(batch.column(3))) % len(told.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc, pa.int32())], ["doc_id", "size", "text_crc32", "place", "arc"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    given = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("\0"))), 64 - _RING_BITS).alias("place"),
    )
    kind = docs.schema[id_column].dataType.simpleString()
    placed = given.mapInArrow(arcs, f"doc_id {kind}, size long, text_crc32 long, place long, arc int")
    unit = F.lit(1).cast("long") if balance == "rows" else F.col("size")
    order = Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")
    before = F.coalesce(F.sum(unit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    ranked = durable(placed.select("doc_id", "size", "text_crc32", "arc", before.alias("before"), F.row_number().over(order).alias("rank")))

    loads = [0] * len(owner)
    for r in ranked.groupBy("arc").agg(F.sum(unit).alias("load")).collect():
        loads[r["arc"]] = r["load"]
    parts = fill(loads, owner.tolist(), bounds(sum(loads), shards, headroom))
    schema = "arc int, begin long, end long, shard int, part int"
    table = spark.createDataFrame([(a, b, e, s, k) for k, (a, b, e, s) in enumerate(parts)], schema)
    chosen = ranked.join(F.broadcast(table), "arc").where("before >= begin and before < end")
    firsts = chosen.groupBy("part", "shard").agg(F.min("rank").alias("first"), F.count("*").alias("rows"))
    slots, held = [], [0] * shards
    for r in sorted(firsts.collect(), key=lambda r: r["part"]):
        slots.append((r["part"], held[r["shard"]] - r["first"]))
        held[r["shard"]] += r["rows"]
    shift = spark.createDataFrame(slots, "part int, shift long")
    return chosen.join(F.broadcast(shift), "part").select(
        "doc_id", "size", "text_crc32", F.lit(balance).alias("law"), "shard", (F.col("rank") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard, in slot order; rows meet their shard by id, so ids must be unique."""
    where = assigned.select(F.col("doc_id").alias(id_column), "shard", "slot")
    given = docs.drop(*({"shard", "slot"} & set(docs.columns)))
    shards = given.join(where, id_column).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    shards.write.partitionBy("shard").parquet(path)
