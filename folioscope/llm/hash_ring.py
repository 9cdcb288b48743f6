"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (native).

Rows fall on ``CELLS`` places of a ring by a hash of their id; each shard owns
``VNODES`` points of it. Capacities are exact (row counts at most one apart), and
rows that find their shard full continue clockwise to the next shard with room.

All rows of one arc (the places before one point) walk the same way round, so the
walk is decided on the counts of arcs, a table of shards x VNODES rows whatever
the input. Rows only need their rank in their arc: the rank in their cell plus the
counts of the arc's earlier cells. One shuffle of (id, size, checksum) by cell.

Law: ``rows``. Defined results: a null id hashes like any value; a null text has
size 8 and checksum 0; repeated rows take a slot each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialise

CELLS = 1 << 16
VNODES = 64


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; a cell holds one point (ties go to the next free cell)."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def allocate(points: list[tuple[int, int]], loads: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot).

    In round r every arc offers what is left to the r-th point clockwise, in ring
    order; a shard takes rows up to its capacity. A shard that is passed again was
    full before, so one turn of the ring places every row.
    """
    total, n = sum(loads), len(points)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, at, out = [0] * shards, [0] * n, []
    pending = [a for a in range(n) if loads[a]]
    for step in range(n):
        if not pending:
            break
        left = []
        for a in pending:
            shard = points[(a + step) % n][1]
            take = min(loads[a] - at[a], room[shard] - used[shard])
            if take:
                out.append((a, at[a], at[a] + take, shard, used[shard]))
                at[a] += take
                used[shard] += take
            if at[a] < loads[a]:
                left.append(a)
        pending = left
    return out


def _literal(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table from plan-time values, as a literal of the query."""
    schema = "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>"
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), schema)).alias("r")).select("r.*")


def hash_ring(docs: DataFrame, shards: int = 24, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``."""
    spark = docs.sparkSession
    points = ring(shards, vnodes, cells)
    arcs = []
    for a, (cell, _) in enumerate(points):
        low = points[a - 1][0] + 1 if a else 0
        arcs.append((a, low, cell, 0))
    if points[-1][0] < cells - 1:  # past the last point: the first arc, before its other cells
        arcs.append((0, points[-1][0] + 1, cells - 1, -1))
    by_cell = _literal(spark, arcs, ["arc", "low", "high", "turn"]).select("arc", "turn", F.explode(F.sequence("low", "high")).alias("cell"))

    key = F.xxhash64(F.col("doc_id"))
    cell = F.pmod(key, F.lit(cells)).alias("cell")
    counts = docs.select(cell).groupBy("cell").agg(F.count("*").alias("n"))
    clockwise = Window.partitionBy("arc").orderBy("turn", "cell").rowsBetween(Window.unboundedPreceding, -1)
    # At most CELLS rows, whatever the input: small enough to broadcast.
    counts = counts.join(F.broadcast(by_cell), "cell").withColumn("before", F.coalesce(F.sum("n").over(clockwise), F.lit(0)))
    counts = materialise(counts.select("cell", "arc", "n", "before"), "hash-ring")
    loads = [0] * len(points)
    for row in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # at most shards x vnodes rows
        loads[row["arc"]] = row["n"]
    segments = _literal(spark, allocate(points, loads, shards), ["arc", "first", "end", "shard", "slot0"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key"), cell)
    in_cell = Window.partitionBy("cell").orderBy("_key", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(in_cell) - 1)
    rows = rows.join(F.broadcast(counts.select("cell", "arc", "before")), "cell").withColumn("rank", F.col("rank") + F.col("before"))
    rows = rows.join(F.broadcast(segments), "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return rows.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
