"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame
operations only.

Each shard owns many points on the ring; a row belongs to the arc that ends at the next
point clockwise. Loads are bounded by exact quotas (all shards within one row of each
other): what an arc's shard cannot take goes on to the next shard clockwise that has room.
Only the arcs' counts, as many as the ring has points, reach the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 24
#: Points of each shard on the ring.
VIRTUAL = 128
#: The ring has 2^62 places; a place's cell is its top CELL_BITS bits.
RING_BITS, CELL_BITS = 62, 14


def ring_points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of all points, in ring order."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - RING_BITS)
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual))


def quotas(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of an arc's rows go to which
    shard. Shards' capacities differ by one at most and add up to the rows."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    placed = dict.fromkeys(counts, 0)
    ahead = {arc: arc for arc in counts}
    out = []
    waiting = sorted(counts)
    while waiting:
        later = []
        for arc in waiting:
            shard = owners[ahead[arc] % len(owners)]
            take = min(counts[arc] - placed[arc], room[shard])
            if take:
                out.append((arc, placed[arc], placed[arc] + take, shard, used[shard]))
                placed[arc] += take
                used[shard] += take
                room[shard] -= take
            if placed[arc] < counts[arc]:
                later.append(arc)
        # clockwise to the next point of a shard with room
        for arc in later:
            ahead[arc] += 1
            while not room[owners[ahead[arc] % len(owners)]]:
                ahead[arc] += 1
        waiting = later
    return out


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small local table without a Python data source."""
    head, *_ = rows
    cast = ", ".join(f"cast(c{k} as bigint) as {n}" for k, n in enumerate(names.split()))
    names_in = ", ".join(f"c{k}" for k in range(len(head)))
    body = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {cast} FROM VALUES {body} AS t({names_in})")


def shard_ring(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of ``docs`` (doc_id, text): shards from 0,
    slots gapless from 0 in each. A null text counts as empty; rows with a null or repeated
    id are told apart by their texts; equal rows are interchangeable. No row, no result."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 64 - RING_BITS))
    points = ring_points(shards, virtual)
    top = 1 << RING_BITS
    # an arc is what lies after the previous point, up to its own; the first arc wraps
    spans = [(k, points[k - 1][0] + 1 if k else 0, p) for k, (p, _) in enumerate(points)] + [(0, points[-1][0] + 1, top - 1)]
    step = RING_BITS - CELL_BITS
    arcs = _values(spark, [s for s in spans if s[1] <= s[2]], "arc low high")
    arcs = arcs.withColumn("cell", F.explode(F.sequence(F.shiftright("low", step), F.shiftright("high", step))))
    rows = rows.withColumn("cell", F.shiftright("place", step))
    rows = rows.join(F.broadcast(arcs), (rows.cell == arcs.cell) & rows.place.between(arcs.low, arcs.high)).select("doc_id", "size", "text_crc32", "place", "arc")
    counts = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    share = quotas(counts, [s for _, s in points], shards) or [(0, 0, 0, 0, 0)]
    given = _values(spark, share, "arc first end shard base")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")) - 1)
    placed = ranked.join(F.broadcast(given), (ranked.arc == given.arc) & (ranked["rank"] >= given["first"]) & (ranked["rank"] < given.end))
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
