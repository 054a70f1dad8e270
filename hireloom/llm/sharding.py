"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of the ring; the arc before a point belongs to it.
Keys land on arcs by hash. A shard takes what its arcs hold up to its bound;
what overflows goes on clockwise to the next shard with room. Since the bounds
add up to all rows, every shard ends exactly at its bound.

Only the count per arc (shards x virtual nodes numbers, whatever the data)
reaches the driver, which walks the ring once and cuts every arc into
segments. Rows then find their segment by their rank in the arc, so the
result equals inserting the keys one after the other in ring order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch

RING = 1 << 32
VNODES = 256


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Points (position, shard) in clockwise order; a shard's points don't depend on the other shards."""
    points = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=4).digest(), "big")
            points.setdefault(at, shard)  # of two points in one place the lower shard's counts
    return sorted(points.items())


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: even shares, at most one apart, widened by `slack`."""
    low, more = divmod(rows, shards)
    return [int((low + (s < more)) * (1 + slack) + 0.999999) if slack else low + (s < more) for s in range(shards)]


def segments(loads: dict[int, int], points: list[tuple[int, int]], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Cut arcs into (arc, first rank, end rank, shard, slot of the first rank).

    First every shard keeps what its own arcs hold, in ring order, up to its
    limit; then each overflow walks clockwise to the next shards with room.
    """
    used = [0] * len(limits)
    cut, over = [], []
    for arc, (_, shard) in enumerate(points):
        n = loads.get(arc, 0)
        take = min(n, limits[shard] - used[shard])
        if take:
            cut.append((arc, 0, take, shard, used[shard]))
            used[shard] += take
        if n > take:
            over.append((arc, take, n))
    for arc, lo, hi in over:
        at = arc
        for _ in range(len(points)):
            if lo == hi:
                break
            at = (at + 1) % len(points)
            shard = points[at][1]
            take = min(hi - lo, limits[shard] - used[shard])
            if take:
                cut.append((arc, lo, lo + take, shard, used[shard]))
                used[shard] += take
                lo += take
        assert lo == hi, "the limits are smaller than the rows"
    return cut


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 24, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text (null: 0) plus 8. The law is `rows`:
    with no slack the shards' counts are at most one apart. Slots of a shard
    run from 0 without gaps. Null ids hash like any other value, rows that
    repeat take slots of their own, an empty table gives an empty result, and
    other columns of `docs` are not read.
    """
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("__at", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 32))
    points = ring(shards, vnodes)
    # An arc ends at its point: the first point at or after the key, around the ring.
    cells = 1 << 12
    width = RING // cells
    starts = [bisect_left(points, (c * width, -1)) for c in range(cells + 1)]
    by_cell = spark.createDataFrame(
        [(c, [p for p, _ in points[starts[c] : starts[c + 1]]], starts[c]) for c in range(cells)], "cell int, inside array<long>, first int"
    )
    keyed = (
        keyed.withColumn("cell", (F.col("__at") / F.lit(width)).cast("int"))
        .join(F.broadcast(by_cell), "cell")
        .withColumn("arc", F.col("first") + F.size(F.filter("inside", lambda p: p < F.col("__at"))))
        .withColumn("arc", F.when(F.col("arc") < F.lit(len(points)), F.col("arc")).otherwise(0))
        .select("doc_id", "size", "text_crc32", "__at", "arc")
    )
    kept = scratch.keep(keyed, "arcs")
    loads = {r["arc"]: r["count"] for r in kept.groupBy("arc").count().collect()}  # at most one row per point
    cut = segments(loads, points, bounds(sum(loads.values()), shards, slack))
    by_arc: dict[int, list] = {}
    for arc, lo, hi, shard, slot in cut:
        by_arc.setdefault(arc, []).append((lo, hi, shard, slot))
    parts = spark.createDataFrame(sorted(by_arc.items()), "arc int, parts array<struct<lo:long,hi:long,shard:int,slot:long>>")
    rank = (F.row_number().over(W.partitionBy("arc").orderBy("__at", "doc_id", "text_crc32", "size")) - 1).cast("long")
    part = F.filter("parts", lambda p: (p["lo"] <= F.col("__rank")) & (F.col("__rank") < p["hi"]))[0]
    return (
        kept.withColumn("__rank", rank)
        .join(F.broadcast(parts), "arc")
        .withColumn("__p", part)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("__p.shard").alias("shard"),
            (F.col("__p.slot") + F.col("__rank") - F.col("__p.lo")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
