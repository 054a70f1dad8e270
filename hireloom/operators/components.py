"""Connected components in the core: stars contracted until nothing changes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session without that setting gets one of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='hireloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/components-{uuid.uuid4().hex[:12]}"


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): the smallest node of each component, for every node that an edge names.

    Each round ties what is larger than a node to the least of its neighbours
    (large star) and then a node's smaller neighbours to the least of them
    (small star). Long chains take a number of rounds that grows with the
    logarithm of their length; the loop ends when a round changes nothing.
    Rounds are written, so a lost executor costs a re-read.
    """
    spark = edges.sparkSession
    folder, n = _folder(spark), 0

    def keep(df):
        nonlocal n
        n += 1
        df.write.parquet(f"{folder}/{n:03d}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n:03d}")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    down = keep(down)
    before = mark(down)
    while before[0]:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = mark(down)
        if after == before:
            break
        before = after
    roots = down.select(F.col("v").alias("node")).distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
