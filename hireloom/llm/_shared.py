"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java/RE2 form of "a word": a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of the largest bucket list that may be broadcast (see `split_by_key`).
BUCKETS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting (tests, a notebook) gets a
    temporary folder of this machine; on a cluster it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='hireloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Arrow batches of at most so many rows for what runs inside: rows that carry whole texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def tidy(run):
    """A function over a partition's batches that gives memory back when it is through."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``keep`` writes a DataFrame as Parquet and reads it back, so a lost
    executor costs a re-read and not a recomputation. ``drop`` removes tables
    that the result no longer depends on.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """Kept tables of one schema as one scan, however many they are."""
        return self.spark.read.schema(frames[0].schema).parquet(*[df._scratch_path for df in frames])

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Words of a text by the rule of `WORD`; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def bucket_of(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def split_by_key(df: DataFrame, keys: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split `df` into rows whose key may occur in `keys` and rows whose key can't.

    Keys are hashed to `BUCKETS` buckets and the distinct buckets are
    broadcast: at most 1,048,576 integers whatever the data, so the rows that
    can't match never move. As the key list grows the first part nears the
    whole table, which costs a shuffle and loses nothing.
    """
    hit = F.broadcast(keys.select(bucket_of(*[keys[c] for c in key]).alias("__bucket")).distinct())
    tagged = df.withColumn("__bucket", bucket_of(*[df[c] for c in key]))
    return (
        tagged.join(hit, "__bucket", "left_semi").drop("__bucket"),
        tagged.join(hit, "__bucket", "left_anti").drop("__bucket"),
    )


def running_total(scratch: Scratch, df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running total of `value` over a global order.

    The table is range-partitioned and written once, so partition sums and row
    totals see the same split; only one sum per partition reaches a single
    task. Rows tied on the order may take either place.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    kept = scratch.keep(spread, "ordered")
    from pyspark.sql import Window as W

    sums = kept.groupBy("__part").agg(F.sum(value).alias("__sum"))
    base = sums.select(
        "__part",
        F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"),
    )
    within = F.coalesce(
        F.sum(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        kept.join(F.broadcast(base), "__part")
        .withColumn(out, (F.col("__base") + within).cast("long"))
        .drop("__part", "__base")
    )


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
