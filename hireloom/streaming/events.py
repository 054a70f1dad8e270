"""Event windows, sessions, limits and lockouts: batch forms, and the same as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDLE = "30 minutes"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream, its parts in order of arrival."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_trend(events: DataFrame, watermark: bool = False) -> DataFrame:
    if watermark:
        events = events.withWatermark("ts", "1 hour")
    days = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = IDLE) -> DataFrame:
    """Sessions of a user: events not more than the gap apart (strictly more closes one)."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(order) <= F.expr(f"interval {gap}"), 0).otherwise(1)
    numbered = events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def session_windows(events: DataFrame, gap: str = IDLE) -> DataFrame:
    """The streaming form of `sessions`; it closes a session at the gap itself."""
    groups = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return groups.select("user_id", F.col("session_window.start").alias("started"), "events")


def sliding_hits(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Every hit with the hits of its user in the window before it; a hit exactly one window old is out."""
    micros = F.unix_micros("ts")
    order = W.partitionBy("user_id").orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.select("event_id", "user_id", F.count("*").over(order).alias("hits")).withColumn("allowed", F.col("hits") <= limit)


def accepted_hits(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Rate limit by accepted hits only: refused ones don't count against a user."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition has whole users in order, so the accepted times of the last user are all that is carried on.
        user, held = None, deque()
        for batch in batches:
            allowed = []
            for u, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if u != user:
                    user, held = u, deque()
                while held and held[0] < t - seconds * 1_000_000:
                    held.popleft()
                allowed.append(len(held) < limit)
                if allowed[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], names=["event_id", "user_id", "allowed"])

    micros = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62)))  # events without a time come first
    rows = events.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), micros.alias("micros"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "micros", "event_id")
    return ordered.mapInArrow(run, "event_id long, user_id long, allowed boolean")


def accepted_stream(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """The same as a stream: the accepted times of each user are its state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "event_id"])
            allowed = []
            for t in pdf["ts"].map(lambda x: x.timestamp()):
                held = [h for h in held if h >= t - seconds]
                ok = len(held) < limit
                if ok:
                    held.append(t)
                allowed.append(ok)
            yield pdf[["event_id", "user_id"]].assign(allowed=allowed)
        state.update((held,))

    return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(
        run, "event_id long, user_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def lockouts(events: DataFrame, failures: int = 5) -> DataFrame:
    """Users and times at which so many failed events in a row were reached."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    runs = events.withColumn("run", F.sum(F.when(failed, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))).where(failed)
    nth = F.row_number().over(W.partitionBy("user_id", "run").orderBy("ts", "event_id"))
    return runs.withColumn("nth", nth).where(F.col("nth") % failures == 0).select("user_id", "event_id", F.col("ts").alias("locked_at"))


def timed_lockouts(events: DataFrame, failures: int = 5, minutes: int = 15) -> DataFrame:
    """(event_id, user_id, outcome) of every attempt: so many failures in a row lock a user for some minutes.

    Attempts within that time are `locked` and count for nothing; one after it starts from none. A success
    ends a row of failures. Attempts at one time come in order of their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, row, until = None, 0, None
        for batch in batches:
            out = []
            for u, t, failed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if u != user:
                    user, row, until = u, 0, None
                if until is not None and t < until:
                    out.append("locked")
                    continue
                if until is not None:
                    row, until = 0, None
                row = row + 1 if failed else 0
                if row >= failures:
                    until = t + minutes * 60_000_000
                out.append("failed" if failed else "ok")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["event_id", "user_id", "outcome"])

    micros = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62)))
    rows = events.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), micros.alias("micros"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "micros", "event_id")
    return ordered.mapInArrow(run, "event_id long, user_id long, outcome string")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and return its result table, which lies as Parquet beside the checkpoint."""
    spark, out = stream.sparkSession, f"{checkpoint}-out/{name}"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(out)  # a stream without a row has a result too
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:  # each batch has the whole table
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest(stream: DataFrame, handle, checkpoint: str):
    """At-least-once batches for `handle(df, batch_id)`, which must be idempotent."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
