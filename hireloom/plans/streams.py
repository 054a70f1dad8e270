"""Event queries; the streaming ones run on what is there and end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hireloom.plans.registry import query
from hireloom.sources.views import Views
from hireloom.streaming import events as ev


def checkpoint(v: Views) -> str:
    """A folder that driver and executors share; of this machine only where none is set."""
    import tempfile

    base = v.spark.conf.get("spark.checkpoint.dir", None)
    if not base and v.spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='hireloom-stream-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def log(v):
    return ev.event_log(v.spark, v.sf_dir)


def run(v, stream, mode):
    return ev.run_available(stream, f"s_{uuid.uuid4().hex[:12]}", mode, checkpoint(v))


DAILY = "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
SESSIONS = """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM o)
    SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY 1, 2"""


@query("event_trend", DAILY)
def event_trend(v):
    return ev.daily_trend(log(v))


@query("rate_limit_sliding", """SELECT event_id, user_id, count(*) OVER w AS hits, count(*) OVER w <= 3 AS allowed FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def rate_limit_sliding(v):
    return ev.sliding_hits(log(v), 86_400, 3)


@query("rate_limit_accepted")
def rate_limit_accepted(v):
    return ev.accepted_hits(log(v), 86_400, 3)


@query("idle_sessions", SESSIONS)
def idle_sessions(v):
    return ev.sessions(log(v))


@query("lockouts", """WITH o AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS nth FROM o WHERE event_type = 'error')
    SELECT user_id, event_id, ts AS locked_at FROM n WHERE nth % 2 = 0""")
def lockouts(v):
    return ev.lockouts(log(v), 2)


@query("stream_trend", DAILY)
def stream_trend(v):
    return run(v, ev.daily_trend(ev.event_stream(v.spark, v.sf_dir), watermark=True), "complete")


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(v):
    once = ev.event_stream(v.spark, v.sf_dir).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return run(v, once.select("event_id", "user_id", "event_type"), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_sessions", "WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o) SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, session")
def stream_sessions(v):
    return run(v, ev.session_windows(ev.event_stream(v.spark, v.sf_dir)), "complete")


@query("lockout_outcomes")
def lockout_outcomes(v):
    """Every attempt with what became of it."""
    return ev.timed_lockouts(log(v))


@query("rate_limit_stream")
def rate_limit_stream(v):
    """`rate_limit_accepted` as a stream with each user's accepted times as its state."""
    return run(v, ev.accepted_stream(ev.event_stream(v.spark, v.sf_dir), 60, 2), "append")
