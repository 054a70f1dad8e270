"""Jobs, users, permissions, sessions, the audit log, and requirements from loose JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def open_jobs(jobs: DataFrame) -> DataFrame:
    """Active jobs, newest first."""
    return jobs.where("is_active").orderBy(F.desc("created_at"), F.desc("job_id"))


def list_users(users: DataFrame, inactive: bool = False) -> DataFrame:
    return (users if inactive else users.where("is_active")).orderBy("full_name", "user_id")


def find_user(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.lower("email") == email.strip().lower())


def allowed(users: DataFrame, permissions: DataFrame, wanted: str) -> DataFrame:
    """Users whose role has a permission (role, permission)."""
    return users.join(permissions.where(F.col("permission") == wanted).select("role"), "role", "left_semi")


def live_sessions(sessions: DataFrame, now: Column, idle: str = "30 minutes") -> DataFrame:
    """Sessions that are neither revoked nor idle for longer than that."""
    return sessions.where(F.col("revoked_at").isNull() & (F.col("last_seen") >= now - F.expr(f"interval {idle}")))


def revoke_all(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """The sessions of some users ended now, unless they were before."""
    marked = sessions.join(users.select("user_id", F.lit(True).alias("__gone")), "user_id", "left")
    return marked.withColumn("revoked_at", F.when(F.col("__gone"), F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at"))).drop("__gone")


def append_audit(rows: DataFrame, path: str) -> None:
    """Add entries (action, user_id, entity, created_at) to the log at a path."""
    rows.select("action", "user_id", "entity", F.col("created_at").cast("timestamp").alias("created_at")).write.mode("append").parquet(path)


def names_of(json: Column) -> Column:
    """Names in a JSON list of strings, or of objects with a `skill` or `name`; anything else gives none."""
    items = F.from_json(json, "array<string>")
    named = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.skill"), F.get_json_object(x, "$.name"), F.when(~x.startswith("{"), x)))
    return F.coalesce(F.filter(named, lambda x: x.isNotNull() & (F.trim(x) != "")), F.array().cast("array<string>"))


def criteria_or(criteria: Column, stored: Column) -> Column:
    """A field of the criteria, or of the stored requirement where it is null, empty or 0."""
    return F.coalesce(F.when(given(criteria), criteria), stored)


def given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "[]") == F.lit(False)
