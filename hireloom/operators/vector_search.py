"""Exact vector search and vector table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hireloom.functions.vectors import dot, norm


def top_k(vectors: DataFrame, query: list[float], k: int, kinds: list[str] | None = None, candidates: list[int] | None = None) -> DataFrame:
    """The k vectors of highest cosine: filters first, one pass, ties by id. An empty filter set gives no rows."""
    rows = vectors.where(F.size("vector") == len(query))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows.limit(0)
    if candidates is not None:
        rows = rows.where(F.col("candidate_id").isin(candidates)) if candidates else rows.limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(x * x for x in query) ** 0.5
    score = F.coalesce(F.try_divide(dot(F.col("vector"), q), norm(F.col("vector")) * F.lit(length)), F.lit(0.0))
    scored = rows.select("embedding_id", "kind", "candidate_id", F.round(score, 5).alias("score"))
    return scored.orderBy(F.desc("score"), "embedding_id").limit(k)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Latest row per key; new empty vectors are skipped and values rounded to 6 places."""
    fresh = new.where(F.size("vector") > 0).withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 6)))
    rows = old.withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 6))).withColumn("__v", F.lit(0)).unionByName(fresh.withColumn("__v", F.lit(1)))
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__v")))).where("__n = 1").drop("__n", "__v")


def delete(vectors: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return vectors.join(gone, key, "left_anti")


def best_per_candidate(hits: DataFrame) -> DataFrame:
    """Best hit of each candidate and how many there were."""
    return hits.groupBy("candidate_id").agg(F.max("score").alias("score"), F.count("*").alias("hits"))
