"""Merging, gap analysis and record-level operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hireloom.operators.reports import percent


def skill_gap(v, requested: list[str], bridges: int = 4) -> DataFrame:
    """Coverage and demand of requested skills, and neighbouring skills that could bridge."""
    wanted = v.spark.createDataFrame([(s,) for s in requested], "skill string")
    own = F.broadcast(wanted).join(v.skill.select(F.col("name").alias("skill"), "category", "skill_id"), "skill")
    held = v.candidate_skill.join(v.alive.select("candidate_id"), "candidate_id").select("candidate_id", F.col("raw_text").alias("skill"))
    counts = held.join(F.broadcast(wanted), "skill").groupBy("skill").agg(F.countDistinct("candidate_id").alias("n"))
    total = v.alive.agg(F.count("*").alias("total"))
    near = symmetric(v.skill_relation)
    names = v.skill.select(F.col("skill_id").alias("other"), F.col("name").alias("bridge"))
    links = own.join(near, "skill_id").join(names, "other").groupBy("skill").agg(F.slice(F.array_sort(F.collect_set("bridge")), 1, bridges).alias("b"))
    joined = own.join(counts, "skill", "left").join(links, "skill", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    share = percent(n, F.col("total"))
    return joined.select(
        "skill", "category", n.alias("candidates"), share.alias("coverage_percent"), F.round(100 - share, 2).alias("demand"),
        F.coalesce(F.array_join("b", "; "), F.lit("")).alias("bridges"),
    )


def symmetric(relation: DataFrame) -> DataFrame:
    """Related pairs in both directions, once each: (skill_id, other)."""
    there = relation.select(F.col("source_skill_id").alias("skill_id"), F.col("target_skill_id").alias("other"))
    back = relation.select(F.col("target_skill_id").alias("skill_id"), F.col("source_skill_id").alias("other"))
    return there.union(back).distinct()


def merge_mentions(mentions: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: mentions summed, best confidence, first known years, whether any came from a skills section."""
    return mentions.groupBy(*key).agg(
        F.sum("mentions").alias("mentions"), F.round(F.max("confidence"), 3).alias("confidence"),
        F.min_by("years", F.when(F.col("years").isNotNull(), F.struct("place", "years"))).alias("years"), F.bool_or("from_section").alias("from_section"),
    )


def merge_lists(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Distinct items per key, sorted, at most `most`."""
    return rows.groupBy(key).agg(F.slice(F.array_sort(F.collect_set(item)), 1, most).alias("items"))


def merge_intervals(spans: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Overlapping or touching spans of a key as one: gaps and islands in one sort."""
    order = W.partitionBy(key).orderBy("start_date", "end_date")
    reach = F.max("end_date").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start_date") <= reach, 0).otherwise(1)
    marked = spans.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "__island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")).drop("__island")


def months_between_inclusive(start, end):
    return F.greatest(F.lit(0), (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1)


def merged_experience(experience: DataFrame) -> DataFrame:
    merged = merge_intervals(experience.select("candidate_id", "start_date", "end_date"))
    out = merged.groupBy("candidate_id").agg(F.count("*").alias("spans"), F.sum(months_between_inclusive("start_date", "end_date")).alias("months"))
    return out.withColumn("years", F.round(F.col("months") / 12, 1))


def total_experience(candidates: DataFrame, computed: DataFrame) -> DataFrame:
    """Stated years win if plausible and near the merged timeline, else the timeline counts."""
    joined = candidates.select("candidate_id", F.col("total_experience_years").alias("stated")).join(
        computed.select("candidate_id", F.col("years").alias("computed")), "candidate_id", "left"
    )
    near = F.col("computed").isNull() | (F.abs(F.col("stated") - F.col("computed")) <= F.greatest(F.lit(2.0), 0.5 * F.col("computed")))
    wins = (F.col("stated") > 0) & (F.col("stated") <= 45) & near
    return joined.withColumn("years", F.when(wins, F.col("stated")).otherwise(F.coalesce("computed", F.lit(0.0))))


def completeness(candidates: DataFrame, links: DataFrame, experience: DataFrame, certification: DataFrame, checks: int = 12) -> DataFrame:
    """Share of the profile checks that hold; checks without a source column count as missing."""
    n = links.groupBy("candidate_id").agg(F.count("*").alias("n"))
    joined = (
        candidates.join(n, "candidate_id", "left")
        .join(experience.select("candidate_id").distinct().withColumn("worked", F.lit(True)), "candidate_id", "left")
        .join(certification.select("candidate_id").distinct().withColumn("held", F.lit(True)), "candidate_id", "left")
    )
    tests = [
        F.col("full_name").isNotNull(), F.col("city").isNotNull() | F.col("country").isNotNull(), F.col("total_experience_years") > 0,
        F.col("highest_degree").isNotNull(), F.coalesce("n", F.lit(0)) >= 3, F.col("worked").isNotNull(), F.col("held").isNotNull(),
    ]
    met = sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
    return joined.select("candidate_id", F.round(met / checks, 3).alias("completeness"))


def candidate_detail(people: DataFrame, experience: DataFrame, certification: DataFrame) -> DataFrame:
    """Profiles with their children as ordered lists; each child table is grouped once."""
    work = experience.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("start_date", "company_name"))).alias("w"))
    held = certification.groupBy("candidate_id").agg(F.array_sort(F.collect_list("name")).alias("c"))
    joined = people.join(work, "candidate_id", "left").join(held, "candidate_id", "left")
    text = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    return joined.select(
        "candidate_id", "full_name", F.concat_ws(", ", "city", "country").alias("location"),
        text(F.transform("w", lambda x: x["company_name"])).alias("companies"), text("c").alias("certifications"),
    )


def long_form(sections: dict[str, DataFrame]) -> DataFrame:
    """Report sections of (metric, value) as rows of (section, metric, value)."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.col("metric"), F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def apply_changes(rows: DataFrame, new: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Rows with new statuses where there is one, and whether it differs."""
    joined = rows.join(new, key, "left")
    return joined.select(key, F.coalesce("new_status", "status").alias("status"), F.coalesce(F.col("new_status") != F.col("status"), F.lit(False)).alias("changed"))
