"""Counts, histograms, trends and rates behind dashboards and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Experience buckets: label, from (inclusive), to (exclusive).
EXPERIENCE_BUCKETS = [("0-1", 0, 1), ("1-3", 1, 3), ("3-5", 3, 5), ("5-8", 5, 8), ("8-12", 8, 12), ("12+", 12, 100)]


def top_by_candidates(links: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Distinct candidates per key, most first, ties by key; the first `k` if given."""
    counts = links.groupBy(*keys).agg(F.countDistinct("candidate_id").alias("candidates"))
    ordered = counts.orderBy(F.desc("candidates"), *[F.asc_nulls_last(c) for c in keys])
    return ordered.limit(k) if k else ordered


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.coalesce(F.round(F.try_divide(100 * part, whole), digits), F.lit(0.0))


def histogram(df: DataFrame, value: str, buckets: list[tuple[str, float, float]]) -> DataFrame:
    """Rows per half-open bucket in one pass, empty buckets included."""
    label = F.coalesce(*[F.when((F.col(value) >= lo) & (F.col(value) < hi), F.lit(i)) for i, (_, lo, hi) in enumerate(buckets)])
    spine = df.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(buckets)], "bucket_no int, bucket string")
    counts = df.select(label.alias("bucket_no")).groupBy("bucket_no").agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, "bucket_no", "left").select("bucket_no", "bucket", F.coalesce("n", F.lit(0)).alias("candidates"))


def month_spine(spark, as_of: str, months: int) -> DataFrame:
    """First days of the last `months` months up to `as_of`."""
    last = F.trunc(F.lit(as_of).cast("date"), "month")
    return spark.range(1).select(F.explode(F.sequence(F.add_months(last, 1 - months), last, F.expr("interval 1 month"))).alias("month"))


def hiring_trends(candidates: DataFrame, resumes: DataFrame, as_of: str, months: int) -> DataFrame:
    """Uploads, new candidates, shortlisted and rejected per month, months without any included."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "month").alias("month")
    uploads = resumes.groupBy(month("created_at")).agg(F.count("*").alias("uploads"))
    created = candidates.groupBy(month("created_at")).agg(F.count("*").alias("candidates"))
    moved = candidates.groupBy(month("updated_at")).agg(
        F.count_if(F.col("status") == "shortlisted").alias("shortlisted"), F.count_if(F.col("status") == "rejected").alias("rejected")
    )
    out = month_spine(candidates.sparkSession, as_of, months)
    for part in (uploads, created, moved):
        out = out.join(part, "month", "left")
    counts = ["uploads", "candidates", "shortlisted", "rejected"]
    return out.select(F.date_format("month", "MMM yyyy").alias("period"), "month", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def growth(trend: DataFrame, value: str = "candidates") -> DataFrame:
    """Each period beside the one before it."""
    before = F.lag(value).over(W.orderBy("month"))  # one row per month
    change = F.col(value) - F.col("previous")
    return trend.select("period", "month", value, before.alias("previous")).withColumn(
        "direction", F.when(change > 0, "growing").when(change < 0, "slowed").when(change == 0, "flat")
    )


def funnel(candidates: DataFrame, stages: list[str]) -> DataFrame:
    """Candidates per stage in the given order, empty stages included, with their share."""
    spine = candidates.sparkSession.createDataFrame(list(enumerate(stages)), "stage_no int, stage string")
    counts = candidates.groupBy(F.col("status").alias("stage")).agg(F.count("*").alias("n"))
    total = candidates.agg(F.count("*").alias("total"))
    joined = F.broadcast(spine).join(counts, "stage", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return joined.select("stage_no", "stage", n.alias("candidates"), percent(n, F.col("total")).alias("percent"))


def processing_stats(resumes: DataFrame) -> DataFrame:
    """One row: totals by status set, success rate and mean parse time."""
    status = F.col("status")
    done, failed = F.count_if(status == "completed"), F.count_if(status == "failed")
    return resumes.agg(
        F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), F.count_if(status == "duplicate").alias("duplicates"),
        F.count_if(status.isin("queued", "parsing", "embedding", "graph_sync")).alias("in_progress"),
        percent(done, done + failed).alias("success_rate"), F.round(F.avg("parse_duration_ms"), 2).alias("mean_parse_ms"),
    )


def coverage(links: DataFrame) -> Column:
    return percent(F.count("skill_id"), F.count("*"))


def kpis(v) -> DataFrame:
    """One row of hiring figures; link counts include deleted candidates, as their definition asks."""
    s = F.col("status")
    people = v.alive.agg(
        F.count("*").alias("total_candidates"),
        F.count_if(s == "shortlisted").alias("shortlisted"), F.count_if(s == "rejected").alias("rejected"), F.count_if(s == "hired").alias("hired"),
        F.count_if(s == "interviewing").alias("interviewing"), F.count_if(s.isin("pending_review", "new")).alias("pending_review"),
        F.coalesce(F.round(F.avg("total_experience_years"), 2), F.lit(0.0)).alias("average_experience"),
        F.round(F.avg("last_match_score"), 2).alias("average_match_score"),
        F.count_if((F.col("created_at") >= F.lit("2001-01-01").cast("timestamp")) & (F.col("created_at") < F.lit("2001-08-01").cast("timestamp"))).alias("added_in_period"),
    )
    links = v.candidate_skill.agg(F.count("*").alias("links"), F.countDistinct(F.coalesce(F.col("skill_id").cast("string"), "raw_text")).alias("unique_skills"), coverage(v.candidate_skill).alias("taxonomy_coverage"))
    work = v.experience.where("company_name is not null and company_name != ''").agg(F.countDistinct("company_name").alias("unique_companies"))
    done = processing_stats(v.resume).select(F.col("total").alias("resumes"), F.col("failed").alias("failed_resumes"), F.col("success_rate").alias("parse_success_rate"))
    row = people.crossJoin(links).crossJoin(work).crossJoin(done)
    return row.select(
        *[c for c in row.columns if c != "links"],
        F.coalesce(F.round(F.try_divide(F.col("links"), F.col("total_candidates")), 2), F.lit(0.0)).alias("skills_per_candidate"),
        percent(F.col("shortlisted"), F.col("total_candidates")).alias("shortlist_rate"),
        percent(F.col("rejected"), F.col("total_candidates")).alias("rejection_rate"),
    )


def insights(kpi: DataFrame, gaps: DataFrame, trend_growth: DataFrame, top: DataFrame, limit: int = 6) -> DataFrame:
    """Threshold rules over report figures: (rule, level, title, value), in rule order."""
    k = F.col
    rules = [
        (1, "warning", "Parsing needs attention", (k("resumes") > 0) & (k("parse_success_rate") < 85), k("parse_success_rate")),
        (2, "warning", "Skills are not mapped", (k("total_candidates") > 0) & (k("taxonomy_coverage") < 70), k("taxonomy_coverage")),
        (3, "warning", "Review backlog is high", k("pending_review") >= 0.35 * k("total_candidates"), k("pending_review")),
        (7, "success", "Hires recorded", k("hired") > 0, k("hired")),
        (8, "info", "Match quality", k("average_match_score").isNotNull(), k("average_match_score")),
    ]
    row = lambda no, level, title, value: F.struct(F.lit(no).alias("rule"), F.lit(level).alias("level"), F.lit(title).alias("title"), value.cast("double").alias("value"))
    own = kpi.select(F.explode(F.array_compact(F.array(*[F.when(test, row(no, level, title, value)) for no, level, title, test, value in rules]))).alias("i")).select("i.*")
    scarce = gaps.where("coverage_percent < 25").agg(F.least(F.count("*"), F.lit(3)).alias("n")).where("n > 0").select(row(4, "warning", "Scarce skills", F.col("n")).alias("i")).select("i.*")
    last = trend_growth.where("previous is not null and direction != 'flat'").where(F.col("month") == F.lit("2001-08-01").cast("date"))
    moved = last.select(
        F.lit(5).alias("rule"), F.when(k("direction") == "growing", "success").otherwise("info").alias("level"),
        F.when(k("direction") == "growing", "Inbound is growing").otherwise("Inbound slowed").alias("title"), k("candidates").cast("double").alias("value"),
    )
    common = top.limit(1).select(row(6, "info", "Most common skill", F.col("candidates")).alias("i")).select("i.*")
    return own.unionByName(scarce).unionByName(moved).unionByName(common).orderBy("rule").limit(limit)
