"""Candidate filters, pages and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hireloom.functions.text import tokenize_py

SORT_COLUMNS = {
    "name": "full_name", "experience": "total_experience_years", "score": "last_match_score", "upload_date": "created_at",
    "created_at": "created_at", "updated_at": "updated_at", "status": "status", "location": "city", "availability": "availability", "degree": "highest_degree",
}


def search_terms(text: str) -> list[str]:
    """Terms of a free-text query: up to 8 tokens without stop words, or the whole phrase if there is one token at most."""
    tokens = tokenize_py(text)
    return tokens[:8] if len(tokens) > 1 else [text.strip().lower()]


def text_match(candidates: DataFrame, links: DataFrame, text: str, mode: str = "any") -> DataFrame:
    """Candidates of whom every (or any) term is in a profile field or one of their skills."""
    terms = search_terms(text)
    keys = [t for t in terms if t]
    skill_hit = links.groupBy("candidate_id").agg(*[F.bool_or(F.lower("raw_text").contains(t)).alias(f"__s{i}") for i, t in enumerate(keys)])
    joined = candidates.join(skill_hit, "candidate_id", "left")
    tests = [
        reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(t) for c in ("full_name", "city", "highest_degree")])
        | F.coalesce(F.col(f"__s{i}"), F.lit(False))
        for i, t in enumerate(keys)
    ]
    join = (lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b)
    return joined.where(reduce(join, tests)).select(*[candidates[c] for c in candidates.columns])


def with_all_skills(candidates: DataFrame, links: DataFrame, skills: list[str]) -> DataFrame:
    """Candidates who have every named skill: one grouped pass, then a semi join."""
    wanted = links.where(F.col("raw_text").isin(skills)).groupBy("candidate_id").agg(F.countDistinct("raw_text").alias("n"))
    return candidates.join(wanted.where(F.col("n") == len(set(skills))), "candidate_id", "left_semi")


def page(df: DataFrame, sort_by: str, descending: bool, number: int, size: int, key: str = "candidate_id") -> DataFrame:
    """One page by an allowed sort column (unknown: created_at), ties by key descending."""
    column = F.col(SORT_COLUMNS.get(sort_by, "created_at"))
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return df.orderBy(order, F.desc(key)).offset((number - 1) * size).limit(size)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n)


def main_skills(links: DataFrame, n: int = 8) -> DataFrame:
    """Each candidate's first skills by confidence, then name, as one ordered list."""
    best = top_per_group(links, "candidate_id", [F.desc("confidence"), F.asc("raw_text")], n)
    ordered = F.array_sort(F.collect_list(F.struct("__n", "raw_text")))
    return best.groupBy("candidate_id").agg(F.transform(ordered, lambda s: s["raw_text"]).alias("top_skills"))


def timeline(experience: DataFrame, certification: DataFrame) -> DataFrame:
    """Experience and certification events under one string key, undated ones at the end of the descending order."""
    work = experience.select("candidate_id", F.lit("experience").alias("kind"), F.col("company_name").alias("title"), F.date_format("start_date", "yyyy-MM-dd").alias("sort_key"))
    held = certification.select("candidate_id", F.lit("certification").alias("kind"), F.col("name").alias("title"), F.lit("0000").alias("sort_key"))
    return work.unionByName(held)


def by_education(candidates: DataFrame, education: DataFrame, text: str) -> DataFrame:
    """Candidates with an education whose degree, institution or field contains the text."""
    low = text.lower()
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(low) for c in ("degree", "institution", "field")])
    return candidates.join(education.where(hit).select("candidate_id"), "candidate_id", "left_semi")


def browse_skills(skills: DataFrame, synonyms: DataFrame, text: str | None = None, category: str | None = None, stack: str | None = None, limit: int = 50) -> DataFrame:
    """Skills whose name or a synonym contains the text, of a category and stack; the limit comes before the order."""
    known = synonyms.groupBy("skill_id").agg(F.collect_set(F.lower("synonym")).alias("s"))
    rows = skills.join(known, "skill_id", "left")
    if text:
        rows = rows.where(F.lower("name").contains(text.lower()) | F.coalesce(F.exists("s", lambda x: x.contains(text.lower())), F.lit(False)))
    if category:
        rows = rows.where(F.lower("category") == category.lower())
    if stack:
        rows = rows.where(F.lower("technology_stack") == stack.lower())
    return rows.drop("s").orderBy("skill_id").limit(limit).orderBy("name")


def full_timeline(experience: DataFrame, certification: DataFrame, education: DataFrame) -> DataFrame:
    """`timeline` with education (candidate_id, degree, end_year); latest first, undated last."""
    learned = education.select("candidate_id", F.lit("education").alias("kind"), F.col("degree").alias("title"), F.coalesce(F.col("end_year").cast("string"), F.lit("0000")).alias("sort_key"))
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("sort_key"), "kind", "title"))
    return timeline(experience, certification).unionByName(learned).withColumn("place", place)


def export_rows(candidates: DataFrame, links: DataFrame, most: int = 1000, skills: int = 12) -> DataFrame:
    """The latest candidates with their first skills as one cell, for a CSV file."""
    newest = candidates.orderBy(F.desc_nulls_last("created_at"), F.desc("candidate_id")).limit(most)
    own = links.join(newest.select("candidate_id"), "candidate_id", "left_semi")
    cell = main_skills(own, skills).select("candidate_id", F.array_join("top_skills", "; ").alias("skills"))
    return newest.join(cell, "candidate_id", "left").withColumn("skills", F.coalesce("skills", F.lit("")))
