"""Query parsing, channel scores and fusion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.functions.text import normalize_key_py, tokenize, tokenize_py

#: Channel weights by search mode.
MODES = {
    "hybrid": (0.45, 0.35, 0.20), "semantic": (0.0, 1.0, 0.0), "graph": (1.0, 0.0, 0.0), "skill": (1.0, 0.0, 0.0), "keyword": (0.0, 0.0, 1.0),
}


def parse_query(text: str, skills: list[str]) -> dict:
    """Years, skills, place and unknown terms of a free-text request."""
    low = text.lower()
    years = re.search(r"(\d{1,2})\s*\+?\s*(?:years?|yrs?)", low)
    keys = {normalize_key_py(s): s for s in skills}
    tokens = tokenize_py(text)
    found, used = [], set()
    for n in (4, 3, 2, 1):
        for i in range(len(tokens) - n + 1):
            if used.isdisjoint(range(i, i + n)) and (name := keys.get(normalize_key_py(" ".join(tokens[i : i + n])))):
                found.append(name)
                used.update(range(i, i + n))
    place = re.search(r"\bin ([A-Z][\w-]+(?: [A-Z][\w-]+)*)", text)
    location = place[1] if place and normalize_key_py(place[1]) not in keys else None
    gone = set(tokenize_py(location or ""))
    rest = [t for i, t in enumerate(tokens) if i not in used and t not in gone and not t.isdigit()]
    return {"min_years": float(years[1]) if years else None, "skills": sorted(dict.fromkeys(found)), "location": location, "unknown": rest[:4]}


def graph_scores(edges: DataFrame, direct: DataFrame, expanded: DataFrame) -> DataFrame:
    """(candidate, graph): direct skills held and half the weight of expanded ones, over all asked for, at most 1."""
    asked = direct.agg(F.count("*").alias("d")).crossJoin(expanded.agg(F.count("*").alias("e")))
    terms = direct.select("key", F.lit(1.0).alias("worth")).unionByName(expanded.select("key", (F.col("weight") * 0.5).alias("worth")))
    held = edges.where("relation = 'HAS_SKILL'").select(F.col("src").alias("candidate"), F.col("dst").alias("key"))
    worth = held.join(F.broadcast(terms), "key").groupBy("candidate").agg(F.sum("worth").alias("worth"))
    top = F.greatest(F.lit(1.0), F.col("d") + 0.5 * F.col("e"))
    return worth.crossJoin(F.broadcast(asked)).select("candidate", F.round(F.least(F.lit(1.0), F.col("worth") / top), 4).alias("graph"))


def fuse(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """Both channels by candidate: 0.65 graph + 0.35 vector, and which channels found it."""
    joined = graph.join(vector, "candidate", "full_outer")
    g, x = F.coalesce("graph", F.lit(0.0)), F.coalesce("vector", F.lit(0.0))
    found = F.concat_ws("+", F.when(F.col("graph").isNotNull(), "graph"), F.when(F.col("vector").isNotNull(), "vector"))
    return joined.select("candidate", F.round(0.65 * g + 0.35 * x, 4).alias("fused"), found.alias("channels"))


def search_scores(channels: DataFrame, modes: list[str]) -> DataFrame:
    """(candidate, mode, score) from graph, vector and keyword channels; nothing found is dropped but in keyword mode."""
    weights = channels.sparkSession.createDataFrame([(m, *MODES[m]) for m in modes], "mode string, wg double, ws double, wk double")
    c = lambda name: F.coalesce(name, F.lit(0.0))
    semantic = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("vector")) / 0.75)
    score = F.round(100 * (F.col("wg") * c("graph") + F.col("ws") * semantic + F.col("wk") * c("keyword")), 2)
    rows = channels.crossJoin(F.broadcast(weights)).select("candidate", "mode", score.alias("score"))
    return rows.where((F.col("score") > 0) | (F.col("mode") == "keyword"))


SEMANTIC_FULL = 0.75
POOL = 500


def token_overlap(haystack, tokens: list[str]):
    """Share of a query's distinct tokens found in a text."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(tokens)])
    return F.round(F.size(F.array_intersect(wanted, tokenize(haystack))) / F.size(wanted), 4)


def hybrid_hits(people: DataFrame, keyword_pool: DataFrame, channels: DataFrame, tokens: list[str], mode: str = "hybrid") -> DataFrame:
    """Scored hits of a search: keyword hits, and what only the other channels found.

    `people` (candidate_id, haystack, and what is shown), `keyword_pool` (candidate_id, at most `POOL` by the
    caller's order), `channels` (candidate_id, graph, vector). Hits of score 0 are dropped.
    """
    wg, ws, wk = MODES[mode]
    only = channels.select("candidate_id").join(keyword_pool, "candidate_id", "left_anti")
    pool = keyword_pool.select("candidate_id").unionByName(only)
    rows = people.join(pool, "candidate_id", "left_semi").join(channels, "candidate_id", "left")
    semantic = F.least(F.lit(1.0), F.coalesce("vector", F.lit(0.0)) / SEMANTIC_FULL)
    rows = rows.withColumn("keyword_score", token_overlap(F.col("haystack"), tokens))
    combined = wg * F.coalesce("graph", F.lit(0.0)) + ws * semantic + wk * F.col("keyword_score")
    return rows.withColumn("combined", combined).where(F.col("combined") > 0).withColumn("ai_score", F.round(F.col("combined") * 100 + 1e-9, 2)).drop("combined")


#: What hits can be sorted by.
SORTS = {"ai_score": "ai_score", "experience": "total_experience_years", "name": "full_name", "upload_date": "candidate_id"}


def page_of_hits(hits: DataFrame, sort_by: str = "ai_score", descending: bool = True, number: int = 1, size: int = 20) -> DataFrame:
    column = F.lower("full_name") if sort_by == "name" else F.col(SORTS.get(sort_by, "ai_score"))
    return hits.orderBy(column.desc() if descending else column.asc(), "candidate_id").offset((number - 1) * size).limit(size)


def skill_credits(people: DataFrame, links: DataFrame, asked: DataFrame, near: DataFrame) -> DataFrame:
    """(candidate_id, requested, match_type, credit): held 1.0, a parent, child or related skill held 0.6, else missing.

    `asked` (requested, want_id), `near` (skill_id, other) of equivalent skills.
    """
    held = links.join(people.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", "raw_text", "skill_id")
    direct = held.join(F.broadcast(asked), (F.col("raw_text") == F.col("requested")) | (F.col("skill_id") == F.col("want_id"))).select("candidate_id", "requested").distinct()
    bridges = asked.join(near.select(F.col("skill_id").alias("want_id"), F.col("other").alias("skill_id")), "want_id").select("requested", "skill_id")
    related = held.join(bridges, "skill_id").select("candidate_id", "requested").distinct()
    grid = people.select("candidate_id").crossJoin(F.broadcast(asked.select("requested")))  # the request is a handful of rows
    rows = grid.join(direct.withColumn("d", F.lit(True)), ["candidate_id", "requested"], "left").join(related.withColumn("r", F.lit(True)), ["candidate_id", "requested"], "left")
    kind = F.when(F.col("d"), "direct").when(F.col("r"), "related").otherwise("missing")
    return rows.select("candidate_id", "requested", kind.alias("match_type"), F.when(F.col("d"), 1.0).when(F.col("r"), 0.6).otherwise(0.0).alias("credit"))


def context_text(hits: DataFrame, credits: DataFrame) -> DataFrame:
    """(candidate_id, context): what is known of each hit, in labelled lines."""
    listed = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("match_type") == kind, F.col("requested")))), ", ")
    asked = credits.groupBy("candidate_id").agg(
        F.array_join(F.array_sort(F.collect_list("requested")), ", ").alias("asked"), listed("direct").alias("matched"), listed("related").alias("near"), listed("missing").alias("absent")
    )
    none = lambda c, word="none": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(word))
    place = F.coalesce(F.nullif(F.concat_ws(", ", "city", "country"), F.lit("")), F.lit("not stated"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    text = F.concat_ws(
        "\n", line("Candidate", F.col("full_name")), line("Total experience", F.concat(F.col("total_experience_years").cast("string"), F.lit(" years"))),
        line("Education", none("highest_degree", "not stated")), line("Location", place), line("Requested skills", none("asked")), line("Matched skills", none("matched")),
        line("Related/transferable skills", none("near")), line("Missing skills", none("absent")),
    )
    return hits.join(asked, "candidate_id", "left").select("candidate_id", text.alias("context"))


def template_answer(hits: DataFrame, question: str, most: int = 5) -> DataFrame:
    """One row: the answer that names the best hits in order."""
    best = hits.orderBy(F.desc("ai_score"), "candidate_id").limit(most)
    names = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("ai_score"), "candidate_id", "full_name"))), lambda x: x["full_name"]), ", ").alias("names"))
    none = F.lit("No candidates in the knowledge graph match that query yet. Upload resumes or relax the filters and try again.")
    told = F.concat(
        F.lit(f'Based on graph and vector retrieval, the strongest candidates for "{question}" are '), F.col("names"),
        F.lit(". The scoring breakdown for each candidate lists the exact matched, related and missing skills that produced their ranking."),
    )
    return names.select(F.when(F.col("names") == "", none).otherwise(told).alias("answer"))
