"""Scoring candidates against a request: evidence, components, overall, rank."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom.functions.text import normalize_key, normalize_key_py, similarity_py
from hireloom.functions.vectors import embed_many
from hireloom.operators.taxonomy import RELATED, expand_kinds, resolve

WEIGHTS = {"skill": 0.4, "semantic": 0.2, "experience": 0.2, "certification": 0.1, "project": 0.1}
FULL_SEMANTIC = 0.75
PREFERRED = 0.5
MANDATORY_MISS = 0.6
RELATED_CAP = 0.85
#: Credit of a step up or down, how alike names must be to count by meaning, what that counts, at most and in part.
STEP_CREDIT = 0.75
SEMANTIC_LEAST, SEMANTIC_CREDIT, LEXICAL = 0.72, 0.8, 0.9
#: Halves of a hundredth round up, however the product came out in binary.
TIE = 1e-9
BANDS = [(85, "strong_hire"), (70, "hire"), (50, "consider")]


@dataclass(frozen=True)
class Request:
    required: list[str]
    preferred: list[str] = field(default_factory=list)
    mandatory: list[str] = field(default_factory=list)
    certifications: list[str] = field(default_factory=list)
    min_years: float = 0.0
    max_years: float | None = None
    weights: dict[str, float] = field(default_factory=dict)
    statuses: list[str] = field(default_factory=list)
    top_k: int = 10
    min_score: float = 0.0
    job_title: str = "the role"
    #: Whether names that are only alike count (SQL can't say how alike they are).
    semantic: bool = True


def component_weights(overrides: dict[str, float]) -> dict[str, float]:
    """Defaults with overrides of 0 or more, scaled to a sum of 1."""
    merged = {k: max(0.0, overrides.get(k, w)) for k, w in WEIGHTS.items()}
    total = sum(merged.values()) or 1.0
    return {k: w / total for k, w in merged.items()}


def requested_skills(v, request: Request, synonyms: DataFrame | None = None) -> DataFrame:
    """One row per requested skill, equal keys once; required ones come first and weigh 1, preferred ones 0.5.

    `want_id` is the skill of that key; with `synonyms` (synonym, skill_id)
    also the one that `taxonomy.resolve` finds.
    """
    must = {normalize_key_py(m) for m in request.mandatory}
    seen: dict[str, tuple] = {}
    for names, weight in ((request.required, 1.0), (request.preferred, PREFERRED)):
        for n in names:
            seen.setdefault(normalize_key_py(n), (n, weight, normalize_key_py(n) in must))
    rows = v.spark.createDataFrame(list(seen.values()), "requested string, weight double, mandatory boolean")
    if synonyms is not None:
        known = resolve(rows.select(F.col("requested").alias("phrase")), v.skill, synonyms)
        return F.broadcast(rows).join(known.select(F.col("phrase").alias("requested"), F.col("skill_id").alias("want_id")), "requested", "left")
    keys = v.skill.groupBy(normalize_key(F.col("name")).alias("key")).agg(F.max("skill_id").alias("want_id"))
    return F.broadcast(rows.withColumn("key", normalize_key(F.col("requested")))).join(keys, "key", "left").drop("key")


def similar_names(names: DataFrame, asked: list[str], least: float = SEMANTIC_LEAST) -> DataFrame:
    """(name, requested, alike) of the distinct `names` (name) at least so alike to one asked for.

    Alike is the cosine of the hash embeddings, or 0.9 x the similarity of the
    keys if that is more. Every name is embedded once; the names asked for are
    those of one request and travel with the function. Null names are left out.
    """
    wanted = embed_many(asked) if asked else None
    sizes = [len(normalize_key_py(a)) for a in asked]

    def compare(batches):
        for batch in batches:
            held = batch["name"].tolist()
            rows = []
            for at in range(0, len(held) if asked else 0, 256):
                part = held[at : at + 256]
                for name, cosines in zip(part, (embed_many(part) @ wanted.T).tolist()):
                    n = len(normalize_key_py(name))
                    for a, size, alike in zip(asked, sizes, cosines):
                        # Keys of such lengths are at most so similar: the letters are compared only where they could decide.
                        if n and size and LEXICAL * 2 * min(n, size) / (n + size) >= max(least, alike):
                            alike = max(alike, LEXICAL * similarity_py(a, name))
                        if alike >= least:
                            rows.append((name, a, alike))
            yield pd.DataFrame(rows, columns=["name", "requested", "alike"])

    return names.select("name").where("name is not null").distinct().mapInPandas(compare, "name string, requested string, alike double")


def skill_evidence(v, candidates: DataFrame, request: Request, synonyms: DataFrame | None = None) -> DataFrame:
    """(candidate_id, requested, weight, mandatory, match_type, score, matched_skill): the best evidence of every requested skill.

    In this order: `exact` and `synonym` (a link to the skill, or of its key; 1),
    `related` (a held skill within two steps: credit of its last step times its
    weight, at most 0.85), `semantic` (a held name that is alike: 0.8 of how much,
    see `similar_names`), `missing` (0). A synonym is a link to the skill under
    another key. Of equally good names the first in alphabetical order is told.
    """
    asked = F.broadcast(requested_skills(v, request, synonyms))
    pool = candidates.select("candidate_id")
    own = v.skill.select("skill_id", "name")
    links = v.candidate_skill.join(pool, "candidate_id", "left_semi").select("candidate_id", "raw_text", "skill_id").join(own, "skill_id", "left")
    links = links.withColumn("name", F.coalesce("name", "raw_text")).withColumn("key", normalize_key(F.col("raw_text")))
    goal = asked.join(own.select(F.col("skill_id").alias("want_id"), F.col("name").alias("display")), "want_id", "left")
    goal = F.broadcast(goal.withColumn("display", F.coalesce("display", "requested")).withColumn("asked_key", normalize_key(F.col("requested"))))
    by_id = F.col("skill_id") == F.col("want_id")
    hit = links.join(goal, by_id | (F.col("key") == F.col("asked_key")))
    order = F.struct(F.when(by_id, 0).otherwise(1).alias("by"), F.when(by_id & (F.col("key") != normalize_key(F.col("display"))), "synonym").otherwise("exact").alias("type"), "name")
    direct = hit.groupBy("candidate_id", "requested").agg(F.min(order).alias("direct"))
    # The request is a handful of skills, and so are the skills within two steps of each.
    near = expand_kinds(v.skill, v.skill_relation, 2, asked.where("want_id is not null").select(F.col("want_id").alias("skill_id")).distinct())
    credit = F.when(F.col("kind") == 2, RELATED).otherwise(STEP_CREDIT) * F.col("near_weight")
    near = asked.join(near.select(F.col("skill_id").alias("want_id"), F.col("other").alias("skill_id"), F.col("weight").alias("near_weight"), "kind"), "want_id").select("requested", "skill_id", credit.alias("credit"))
    related = links.join(near, "skill_id").groupBy("candidate_id", "requested").agg(F.min(F.struct((-F.col("credit")).alias("loss"), "name")).alias("near"))
    grid = pool.crossJoin(asked)  # the request is a handful of rows
    joined = grid.join(direct, ["candidate_id", "requested"], "left").join(related, ["candidate_id", "requested"], "left")
    if request.semantic:
        names = {r["requested"]: r["display"] for r in goal.select("requested", "display").collect()}  # the request's own few names
        found = similar_names(links, sorted(set(names.values()))).withColumnRenamed("requested", "display")
        alike = links.select("candidate_id", "name").join(found, "name").join(goal.select("requested", "display"), "display")
        best = alike.groupBy("candidate_id", "requested").agg(F.min(F.struct((-F.col("alike")).alias("loss"), "name")).alias("alike"))
        joined = joined.join(best, ["candidate_id", "requested"], "left")
    else:
        joined = joined.withColumn("alike", F.lit(None).cast("struct<loss:double,name:string>"))
    kind = F.when(F.col("direct").isNotNull(), F.col("direct.type")).when(F.col("near").isNotNull(), "related").when(F.col("alike").isNotNull(), "semantic").otherwise("missing")
    by_step = F.when(F.col("near").isNotNull(), F.round(F.least(F.lit(RELATED_CAP), -F.col("near.loss")), 3))
    by_name = F.when(F.col("alike").isNotNull(), F.round(F.least(F.lit(SEMANTIC_CREDIT), -F.col("alike.loss") * SEMANTIC_CREDIT), 3))
    score = F.when(F.col("direct").isNotNull(), 1.0).otherwise(F.coalesce(by_step, by_name, F.lit(0.0)))
    return joined.select(
        "candidate_id", "requested", "weight", "mandatory", kind.alias("match_type"), score.alias("score"), F.coalesce("direct.name", "near.name", "alike.name").alias("matched_skill")
    )


def experience_score(years: Column, request: Request) -> tuple[Column, bool]:
    low, high = request.min_years, request.max_years
    if low <= 0 and high is None:
        return F.when(years > 0, 100.0).otherwise(60.0), False
    if low > 0:
        over = F.when(years > high, 88.0).otherwise(100.0) if high else F.lit(100.0)
        short = F.round(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), years / low)), F.lit(1.2)) * 100, 2)
        return F.when(years >= low, over).otherwise(short), True
    return F.when(years <= high, 100.0).otherwise(85.0), True


def certification_scores(v, candidates: DataFrame, request: Request) -> DataFrame:
    """Share of the wanted certifications whose key contains a held one's or is contained in it."""
    held = v.certification.join(candidates.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", F.lower("name").alias("held"))
    wanted = v.spark.createDataFrame([(c.lower(),) for c in request.certifications], "wanted string")
    hits = held.join(F.broadcast(wanted), F.col("held").contains(F.col("wanted")) | F.col("wanted").contains(F.col("held")))
    return hits.groupBy("candidate_id").agg(F.round(100 * F.countDistinct("wanted") / len(request.certifications), 2).alias("certification"))


def project_scores(v, candidates: DataFrame, request: Request) -> DataFrame:
    """Share of the requested skills that occur in the texts of a candidate's work; no work, no row."""
    work = v.experience.join(candidates.select("candidate_id"), "candidate_id", "left_semi").groupBy("candidate_id").agg(F.lower(F.array_join(F.collect_set("company_name"), "\n")).alias("text"))
    hits = sum((F.when(F.col("text").contains(s.lower()), 1).otherwise(0) for s in request.required + request.preferred), F.lit(0))
    return work.select("candidate_id", F.round(100 * hits / max(1, len(request.required + request.preferred)), 2).alias("project"))


def score(v, candidates: DataFrame, request: Request, vector_scores: DataFrame) -> DataFrame:
    """One row per candidate: components, overall, confidence, band.

    Components that don't apply give their weight to the others; contributions
    are rounded before they are summed; a missing mandatory skill costs 40 %.
    """
    evidence = skill_evidence(v, candidates, request)
    skill = evidence.groupBy("candidate_id").agg(
        F.round(100 * F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), 2).alias("skill"),
        F.bool_or(F.col("mandatory") & (F.col("match_type") == "missing")).alias("mandatory_missing"),
        F.count_if(F.col("match_type").isin("exact", "synonym")).alias("matched"), F.count_if(F.col("match_type").isin("related", "semantic")).alias("related"),
        F.count_if(F.col("match_type") == "missing").alias("missing"),
    )
    rows = candidates.join(skill, "candidate_id").join(vector_scores.select("candidate_id", F.col("score").alias("vector")), "candidate_id", "left")
    if request.certifications:
        rows = rows.join(certification_scores(v, candidates, request), "candidate_id", "left").withColumn("certification", F.coalesce("certification", F.lit(0.0)))
    else:
        rows = rows.withColumn("certification", F.lit(70.0))
    rows = rows.join(project_scores(v, candidates, request), "candidate_id", "left")
    years, applies = experience_score(F.col("total_experience_years"), request)
    w = component_weights(request.weights)
    rows = rows.withColumn("experience", years).withColumn("semantic", F.round(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("vector", F.lit(0.0))) / FULL_SEMANTIC), 2))
    active = {
        "skill": F.lit(w["skill"]), "semantic": F.when(F.col("vector").isNotNull(), w["semantic"]).otherwise(0.0), "experience": F.lit(w["experience"] if applies else 0.0),
        "certification": F.lit(w["certification"] if request.certifications else 0.0), "project": F.when(F.col("project").isNotNull(), w["project"]).otherwise(0.0),
    }
    rows = rows.withColumns({f"w_{k}": c for k, c in active.items()}).withColumn("project", F.coalesce("project", F.lit(0.0)))
    rows = rows.withColumn("w", sum((F.col(f"w_{k}") for k in WEIGHTS), F.lit(0.0)))
    share = lambda k: F.coalesce(F.try_divide(F.col(f"w_{k}"), F.col("w")), F.lit(0.0))
    total = sum((F.round(share(k) * F.col(k) + TIE, 2) for k in WEIGHTS), F.lit(0.0))
    overall = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(F.col("mandatory_missing"), total * MANDATORY_MISS).otherwise(total))) + TIE, 2)
    rows = rows.withColumn("overall", overall)
    asked = F.col("matched") + F.col("related") + F.col("missing")
    channels = F.when(F.col("vector").isNotNull(), 1.0).otherwise(0.5)
    sure = 0.3 + 0.25 * F.col("matched") / asked + 0.15 * channels + 0.1 * (F.col("matched") + F.col("related")) / asked
    band = F.coalesce(*[F.when(F.col("overall") >= at, F.lit(name)) for at, name in BANDS], F.lit("reject"))
    capped = F.when(F.col("mandatory_missing") & band.isin("strong_hire", "hire"), "consider").otherwise(band)
    return rows.withColumn("confidence", F.round(100 * sure, 1)).withColumn("recommendation", capped)


def rank(scored: DataFrame, request: Request) -> DataFrame:
    """Best first: overall, experience, name; at least `min_score`; ranks 1..top_k."""
    from pyspark.sql import Window as W

    order = [F.desc("overall"), F.desc("total_experience_years"), F.asc("full_name")]
    best = scored.where(F.col("overall") >= request.min_score).orderBy(*order).limit(request.top_k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # top_k rows


def widen(retrieved: DataFrame, recent: DataFrame, n: int) -> DataFrame:
    """Retrieved ids in order, then recent ones that weren't, `n` in all."""
    rows = retrieved.select("candidate_id", F.lit(0).alias("channel"), "place").unionByName(recent.select("candidate_id", F.lit(1).alias("channel"), "place"))
    first = rows.groupBy("candidate_id").agg(F.min(F.struct("channel", "place")).alias("at"))
    return first.orderBy("at", "candidate_id").limit(n).select("candidate_id", F.col("at.channel").alias("channel"))


def narrative(ranked: DataFrame, request: Request) -> DataFrame:
    """A sentence or two for each ranked row, from its figures."""
    label = F.when(F.col("overall") >= 85, "an excellent fit").when(F.col("overall") >= 70, "a strong fit").when(F.col("overall") >= 50, "a partial fit").otherwise("a weak fit")
    text = F.concat(
        F.col("full_name"), F.lit(" scores "), F.round("overall").cast("int"), F.lit(f"% for {request.job_title}: "), label, F.lit(". "), F.col("matched"), F.lit(" skills directly, "),
        F.col("related"), F.lit(" by relation, "), F.col("missing"), F.lit(" missing."), F.when(F.col("mandatory_missing"), " A mandatory skill is missing.").otherwise(""),
    )
    return ranked.select("rank", "candidate_id", text.alias("explanation"))


#: The reference bands of a recommendation, and the least score of one with a mandatory skill missing.
RECOMMENDATIONS = [(85, "Highly Recommended"), (70, "Recommended"), (50, "Consider")]
CONSIDER_MISSING = 60
NO_EVIDENCE = 0.55
MOST_ADDITIONAL = 15


def recommendation(overall: Column, mandatory_missing: Column) -> Column:
    plain = F.coalesce(*[F.when(overall >= at, F.lit(name)) for at, name in RECOMMENDATIONS], F.lit("Not Recommended"))
    return F.when(mandatory_missing, F.when(overall >= CONSIDER_MISSING, "Consider").otherwise("Not Recommended")).otherwise(plain)


def confidence(v, candidates: DataFrame, request: Request, evidence: DataFrame, complete: DataFrame, channels: DataFrame) -> DataFrame:
    """(candidate_id, confidence) in percent: evidence, completeness of the profile, channels that found it, coverage.

    `channels` has the number of retrieval channels of a candidate, at most 2 count; `complete` its completeness.
    """
    asked = requested_skills(v, request)
    links = v.candidate_skill.join(F.broadcast(asked), (F.col("raw_text") == F.col("requested")) | (F.col("skill_id") == F.col("want_id")))
    sure = links.groupBy("candidate_id", "requested").agg(F.max("confidence").alias("sure"))
    matched = evidence.where("match_type in ('exact', 'synonym')").join(sure, ["candidate_id", "requested"], "left")
    found = matched.groupBy("candidate_id").agg(F.avg(F.coalesce("sure", F.lit(NO_EVIDENCE))).alias("sure"), F.count("*").alias("n"))
    total = max(1, len({n.lower() for n in request.required + request.preferred}))
    rows = candidates.select("candidate_id").join(found, "candidate_id", "left").join(complete, "candidate_id", "left").join(channels, "candidate_id", "left")
    c = lambda name, default: F.coalesce(name, F.lit(default))
    raw = 0.30 + 0.25 * c("sure", NO_EVIDENCE) + 0.20 * c("completeness", 0.0) + 0.15 * F.least(F.lit(1.0), c("channels", 0) / 2) + 0.10 * c("n", 0) / total
    return rows.select("candidate_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)) * 100 + TIE, 1).alias("confidence"))


def with_statuses(candidates: DataFrame, request: Request) -> DataFrame:
    """Candidates in one of the statuses asked for; all if none is."""
    return candidates.where(F.lower("status").isin([s.lower() for s in request.statuses])) if request.statuses else candidates


def candidate_pool(retrieved: DataFrame, recent: DataFrame, candidates: DataFrame, request: Request) -> DataFrame:
    """Candidates that a run scores: the best retrieved ones, filled up with recent ones if they are fewer than `top_k`.

    `retrieved` (candidate_id, fused); `recent` (candidate_id, place).
    """
    most = max(4 * request.top_k, 60)
    best = retrieved.orderBy(F.desc("fused"), "candidate_id").limit(most).select("candidate_id")
    short = best.agg((F.count("*") < request.top_k).alias("short"))
    fill = recent.orderBy("place").limit(most).crossJoin(F.broadcast(short)).where("short").select("candidate_id")  # one row says whether they are needed
    pool = best.unionByName(fill.join(best, "candidate_id", "left_anti"))
    # At most twice `most` ids, whatever the data; as a list they reach the scans of everything that is scored.
    ids = sorted(r["candidate_id"] for r in pool.collect())
    return with_statuses(candidates.where(F.col("candidate_id").isin(ids)) if ids else candidates.limit(0), request)


def additional_skills(links: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """A candidate's skills that no request asked for, by confidence: (candidate_id, raw_text, place), at most `MOST_ADDITIONAL`."""
    from pyspark.sql import Window as W

    used = evidence.where("match_type in ('exact', 'synonym')").select("candidate_id", F.col("requested").alias("raw_text"))
    rest = links.join(candidates.select("candidate_id"), "candidate_id", "left_semi").join(used, ["candidate_id", "raw_text"], "left_anti")
    place = F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("confidence"), "raw_text"))
    return rest.select("candidate_id", "raw_text", place.alias("place")).where(F.col("place") <= MOST_ADDITIONAL)


def strengths_and_gaps(ranked: DataFrame, evidence: DataFrame, request: Request) -> DataFrame:
    """(candidate_id, strengths, gaps, questions, learning, career_fit) of ranked rows, as the template words them."""
    own = evidence.join(ranked.select("candidate_id"), "candidate_id", "left_semi")
    listed = lambda *kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("match_type").isin(*kinds), F.struct(-F.col("weight"), "requested")))), lambda x: x["requested"])
    lists = own.groupBy("candidate_id").agg(listed("exact", "synonym").alias("matched"), listed("related", "semantic").alias("near"), listed("missing").alias("absent"))
    rows = ranked.select("candidate_id", "total_experience_years", "overall").join(lists, "candidate_id", "left")
    low, years = request.min_years, F.col("total_experience_years")
    some = lambda a, n, f: F.transform(F.slice(a, 1, n), f)
    meets = F.when((F.lit(low) > 0) & (years >= low), F.concat(F.lit("Meets the experience bar ("), years.cast("string"), F.lit(" yrs)")))
    short = F.when((F.lit(low) > 0) & (years < low), F.concat(F.lit("Experience is "), F.round(low - years, 1).cast("string"), F.lit(" years short")))
    questions = F.concat(
        some("matched", 4, lambda s: F.concat(F.lit("Describe a project where "), s, F.lit(" was central to the outcome."))),
        some("absent", 2, lambda s: F.concat(F.lit("How would you ramp up on "), s, F.lit("?"))), some("near", 2, lambda s: F.concat(F.lit("How does your experience carry over to "), s, F.lit("?"))),
    )
    label = F.when(F.col("overall") >= 85, f"Strong immediate fit for {request.job_title}").when(F.col("overall") >= 70, f"Good fit for {request.job_title}").when(
        F.col("overall") >= 50, "Partial fit").otherwise("Not aligned with this requirement")
    return rows.select(
        "candidate_id", F.slice(F.array_compact(F.concat(F.slice("matched", 1, 6), F.array(meets))), 1, 8).alias("strengths"),
        F.slice(F.array_compact(F.concat(some("absent", 6, lambda s: F.concat(F.lit("No evidence of "), s)), F.array(short))), 1, 8).alias("gaps"), F.slice(questions, 1, 8).alias("questions"),
        F.slice(some("absent", 5, lambda s: F.concat(s, F.lit(": start with the fundamentals and a small project."))), 1, 6).alias("learning"), label.alias("career_fit"),
    )


def persist_run(ranked: DataFrame, path: str, run_id: int, title: str) -> None:
    """Append a run's results under `path`/results and its summary under `path`/runs."""
    rows = ranked.select(F.lit(run_id).cast("long").alias("run_id"), "rank", "candidate_id", "overall", "recommendation")
    rows.write.mode("append").parquet(f"{path}/results")
    told = rows.agg(F.first("run_id").alias("run_id"), F.lit(title).alias("title"), F.count("*").alias("returned"), F.max("overall").alias("top_score"))
    told.where("run_id is not null").write.mode("append").parquet(f"{path}/runs")


def run_detail(spark, path: str) -> DataFrame:
    """Every run with its results, best first."""
    results = spark.read.parquet(f"{path}/results").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "overall"))).alias("results"))
    return spark.read.parquet(f"{path}/runs").join(results, "run_id")


def with_last_score(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates with the score of the latest run that has them."""
    last = results.groupBy("candidate_id").agg(F.max_by("overall", "run_id").alias("__score"))
    return candidates.join(last, "candidate_id", "left").withColumn("last_match_score", F.coalesce("__score", "last_match_score")).drop("__score")
