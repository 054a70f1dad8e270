"""Matching queries."""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

from pyspark.sql import functions as F

from hireloom.operators import matching
from hireloom.plans.registry import query
from hireloom.plans.relational import skill_names
from hireloom.plans.taxonomies import HOPS, NORM
from hireloom.plans.vectors import COS, QV, first_vector
from hireloom.functions.vectors import cosine

CERTS = ["Brand#11", "Brand#23 STANDARD"]


def request(v, **more) -> matching.Request:
    """The first two skills by name are required (the first is mandatory), the next two preferred."""
    names = skill_names(v, 4)
    base = dict(required=names[:2], preferred=names[2:], mandatory=names[:1], certifications=CERTS, min_years=5.0, max_years=11.0, top_k=20, semantic=False)
    return matching.Request(**(base | more))


def vector_scores(v):
    """Best cosine of a candidate's embeddings with the first vector; most candidates have none."""
    q = F.array(*[F.lit(x) for x in first_vector(v)])
    return v.embedding.groupBy("candidate_id").agg(F.max(F.round(cosine(F.col("vector"), q), 5)).alias("score"))


ASK = "ask AS (SELECT name AS requested, skill_id AS want_id, CASE WHEN rn <= 2 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, rn = 1 AS mandatory FROM (SELECT *, row_number() OVER (ORDER BY name) AS rn FROM skill) WHERE rn <= 4)"
EVID = f"""{ASK}, {HOPS},
    d2 AS (SELECT d1.seed, h.other AS node, round(d1.weight * h.weight, 4) AS weight, h.kind, row_number() OVER (PARTITION BY d1.seed, h.other ORDER BY rank, h.kind) AS n
      FROM d1 JOIN hops h ON h.skill_id = d1.node WHERE h.other <> d1.seed AND NOT EXISTS (SELECT 1 FROM d1 p WHERE p.seed = d1.seed AND p.node = h.other)),
    reach AS (SELECT seed, node, weight, kind FROM d1 UNION ALL SELECT seed, node, weight, kind FROM d2 WHERE n = 1),
    near AS (SELECT requested, node AS skill_id, max(CASE WHEN kind = 2 THEN 0.6 ELSE 0.75 END::DOUBLE * r.weight) AS credit FROM ask JOIN reach r ON seed = want_id GROUP BY 1, 2),
    direct AS (SELECT candidate_id, requested, CASE WHEN min(CASE WHEN skill_id = want_id THEN 0 ELSE 1 END) = 0 AND NOT bool_or(skill_id = want_id AND {NORM.format('raw_text')} = {NORM.format('requested')}) THEN 'synonym' ELSE 'exact' END AS type
      FROM links JOIN ask ON {NORM.format('raw_text')} = {NORM.format('requested')} OR skill_id = want_id GROUP BY 1, 2),
    rel AS (SELECT candidate_id, requested, round(least(max(credit), 0.85), 3) AS near FROM links JOIN near USING (skill_id) GROUP BY 1, 2),
    evid AS (SELECT a.candidate_id, k.requested, k.weight, k.mandatory, CASE WHEN d.candidate_id IS NOT NULL THEN d.type WHEN r.near IS NOT NULL THEN 'related' ELSE 'missing' END AS match_type,
        CASE WHEN d.candidate_id IS NOT NULL THEN 1.0 ELSE coalesce(r.near, 0) END::DOUBLE AS score
      FROM alive a CROSS JOIN ask k LEFT JOIN direct d ON d.candidate_id = a.candidate_id AND d.requested = k.requested LEFT JOIN rel r ON r.candidate_id = a.candidate_id AND r.requested = k.requested)"""
#: The same ladder over links written otherwise: the words of every third skill the other way round, and of others in capitals.
TURNED_LINKS = "links AS (SELECT candidate_id, skill_id, CASE WHEN skill_id % 3 = 1 THEN array_to_string(list_reverse(string_split(raw_text, ' ')), ' ') ELSE upper(raw_text) END AS raw_text FROM candidate_skill)"
TURNED = f"{TURNED_LINKS}, {EVID}"
EVID = f"links AS (SELECT * FROM candidate_skill), {EVID}"
EXPER = "CASE WHEN total_experience_years >= 5 THEN CASE WHEN total_experience_years > 11 THEN 88.0 ELSE 100.0 END ELSE round(pow(greatest(0, least(1, total_experience_years / 5)), 1.2) * 100, 2) END"
CERTQ = f"cert AS (SELECT candidate_id, round(100.0 * count(DISTINCT wanted) / 2, 2)::DOUBLE AS certification FROM certification JOIN (VALUES {', '.join(f'(lower({c!r}))' for c in CERTS)}) w(wanted) ON contains(lower(name), wanted) OR contains(wanted, lower(name)) GROUP BY 1)"
PROJ = "proj AS (SELECT candidate_id, round(100.0 * sum(hit) / 4, 2)::DOUBLE AS project FROM (SELECT DISTINCT e.candidate_id, requested, max(contains(lower(company_name), lower(requested))::INT) OVER (PARTITION BY e.candidate_id, requested) AS hit FROM experience e CROSS JOIN ask) GROUP BY 1)"


@query("match_skill_evidence", f"WITH {EVID} SELECT * FROM evid")
def match_skill_evidence(v):
    return matching.skill_evidence(v, v.alive, request(v)).select("candidate_id", "requested", "weight", "mandatory", "match_type", "score")


def turned_links(v):
    """Skill links whose raw texts are written otherwise, see `TURNED_LINKS`."""
    words = F.array_join(F.reverse(F.split("raw_text", " ")), " ")
    return v.candidate_skill.withColumn("raw_text", F.when(F.col("skill_id") % 3 == 1, words).otherwise(F.upper("raw_text")))


def over_turned(v):
    return SimpleNamespace(spark=v.spark, skill=v.skill, skill_relation=v.skill_relation, candidate_skill=turned_links(v))


@query("match_evidence_synonym", f"WITH {TURNED} SELECT * FROM evid")
def match_evidence_synonym(v):
    found = matching.skill_evidence(over_turned(v), v.alive, request(v))
    return found.select("candidate_id", "requested", "weight", "mandatory", "match_type", "score")


@query("match_evidence_ladder")
def match_evidence_ladder(v):
    """All five kinds of evidence of all candidates, names that are alike included."""
    r = request(v, semantic=True)
    turned = [" ".join(reversed(n.split(" "))) for n in r.preferred]
    return matching.skill_evidence(over_turned(v), v.alive, replace(r, preferred=turned))


@query("match_experience", f"SELECT candidate_id, {EXPER}::DOUBLE AS score FROM alive")
def match_experience(v):
    years, _ = matching.experience_score(F.col("total_experience_years"), request(v))
    return v.alive.select("candidate_id", years.alias("score"))


@query("match_certification", f"WITH {CERTQ} SELECT candidate_id, certification FROM cert JOIN alive USING (candidate_id)")
def match_certification(v):
    return matching.certification_scores(v, v.alive, request(v))


@query("match_project", f"WITH {ASK}, {PROJ} SELECT candidate_id, project FROM proj JOIN alive USING (candidate_id)")
def match_project(v):
    return matching.project_scores(v, v.alive, request(v))


SCORE = f"""{EVID}, {CERTQ}, {PROJ},
    vec AS (SELECT candidate_id, max(round({COS.format(a='vector', b=QV)}, 5)) AS vector FROM embedding GROUP BY 1),
    sk AS (SELECT candidate_id, round(100 * sum(weight * score) / sum(weight), 2) AS skill, bool_or(mandatory AND match_type = 'missing') AS mandatory_missing,
      count(*) FILTER (match_type = 'exact') AS matched, count(*) FILTER (match_type = 'related') AS related, count(*) FILTER (match_type = 'missing') AS missing FROM evid GROUP BY 1),
    comp AS (SELECT a.candidate_id, full_name, total_experience_years, skill, mandatory_missing, matched, related, missing, vector, round(100 * least(1, greatest(0, coalesce(vector, 0)) / 0.75), 2) AS semantic,
      {EXPER} AS experience, coalesce(certification, 0) AS certification, coalesce(project, 0) AS project,
      CASE WHEN vector IS NULL THEN 0 ELSE 0.2 END::DOUBLE AS ws, CASE WHEN project IS NULL THEN 0 ELSE 0.1 END::DOUBLE AS wp
      FROM alive a JOIN sk USING (candidate_id) LEFT JOIN vec USING (candidate_id) LEFT JOIN cert USING (candidate_id) LEFT JOIN proj USING (candidate_id)),
    tot AS (SELECT *, round(0.4::DOUBLE / w * skill + 1e-9, 2) + round(ws / w * semantic + 1e-9, 2) + round(0.2::DOUBLE / w * experience + 1e-9, 2) + round(0.1::DOUBLE / w * certification + 1e-9, 2) + round(wp / w * project + 1e-9, 2) AS total
      FROM (SELECT *, 0.4::DOUBLE + ws + 0.2::DOUBLE + 0.1::DOUBLE + wp AS w FROM comp)),
    fin AS (SELECT candidate_id, full_name, total_experience_years, skill, semantic, experience::DOUBLE AS experience, certification, project, matched, related, missing, mandatory_missing,
      round(least(100, greatest(0, CASE WHEN mandatory_missing THEN total * 0.6::DOUBLE ELSE total END)) + 1e-9, 2) AS overall FROM tot)"""
PARTS = ["candidate_id", "skill", "semantic", "experience", "certification", "project", "overall"]


@query("match_overall", f"WITH {SCORE} SELECT {', '.join(PARTS)} FROM fin")
def match_overall(v):
    return matching.score(v, v.alive, request(v), vector_scores(v)).select(*PARTS)


def _ranked(v):
    r = request(v)
    return matching.rank(matching.score(v, v.alive, r, vector_scores(v)), r)


BAND = "CASE WHEN mandatory_missing AND overall >= 70 THEN 'consider' WHEN overall >= 85 THEN 'strong_hire' WHEN overall >= 70 THEN 'hire' WHEN overall >= 50 THEN 'consider' ELSE 'reject' END"


@query("match_ranked", f"WITH {SCORE} SELECT row_number() OVER (ORDER BY overall DESC, total_experience_years DESC, full_name) AS rank, candidate_id, overall, {BAND} AS recommendation FROM fin ORDER BY rank LIMIT 20")
def match_ranked(v):
    return _ranked(v).select("rank", "candidate_id", "overall", "recommendation")


@query("match_skill_only", f"WITH {SCORE} SELECT candidate_id, skill, round(least(100, CASE WHEN mandatory_missing THEN skill * 0.6::DOUBLE ELSE skill END) + 1e-9, 2) AS overall FROM fin")
def match_skill_only(v):
    r = request(v, weights={"skill": 1.0, "semantic": 0.0, "experience": 0.0, "certification": 0.0, "project": 0.0})
    return matching.score(v, v.alive, r, vector_scores(v)).select("candidate_id", "skill", "overall")


@query("match_widen", """WITH got AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id DESC) AS place FROM alive WHERE candidate_id % 50 = 1),
    recent AS (SELECT candidate_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, candidate_id DESC) AS place FROM alive)
    SELECT candidate_id, channel FROM (SELECT candidate_id, min(channel) AS channel, min(channel * 1000000 + place) AS pos FROM (SELECT candidate_id, 0 AS channel, place FROM got UNION ALL SELECT candidate_id, 1, place FROM recent) GROUP BY 1)
    ORDER BY pos, candidate_id LIMIT 60""")
def match_widen(v):
    from pyspark.sql import Window as W

    got = v.alive.where("candidate_id % 50 = 1").withColumn("place", F.row_number().over(W.orderBy(F.desc("candidate_id"))))
    newest = v.alive.orderBy(F.desc_nulls_last("created_at"), F.desc("candidate_id")).limit(120)
    recent = newest.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("created_at"), F.desc("candidate_id"))))
    return matching.widen(got.limit(60), recent, 60)


@query("match_narrative")
def match_narrative(v):
    return matching.narrative(_ranked(v), request(v))


REC = "CASE WHEN mandatory_missing THEN CASE WHEN overall >= 60 THEN 'Consider' ELSE 'Not Recommended' END WHEN overall >= 85 THEN 'Highly Recommended' WHEN overall >= 70 THEN 'Recommended' WHEN overall >= 50 THEN 'Consider' ELSE 'Not Recommended' END"


@query("match_recommendation", f"WITH {SCORE} SELECT candidate_id, overall, {REC} AS recommendation FROM fin")
def match_recommendation(v):
    scored = matching.score(v, v.alive, request(v), vector_scores(v))
    return scored.select("candidate_id", "overall", matching.recommendation(F.col("overall"), F.col("mandatory_missing")).alias("recommendation"))


COMPLETE = """compl AS (SELECT a.candidate_id, round(((full_name IS NOT NULL)::INT + (city IS NOT NULL OR country IS NOT NULL)::INT + (total_experience_years > 0)::INT + (highest_degree IS NOT NULL)::INT
      + (coalesce(n, 0) >= 3)::INT + (a.candidate_id IN (SELECT candidate_id FROM experience))::INT + (a.candidate_id IN (SELECT candidate_id FROM certification))::INT) / 12.0, 3)::DOUBLE AS completeness
      FROM alive a LEFT JOIN (SELECT candidate_id, count(*) AS n FROM candidate_skill GROUP BY 1) USING (candidate_id))"""


@query("match_confidence", f"""WITH {EVID}, {COMPLETE}, sure AS (SELECT candidate_id, requested, max(confidence) AS sure FROM candidate_skill JOIN ask ON raw_text = requested OR skill_id = want_id GROUP BY 1, 2),
    m AS (SELECT candidate_id, avg(sure) AS sure, count(*) AS n FROM evid JOIN sure USING (candidate_id, requested) WHERE match_type = 'exact' GROUP BY 1),
    ch AS (SELECT candidate_id, count(*) AS channels FROM (SELECT DISTINCT candidate_id, 'v' FROM embedding UNION ALL SELECT DISTINCT candidate_id, 'g' FROM evid WHERE match_type <> 'missing') GROUP BY 1)
    SELECT candidate_id, round(least(1, greatest(0, 0.3 + 0.25 * coalesce(sure, 0.55) + 0.2 * completeness + 0.15 * least(1.0, coalesce(channels, 0) / 2) + 0.1 * coalesce(n, 0) / 4)) * 100 + 1e-9, 1)::DOUBLE AS confidence
    FROM alive LEFT JOIN m USING (candidate_id) LEFT JOIN compl USING (candidate_id) LEFT JOIN ch USING (candidate_id)""")
def match_confidence(v):
    from hireloom.operators.entities import completeness

    r = request(v)
    evidence = matching.skill_evidence(v, v.alive, r)
    complete = completeness(v.alive, v.candidate_skill, v.experience, v.certification)
    found = v.embedding.select("candidate_id", F.lit("v").alias("c")).unionByName(evidence.where("match_type != 'missing'").select("candidate_id", F.lit("g").alias("c")))
    channels = found.distinct().groupBy("candidate_id").agg(F.count("*").alias("channels"))
    return matching.confidence(v, v.alive, r, evidence, complete, channels)


def _retrieved(v):
    """(candidate_id, fused) of living candidates that a channel found."""
    from hireloom.plans.retrievals import graph_channel, vector_channel
    from hireloom.operators import retrieval

    fused = retrieval.fuse(graph_channel(v), vector_channel(v))
    return fused.select(F.split_part("candidate", F.lit(":"), F.lit(2)).cast("long").alias("candidate_id"), "fused").join(v.alive.select("candidate_id"), "candidate_id", "left_semi")


def _run(v, **more):
    from pyspark.sql import Window as W

    r = request(v, **more)
    newest = v.alive.orderBy(F.desc_nulls_last("created_at"), F.desc("candidate_id")).limit(max(4 * r.top_k, 60))
    recent = newest.select("candidate_id", F.row_number().over(W.orderBy(F.desc_nulls_last("created_at"), F.desc("candidate_id"))).alias("place"))
    pool = matching.candidate_pool(_retrieved(v), recent, v.alive, r)
    scored = matching.score(v, pool, r, vector_scores(v))
    return matching.rank(scored.withColumn("recommendation", matching.recommendation(F.col("overall"), F.col("mandatory_missing"))), r), r


STATUSES = ["new", "shortlisted", "in_review", "hired"]


def run_sql(top: int, statuses: list[str]) -> str:
    """A run's rows, after the parts of `SCORE` and of the fused retrieval."""
    allowed = ", ".join(f"'{s}'" for s in statuses)
    return f"""pool AS (SELECT candidate_id FROM (SELECT split_part(candidate, ':', 2)::BIGINT AS candidate_id, round(0.65 * coalesce(graph, 0) + 0.35 * coalesce(vec.vector, 0), 4) AS fused FROM g FULL OUTER JOIN vecs vec USING (candidate))
        JOIN alive USING (candidate_id) ORDER BY fused DESC, candidate_id LIMIT {max(4 * top, 60)}),
      run AS (SELECT row_number() OVER (ORDER BY overall DESC, f.total_experience_years DESC, f.full_name) AS rank, candidate_id, overall, {REC} AS recommendation
        FROM fin f JOIN alive a USING (candidate_id) WHERE candidate_id IN (SELECT candidate_id FROM pool) AND status IN ({allowed}) ORDER BY rank LIMIT {top})"""


def _run_query(top: int, select: str) -> str:
    from hireloom.plans.retrievals import GRAPH, VEC

    hops_once = GRAPH.split("dir AS (", 1)[1]  # `SCORE` has the hops already
    return f"WITH {SCORE}, dir AS ({hops_once}, {VEC.replace('vec AS', 'vecs AS', 1)}, {run_sql(top, STATUSES)} {select}"


def _register_runs() -> None:
    """The run queries; they need the retrieval plans, which need this module."""

    @query("match_run", _run_query(20, "SELECT * FROM run"))
    def match_run(v):
        return _run(v, statuses=STATUSES)[0].select("rank", "candidate_id", "overall", "recommendation")

    @query("match_run_detail", _run_query(20, "SELECT 7 AS run_id, 'first' AS title, count(*) AS returned, max(overall) AS top_score, string_agg(candidate_id, ';' ORDER BY rank) AS best FROM run"))
    def match_run_detail(v):
        """A run written, and read again with its results."""
        from hireloom.plans.streams import checkpoint

        path = checkpoint(v)
        ranked, _ = _run(v, statuses=STATUSES)
        matching.persist_run(ranked, path, 7, "first")
        told = matching.run_detail(v.spark, path)
        return told.select(F.col("run_id").cast("int").alias("run_id"), "title", "returned", "top_score", F.array_join(F.transform("results", lambda r: r["candidate_id"].cast("string")), ";").alias("best"))

    @query("match_last_score", _run_query(20, "SELECT candidate_id, coalesce(run.overall, last_match_score) AS last_match_score FROM candidate LEFT JOIN run USING (candidate_id)"))
    def match_last_score(v):
        ranked, _ = _run(v, statuses=STATUSES)
        results = ranked.select("candidate_id", "overall", F.lit(7).alias("run_id"))
        return matching.with_last_score(v.candidate, results).select("candidate_id", "last_match_score")


@query("match_single", f"WITH {SCORE} SELECT candidate_id, overall, {REC} AS recommendation FROM fin WHERE candidate_id = 7")
def match_single(v):
    """One candidate, scored by itself."""
    scored = matching.score(v, v.alive.where("candidate_id = 7"), request(v, top_k=1), vector_scores(v))
    return scored.select("candidate_id", "overall", matching.recommendation(F.col("overall"), F.col("mandatory_missing")).alias("recommendation"))


@query("match_additional_skills", f"""WITH {EVID} SELECT candidate_id, raw_text, row_number() OVER (PARTITION BY candidate_id ORDER BY confidence DESC, raw_text) AS place FROM candidate_skill JOIN alive USING (candidate_id)
    WHERE (candidate_id, raw_text) NOT IN (SELECT (candidate_id, requested) FROM evid WHERE match_type = 'exact') QUALIFY place <= 15""")
def match_additional_skills(v):
    return matching.additional_skills(v.candidate_skill, matching.skill_evidence(v, v.alive, request(v)), v.alive)


@query("match_gaps", f"""WITH {SCORE}, top AS (SELECT candidate_id, total_experience_years FROM fin ORDER BY overall DESC, total_experience_years DESC, full_name LIMIT 20)
    SELECT candidate_id, concat_ws('; ', (SELECT string_agg('No evidence of ' || requested, '; ' ORDER BY weight DESC, requested) FROM evid e WHERE e.candidate_id = t.candidate_id AND match_type = 'missing'),
      CASE WHEN total_experience_years < 5 THEN 'Experience is ' || round(5 - total_experience_years, 1) || ' years short' END) AS gaps,
      concat_ws('; ', (SELECT string_agg(requested, '; ' ORDER BY weight DESC, requested) FROM evid e WHERE e.candidate_id = t.candidate_id AND match_type = 'exact'),
      CASE WHEN total_experience_years >= 5 THEN 'Meets the experience bar (' || total_experience_years || ' yrs)' END) AS strengths FROM top t""")
def match_gaps(v):
    r = request(v)
    ranked = matching.rank(matching.score(v, v.alive, r, vector_scores(v)), r)
    told = matching.strengths_and_gaps(ranked, matching.skill_evidence(v, v.alive, r), r)
    return told.select("candidate_id", F.array_join("gaps", "; ").alias("gaps"), F.array_join("strengths", "; ").alias("strengths"))
