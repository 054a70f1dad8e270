"""Retrieval and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hireloom.operators import graph, retrieval, taxonomy
from hireloom.plans.graphs import K
from hireloom.plans.matches import vector_scores
from hireloom.plans.registry import query
from hireloom.plans.relational import skill_names
from hireloom.plans.taxonomies import HOPS
from hireloom.plans.vectors import COS, QV

NAMED = "SELECT skill_id FROM skill ORDER BY name LIMIT 2"
GRAPH = f"""{HOPS}, dir AS ({NAMED}),
    ex AS (SELECT node, max(weight) AS weight FROM d1 WHERE seed IN (SELECT skill_id FROM dir) AND node NOT IN (SELECT skill_id FROM dir) GROUP BY 1),
    terms AS (SELECT {K('Skill', 'name')} AS key, 1.0::DOUBLE AS worth FROM skill WHERE skill_id IN (SELECT skill_id FROM dir) UNION ALL SELECT {K('Skill', 'name')}, 0.5 * weight FROM ex JOIN skill ON skill_id = node),
    g AS (SELECT src AS candidate, round(least(1, sum(worth) / greatest(1, (SELECT count(*) FROM dir) + 0.5 * (SELECT count(*) FROM ex))), 4)::DOUBLE AS graph
      FROM gedges JOIN terms ON dst = key WHERE relation = 'HAS_SKILL' GROUP BY 1)"""
VEC = f"vec AS (SELECT 'Candidate:' || candidate_id AS candidate, max(round({COS.format(a='vector', b=QV)}, 5)) AS vector FROM embedding GROUP BY 1)"


def graph_channel(v):
    direct = v.skill.orderBy("name").limit(2)
    near = taxonomy.expand(v.skill, v.skill_relation, 1).join(direct.select("skill_id"), "skill_id").groupBy("other").agg(F.max("weight").alias("weight"))
    near = near.join(direct.select(F.col("skill_id").alias("other")), "other", "left_anti")
    expanded = near.join(v.skill.select(F.col("skill_id").alias("other"), "name"), "other").select(graph.key_of("Skill", "name").alias("key"), "weight")
    return retrieval.graph_scores(v.edges, direct.select(graph.key_of("Skill", "name").alias("key")), expanded)


def vector_channel(v):
    return vector_scores(v).select(graph.node_key("Candidate", F.col("candidate_id").cast("string")).alias("candidate"), F.col("score").alias("vector"))


@query("retrieve_graph_score", f"WITH {GRAPH} SELECT * FROM g")
def retrieve_graph_score(v):
    return graph_channel(v)


@query("retrieve_fused", f"""WITH {GRAPH}, {VEC} SELECT candidate, round(0.65 * coalesce(graph, 0) + 0.35 * coalesce(vector, 0), 4) AS fused,
      concat_ws('+', CASE WHEN graph IS NOT NULL THEN 'graph' END, CASE WHEN vector IS NOT NULL THEN 'vector' END) AS channels FROM g FULL OUTER JOIN vec USING (candidate)""")
def retrieve_fused(v):
    return retrieval.fuse(graph_channel(v), vector_channel(v))


@query("search_modes", f"""WITH {GRAPH}, {VEC}, kw AS (SELECT 'Candidate:' || candidate_id AS candidate, CASE WHEN contains(lower(city), 'an') THEN 0.5 ELSE 0 END::DOUBLE AS keyword FROM alive),
    c AS (SELECT candidate, coalesce(graph, 0) AS graph, least(1, greatest(0, coalesce(vector, 0)) / 0.75) AS semantic, keyword FROM kw LEFT JOIN g USING (candidate) LEFT JOIN vec USING (candidate)),
    s AS (SELECT candidate, mode, round(100 * (wg * graph + ws * semantic + wk * keyword), 2) AS score FROM c, (VALUES {', '.join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {k}::DOUBLE)" for m, (a, b, k) in retrieval.MODES.items())}) w(mode, wg, ws, wk))
    SELECT * FROM s WHERE score > 0 OR mode = 'keyword'""")
def search_modes(v):
    people = v.alive.select(graph.node_key("Candidate", F.col("candidate_id").cast("string")).alias("candidate"), F.when(F.lower("city").contains("an"), 0.5).otherwise(0.0).alias("keyword"))
    channels = people.join(graph_channel(v), "candidate", "left").join(vector_channel(v), "candidate", "left")
    return retrieval.search_scores(channels, list(retrieval.MODES))


@query("skill_breakdown", """SELECT a.candidate_id, s.name AS requested, CASE WHEN max((cs.skill_id = s.skill_id OR cs.raw_text = s.name)::INT) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS credit
    FROM alive a CROSS JOIN (SELECT * FROM skill ORDER BY name LIMIT 2) s LEFT JOIN candidate_skill cs ON cs.candidate_id = a.candidate_id GROUP BY 1, 2""")
def skill_breakdown(v):
    asked = v.skill.orderBy("name").limit(2).select(F.col("name").alias("requested"))
    held = v.candidate_skill.join(F.broadcast(asked), F.col("raw_text") == F.col("requested")).select("candidate_id", "requested").distinct().withColumn("hit", F.lit(1.0))
    grid = v.alive.select("candidate_id").crossJoin(F.broadcast(asked))
    return grid.join(held, ["candidate_id", "requested"], "left").select("candidate_id", "requested", F.coalesce("hit", F.lit(0.0)).alias("credit"))


@query("parse_query")
def parse_query(v):
    """Literal requests, parsed on the driver against the skill names."""
    names = [r["name"] for r in v.skill.select("name").collect()]
    texts = [f"{names[0]} developer with 5+ years in France", f"{names[1]} and {names[2]} analyst", f"10 years experience in {names[3].title()}"]
    rows = [(t, (p := retrieval.parse_query(t, names))["min_years"], ";".join(p["skills"]), p["location"], ";".join(p["unknown"])) for t in texts]
    return v.spark.createDataFrame(rows, "query string, min_years double, skills string, location string, unknown string")


QUESTION = "engineer in MIDDLE EAST with PhD"
HAY = "lower(full_name || ' ' || city || ' ' || country || ' ' || highest_degree || coalesce(' ' || s, ''))"


def _hits(v):
    from hireloom.functions.text import tokenize_py

    links = v.candidate_skill.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("raw_text")), " ").alias("s"))
    people = v.alive.join(links, "candidate_id", "left").withColumn("haystack", F.concat_ws(" ", "full_name", "city", "country", "highest_degree", "s"))
    tokens = tokenize_py(QUESTION)
    words = F.lower("haystack")
    pool = people.where(reduce_or([F.contains(words, F.lit(t)) for t in tokens])).orderBy(F.desc_nulls_last("created_at"), F.desc("candidate_id")).limit(retrieval.POOL)
    id_ = lambda df: df.withColumn("candidate_id", F.split_part("candidate", F.lit(":"), F.lit(2)).cast("long")).drop("candidate")
    channels = id_(graph_channel(v)).join(id_(vector_channel(v)), "candidate_id", "full_outer")
    return retrieval.hybrid_hits(people, pool.select("candidate_id"), channels, tokens)


def reduce_or(tests):
    from functools import reduce

    return reduce(lambda a, b: a | b, tests)


HITS = f"""{GRAPH}, {VEC}, hay AS (SELECT a.*, {HAY} AS h FROM alive a LEFT JOIN (SELECT candidate_id, string_agg(DISTINCT raw_text, ' ' ORDER BY raw_text) AS s FROM candidate_skill GROUP BY 1) USING (candidate_id)),
    q AS (SELECT unnest(['engineer', 'middle', 'east', 'phd']) AS t),
    pool AS (SELECT candidate_id FROM hay WHERE contains(h, 'engineer') OR contains(h, 'middle') OR contains(h, 'east') OR contains(h, 'phd') ORDER BY created_at DESC NULLS LAST, candidate_id DESC LIMIT 500),
    ch AS (SELECT split_part(candidate, ':', 2)::BIGINT AS candidate_id, graph, vector FROM g FULL OUTER JOIN vec USING (candidate)),
    hits AS (SELECT candidate_id, full_name, total_experience_years, city, country, highest_degree, round((0.45 * coalesce(graph, 0) + 0.35 * least(1, coalesce(vector, 0) / 0.75) + 0.2 * kw) * 100 + 1e-9, 2)::DOUBLE AS ai_score, kw
      FROM (SELECT hay.*, ch.graph, ch.vector, round((SELECT count(*) FROM q WHERE list_contains(list_transform(regexp_extract_all(h, '[a-z0-9+#.]+'), lambda x: trim(x, '.')), q.t)) / 4, 4)::DOUBLE AS kw
        FROM hay LEFT JOIN ch USING (candidate_id) WHERE candidate_id IN (SELECT candidate_id FROM pool) OR ch.candidate_id IS NOT NULL) WHERE 0.45 * coalesce(graph, 0) + 0.35 * least(1, coalesce(vector, 0) / 0.75) + 0.2 * kw > 0)"""


@query("search_hybrid", f"WITH {HITS} SELECT candidate_id, ai_score, round(kw * 100, 2) AS keyword_score FROM hits")
def search_hybrid(v):
    return _hits(v).select("candidate_id", "ai_score", F.round(F.col("keyword_score") * 100, 2).alias("keyword_score"))


@query("search_page", f"WITH {HITS} SELECT candidate_id, full_name, total_experience_years FROM (SELECT * FROM hits ORDER BY total_experience_years DESC, candidate_id OFFSET 10 LIMIT 10)")
def search_page(v):
    return retrieval.page_of_hits(_hits(v), "experience", True, 2, 10).select("candidate_id", "full_name", "total_experience_years")


@query("search_answer", f"""WITH {HITS} SELECT 'Based on graph and vector retrieval, the strongest candidates for "{QUESTION}" are ' || string_agg(full_name, ', ' ORDER BY ai_score DESC, candidate_id)
      || '. The scoring breakdown for each candidate lists the exact matched, related and missing skills that produced their ranking.' AS answer FROM (SELECT * FROM hits ORDER BY ai_score DESC, candidate_id LIMIT 5)""")
def search_answer(v):
    return retrieval.template_answer(_hits(v), QUESTION)


CREDITS = f"""{HOPS}, ask AS (SELECT skill_id AS want_id, name AS requested FROM skill ORDER BY name LIMIT 3),
    direct AS (SELECT DISTINCT candidate_id, requested FROM candidate_skill JOIN ask ON raw_text = requested OR skill_id = want_id),
    rel AS (SELECT DISTINCT candidate_id, requested FROM candidate_skill cs JOIN hops h ON h.other = cs.skill_id JOIN ask ON ask.want_id = h.skill_id WHERE h.skill_id <> h.other),
    cred AS (SELECT a.candidate_id, k.requested, CASE WHEN d.requested IS NOT NULL THEN 'direct' WHEN r.requested IS NOT NULL THEN 'related' ELSE 'missing' END AS match_type,
      CASE WHEN d.requested IS NOT NULL THEN 1.0 WHEN r.requested IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS credit FROM alive a CROSS JOIN ask k
      LEFT JOIN direct d ON d.candidate_id = a.candidate_id AND d.requested = k.requested LEFT JOIN rel r ON r.candidate_id = a.candidate_id AND r.requested = k.requested)"""


def _credits(v):
    asked = v.skill.orderBy("name").limit(3).select(F.col("name").alias("requested"), F.col("skill_id").alias("want_id"))
    near = taxonomy.expand_one(v.skill, v.skill_relation).select("skill_id", "other").where("skill_id != other").distinct()
    return retrieval.skill_credits(v.alive, v.candidate_skill, asked, near)


@query("search_skill_credits", f"WITH {CREDITS} SELECT * FROM cred")
def search_skill_credits(v):
    return _credits(v)


@query("search_context", f"""WITH {CREDITS}, l AS (SELECT candidate_id, string_agg(requested, ', ' ORDER BY requested) AS asked, string_agg(requested, ', ' ORDER BY requested) FILTER (match_type = 'direct') AS m,
      string_agg(requested, ', ' ORDER BY requested) FILTER (match_type = 'related') AS r, string_agg(requested, ', ' ORDER BY requested) FILTER (match_type = 'missing') AS x FROM cred GROUP BY 1)
    SELECT candidate_id, 'Candidate: ' || full_name || chr(10) || 'Total experience: ' || total_experience_years || ' years' || chr(10) || 'Education: ' || highest_degree || chr(10) || 'Location: ' || city || ', ' || country || chr(10)
      || 'Requested skills: ' || asked || chr(10) || 'Matched skills: ' || coalesce(m, 'none') || chr(10) || 'Related/transferable skills: ' || coalesce(r, 'none') || chr(10) || 'Missing skills: ' || coalesce(x, 'none') AS context FROM alive JOIN l USING (candidate_id)""")
def search_context(v):
    return retrieval.context_text(v.alive, _credits(v))
