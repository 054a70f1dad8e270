"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hireloom.operators import graph
from hireloom.plans.registry import query
from hireloom.sources.views import CTES


def key_sql(label: str, column: str) -> str:
    return f"'{label}:' || regexp_replace(replace(lower(trim({column})), '&', 'and'), '[^\\p{{L}}\\p{{N}}+#]', '', 'g')"


K = key_sql
CTES["gnodes"] = (["alive", "skill", "experience", "certification"], f"""
    SELECT key, min(label) AS label, min(name) AS name FROM (
      SELECT 'Candidate:' || candidate_id AS key, 'Candidate' AS label, full_name AS name FROM alive
      UNION ALL SELECT {K('Skill', 'name')}, 'Skill', name FROM skill
      UNION ALL SELECT {K('Category', 'category')}, 'Category', category FROM skill
      UNION ALL SELECT {K('Technology', 'technology_stack')}, 'Technology', technology_stack FROM skill
      UNION ALL SELECT {K('Company', 'company_name')}, 'Company', company_name FROM experience
      UNION ALL SELECT {K('Certification', 'name')}, 'Certification', name FROM certification) GROUP BY 1""")  # fmt: skip
CTES["gedges"] = (["gnodes", "skill", "skill_relation", "candidate_skill", "experience", "certification"], f"""
    SELECT src, dst, relation, arg_max(weight, seq * 10 + weight) AS weight FROM (
      SELECT 0 AS seq, {K('Skill', 'name')} AS src, {K('Category', 'category')} AS dst, 'BELONGS_TO' AS relation, 1.0::DOUBLE AS weight FROM skill
      UNION ALL SELECT 1, {K('Skill', 'name')}, {K('Technology', 'technology_stack')}, 'PART_OF', 0.8 FROM skill
      UNION ALL SELECT 2, {K('Skill', 'p.name')}, {K('Skill', 's.name')}, 'PARENT_OF', 0.75 FROM skill s JOIN skill p ON p.skill_id = s.parent_skill_id
      UNION ALL SELECT 3, {K('Skill', 's.name')}, {K('Skill', 'p.name')}, 'DEPENDS_ON', 0.7 FROM skill s JOIN skill p ON p.skill_id = s.parent_skill_id
      UNION ALL SELECT 4, {K('Skill', 'a.name')}, {K('Skill', 'b.name')}, 'RELATED_TO', weight FROM skill_relation JOIN skill a ON a.skill_id = source_skill_id JOIN skill b ON b.skill_id = target_skill_id
      UNION ALL SELECT 5, {K('Skill', 'b.name')}, {K('Skill', 'a.name')}, 'RELATED_TO', round(weight * 0.9, 3) FROM skill_relation JOIN skill a ON a.skill_id = source_skill_id JOIN skill b ON b.skill_id = target_skill_id
      UNION ALL SELECT 6, 'Candidate:' || candidate_id, {K('Skill', 'raw_text')}, 'HAS_SKILL', round(confidence, 3) FROM candidate_skill WHERE skill_id IS NOT NULL
      UNION ALL SELECT DISTINCT 7, 'Candidate:' || candidate_id, {K('Company', 'company_name')}, 'WORKED_AT', 1.0 FROM experience
      UNION ALL SELECT 8, 'Candidate:' || candidate_id, {K('Certification', 'name')}, 'HOLDS', 1.0 FROM certification)
    WHERE src IN (SELECT key FROM gnodes) AND dst IN (SELECT key FROM gnodes) GROUP BY 1, 2, 3""")  # fmt: skip


@query("graph_nodes", "SELECT * FROM gnodes")
def graph_nodes(v):
    return v.nodes


@query("graph_edges", "SELECT * FROM gedges")
def graph_edges(v):
    return v.edges


@query("graph_stats", "SELECT 'node' AS kind, label AS name, count(*) AS n FROM gnodes GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM gedges GROUP BY 2")
def graph_stats(v):
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(v.nodes, "node", "label").unionByName(count(v.edges, "edge", "relation"))


@query("graph_delete", "SELECT relation, count(*) AS n FROM gedges WHERE src <> 'Candidate:1' AND dst <> 'Candidate:1' AND NOT (src = 'Candidate:2' AND relation = 'HAS_SKILL') GROUP BY 1")
def graph_delete(v):
    _, edges = graph.delete_node(v.nodes, v.edges, "Candidate:1")
    return graph.delete_out_edges(edges, "Candidate:2", "HAS_SKILL").groupBy("relation").agg(F.count("*").alias("n"))


FIRST_SKILL = f"(SELECT {K('Skill', 'name')} FROM skill ORDER BY name LIMIT 1)"


def first_skill_key(v) -> str:
    return v.skill.orderBy("name").select(graph.key_of("Skill", "name").alias("k")).first()["k"]


@query("neighbours", f"""SELECT other, relation, max(weight) AS weight FROM (
      SELECT dst AS other, relation, weight FROM gedges WHERE src = {FIRST_SKILL} UNION ALL SELECT src, relation, weight FROM gedges WHERE dst = {FIRST_SKILL}) GROUP BY 1, 2""")
def neighbours(v):
    return graph.neighbours(v.edges, first_skill_key(v))


def _seeds(v, label):
    """Every node of a label, as its own seed."""
    return v.nodes.where(F.col("label") == label).select(F.col("key").alias("seed"), "key")


WALK = """l0 AS (SELECT key AS seed, key AS node, 1.0::DOUBLE AS weight, 0 AS depth FROM gnodes WHERE label = 'Candidate'),
    l1 AS (SELECT seed, dst AS node, max(round(l0.weight * e.weight, 4)) AS weight, 1 AS depth FROM l0 JOIN gedges e ON e.src = node
      WHERE NOT EXISTS (SELECT 1 FROM l0 p WHERE p.seed = l0.seed AND p.node = e.dst) GROUP BY 1, 2),
    s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
    l2 AS (SELECT l1.seed, e.dst AS node, max(round(l1.weight * e.weight, 4)) AS weight, 2 AS depth FROM l1 JOIN gedges e ON e.src = l1.node
      WHERE NOT EXISTS (SELECT 1 FROM s1 p WHERE p.seed = l1.seed AND p.node = e.dst) GROUP BY 1, 2),
    s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2)"""


@query("traverse_depth2", f"WITH {WALK} SELECT * FROM s2")
def traverse_depth2(v):
    return graph.traverse(v.edges, _seeds(v, "Candidate"), 2)


@query("subgraph", f"WITH {WALK} SELECT e.* FROM gedges e WHERE src IN (SELECT node FROM s2) AND dst IN (SELECT node FROM s2)")
def subgraph(v):
    return graph.subgraph(v.edges, _seeds(v, "Candidate"), 2)


@query("candidates_by_skills", f"""SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ';') AS skills FROM gedges
    WHERE relation = 'HAS_SKILL' AND dst IN (SELECT {K('Skill', 'name')} FROM (SELECT name FROM skill ORDER BY name LIMIT 3)) GROUP BY 1""")
def candidates_by_skills(v):
    keys = [r["k"] for r in v.skill.orderBy("name").limit(3).select(graph.key_of("Skill", "name").alias("k")).collect()]
    return graph.candidates_by_skills(v.edges, keys).select("src", F.array_join("skills", ";").alias("skills"))


@query("similar_candidates", """WITH held AS (SELECT DISTINCT candidate_id, skill_id FROM candidate_skill WHERE skill_id IS NOT NULL),
    pairs AS (SELECT a.candidate_id, b.candidate_id AS other_id, count(*) AS shared FROM held a JOIN held b USING (skill_id) WHERE a.candidate_id % 100 = 0 AND a.candidate_id <> b.candidate_id GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY shared DESC, other_id) AS place FROM pairs QUALIFY place <= 5)
    SELECT candidate_id, other_id, shared, round(least(1, shared / (SELECT count(*) FROM held h WHERE h.candidate_id = best.candidate_id)) * 100, 1) AS percent, place FROM best
    WHERE other_id IN (SELECT candidate_id FROM alive)""")
def similar_candidates(v):
    return graph.similar_candidates(v.candidate_skill, v.alive, v.candidate.where("candidate_id % 100 = 0").select("candidate_id"), 5)


@query("degree_centrality", """SELECT key, coalesce(d, 0) AS degree, round(coalesce(d, 0) / ((SELECT count(*) FROM gnodes) - 1), 6) AS centrality FROM gnodes
    LEFT JOIN (SELECT key, count(*) AS d FROM (SELECT src AS key FROM gedges UNION ALL SELECT dst FROM gedges) GROUP BY 1) USING (key)""")
def degree_centrality(v):
    return graph.degree_centrality(v.nodes, v.edges)


BOTH = "b AS (SELECT src, dst FROM gedges UNION SELECT dst, src FROM gedges)"


@query("shortest_path_len", f"""WITH RECURSIVE {BOTH}, walk(seed, node, distance) AS (
      SELECT key, key, 0 FROM gnodes WHERE label = 'Category' UNION SELECT seed, b.dst, distance + 1 FROM walk JOIN b ON b.src = node WHERE distance < 2)
    SELECT seed, node, min(distance) AS distance FROM walk GROUP BY 1, 2""")
def shortest_path_len(v):
    return graph.shortest_paths(v.edges, _seeds(v, "Category"), 2)


@query("skills_graph", """
    SELECT s.skill_id, s.name, p.name AS parent,
      coalesce((SELECT string_agg(c.name, '; ' ORDER BY c.name) FROM skill c WHERE c.parent_skill_id = s.skill_id), '') AS children,
      (SELECT count(DISTINCT candidate_id) FROM candidate_skill k WHERE k.skill_id = s.skill_id) AS candidates
    FROM skill s LEFT JOIN skill p ON p.skill_id = s.parent_skill_id""")
def skills_graph(v):
    parents = v.skill.select(F.col("skill_id").alias("parent_skill_id"), F.col("name").alias("parent"))
    children = v.skill.where("parent_skill_id is not null").groupBy(F.col("parent_skill_id").alias("skill_id")).agg(F.array_sort(F.collect_list("name")).alias("c"))
    counts = v.candidate_skill.groupBy("skill_id").agg(F.countDistinct("candidate_id").alias("n"))
    joined = v.skill.join(F.broadcast(parents), "parent_skill_id", "left").join(F.broadcast(children), "skill_id", "left").join(counts, "skill_id", "left")
    return joined.select("skill_id", "name", "parent", F.coalesce(F.array_join("c", "; "), F.lit("")).alias("children"), F.coalesce("n", F.lit(0)).alias("candidates"))


@query("graph_context", """
    SELECT src AS candidate, relation, array_to_string(list_sort(list(DISTINCT dst))[1:20], ';') AS items FROM gedges
    WHERE starts_with(src, 'Candidate:') GROUP BY 1, 2""")
def graph_context(v):
    near = v.edges.where(F.col("src").startswith("Candidate:"))
    return near.groupBy(F.col("src").alias("candidate"), "relation").agg(F.array_join(F.slice(F.array_sort(F.collect_set("dst")), 1, 20), ";").alias("items"))


@query("graph_incremental", "SELECT relation, count(*) AS n, round(sum(weight), 3) AS weight FROM gedges WHERE src IN (SELECT 'Candidate:' || candidate_id FROM alive WHERE updated_at >= TIMESTAMP '2001-01-01') GROUP BY 1")
def graph_incremental(v):
    """Rebuild of chosen candidates: their old out-edges go, the new ones come."""
    recent = v.alive.where(F.col("updated_at") >= F.lit("2001-01-01").cast("timestamp"))
    own = recent.select(graph.node_key("Candidate", F.col("candidate_id").cast("string")).alias("src"))
    fresh = v.edges.join(own, "src", "left_semi")
    merged = v.edges.join(own, "src", "left_anti").unionByName(fresh)
    return merged.join(own, "src", "left_semi").groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("weight"))


ROLES = "roles AS (SELECT name AS skill, technology_stack || ' engineer' AS role, upper(technology_stack[1]) || ' unit' AS department FROM skill)"


def roles(v):
    """A role per stack and a department per first letter."""
    return v.skill.select(F.col("name").alias("skill"), F.concat("technology_stack", F.lit(" engineer")).alias("role"), F.concat(F.upper(F.substring("technology_stack", 1, 1)), F.lit(" unit")).alias("department"))


@query("graph_roles", f"""WITH {ROLES} SELECT {K('Skill', 'skill')} AS src, {K('JobRole', 'role')} AS dst, 'REQUIRED_FOR' AS relation, 0.9::DOUBLE AS weight FROM roles
    UNION SELECT {K('JobRole', 'role')}, {K('Department', 'department')}, 'PART_OF', 1.0::DOUBLE FROM roles""")
def graph_roles(v):
    return graph.role_edges(roles(v))


@query("graph_stacks", f"""WITH r AS (SELECT skill_id AS a, lead(skill_id) OVER (PARTITION BY category ORDER BY skill_id) AS b FROM skill)
    SELECT DISTINCT {K('Technology', 'x.technology_stack')} AS src, {K('Technology', 'y.technology_stack')} AS dst, 'DEPENDS_ON' AS relation, 0.5::DOUBLE AS weight
    FROM r JOIN skill x ON x.skill_id = a JOIN skill y ON y.skill_id = b WHERE x.technology_stack <> y.technology_stack""")
def graph_stacks(v):
    from pyspark.sql import Window as W

    after = F.lead("skill_id").over(W.partitionBy("category").orderBy("skill_id"))
    relation = v.skill.select(F.col("skill_id").alias("source_skill_id"), after.alias("target_skill_id")).where("target_skill_id is not null")
    return graph.stack_edges(v.skill, relation)


@query("graph_work", f"""WITH p AS (SELECT candidate_id, 'Rollout' AS project, min(raw_text) AS skill FROM candidate_skill GROUP BY 1),
    pk AS (SELECT *, 'Project:' || candidate_id || '-rollout' AS k FROM p)
    SELECT DISTINCT {K('Company', 'company_name')} AS src, 'Technology:spark' AS dst, 'USES' AS relation, 0.6::DOUBLE AS weight FROM experience WHERE candidate_id % 2 = 0
    UNION ALL SELECT 'Candidate:' || candidate_id, k, 'COMPLETED', 1.0 FROM pk UNION ALL SELECT k, {K('Skill', 'skill')}, 'USED_SKILL', 0.7 FROM pk
    UNION ALL SELECT 'Candidate:' || candidate_id, {K('Education', 'highest_degree')}, 'STUDIED_AT', 1.0 FROM alive""")
def graph_work(v):
    jobs = v.experience.select("candidate_id", "company_name", F.when(F.col("candidate_id") % 2 == 0, "Spark").alias("technology"))
    projects = v.candidate_skill.groupBy("candidate_id").agg(F.lit("Rollout").alias("project"), F.min("raw_text").alias("skill"))
    schools = v.alive.select("candidate_id", F.lit(None).cast("string").alias("institution"), F.col("highest_degree").alias("degree"))
    return graph.work_edges(jobs, projects, schools)


@query("traverse_labels", f"""WITH {WALK} SELECT seed, node, label, weight, depth, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, depth, node) AS place
    FROM s2 JOIN gnodes ON key = node WHERE depth > 0 AND label IN ('Category', 'Technology') QUALIFY place <= 5""")
def traverse_labels(v):
    return graph.reachable(v.nodes, graph.traverse(v.edges, _seeds(v, "Candidate"), 2), ["Category", "Technology"], 5)


@query("graph_overview", """WITH seeds AS (SELECT * FROM (SELECT 'Candidate:' || candidate_id AS key FROM alive ORDER BY created_at DESC NULLS LAST, candidate_id DESC LIMIT 25)
      UNION ALL SELECT key FROM (SELECT dst AS key, count(*) AS n FROM gedges WHERE relation = 'HAS_SKILL' GROUP BY 1 ORDER BY n DESC, key LIMIT 20)),
    ball AS (SELECT key FROM seeds UNION SELECT dst FROM gedges JOIN seeds ON src = key)
    SELECT relation, count(*) AS n, round(sum(weight), 3) AS weight FROM gedges WHERE src IN (SELECT key FROM ball) AND dst IN (SELECT key FROM ball) GROUP BY 1""")
def graph_overview(v):
    near = graph.subgraph(v.edges, graph.overview_seeds(v.alive, v.edges), 1)
    return near.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("weight"))


@query("graph_candidate_view", """WITH ball AS (SELECT 'Candidate:7' AS key UNION SELECT dst FROM gedges WHERE src = 'Candidate:7'),
    two AS (SELECT key FROM ball UNION SELECT dst FROM gedges JOIN ball ON src = key) SELECT e.* FROM gedges e WHERE src IN (SELECT key FROM two) AND dst IN (SELECT key FROM two)""")
def graph_candidate_view(v):
    """All edges within two steps of one candidate."""
    return graph.subgraph(v.edges, v.nodes.where("key = 'Candidate:7'").select("key"), 2)


@query("node_properties", """SELECT 'Candidate:' || candidate_id AS key, CASE WHEN candidate_id % 2 = 0 THEN 'second' ELSE 'first' END AS last_status, 'first' AS first_status,
      CASE WHEN candidate_id % 3 <> 0 THEN city END AS city FROM alive""")
def node_properties(v):
    """Two writes of every candidate's properties: nulls never win."""
    k = F.col("candidate_id")
    key = graph.node_key("Candidate", k.cast("string"))
    props = lambda status, city: F.create_map(F.lit("status"), status, F.lit("city"), city)
    one = v.alive.select(key.alias("key"), F.lit(1).alias("seq"), props(F.lit("first"), F.when(k % 3 != 0, F.col("city"))).alias("properties"))
    two = v.alive.select(key.alias("key"), F.lit(2).alias("seq"), props(F.when(k % 2 == 0, "second"), F.lit(None).cast("string")).alias("properties"))
    both = one.unionByName(two)
    first = graph.first_properties(both).select("key", F.col("properties")["status"].alias("first_status"))
    return graph.merge_properties(both).join(first, "key").select("key", F.col("properties")["status"].alias("last_status"), "first_status", F.col("properties")["city"].alias("city"))
