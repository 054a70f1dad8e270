"""Taxonomy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hireloom.operators import taxonomy
from hireloom.plans.registry import query


def synonyms(v):
    """Each skill's words the other way round."""
    return v.skill.select("skill_id", F.array_join(F.reverse(F.split("name", " ")), " ").alias("synonym"))


def phrases(v):
    names = v.skill
    exact = names.where("skill_id % 3 = 0").select(F.upper("name").alias("phrase"))
    turned = synonyms(v).where("skill_id % 3 = 1").select(F.col("synonym").alias("phrase"))
    misspelt = names.where("skill_id % 3 = 2").select(F.concat("name", F.lit("zqxj")).alias("phrase"))
    return exact.unionByName(turned).unionByName(misspelt)


NORM = "regexp_replace(replace(lower(trim({0})), '&', 'and'), '[^\\p{{L}}\\p{{N}}+#]', '', 'g')"
SYN = "syn AS (SELECT skill_id, array_to_string(list_reverse(string_split(name, ' ')), ' ') AS synonym FROM skill)"


@query("resolve_exact_synonym", f"""WITH {SYN}, asked AS (
      SELECT upper(name) AS phrase FROM skill WHERE skill_id % 3 = 0 UNION SELECT synonym FROM syn WHERE skill_id % 3 = 1 UNION SELECT name || 'zqxj' FROM skill WHERE skill_id % 3 = 2),
    k AS (SELECT {NORM.format('name')} AS key, max(skill_id) AS id FROM skill GROUP BY 1), s AS (SELECT {NORM.format('synonym')} AS key, min(skill_id) AS id FROM syn GROUP BY 1)
    SELECT phrase, coalesce(k.id, s.id) AS skill_id, CASE WHEN k.id IS NOT NULL THEN 'exact' WHEN s.id IS NOT NULL THEN 'synonym' ELSE 'none' END AS match_type,
      CASE WHEN k.id IS NOT NULL THEN 1.0 WHEN s.id IS NOT NULL THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence
    FROM (SELECT phrase, {NORM.format('phrase')} AS key FROM asked) a LEFT JOIN k USING (key) LEFT JOIN s USING (key)""")
def resolve_exact_synonym(v):
    return taxonomy.resolve(phrases(v), v.skill, synonyms(v), fuzzy=False)


@query("resolve_fuzzy")
def resolve_fuzzy(v):
    misspelt = v.skill.select(F.concat(F.substring("name", 1, 4), F.substring("name", 6, 40)).alias("phrase"))
    return taxonomy.resolve(misspelt, v.skill, synonyms(v))


@query("scan_text", f"""WITH {SYN}, lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM docs2),
    toks AS (SELECT doc_id, line_no, line, list_filter(list_transform(regexp_extract_all(lower(line), '[a-z0-9+#.]+'), lambda t: trim(t, '.')), lambda t: length(t) >= 2) AS t FROM lines),
    grams AS (SELECT doc_id, line_no, line, n, i, array_to_string(t[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM toks, (VALUES (1), (2), (3), (4)) w(n) WHERE len(t) >= n)),
    names AS (SELECT {NORM.format('name')} AS key, max(skill_id) AS skill_id, arg_max(name, skill_id) AS name FROM skill GROUP BY 1),
    others AS (SELECT {NORM.format('synonym')} AS key, min(skill_id) AS skill_id, arg_min(name, skill_id) AS name FROM syn JOIN skill USING (skill_id) GROUP BY 1),
    known AS (SELECT *, 'exact' AS match_type, 1.0::DOUBLE AS confidence FROM names UNION ALL SELECT *, 'synonym', 0.95 FROM others WHERE key NOT IN (SELECT key FROM names)),
    hits AS (SELECT * FROM grams g JOIN known k ON {NORM.format('gram')} = key WHERE key NOT IN {tuple(taxonomy.AMBIGUOUS)} OR list_contains(string_split_regex(line, '{taxonomy.SPACE}'), name))
    SELECT doc_id, skill_id, arg_min(match_type, (-confidence, line_no, n, i)) AS match_type, max(confidence) AS confidence, arg_min(gram, (-confidence, line_no, n, i)) AS matched_text,
      arg_min(line_no, (-confidence, line_no, n, i))::INT AS line_no, count(*) AS mentions, arg_min(line[:140], (-confidence, line_no, n, i)) AS evidence
    FROM hits GROUP BY 1, 2""".replace("docs2", "(SELECT o.o_orderkey AS doc_id, string_agg('worked with ' || p_name || '.', chr(10) ORDER BY l_linenumber, p_name) AS text FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1) d"))
def scan_text(v):
    return taxonomy.scan_text(order_notes(v), v.skill, synonyms=synonyms(v))


def order_notes(v):
    """A text per order that names the parts it holds, a line each."""
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey")).join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: F.concat(F.lit("worked with "), x["p_name"], F.lit(".")))
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(lines, "\n").alias("text"))


HOPS = """hops AS (
      SELECT skill_id, parent_skill_id AS other, 0.75::DOUBLE AS weight, 0 AS kind FROM skill WHERE parent_skill_id IS NOT NULL
      UNION ALL SELECT parent_skill_id, skill_id, 0.7, 1 FROM skill WHERE parent_skill_id IS NOT NULL
      UNION ALL SELECT * FROM (SELECT DISTINCT a, b, 0.6::DOUBLE, 2 FROM (SELECT source_skill_id AS a, target_skill_id AS b FROM skill_relation UNION ALL SELECT target_skill_id, source_skill_id FROM skill_relation))),
    d1 AS (SELECT skill_id AS seed, other AS node, weight, kind, row_number() OVER (PARTITION BY skill_id ORDER BY kind, other) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY skill_id, other ORDER BY kind) AS n FROM hops WHERE skill_id <> other) WHERE n = 1)"""


@query("expand_depth1", f"WITH {HOPS} SELECT seed AS skill_id, node AS other, 1 AS depth, weight FROM d1")
def expand_depth1(v):
    return taxonomy.expand(v.skill, v.skill_relation, 1)


@query("expand_depth2", f"""WITH {HOPS}, d2 AS (SELECT d1.seed, h.other AS node, round(d1.weight * h.weight, 4) AS weight, row_number() OVER (PARTITION BY d1.seed, h.other ORDER BY rank, h.kind) AS n
      FROM d1 JOIN hops h ON h.skill_id = d1.node WHERE h.other <> d1.seed AND NOT EXISTS (SELECT 1 FROM d1 p WHERE p.seed = d1.seed AND p.node = h.other))
    SELECT seed AS skill_id, node AS other, 1 AS depth, weight FROM d1 UNION ALL SELECT seed, node, 2, weight FROM d2 WHERE n = 1""")
def expand_depth2(v):
    return taxonomy.expand(v.skill, v.skill_relation, 2)


@query("equivalent_skills", f"WITH {HOPS} SELECT DISTINCT skill_id, other FROM hops WHERE skill_id <> other")
def equivalent_skills(v):
    return taxonomy.expand_one(v.skill, v.skill_relation).select("skill_id", "other").where("skill_id != other").distinct()


@query("suggest", """
    (SELECT DISTINCT 'skill' AS kind, name AS value FROM skill WHERE starts_with(lower(name), 'co') ORDER BY 2 LIMIT 5)
    UNION ALL (SELECT DISTINCT 'company', company_name FROM experience WHERE contains(lower(company_name), 'co') ORDER BY 2 LIMIT 5)
    UNION ALL (SELECT DISTINCT 'candidate', full_name FROM alive WHERE contains(lower(full_name), 'co') ORDER BY 2 LIMIT 5)""")
def suggest(v):
    return taxonomy.suggest("Co", v.skill, v.alive, v.experience)
