"""Queries over jobs, users, sessions and requirements made from the star schema, and the remaining candidate lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from hireloom.operators import access, search, taxonomy
from hireloom.plans.documents import TOKENS
from hireloom.plans.registry import query
from hireloom.plans.taxonomies import synonyms


def jobs(v):
    k = F.col("s_suppkey")
    return v.table("supplier").select(
        k.alias("job_id"), F.col("s_name").alias("title"), (k % 4 != 0).alias("is_active"), F.date_sub(F.lit("1998-01-01").cast("date"), (k % 700).cast("int")).alias("created_at")
    )


@query("job_list", "SELECT s_suppkey AS job_id, s_name AS title, DATE '1998-01-01' - (s_suppkey % 700)::INT AS created_at FROM supplier WHERE s_suppkey % 4 <> 0")
def job_list(v):
    return access.open_jobs(jobs(v)).select("job_id", "title", "created_at")


def users(v):
    k = F.col("c_custkey")
    return v.table("customer").select(k.alias("user_id"), F.col("c_name").alias("full_name"), F.concat(F.lit("U"), k, F.lit("@Example.com")).alias("email"), (k % 6 != 0).alias("is_active"), F.lower("c_mktsegment").alias("role"))


@query("user_list", "SELECT c_custkey AS user_id, c_name AS full_name FROM customer WHERE c_custkey % 6 <> 0")
def user_list(v):
    return access.list_users(users(v)).select("user_id", "full_name")


@query("user_lookup", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey = 12")
def user_lookup(v):
    return access.find_user(users(v), " u12@EXAMPLE.com ").select("user_id")


@query("permitted_users", "SELECT c_custkey AS user_id FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def permitted_users(v):
    table = v.spark.createDataFrame([("building", "match:run"), ("machinery", "match:run"), ("building", "users:list"), ("household", "users:list")], "role string, permission string")
    return access.allowed(users(v), table, "match:run").select("user_id")


def sessions(v):
    k = F.col("event_id")
    return v.table("events").select(k.alias("session_id"), "user_id", F.col("ts").cast("timestamp").alias("last_seen"), F.when(k % 5 == 0, F.col("ts").cast("timestamp")).alias("revoked_at"))


NOW = "(SELECT max(ts) FROM events)"


@query("live_sessions", f"SELECT event_id AS session_id, user_id FROM events WHERE event_id % 5 <> 0 AND ts >= {NOW} - INTERVAL 2 HOUR")
def live_sessions(v):
    now = sessions(v).agg(F.max("last_seen").alias("now")).first()["now"]
    return access.live_sessions(sessions(v), F.lit(now), "2 hours").select("session_id", "user_id")


@query("revoked_sessions", "SELECT user_id, count(*) AS revoked FROM events WHERE event_id % 5 = 0 OR user_id % 3 = 0 GROUP BY 1")
def revoked_sessions(v):
    now = F.lit("2030-01-01").cast("timestamp")
    ended = access.revoke_all(sessions(v), sessions(v).where("user_id % 3 = 0").select("user_id").distinct(), now)
    return ended.where("revoked_at is not null").groupBy("user_id").agg(F.count("*").alias("revoked"))


@query("requirement_merge", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a;b' WHEN p_partkey % 3 = 1 THEN 'c;d' ELSE 'stored' END AS skills,
      CASE WHEN p_partkey % 2 = 0 THEN 3.5 ELSE 1.0 END::DOUBLE AS years, CASE WHEN p_partkey % 4 = 0 THEN 'stored title' ELSE 'asked title' END AS title FROM part""")
def requirement_merge(v):
    """Criteria as JSON lists of names or objects; what is missing, empty or 0 comes from the stored requirement."""
    k = F.col("p_partkey")
    asked = access.names_of(F.when(k % 3 == 0, F.lit('["a", "b"]')).when(k % 3 == 1, F.lit('[{"skill": "c"}, {"name": "d"}, 5, {"other": 1}]')).otherwise(F.lit("not json")))
    only_names = F.filter(asked, lambda x: x != "5")
    skills = F.when(F.size(only_names) > 0, only_names).otherwise(F.array(F.lit("stored")))
    return v.table("part").select(
        "p_partkey", F.array_join(skills, ";").alias("skills"), access.criteria_or(F.when(k % 2 == 0, 3.5).otherwise(0.0), F.lit(1.0)).alias("years"),
        access.criteria_or(F.when(k % 4 == 0, "").otherwise("asked title"), F.lit("stored title")).alias("title"),
    )


def education(v):
    return v.alive.select("candidate_id", F.col("highest_degree").alias("degree"), F.concat(F.lit("University of "), F.col("city")).alias("institution"), F.lit(None).cast("string").alias("field"), (F.col("candidate_id") % 30 + 1970).cast("int").alias("end_year"))


@query("candidate_filter_education", "SELECT candidate_id, full_name FROM alive WHERE contains(lower(highest_degree), 'tech') OR contains(lower('University of ' || city), 'tech')")
def candidate_filter_education(v):
    return search.by_education(v.alive, education(v), "Tech").select("candidate_id", "full_name")


@query("skill_browse", """SELECT skill_id, name FROM (SELECT * FROM skill WHERE (contains(lower(name), 'bolt') OR contains(lower(array_to_string(list_reverse(string_split(name, ' ')), ' ')), 'bolt ')) ORDER BY skill_id LIMIT 50)""")
def skill_browse(v):
    return search.browse_skills(v.skill, synonyms(v), "bolt").select("skill_id", "name")


@query("candidate_timeline_full", """WITH t AS (SELECT candidate_id, 'experience' AS kind, company_name AS title, strftime(start_date, '%Y-%m-%d') AS sort_key FROM experience UNION ALL SELECT candidate_id, 'certification', name, '0000' FROM certification
      UNION ALL SELECT candidate_id, 'education', highest_degree, (candidate_id % 30 + 1970)::VARCHAR FROM alive)
    SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sort_key DESC, kind, title) AS place FROM t""")
def candidate_timeline_full(v):
    return search.full_timeline(v.experience, v.certification, education(v))


@query("candidate_export", """WITH p AS (SELECT * FROM alive ORDER BY created_at DESC NULLS LAST, candidate_id DESC LIMIT 1000),
    s AS (SELECT candidate_id, string_agg(raw_text, '; ' ORDER BY confidence DESC, raw_text) AS skills FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY confidence DESC, raw_text) AS n FROM candidate_skill) WHERE n <= 12 GROUP BY 1)
    SELECT candidate_id, full_name, status, coalesce(skills, '') AS skills FROM p LEFT JOIN s USING (candidate_id)""")
def candidate_export(v):
    return search.export_rows(v.alive, v.candidate_skill).select("candidate_id", "full_name", "status", "skills")


LINE = "list_filter(list_transform(regexp_extract_all(lower(line), '[a-z0-9+#.]+'), lambda t: trim(t, '.')), lambda t: length(t) >= 2)"


@query("scan_documents", f"""WITH b AS (SELECT item_id AS term_id, {TOKENS.format('text')} AS t FROM benchmark), terms AS (SELECT term_id, array_to_string(t[1:3], '') AS gram, 1.0::DOUBLE AS confidence FROM b UNION ALL SELECT term_id, array_to_string(t[4:5], ''), 0.95 FROM b),
    known AS (SELECT gram, term_id, max(confidence) AS confidence FROM (SELECT regexp_replace(gram, '[^\\p{{L}}\\p{{N}}+#]', '', 'g') AS gram, term_id, confidence FROM terms) WHERE gram <> '' GROUP BY 1, 2),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
    keys AS (SELECT doc_id, line_no, line, list_transform({LINE}, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}+#]', '', 'g')) AS k FROM lines),
    grams AS (SELECT doc_id, line_no, line, unnest(list_transform(range(1, len(k) - n + 2), lambda i: array_to_string(k[i:i + n - 1], ''))) AS gram FROM keys, (VALUES (1), (2), (3), (4)) w(n) WHERE len(k) >= n)
    SELECT doc_id, term_id, max(confidence) AS confidence, arg_min(line_no, (-confidence, line_no))::INT AS line_no, count(*) AS mentions, arg_min(line[:140], (-confidence, line_no)) AS evidence FROM grams JOIN known USING (gram) GROUP BY 1, 2""")
def scan_documents(v):
    """Whole documents scanned for the first words of each benchmark item, and with less confidence for the next two."""
    from hireloom.functions.text import tokenize

    words = v.table("benchmark").select(F.col("item_id").alias("term_id"), tokenize(F.col("text")).alias("t"))
    one = words.select("term_id", F.array_join(F.slice("t", 1, 3), " ").alias("name"), F.lit(1.0).alias("confidence"))
    two = words.select("term_id", F.array_join(F.slice("t", 4, 2), " ").alias("name"), F.lit(0.95).alias("confidence"))
    return taxonomy.scan_terms(v.table("documents").select("doc_id", "text"), one.unionByName(two).where("name != ''"), most=4)
