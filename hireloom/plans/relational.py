"""Counts, filters, pages and reports over the talent relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hireloom.operators import entities, reports, search
from hireloom.plans.registry import query
from hireloom.sources.views import AS_OF, STATUSES

STAGES_SQL = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"
BUCKETS_SQL = ", ".join(f"({i}, '{b}', {lo}, {hi})" for i, (b, lo, hi) in enumerate(reports.EXPERIENCE_BUCKETS))


@query("top_skills", """
    SELECT coalesce(s.name, cs.raw_text) AS skill, s.category, count(DISTINCT cs.candidate_id) AS candidates
    FROM candidate_skill cs JOIN alive a USING (candidate_id) LEFT JOIN skill s ON cs.skill_id = s.skill_id
    GROUP BY ALL ORDER BY candidates DESC, skill, category NULLS LAST LIMIT 10""")
def top_skills(v):
    links = v.candidate_skill.join(v.alive.select("candidate_id"), "candidate_id")
    named = links.join(F.broadcast(v.skill.select("skill_id", "name", "category")), "skill_id", "left")
    return reports.top_by_candidates(named.withColumn("skill", F.coalesce("name", "raw_text")), ["skill", "category"], 10)


def _distribution(v, column):
    mapped = v.candidate_skill.join(F.broadcast(v.skill), "skill_id").join(v.alive.select("candidate_id"), "candidate_id")
    return reports.top_by_candidates(mapped.where(F.col(column).isNotNull()), [column])


DISTRIBUTION = "SELECT s.{0}, count(DISTINCT cs.candidate_id) AS candidates FROM candidate_skill cs JOIN skill s USING (skill_id) JOIN alive USING (candidate_id) WHERE s.{0} IS NOT NULL GROUP BY 1"


@query("technology_distribution", DISTRIBUTION.format("technology_stack"))
def technology_distribution(v):
    return _distribution(v, "technology_stack")


@query("category_distribution", DISTRIBUTION.format("category"))
def category_distribution(v):
    return _distribution(v, "category")


@query("top_companies", "SELECT company_name, count(DISTINCT candidate_id) AS candidates FROM experience JOIN alive USING (candidate_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_companies(v):
    return reports.top_by_candidates(v.experience.join(v.alive, "candidate_id", "left_semi"), ["company_name"], 10)


@query("top_certifications", "SELECT name, count(DISTINCT candidate_id) AS candidates FROM certification JOIN alive USING (candidate_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_certifications(v):
    return reports.top_by_candidates(v.certification.join(v.alive, "candidate_id", "left_semi"), ["name"], 10)


@query("experience_distribution", f"""
    SELECT b.no AS bucket_no, b.label AS bucket, count(candidate_id) AS candidates
    FROM (VALUES {BUCKETS_SQL}) b(no, label, lo, hi)
    LEFT JOIN alive ON total_experience_years >= lo AND total_experience_years < hi GROUP BY 1, 2""")
def experience_distribution(v):
    return reports.histogram(v.alive, "total_experience_years", reports.EXPERIENCE_BUCKETS)


TRENDS = f"""trends AS (
    SELECT strftime(m, '%b %Y') AS period, m::DATE AS month,
      (SELECT count(*) FROM resume WHERE date_trunc('month', created_at) = m) AS uploads,
      (SELECT count(*) FROM alive WHERE date_trunc('month', created_at) = m) AS candidates,
      (SELECT count(*) FROM alive WHERE date_trunc('month', updated_at) = m AND status = 'shortlisted') AS shortlisted,
      (SELECT count(*) FROM alive WHERE date_trunc('month', updated_at) = m AND status = 'rejected') AS rejected
    FROM (SELECT unnest(generate_series(date_trunc('month', DATE '{AS_OF}') - INTERVAL 11 MONTH, date_trunc('month', DATE '{AS_OF}'), INTERVAL 1 MONTH)) AS m))"""


@query("hiring_trends", f"WITH {TRENDS} SELECT * FROM trends")
def hiring_trends(v):
    return reports.hiring_trends(v.alive, v.resume, AS_OF, 12)


@query("trend_growth", f"""WITH {TRENDS}, g AS (SELECT period, month, candidates, lag(candidates) OVER (ORDER BY month) AS previous FROM trends)
    SELECT *, CASE WHEN candidates > previous THEN 'growing' WHEN candidates < previous THEN 'slowed' WHEN candidates = previous THEN 'flat' END AS direction FROM g""")
def trend_growth(v):
    return reports.growth(reports.hiring_trends(v.alive, v.resume, AS_OF, 12))


@query("status_counts", "SELECT status, count(*) AS candidates FROM alive GROUP BY 1")
def status_counts(v):
    return v.alive.groupBy("status").agg(F.count("*").alias("candidates"))


@query("pipeline_funnel", f"""
    SELECT (i - 1)::INT AS stage_no, ({STAGES_SQL})[i] AS stage, count(a.candidate_id) AS candidates,
      round(100.0 * count(a.candidate_id) / (SELECT count(*) FROM alive), 2)::DOUBLE AS percent
    FROM range(1, 10) r(i) LEFT JOIN alive a ON a.status = ({STAGES_SQL})[i] GROUP BY i""")
def pipeline_funnel(v):
    return reports.funnel(v.alive, STATUSES)


STATS = """SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
      count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status IN ('queued', 'parsing', 'embedding', 'graph_sync')) AS in_progress,
      round(100.0 * count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')), 2)::DOUBLE AS success_rate,
      round(avg(parse_duration_ms), 2) AS mean_parse_ms FROM resume"""


@query("processing_stats", STATS)
def processing_stats(v):
    return reports.processing_stats(v.resume)


KPIS = f"""k AS (
    SELECT *, round(links / total_candidates, 2) AS skills_per_candidate, round(100.0 * shortlisted / total_candidates, 2)::DOUBLE AS shortlist_rate,
      round(100.0 * rejected / total_candidates, 2)::DOUBLE AS rejection_rate
    FROM (SELECT count(*) AS total_candidates, count(*) FILTER (status = 'shortlisted') AS shortlisted, count(*) FILTER (status = 'rejected') AS rejected,
        count(*) FILTER (status = 'hired') AS hired, count(*) FILTER (status = 'interviewing') AS interviewing,
        count(*) FILTER (status IN ('pending_review', 'new')) AS pending_review, round(avg(total_experience_years), 2) AS average_experience,
        round(avg(last_match_score), 2) AS average_match_score,
        count(*) FILTER (created_at >= TIMESTAMP '2001-01-01' AND created_at < TIMESTAMP '2001-08-01') AS added_in_period FROM alive),
      (SELECT count(*) AS links, count(DISTINCT coalesce(skill_id::VARCHAR, raw_text)) AS unique_skills,
        round(100.0 * count(skill_id) / count(*), 2)::DOUBLE AS taxonomy_coverage FROM candidate_skill),
      (SELECT count(DISTINCT company_name) AS unique_companies FROM experience WHERE company_name <> ''),
      (SELECT total AS resumes, failed AS failed_resumes, success_rate AS parse_success_rate FROM ({STATS})))"""


@query("report_kpis", f"WITH {KPIS} SELECT * EXCLUDE (links) FROM k")
def report_kpis(v):
    return reports.kpis(v)


def skill_names(v, n=4):
    """The first skills by name: a request that exists at every scale."""
    return [r["name"] for r in v.skill.orderBy("name").limit(n).collect()]


REQ = "(SELECT name AS skill FROM skill ORDER BY name LIMIT 4)"
GAP = f"""gaps AS (
    SELECT r.skill, any_value(s.category) AS category, count(DISTINCT a.candidate_id) AS candidates,
      round(100.0 * count(DISTINCT a.candidate_id) / (SELECT count(*) FROM alive), 2)::DOUBLE AS coverage_percent,
      round(100 - round(100.0 * count(DISTINCT a.candidate_id) / (SELECT count(*) FROM alive), 2), 2)::DOUBLE AS demand
    FROM {REQ} r JOIN skill s ON s.name = r.skill LEFT JOIN candidate_skill cs ON cs.raw_text = r.skill
    LEFT JOIN alive a ON a.candidate_id = cs.candidate_id GROUP BY 1)"""


@query("skill_gap", f"""WITH {GAP}, near AS (
      SELECT g.skill, o.name AS bridge FROM gaps g JOIN skill s ON s.name = g.skill JOIN skill_relation r ON s.skill_id IN (r.source_skill_id, r.target_skill_id)
      JOIN skill o ON o.skill_id = CASE WHEN r.source_skill_id = s.skill_id THEN r.target_skill_id ELSE r.source_skill_id END)
    SELECT g.*, coalesce((SELECT string_agg(bridge, '; ' ORDER BY bridge) FROM (SELECT DISTINCT bridge FROM near n WHERE n.skill = g.skill ORDER BY bridge LIMIT 4)), '') AS bridges FROM gaps g""")
def skill_gap(v):
    return entities.skill_gap(v, skill_names(v))


@query("report_insights", f"""WITH {TRENDS}, {KPIS}, {GAP}, g AS (SELECT month, candidates, lag(candidates) OVER (ORDER BY month) AS previous FROM trends),
    rules AS (
      SELECT 1 AS rule, 'warning' AS level, 'Parsing needs attention' AS title, parse_success_rate::DOUBLE AS value FROM k WHERE resumes > 0 AND parse_success_rate < 85
      UNION ALL SELECT 2, 'warning', 'Skills are not mapped', taxonomy_coverage FROM k WHERE total_candidates > 0 AND taxonomy_coverage < 70
      UNION ALL SELECT 3, 'warning', 'Review backlog is high', pending_review FROM k WHERE pending_review >= 0.35 * total_candidates
      UNION ALL SELECT 4, 'warning', 'Scarce skills', least(count(*), 3) FROM gaps WHERE coverage_percent < 25 HAVING count(*) > 0
      UNION ALL SELECT 5, CASE WHEN candidates > previous THEN 'success' ELSE 'info' END, CASE WHEN candidates > previous THEN 'Inbound is growing' ELSE 'Inbound slowed' END, candidates
        FROM g WHERE month = DATE '{AS_OF}' AND candidates <> previous
      UNION ALL SELECT 6, 'info', 'Most common skill', max(n) FROM (SELECT count(DISTINCT candidate_id) AS n FROM candidate_skill JOIN alive USING (candidate_id) GROUP BY raw_text)
      UNION ALL SELECT 7, 'success', 'Hires recorded', hired FROM k WHERE hired > 0
      UNION ALL SELECT 8, 'info', 'Match quality', average_match_score FROM k WHERE average_match_score IS NOT NULL)
    SELECT * FROM rules ORDER BY rule LIMIT 6""")
def report_insights(v):
    trend = reports.growth(reports.hiring_trends(v.alive, v.resume, AS_OF, 12))
    return reports.insights(reports.kpis(v), entities.skill_gap(v, skill_names(v)), trend, top_skills(v))


@query("dashboard_cards", f"""
    SELECT (SELECT count(*) FROM alive) AS candidates, (SELECT count(*) FROM resume) AS resumes,
      (SELECT count(*) FROM resume WHERE created_at >= TIMESTAMP '{AS_OF}') AS uploads_today,
      (SELECT count(*) FROM alive WHERE status IN ('pending_review', 'new')) AS pending,
      (SELECT count(*) FROM alive WHERE status = 'shortlisted') AS shortlisted, (SELECT count(*) FROM alive WHERE status = 'rejected') AS rejected,
      (SELECT round(avg(last_match_score), 2) FROM alive) AS average_match_score""")
def dashboard_cards(v):
    s = F.col("status")
    people = v.alive.agg(
        F.count("*").alias("candidates"), F.count_if(s.isin("pending_review", "new")).alias("pending"), F.count_if(s == "shortlisted").alias("shortlisted"),
        F.count_if(s == "rejected").alias("rejected"), F.round(F.avg("last_match_score"), 2).alias("average_match_score"),
    )
    files = v.resume.agg(F.count("*").alias("resumes"), F.count_if(F.col("created_at") >= F.lit(AS_OF).cast("timestamp")).alias("uploads_today"))
    return people.crossJoin(files)


STALE = f"SELECT candidate_id, full_name, status, updated_at FROM alive WHERE status IN ('new', 'pending_review') AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY ORDER BY updated_at, candidate_id LIMIT {{0}}"


@query("stale_candidates", STALE.format(10))
def stale_candidates(v, n=10):
    waiting = v.alive.where(F.col("status").isin("new", "pending_review") & (F.col("updated_at") < F.lit(AS_OF).cast("timestamp") - F.expr("interval 14 days")))
    return waiting.select("candidate_id", "full_name", "status", "updated_at").orderBy("updated_at", "candidate_id").limit(n)


@query("dashboard_recommendations", f"""WITH best AS (
      SELECT availability, candidate_id, full_name, last_match_score, row_number() OVER (PARTITION BY availability ORDER BY last_match_score DESC NULLS LAST, candidate_id) AS rn FROM alive),
    recs AS (
      SELECT 1 AS kind_no, 'top_match' AS kind, availability || '/' || full_name AS subject, last_match_score AS score FROM best WHERE rn <= 3 AND availability IN ('AUTOMOBILE', 'BUILDING')
      UNION ALL SELECT 2, 'needs_review', full_name, NULL FROM ({STALE.format(4)})
      UNION ALL SELECT 3, 'action_required', 'failed resumes', count(*)::DOUBLE FROM resume WHERE status = 'failed' HAVING count(*) > 0
      UNION ALL SELECT 4, 'taxonomy', 'coverage', round(100.0 * count(skill_id) / count(*), 2)::DOUBLE AS c FROM candidate_skill HAVING c < 80)
    SELECT * FROM recs ORDER BY kind_no, subject LIMIT 8""")
def dashboard_recommendations(v):
    rec = lambda df, no, kind, subject, score: df.select(F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), subject.alias("subject"), score.cast("double").alias("score"))
    runs = v.alive.where(F.col("availability").isin("AUTOMOBILE", "BUILDING"))
    best = search.top_per_group(runs, "availability", [F.desc_nulls_last("last_match_score"), F.asc("candidate_id")], 3)
    failed = v.resume.where("status = 'failed'").agg(F.count("*").alias("n")).where("n > 0")
    covered = v.candidate_skill.agg(reports.coverage(v.candidate_skill).alias("c")).where("c < 80")
    parts = [
        rec(best, 1, "top_match", F.concat_ws("/", "availability", "full_name"), F.col("last_match_score")),
        rec(stale_candidates(v, 4), 2, "needs_review", F.col("full_name"), F.lit(None)),
        rec(failed, 3, "action_required", F.lit("failed resumes"), F.col("n")), rec(covered, 4, "taxonomy", F.lit("coverage"), F.col("c")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("kind_no", "subject").limit(8)


@query("top_locations", "SELECT coalesce(city, country) AS location, count(*) AS candidates FROM alive WHERE coalesce(city, country) IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_locations(v):
    place = v.alive.select(F.coalesce("city", "country").alias("location")).where("location is not null")
    return place.groupBy("location").agg(F.count("*").alias("candidates")).orderBy(F.desc("candidates"), "location").limit(10)


@query("education_distribution", "SELECT highest_degree, count(*) AS candidates FROM alive WHERE highest_degree IS NOT NULL GROUP BY 1")
def education_distribution(v):
    return v.alive.where("highest_degree is not null").groupBy("highest_degree").agg(F.count("*").alias("candidates"))


@query("recent_uploads", "SELECT resume_id, candidate_id, status, created_at FROM resume ORDER BY created_at DESC, resume_id DESC LIMIT 10")
def recent_uploads(v):
    return v.resume.select("resume_id", "candidate_id", "status", "created_at").orderBy(F.desc("created_at"), F.desc("resume_id")).limit(10)


@query("resume_list", "SELECT resume_id, candidate_id, status, created_at FROM resume WHERE status = 'completed' ORDER BY created_at DESC, resume_id DESC LIMIT 25 OFFSET 25")
def resume_list(v):
    done = v.resume.where("status = 'completed'").select("resume_id", "candidate_id", "status", "created_at")
    return done.orderBy(F.desc("created_at"), F.desc("resume_id")).offset(25).limit(25)


@query("kb_stats", """
    SELECT (SELECT count(*) FROM skill) AS skills, (SELECT count(DISTINCT category) FROM skill) AS categories, count(*) AS links, count(skill_id) AS mapped,
      round(100.0 * count(skill_id) / count(*), 2)::DOUBLE AS coverage FROM candidate_skill""")
def kb_stats(v):
    own = v.skill.agg(F.count("*").alias("skills"), F.countDistinct("category").alias("categories"))
    return own.crossJoin(v.candidate_skill.agg(F.count("*").alias("links"), F.count("skill_id").alias("mapped"), reports.coverage(v.candidate_skill).alias("coverage")))


@query("kb_category_counts", "SELECT category, count(*) AS skills FROM skill GROUP BY 1")
def kb_category_counts(v):
    return v.skill.groupBy("category").agg(F.count("*").alias("skills"))


@query("kb_skill_list", """
    SELECT s.skill_id, s.name, s.category, p.name AS parent, coalesce(n, 0) AS candidates
    FROM (SELECT * FROM skill WHERE contains(lower(name), 'a') ORDER BY skill_id LIMIT 50) s LEFT JOIN skill p ON p.skill_id = s.parent_skill_id
    LEFT JOIN (SELECT skill_id, count(DISTINCT candidate_id) AS n FROM candidate_skill GROUP BY 1) c ON c.skill_id = s.skill_id""")
def kb_skill_list(v):
    found = v.skill.where(F.lower("name").contains("a")).orderBy("skill_id").limit(50)
    parents = v.skill.select(F.col("skill_id").alias("parent_skill_id"), F.col("name").alias("parent"))
    counts = v.candidate_skill.groupBy("skill_id").agg(F.countDistinct("candidate_id").alias("n"))
    joined = found.join(F.broadcast(parents), "parent_skill_id", "left").join(counts, "skill_id", "left")
    return joined.select("skill_id", "name", "category", "parent", F.coalesce("n", F.lit(0)).alias("candidates"))


TEXT_HIT = "(contains(lower(coalesce(full_name, '')), '{0}') OR contains(lower(coalesce(city, '')), '{0}') OR contains(lower(coalesce(highest_degree, '')), '{0}') OR candidate_id IN (SELECT candidate_id FROM candidate_skill WHERE contains(lower(raw_text), '{0}')))"
SEARCH_TEXT = "azure skills in france"
SEARCH_SQL = "SELECT candidate_id, full_name, city FROM alive WHERE " + TEXT_HIT.format("azure") + " {0} " + TEXT_HIT.format("france")


@query("candidate_search_any", SEARCH_SQL.format("OR"))
def candidate_search_any(v):
    return search.text_match(v.alive, v.candidate_skill, SEARCH_TEXT, "any").select("candidate_id", "full_name", "city")


@query("candidate_search_all", SEARCH_SQL.format("AND"))
def candidate_search_all(v):
    return search.text_match(v.alive, v.candidate_skill, SEARCH_TEXT, "all").select("candidate_id", "full_name", "city")


@query("candidate_filter_skills_all", """SELECT candidate_id, full_name FROM alive WHERE candidate_id IN (
      SELECT candidate_id FROM candidate_skill WHERE raw_text IN (SELECT name FROM skill ORDER BY name LIMIT 2) GROUP BY 1 HAVING count(DISTINCT raw_text) = 2)""")
def candidate_filter_skills_all(v):
    return search.with_all_skills(v.alive, v.candidate_skill, skill_names(v, 2)).select("candidate_id", "full_name")


@query("candidate_filter_combo", """
    SELECT candidate_id, full_name, city, country, total_experience_years FROM alive
    WHERE status IN ('new', 'shortlisted', 'hired') AND total_experience_years BETWEEN 2 AND 12 AND (contains(lower(city), 'a') OR contains(lower(country), 'asia'))
      AND lower(availability) = 'building' AND created_at >= TIMESTAMP '1995-01-01'
      AND candidate_id IN (SELECT candidate_id FROM experience WHERE contains(lower(company_name), 'supplier'))
      AND (candidate_id IN (SELECT candidate_id FROM certification WHERE contains(lower(name), 'brand') OR contains(lower(issuer), 'brand'))
        OR candidate_id IN (SELECT candidate_id FROM candidate_skill JOIN skill USING (skill_id) WHERE contains(lower(technology_stack), 'a')))""")
def candidate_filter_combo(v):
    people = v.alive.where(
        F.col("status").isin("new", "shortlisted", "hired") & F.col("total_experience_years").between(2, 12)
        & (F.lower("city").contains("a") | F.lower("country").contains("asia")) & (F.lower("availability") == "building")
        & (F.col("created_at") >= F.lit("1995-01-01").cast("timestamp"))
    )
    worked = v.experience.where(F.lower("company_name").contains("supplier"))
    held = v.certification.where(F.lower("name").contains("brand") | F.lower("issuer").contains("brand")).select("candidate_id")
    tech = v.candidate_skill.join(F.broadcast(v.skill.where(F.lower("technology_stack").contains("a"))), "skill_id", "left_semi").select("candidate_id")
    found = people.join(worked, "candidate_id", "left_semi").join(held.union(tech), "candidate_id", "left_semi")
    return found.select("candidate_id", "full_name", "city", "country", "total_experience_years")


@query("candidate_page", """WITH page AS (
      SELECT candidate_id, full_name, total_experience_years FROM alive ORDER BY total_experience_years DESC NULLS LAST, candidate_id DESC LIMIT 20 OFFSET 20),
    best AS (SELECT candidate_id, raw_text, row_number() OVER (PARTITION BY candidate_id ORDER BY confidence DESC, raw_text) AS rn FROM candidate_skill)
    SELECT p.*, (SELECT count(*) FROM alive) AS total, coalesce((SELECT count(*) FROM resume r WHERE r.candidate_id = p.candidate_id), 0) AS resumes,
      coalesce((SELECT string_agg(raw_text, '; ' ORDER BY rn) FROM best b WHERE b.candidate_id = p.candidate_id AND rn <= 8), '') AS top_skills FROM page p""")
def candidate_page(v):
    rows = search.page(v.alive.select("candidate_id", "full_name", "total_experience_years"), "experience", True, 2, 20)
    files = v.resume.groupBy("candidate_id").agg(F.count("*").alias("n"))
    skills = search.main_skills(v.candidate_skill.join(F.broadcast(rows), "candidate_id", "left_semi"))
    joined = rows.join(files, "candidate_id", "left").join(skills, "candidate_id", "left").crossJoin(v.alive.agg(F.count("*").alias("total")))
    return joined.select(*rows.columns, "total", F.coalesce("n", F.lit(0)).alias("resumes"), F.coalesce(F.array_join("top_skills", "; "), F.lit("")).alias("top_skills"))


@query("candidate_detail", """
    SELECT candidate_id, full_name, concat_ws(', ', city, country) AS location,
      coalesce((SELECT string_agg(company_name, '; ' ORDER BY start_date, company_name) FROM experience e WHERE e.candidate_id = c.candidate_id), '') AS companies,
      coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM certification e WHERE e.candidate_id = c.candidate_id), '') AS certifications
    FROM alive c""")
def candidate_detail(v):
    return entities.candidate_detail(v.alive, v.experience, v.certification)


@query("candidate_timeline", """
    SELECT candidate_id, 'experience' AS kind, company_name AS title, strftime(start_date, '%Y-%m-%d') AS sort_key FROM experience
    UNION ALL SELECT candidate_id, 'certification', name, '0000' FROM certification""")
def candidate_timeline(v):
    return search.timeline(v.experience, v.certification)


@query("note_visibility", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' OR conv_id % 7 = 3")
def note_visibility(v):
    notes = v.table("conversations").withColumn("author", F.col("conv_id") % 7)
    return notes.where((F.col("role") == "user") | (F.col("author") == 3)).select("conv_id", "turn", "role")


@query("audit_recent", "SELECT event_id, event_type AS action, user_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_recent(v):
    log = v.table("events").select("event_id", F.col("event_type").alias("action"), "user_id", F.col("ts").cast("timestamp").alias("created_at"))
    return log.orderBy(F.desc("created_at"), F.desc("event_id")).limit(20)


@query("audit_page", "SELECT event_id, user_id, ts AS created_at, count(*) OVER () AS total FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def audit_page(v):
    log = v.table("events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("created_at"))
    rows = log.orderBy(F.desc("created_at"), F.desc("event_id")).offset(50).limit(25)
    return rows.crossJoin(F.broadcast(log.agg(F.count("*").alias("total"))))


@query("report_long_form", f"""WITH {KPIS}
    SELECT 'kpis' AS section, 'total_candidates' AS metric, total_candidates::DOUBLE AS value FROM k UNION ALL SELECT 'kpis', 'hired', hired FROM k
    UNION ALL SELECT 'kpis', 'taxonomy_coverage', taxonomy_coverage FROM k
    UNION ALL SELECT 'status', status, count(*) FROM alive GROUP BY status
    UNION ALL SELECT 'education', highest_degree, count(*) FROM alive GROUP BY highest_degree""")
def report_long_form(v):
    return entities.long_form({
        "kpis": reports.kpis(v).selectExpr("stack(3, 'total_candidates', double(total_candidates), 'hired', double(hired), 'taxonomy_coverage', double(taxonomy_coverage)) as (metric, value)"),
        "status": status_counts(v).select(F.col("status").alias("metric"), F.col("candidates").alias("value")),
        "education": education_distribution(v).select(F.col("highest_degree").alias("metric"), F.col("candidates").alias("value")),
    })


@query("mention_merge", """
    SELECT o_custkey AS candidate_id, p_name AS skill, sum(l_linenumber) AS mentions, round(max(1 - l_discount), 3) AS confidence,
      arg_min(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity) FILTER (l_quantity > 10) AS years, max((l_returnflag = 'R')::INT) = 1 AS from_section
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def mention_merge(v):
    rows = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    mentions = rows.select(
        F.col("o_custkey").alias("candidate_id"), F.col("p_name").alias("skill"), F.col("l_linenumber").alias("mentions"), (1 - F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("years"), (F.col("l_returnflag") == "R").alias("from_section"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
    )
    return entities.merge_mentions(mentions, ["candidate_id", "skill"])


@query("list_merge", """
    SELECT s_suppkey, array_to_string(list_sort(list(DISTINCT p_brand)), ';') AS brands FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def list_merge(v):
    rows = v.table("lineitem").join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return entities.merge_lists(rows, "s_suppkey", "p_brand", 60).select("s_suppkey", F.array_join("items", ";").alias("brands"))


MERGED = """merged AS (
    SELECT candidate_id, isl, min(start_date) AS start_date, max(end_date) AS end_date FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY candidate_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS isl FROM (
        SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY candidate_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM experience)) GROUP BY 1, 2),
  years AS (SELECT candidate_id, count(*) AS spans, sum(greatest(0, (year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) + 1))::BIGINT AS months FROM merged GROUP BY 1)"""


@query("interval_merge", f"WITH {MERGED} SELECT candidate_id, spans, months, round(months / 12, 1) AS years FROM years")
def interval_merge(v):
    return entities.merged_experience(v.experience)


@query("stated_vs_computed_experience", f"""WITH {MERGED} SELECT candidate_id, total_experience_years AS stated, round(months / 12, 1) AS computed,
      CASE WHEN total_experience_years > 0 AND total_experience_years <= 45 AND (months IS NULL OR abs(total_experience_years - round(months / 12, 1)) <= greatest(2, 0.5 * round(months / 12, 1)))
        THEN total_experience_years ELSE coalesce(round(months / 12, 1), 0) END AS years
    FROM candidate LEFT JOIN years USING (candidate_id)""")
def stated_vs_computed_experience(v):
    return entities.total_experience(v.candidate, entities.merged_experience(v.experience))


@query("completeness", """
    SELECT candidate_id, round(((full_name IS NOT NULL)::INT + (city IS NOT NULL OR country IS NOT NULL)::INT + (total_experience_years > 0)::INT + (highest_degree IS NOT NULL)::INT
      + (coalesce(s.n, 0) >= 3)::INT + (e.candidate_id IS NOT NULL)::INT + (k.candidate_id IS NOT NULL)::INT) / 12, 3) AS completeness
    FROM candidate LEFT JOIN (SELECT candidate_id, count(*) AS n FROM candidate_skill GROUP BY 1) s USING (candidate_id)
    LEFT JOIN (SELECT DISTINCT candidate_id FROM experience) e USING (candidate_id) LEFT JOIN (SELECT DISTINCT candidate_id FROM certification) k USING (candidate_id)""")
def completeness(v):
    return entities.completeness(v.candidate, v.candidate_skill, v.experience, v.certification)


@query("rank_within_status", "SELECT candidate_id, status, row_number() OVER (PARTITION BY status ORDER BY last_match_score DESC NULLS LAST, candidate_id) AS rank FROM alive QUALIFY rank <= 5")
def rank_within_status(v):
    best = search.top_per_group(v.alive, "status", [F.desc_nulls_last("last_match_score"), F.asc("candidate_id")], 5)
    return best.select("candidate_id", "status", F.col("__n").alias("rank"))


@query("latest_resume", "SELECT candidate_id, max(resume_id) AS resume_id, arg_max(status, resume_id) AS status FROM resume GROUP BY 1")
def latest_resume(v):
    return v.resume.groupBy("candidate_id").agg(F.max("resume_id").alias("resume_id"), F.max_by("status", "resume_id").alias("status"))


@query("status_change", "SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN 'on_hold' ELSE status END AS status, candidate_id % 3 = 0 AND status <> 'on_hold' AS changed FROM alive")
def status_change(v):
    new = v.alive.where("candidate_id % 3 = 0").select("candidate_id", F.lit("on_hold").alias("new_status"))
    return entities.apply_changes(v.alive.select("candidate_id", "status"), new)
