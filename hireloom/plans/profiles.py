"""Resume extraction over planted resumes, candidate records and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom.operators import documents, extract, profiles
from hireloom.plans.registry import query
from hireloom.plans.taxonomies import synonyms

LETTERS = "translate({0}, '0123456789', 'abcdefghij')"


def planted_resumes(v):
    """A resume per candidate with every kind of section, written from the relations."""
    jobs = F.transform(
        F.array_sort(F.collect_list(F.struct("start_date", "end_date", "company_name"))),
        lambda x: F.concat(F.lit("Data Engineer - "), x["company_name"], F.lit(" ("), F.date_format(x["start_date"], "MMM yyyy"), F.lit(" - "), F.date_format(x["end_date"], "MMM yyyy"), F.lit(")")),
    )
    work = v.experience.groupBy("candidate_id").agg(F.array_join(jobs, "\n").alias("work"))
    held = v.certification.groupBy("candidate_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "issuer"))), lambda x: F.concat(x["name"], F.lit(" - "), x["issuer"], F.lit(" (2001)"))), "\n").alias("held")
    )
    names = F.slice(F.array_sort(F.collect_set("raw_text")), 1, 3)
    skills = v.candidate_skill.groupBy("candidate_id").agg(names.alias("names"))
    rows = v.alive.join(work, "candidate_id", "left").join(held, "candidate_id", "left").join(skills, "candidate_id", "left")
    id_ = F.col("candidate_id").cast("string")
    letters = F.translate(id_, "0123456789", "abcdefghij")
    listed = F.transform("names", lambda n, i: F.when(i == 0, F.concat(n, F.lit(" ("), (F.col("candidate_id") % 9 + 1).cast("string"), F.lit(" years)"))).otherwise(n))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Alex P"), letters), F.concat(F.lit("Person"), id_, F.lit("@Example.com | +1 555 "), F.lpad(id_, 7, "0")),
        F.concat(F.lit("linkedin.com/in/p"), id_, F.lit(" github.com/p"), id_), F.concat(F.lit("Location: "), F.col("city"), F.lit(", "), F.col("country")),
        F.lit("PROFESSIONAL SUMMARY"), F.lit("Builds pipelines."), F.lit("Technical Skills:"), F.concat(F.lit("Main: "), F.array_join(listed, ", ")),
        F.lit("WORK EXPERIENCE"), F.col("work"), F.lit("Education"), F.concat("highest_degree", F.lit(", Example University, 1990 - 1994")),
        F.lit("PROJECTS"), F.concat(F.lit("Rollout "), letters, F.lit(": moved tables. Tools: Spark, SQL")), F.lit("CERTIFICATIONS"), F.col("held"),
        F.lit("Languages Known"), F.lit("German (fluent), English, Klingon"),
    )
    return rows.select(F.col("candidate_id").alias("doc_id"), text.alias("text"))


def parsed(v, *fields: str):
    """Records with the fields that a query reads, all if it names none."""
    return extract.parse_resumes(planted_resumes(v), fields=fields)


def exploded(v, child: str, *fields: str):
    # Not the plain explode: Spark would test its input for being empty in a filter below, parsing all of it once more.
    rows = parsed(v, child).select("doc_id", F.explode_outer(f"resume.{child}").alias("x")).where("x is not null")
    return rows.select("doc_id", *[F.col("x")[f].alias(f) for f in fields])


@query("resume_experience_rows", """SELECT candidate_id AS doc_id, 'Data Engineer' AS title, company_name AS company, date_trunc('month', start_date)::DATE AS start_date, last_day(end_date) AS end_date,
      ((year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) + 1)::INT AS months FROM experience JOIN alive USING (candidate_id)""")
def resume_experience_rows(v):
    return exploded(v, "experiences", "title", "company", "start_date", "end_date", "months")


@query("resume_education_rows", "SELECT candidate_id AS doc_id, highest_degree AS degree, 'Example University' AS institution, 1990 AS start_year, 1994 AS end_year FROM alive")
def resume_education_rows(v):
    return exploded(v, "educations", "degree", "institution", "start_year", "end_year")


@query("resume_certification_rows", "SELECT DISTINCT candidate_id AS doc_id, name, issuer, 2001 AS year FROM certification JOIN alive USING (candidate_id)")
def resume_certification_rows(v):
    return exploded(v, "certifications", "name", "issuer", "year")


@query("resume_skill_rows", """WITH s AS (SELECT candidate_id, raw_text, row_number() OVER (PARTITION BY candidate_id ORDER BY raw_text) AS n FROM (SELECT DISTINCT candidate_id, raw_text FROM candidate_skill JOIN alive USING (candidate_id)))
    SELECT candidate_id AS doc_id, raw_text AS name, CASE WHEN n = 1 THEN (candidate_id % 9 + 1)::DOUBLE END AS years, 0.95::DOUBLE AS confidence, 'skills_section' AS source, 1 AS mentions FROM s WHERE n <= 3
    UNION ALL SELECT candidate_id, unnest(['Spark', 'SQL']), NULL, 0.85, 'project', 1 FROM alive""")
def resume_skill_rows(v):
    return exploded(v, "skills", "name", "years", "confidence", "source", "mentions")


@query("resume_contact_fields", f"""SELECT candidate_id AS doc_id, 'Alex P' || {LETTERS.format('candidate_id::VARCHAR')} AS full_name, 'person' || candidate_id || '@example.com' AS email, '+1 555 ' || lpad(candidate_id::VARCHAR, 7, '0') AS phone,
      'https://linkedin.com/in/p' || candidate_id AS linkedin, 'https://github.com/p' || candidate_id AS github, city || ', ' || country AS location FROM alive""")
def resume_contact_fields(v):
    fields = ("full_name", "email", "phone", "linkedin", "github", "location")
    return parsed(v, *fields).select("doc_id", *[F.col("resume")[f].alias(f) for f in fields])


@query("resume_projects_languages", f"""SELECT candidate_id AS doc_id, 'Rollout ' || {LETTERS.format('candidate_id::VARCHAR')} AS project, 'German;English' AS languages, highest_degree AS degree FROM alive""")
def resume_projects_languages(v):
    r = F.col("resume")
    return parsed(v, "projects", "languages", "highest_degree").select("doc_id", r["projects"][0]["name"].alias("project"), F.array_join(r["languages"], ";").alias("languages"), r["highest_degree"].alias("degree"))


@query("resume_completeness", """SELECT candidate_id AS doc_id, round((5 + (w > 0)::INT * 3 + coalesce(total, 0) + 2 + (s + 2 >= 3)::INT) / 12.0, 3)::DOUBLE AS completeness FROM (
      SELECT a.candidate_id, count(DISTINCT e.start_date) AS w, max((e.end_date >= e.start_date)::INT) AS total, least(3, (SELECT count(DISTINCT raw_text) FROM candidate_skill k WHERE k.candidate_id = a.candidate_id)) AS s
      FROM alive a LEFT JOIN experience e ON e.candidate_id = a.candidate_id GROUP BY 1)""")
def resume_completeness(v):
    """Five checks hold for every planted resume (name, e-mail, phone, place, education) and the degree and project ones too."""
    return profiles.record_completeness(parsed(v, *profiles.CHECKED))


HEADERS = ["TECHNICAL SKILLS AND TOOLS USED DAILY", "skills used in my daily work", "Professional Experience:", "Skills: Python, SQL", "Education and other studies.", "Career Objective", "Key Projects Undertaken", "Areas of Expertise / tools"]
OPENS = ["skills", None, "experience", "skills", None, "summary", "projects", None]


@query("section_headers", f"""WITH h AS (SELECT doc_id, {HEADERS!r}[(doc_id % 8 + 1)::INT] AS head, {str(OPENS).replace('None', 'NULL')}[(doc_id % 8 + 1)::INT] AS opens FROM documents)
    SELECT doc_id, coalesce(opens, 'header') AS section, CASE WHEN opens IS NULL THEN 3 WHEN doc_id % 8 = 3 THEN 2 ELSE 1 END AS lines FROM h
    UNION ALL SELECT doc_id, 'header', 1 FROM h WHERE opens IS NOT NULL""")
def section_headers(v):
    """Headers of all shapes between two lines: capitals, a colon, inline content, and lines that only begin like one."""
    made = F.concat_ws("\n", F.lit("first line here."), F.get(F.array(*[F.lit(h) for h in HEADERS]), (F.col("doc_id") % 8).cast("int")), F.lit("last line here."))
    return documents.segment_sections(v.table("documents").select("doc_id", made.alias("text"))).select("doc_id", "section", F.col("lines").cast("int").alias("lines"))


def profile_rows(v):
    """Candidates with their child lists."""
    skills = v.candidate_skill.groupBy("candidate_id").agg(F.array_sort(F.collect_set("raw_text")).alias("skills"))
    work = v.experience.groupBy("candidate_id").agg(F.array_sort(F.collect_set("company_name")).alias("companies"))
    held = v.certification.groupBy("candidate_id").agg(F.array_sort(F.collect_list("name")).alias("certifications"))
    rows = v.alive.join(skills, "candidate_id", "left").join(work, "candidate_id", "left").join(held, "candidate_id", "left")
    return rows.withColumn("educations", F.array("highest_degree"))


PROFILE = """prof AS (SELECT a.candidate_id, 'Candidate: ' || full_name || chr(10) || 'Experience: ' || total_experience_years || ' years' || coalesce(chr(10) || 'Companies: ' || w, '') || coalesce(chr(10) || 'Skills: ' || s, '')
      || coalesce(chr(10) || 'Certifications: ' || c, '') || chr(10) || 'Education: ' || highest_degree AS document FROM alive a
      LEFT JOIN (SELECT candidate_id, string_agg(DISTINCT raw_text, ', ' ORDER BY raw_text) AS s FROM candidate_skill GROUP BY 1) USING (candidate_id)
      LEFT JOIN (SELECT candidate_id, string_agg(DISTINCT company_name, ', ' ORDER BY company_name) AS w FROM experience GROUP BY 1) USING (candidate_id)
      LEFT JOIN (SELECT candidate_id, string_agg(name, ', ' ORDER BY name) AS c FROM certification GROUP BY 1) USING (candidate_id))"""


@query("candidate_document", f"WITH {PROFILE} SELECT candidate_id, sha256(document) AS digest, length(document) AS chars FROM prof")
def candidate_document(v):
    made = profile_rows(v).select("candidate_id", profiles.candidate_document(profile_rows(v)).alias("d"))
    return made.select("candidate_id", F.sha2("d", 256).alias("digest"), F.length("d").cast("long").alias("chars"))


def _texts(v):
    rows = profile_rows(v)
    whole = rows.select("candidate_id", profiles.candidate_document(rows).alias("document"), F.lit(None).cast("string").alias("raw_text"))
    raw = planted_resumes(v).select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("raw_text"))
    whole = whole.drop("raw_text").join(raw, "candidate_id", "left")
    work = v.experience.join(v.alive.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", F.concat(F.lit("Project: "), F.col("company_name")).alias("text"))
    held = v.certification.join(v.alive.select("candidate_id"), "candidate_id", "left_semi").select("candidate_id", F.concat(F.lit("Certification: "), F.col("name")).alias("text"))
    return profiles.embedding_texts(whole, work, held)


@query("candidate_embedding_texts", f"""WITH {PROFILE}, t AS (SELECT candidate_id, 'profile' AS kind, 0 AS chunk_index, document AS text FROM prof
      UNION ALL SELECT candidate_id, 'project', row_number() OVER (PARTITION BY candidate_id ORDER BY company_name) - 1, 'Project: ' || company_name FROM experience JOIN alive USING (candidate_id)
      UNION ALL SELECT candidate_id, 'certification', row_number() OVER (PARTITION BY candidate_id ORDER BY name) - 1, 'Certification: ' || name FROM certification JOIN alive USING (candidate_id))
    SELECT candidate_id, kind, chunk_index::INT AS chunk_index, sha256(text) AS digest FROM t""")
def candidate_embedding_texts(v):
    """The texts that SQL can say; `candidate_embeddings` has the chunks too, and the vectors."""
    return _texts(v).where("kind != 'resume_chunk'").select("candidate_id", "kind", F.col("chunk_index").cast("int").alias("chunk_index"), F.sha2("text", 256).alias("digest"))


@query("candidate_embeddings")
def candidate_embeddings(v):
    made = profiles.embed_rows(_texts(v))
    return made.select("candidate_id", "kind", "chunk_index", F.size("vector").alias("dim"), F.transform(F.slice("vector", 1, 4), lambda x: F.round(x.cast("double"), 4)).alias("head"))


@query("skill_embedding_texts", "SELECT skill_id, 'Skill: ' || name || chr(10) || 'Category: ' || category || chr(10) || 'Stack: ' || technology_stack || chr(10) || 'Also: ' || array_to_string(list_reverse(string_split(name, ' ')), ' ') AS text FROM skill")
def skill_embedding_texts(v):
    return profiles.skill_texts(v.skill, synonyms(v))


@query("vector_index_stats", "SELECT kind, count(*) AS vectors, count(DISTINCT candidate_id) AS candidates, min(len(vector))::INT AS least_dim, max(len(vector))::INT AS most_dim FROM embedding GROUP BY 1")
def vector_index_stats(v):
    return profiles.index_stats(v.embedding)


def _phone(c: str = "c_custkey") -> Column:
    return F.concat(F.lit("+1 (555) "), F.lpad(F.col(c).cast("string"), 7, "0"))


def _people(v):
    return v.candidate.select("candidate_id", F.concat(F.lit("person"), F.col("candidate_id"), F.lit("@example.com")).alias("email"), _phone("candidate_id").alias("phone"), "is_deleted")


def _incoming(v):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return v.table("orders").select(
        k.alias("resume_id"), F.when(k % 5 == 0, c).alias("linked_id"), F.when(k % 3 == 0, F.concat(F.lit("PERSON"), c, F.lit("@Example.com"))).alias("email"),
        F.when(k % 2 == 0, F.concat(F.lit("1-555-"), F.lpad(c.cast("string"), 7, "0"))).alias("phone"),
    )


FOUND = """found AS (SELECT o_orderkey AS resume_id, c.candidate_id AS by_link, m.candidate_id AS by_mail, p.candidate_id AS by_phone, o_custkey,
      o_orderkey % 3 = 0 AS has_mail, o_orderkey % 2 = 0 AS has_phone FROM orders
      LEFT JOIN candidate c ON c.candidate_id = o_custkey AND o_orderkey % 5 = 0 LEFT JOIN alive m ON m.candidate_id = o_custkey AND o_orderkey % 3 = 0 LEFT JOIN alive p ON p.candidate_id = o_custkey AND o_orderkey % 2 = 0)"""


@query("identity_priority", f"WITH {FOUND} SELECT resume_id, coalesce(by_link, by_mail, by_phone) AS candidate_id, CASE WHEN by_link IS NOT NULL THEN 'link' WHEN by_mail IS NOT NULL THEN 'email' WHEN by_phone IS NOT NULL THEN 'phone' END AS found_by FROM found")
def identity_priority(v):
    return profiles.find_person(_incoming(v), _people(v)).drop("mail", "number")


@query("identity_new_persons", f"""WITH {FOUND}, n AS (SELECT * FROM found WHERE coalesce(by_link, by_mail, by_phone) IS NULL)
    SELECT resume_id, CASE WHEN has_mail OR has_phone THEN (SELECT min(m.resume_id) FROM n m WHERE m.o_custkey = n.o_custkey AND ((m.has_mail OR m.has_phone)
      AND (EXISTS (SELECT 1 FROM n b WHERE b.o_custkey = n.o_custkey AND b.has_mail AND b.has_phone) OR (n.has_mail AND m.has_mail) OR (n.has_phone AND m.has_phone)))) ELSE resume_id END AS person FROM n""")
def identity_new_persons(v):
    return profiles.new_person_groups(profiles.find_person(_incoming(v), _people(v)))


@query("field_merge", """SELECT candidate_id, CASE WHEN candidate_id % 3 = 0 THEN 'new name ' || candidate_id ELSE full_name END AS full_name, CASE WHEN candidate_id % 4 = 0 THEN 'new@example.com' END AS email,
      CASE WHEN candidate_id % 5 = 0 THEN 7.5 ELSE total_experience_years END AS total_experience_years FROM candidate UNION ALL SELECT 10000000, 'somebody else', NULL, 0.0""")
def field_merge(v):
    old = v.candidate.select("candidate_id", "full_name", F.lit(None).cast("string").alias("email"), "total_experience_years")
    k = F.col("candidate_id")
    new = v.candidate.select(
        k, F.when(k % 3 == 0, F.concat(F.lit("new name "), k)).otherwise("").alias("full_name"), F.when(k % 4 == 0, "NEW@Example.com").alias("email"), F.when(k % 5 == 0, 7.5).otherwise(0.0).alias("total_experience_years")
    )
    extra = v.spark.createDataFrame([(10_000_000, "somebody else", None, 0.0)], "candidate_id long, full_name string, email string, total_experience_years double")
    merged = profiles.merge_fields(old, new.unionByName(extra), "candidate_id")
    return merged.withColumn("total_experience_years", F.coalesce("total_experience_years", F.lit(0.0)))


@query("field_diff", "SELECT candidate_id, 'status' AS field, status AS \"from\", 'on_hold' AS \"to\" FROM candidate WHERE candidate_id % 3 = 0 AND status <> 'on_hold' UNION ALL SELECT candidate_id, 'city', city, NULL FROM candidate WHERE candidate_id % 7 = 0")
def field_diff(v):
    k = F.col("candidate_id")
    new = v.candidate.withColumn("status", F.when(k % 3 == 0, "on_hold").otherwise(F.col("status"))).withColumn("city", F.when(k % 7 != 0, F.col("city")))
    changes = profiles.field_diff(v.candidate, new, "candidate_id", ["status", "city", "full_name"])
    return changes.select("candidate_id", F.explode("changes").alias("field", "c")).select("candidate_id", "field", "c.from", "c.to")


COMPANY_KEY = "regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}+#]', '', 'g')"


@query("company_upsert", f"""WITH k AS (SELECT s_suppkey AS company_id, {COMPANY_KEY.format('s_name')} AS key, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0),
    n AS (SELECT {COMPANY_KEY.format('s_name')} AS key, min(s_name) AS name FROM supplier GROUP BY 1 HAVING key NOT IN (SELECT key FROM k))
    SELECT company_id, key, name, false AS created FROM k UNION ALL SELECT (SELECT max(company_id) FROM k) + row_number() OVER (ORDER BY key), key, name, true FROM n""")
def company_upsert(v):
    from hireloom.functions.text import normalize_key

    s = v.table("supplier")
    known = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("company_id"), normalize_key(F.col("s_name")).alias("key"), F.col("s_name").alias("name"))
    return profiles.get_or_create_companies(s.select(F.col("s_name").alias("name")), known)


@query("child_replace", "SELECT candidate_id, company_name FROM experience WHERE candidate_id % 4 <> 0 UNION ALL SELECT DISTINCT candidate_id, 'only one' FROM candidate WHERE candidate_id % 4 = 0")
def child_replace(v):
    parents = v.candidate.where("candidate_id % 4 = 0")
    fresh = v.candidate.select("candidate_id", F.lit("only one").alias("company_name"))
    return profiles.replace_children(v.experience.select("candidate_id", "company_name"), fresh, parents)


@query("skill_persistence", """WITH m AS (SELECT candidate_id, coalesce('skill:' || skill_id, 'raw:' || regexp_replace(lower(raw_text), '[^\\p{L}\\p{N}+#]', '', 'g')) AS key, raw_text, 'skills_section' AS source,
      confidence * CASE WHEN skill_id IS NULL THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence, years_experience AS years, mention_count AS mentions, 1 AS turn FROM candidate_skill),
    s AS (SELECT candidate_id, 'skill:' || skill_id, raw_text, 'experience', least(0.9::DOUBLE, 0.85::DOUBLE), NULL, 1, 2 FROM candidate_skill WHERE skill_id % 3 = 0),
    b AS (SELECT * FROM m UNION ALL SELECT * FROM s), few AS (SELECT candidate_id FROM b GROUP BY 1 HAVING count(DISTINCT key) < 5),
    w AS (SELECT candidate_id, 'skill:1', 'swept', 'semantic_inference', 0.7::DOUBLE, NULL, 1, 3 FROM alive WHERE candidate_id IN (SELECT candidate_id FROM few) OR candidate_id NOT IN (SELECT candidate_id FROM b)),
    a AS (SELECT * FROM b UNION ALL SELECT * FROM w)
    SELECT candidate_id, key, arg_min(raw_text, turn) AS raw_text, CASE WHEN bool_or(source = 'skills_section') THEN 'skills_section' ELSE arg_min(source, turn) END AS source, round(least(1, max(confidence)), 3) AS confidence,
      arg_min(years, turn) AS years, sum(mentions)::BIGINT AS mentions FROM a GROUP BY 1, 2""")
def skill_persistence(v):
    base = v.candidate_skill.select("candidate_id", "skill_id", "raw_text", "confidence", F.lit(None).cast("string").alias("evidence"), F.col("years_experience").alias("years"), F.col("mention_count").alias("mentions"), F.lit(0).alias("place"))
    mentions = base.withColumn("source", F.lit("skills_section"))
    scans = base.where("skill_id % 3 = 0").withColumns({"source": F.lit("experience"), "confidence": F.lit(1.0)})
    sweeps = v.alive.select("candidate_id", F.lit(1).cast("long").alias("skill_id"), F.lit("swept").alias("raw_text"), F.lit(None).cast("string").alias("evidence"), F.lit(0).alias("place"))
    return profiles.persist_skills(mentions, scans, sweeps).select("candidate_id", "key", "raw_text", "source", "confidence", "years", "mentions")


@query("status_machine", """SELECT o_orderkey AS resume_id, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'embedding' ELSE 'completed' END AS status,
      CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 3 ELSE 5 END::BIGINT AS steps FROM orders""")
def status_machine(v):
    """Steps of every resume: some failed at the third, some stand there, and some of the rest were started twice."""
    k = F.col("o_orderkey")
    names = lambda *x: F.array(*[F.lit(s) for s in x])
    first = F.when(k % 2 == 0, names("queued", "parsing", "failed")).otherwise(names())
    last = F.when(k % 7 == 0, names("queued", "parsing", "failed")).when(k % 3 == 0, names("queued", "parsing", "embedding")).otherwise(names(*profiles.STAGES))
    return profiles.latest_status(v.table("orders").select(k.alias("resume_id"), F.posexplode(F.concat(first, last)).alias("at", "status")))


@query("reprocess_latest", "SELECT candidate_id, arg_max(resume_id, (created_at, resume_id)) AS resume_id, 'queued' AS status FROM resume GROUP BY 1")
def reprocess_latest(v):
    return profiles.reprocess(v.resume)


@query("candidate_highlights", """SELECT candidate_id AS doc_id, 'Currently Data Engineer at ' || arg_min(company_name, (start_date, end_date, company_name)) AS now FROM experience JOIN alive USING (candidate_id) GROUP BY 1""")
def candidate_highlights(v):
    lines = profiles.highlights(parsed(v, *profiles.HIGHLIGHTED)).select("doc_id", F.explode_outer("highlights").alias("now"))
    return lines.where("now like 'Currently %'")


@query("file_name_fallback", "SELECT p_partkey, upper(s[1][1]) || lower(s[1][2:]) || ' ' || upper(s[2][1]) || lower(s[2][2:]) || ' Cv' AS name FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)")
def file_name_fallback(v):
    made = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("-2021_cv."), F.lit("pdf"))
    return v.table("part").select("p_partkey", profiles.name_from_file(made).alias("name"))


@query("candidate_cascade", "SELECT 'candidate' AS relation, count(*) AS n FROM candidate WHERE NOT is_deleted AND candidate_id % 10 <> 0 UNION ALL SELECT 'experience', count(*) FROM experience WHERE candidate_id % 10 <> 0 UNION ALL SELECT 'embedding', count(*) FROM embedding WHERE candidate_id % 10 <> 0")
def candidate_cascade(v):
    gone = v.candidate.where("candidate_id % 10 = 0").select("candidate_id")
    left = profiles.delete_candidates(gone, v.candidate, {"experience": v.experience, "embedding": v.embedding})
    left["candidate"] = left["candidate"].where("not is_deleted")
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in left.items()]
    return one[0].unionByName(one[1]).unionByName(one[2])
