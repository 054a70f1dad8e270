"""Text and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hireloom.functions import dates, text
from hireloom.operators import documents, extract
from hireloom.plans.registry import query
from hireloom.sources import skills_csv

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
TOKENS = "list_filter(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9+#.]+'), lambda t: trim(t, '.')), lambda t: length(t) >= 2 AND t NOT IN " + STOP_SQL + ")"


def _docs(v):
    return v.table("documents").select("doc_id", "text")


@query("checksum_dedup", "SELECT doc_id, sha256(coalesce(text, '')) AS checksum, nullif(min(doc_id) OVER (PARTITION BY coalesce(text, '')), doc_id) AS duplicate_of FROM documents")
def checksum_dedup(v):
    return documents.checksum_duplicates(_docs(v))


EMAIL_SQL = "[A-Za-z0-9_!#$%&''*+/=?^`{|}~.-]+@[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+"


@query("identity_resolution", f"""WITH f AS (SELECT doc_id, lower(nullif(regexp_extract(text, '{EMAIL_SQL}'), '')) AS email FROM documents)
    SELECT doc_id, email, CASE WHEN email IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY email) END AS person_id FROM f""")
def identity_resolution(v):
    email = F.regexp_extract("text", f"({text.EMAIL})", 1)
    return documents.resolve_identity(_docs(v), F.when(email != "", email))


FORMS = ["%b %Y", "%m/%Y", "%Y-%m", "%Y"]


@query("partial_date_parse", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN make_date(year(o_orderdate), 1, 1) ELSE date_trunc('month', o_orderdate)::DATE END AS parsed,
      CASE WHEN o_orderkey % 4 = 3 THEN make_date(year(o_orderdate), 12, 31) ELSE last_day(o_orderdate)::DATE END AS parsed_end FROM orders""")
def partial_date_parse(v):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format(d, "MMM yyyy")).when(k == 1, F.date_format(d, "MM/yyyy")).when(k == 2, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "yyyy"))
    rows = v.table("orders").select("o_orderkey", shown.alias("shown"))
    return rows.select("o_orderkey", dates.parse_partial_date(F.col("shown")).alias("parsed"), dates.parse_partial_date(F.col("shown"), True).alias("parsed_end"))


@query("truncate", """SELECT doc_id, CASE WHEN length(text) > 200 THEN rtrim(regexp_replace(text[:199], ' [^ ]*$', '')) || '…' ELSE text END AS short FROM documents""")
def truncate(v):
    return _docs(v).select("doc_id", text.truncate(F.col("text"), 200).alias("short"))


@query("slugify", """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9\\s_-]', '-', 'g'), '[\\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '-'), ''), 'item') AS slug FROM part""")
def slugify(v):
    return v.table("part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" & "), "p_brand")).alias("slug"))


@query("title_case", """SELECT p_partkey, upper(s[1][1]) || s[1][2:] || ' of McDonald on the R&D Or IPhone ' || upper(s[2][1]) || s[2][2:] || ' AWS3 KUBERNETES' AS title FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)""")
def title_case(v):
    parts = F.split("p_name", " ")
    return v.table("part").select("p_partkey", text.title_case(F.concat(parts[0], F.lit(" Of McDonald on The R&D or iPhone "), parts[1], F.lit(" AWS3 KUBERNETES"))).alias("title"))


@query("clean_text")
def clean_text(v):
    cleaned = _docs(v).select("doc_id", text.clean_text("text").alias("clean"))
    return cleaned.select("doc_id", F.length("clean").alias("chars"), F.sha2("clean", 256).alias("digest"))


@query("normalize_key", "SELECT p_partkey, regexp_replace(replace(lower(trim(p_name || ' & C++')), '&', 'and'), '[^\\p{L}\\p{N}+#]', '', 'g') AS key FROM part")
def normalize_key(v):
    return v.table("part").select("p_partkey", text.normalize_key(F.concat("p_name", F.lit(" & C++"))).alias("key"))


@query("normalize_key_unicode")
def normalize_key_unicode(v):
    return _docs(v).select("doc_id", text.normalize_key_unicode("text").alias("key")).select("doc_id", F.length("key").alias("chars"), F.sha2("key", 256).alias("digest"))


@query("tokenize_counts", f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 200")
def tokenize_counts(v):
    words = _docs(v).select(F.explode(text.tokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(200)


@query("ngram_counts", f"""WITH t AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark)
    SELECT gram, count(*) AS n FROM (SELECT unnest(t) AS gram FROM t UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t) GROUP BY 1""")
def ngram_counts(v):
    grams = v.table("benchmark").select(F.explode(text.ngrams(text.tokenize(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("tokenize_all_counts", f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY 1")
def tokenize_all_counts(v):
    """Every token of the documents; `tokenize_counts` has the 200 most frequent."""
    words = _docs(v).select(F.explode(text.tokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


@query("ngram_document_counts")
def ngram_document_counts(v):
    """Tokens and pairs of whole documents; `ngram_counts` has those of the benchmark."""
    # A column of its own, or every pair would split its document anew.
    tokens = _docs(v).select(text.tokenize(F.col("text")).alias("t"))
    grams = tokens.select(F.explode(text.ngrams(F.col("t"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("chunk_text")
def chunk_text(v):
    pieces = documents.chunks(_docs(v))
    return pieces.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("digest"))


@query("extract_contacts", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}'))), ';') AS emails FROM documents WHERE regexp_matches(text, '{EMAIL_SQL}')""")
def extract_contacts(v):
    found = _docs(v).select("doc_id", F.array_join(F.array_sort(text.emails(F.col("text"))), ";").alias("emails"))
    return found.where("emails != ''")


@query("extract_links", """SELECT page_id, len(u) AS links, array_to_string(list_sort(u), ';') AS urls FROM (
      SELECT page_id, list_distinct(list_transform(regexp_extract_all(page, '(?i)(https?://[^\\s,;)\\]"''<>]+|www\\.[^\\s,;)\\]"''<>]+)'), lambda x: CASE WHEN starts_with(lower(x), 'www.') THEN 'https://' || rtrim(x, '.,;') ELSE rtrim(x, '.,;') END)) AS u
      FROM (SELECT page_id, html || ' Read www.a.org/b' || page_id || '... and https://a.b/c. ' AS page FROM pages))""")
def extract_links(v):
    found = v.table("pages").select("page_id", text.urls(F.concat("html", F.lit(" Read www.a.org/b"), "page_id", F.lit("... and https://a.b/c. "))).alias("u"))
    return found.select("page_id", F.size("u").alias("links"), F.array_join(F.array_sort("u"), ";").alias("urls"))


@query("text_quality", """SELECT doc_id, (n + CASE WHEN contains(text, '@') THEN 80 ELSE 0 END + CASE WHEN contains(l, 'linkedin') OR contains(l, 'github') THEN 20 ELSE 0 END
      + CASE WHEN regexp_matches(l, 'experience|education|skills') THEN 30 ELSE 0 END)::BIGINT AS quality, greatest(1, round_even(n / 500, 0))::INT AS pages
    FROM (SELECT doc_id, text, lower(text) AS l, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS n FROM documents)""")
def text_quality(v):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return _docs(v).select("doc_id", text.quality_score(F.col("text")).alias("quality"), text.page_estimate(words).alias("pages"))


@query("keyword_score", f"""WITH q AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS t FROM benchmark), d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)
    SELECT item_id, doc_id, round(len(list_filter(q.t, lambda x: list_contains(d.t, x))) / len(q.t), 4) AS score FROM q, d WHERE len(list_filter(q.t, lambda x: list_contains(d.t, x))) > 0""")
def keyword_score(v):
    asked = v.table("benchmark").select("item_id", F.array_distinct(text.tokenize(F.col("text"))).alias("q"))
    # Only documents that share a token are scored: an inverted-index join, not all pairs.
    terms = asked.select("item_id", "q")
    hits = _docs(v).select("doc_id", F.explode(F.array_distinct(text.tokenize(F.col("text")))).alias("t"))
    own = F.broadcast(terms.select("item_id", F.size("q").alias("n"), F.explode("q").alias("t")))
    found = hits.join(own, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("found"), F.max("n").alias("n"))
    return found.select("item_id", "doc_id", F.round(F.col("found") / F.col("n"), 4).alias("score"))


PROF = " ".join(f"WHEN regexp_matches(w, '{'|'.join(words)}') THEN '{level}'" for level, words in text.PROFICIENCY)


@query("proficiency", f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 13 >= 8 THEN 'expert' WHEN doc_id % 13 >= 4 THEN 'advanced' WHEN doc_id % 13 >= 2 THEN 'intermediate' ELSE 'beginner' END
      ELSE CASE WHEN p = 0 THEN 'intermediate' {PROF} ELSE 'intermediate' END END AS level
    FROM (SELECT doc_id, p, substring(l, greatest(p - 90, 1), 3 + 40 + least(p - 1, 90)) AS w FROM (SELECT doc_id, lower(text) AS l, instr(lower(text), 'lea') AS p FROM documents))""")
def proficiency(v):
    years = F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 13).cast("double"))
    return _docs(v).select("doc_id", text.proficiency(F.lit("lea"), F.col("text"), years).alias("level"))


HEAD = "['SKILLS', 'Work Experience', 'Education:', 'Projects', 'Languages'][(doc_id % 5 + 1)::INT]"
SECT = "CASE lower(line) WHEN 'skills' THEN 'skills' WHEN 'work experience' THEN 'experience' WHEN 'education:' THEN 'education' WHEN 'projects' THEN 'projects' WHEN 'languages' THEN 'languages' END"


@query("section_segmentation", f"""WITH t AS (SELECT doc_id, 'intro line.' || chr(10) || {HEAD} || chr(10) || 'first entry.' || chr(10) || 'second entry.' || chr(10) || 'Languages' || chr(10) || 'English.' AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
    s AS (SELECT *, {SECT} AS opens FROM l), p AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'header') AS section FROM s)
    SELECT doc_id, section, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM p WHERE opens IS NULL GROUP BY 1, 2""")
def section_segmentation(v):
    heads = F.element_at(F.array(*[F.lit(h) for h in ("SKILLS", "Work Experience", "Education:", "Projects", "Languages")]), (F.col("doc_id") % 5 + 1).cast("int"))
    made = F.concat_ws("\n", F.lit("intro line."), heads, F.lit("first entry."), F.lit("second entry."), F.lit("Languages"), F.lit("English."))
    return documents.segment_sections(_docs(v).select("doc_id", made.alias("text")))


@query("parse_resumes")
def parse_resumes(v):
    """Made-up resumes, one per customer, through the whole parser."""
    fields = ("full_name", "email", "total_experience_years", "highest_degree", "experiences", "certifications", "languages")
    parsed = extract.parse_resumes(extract.sample_resumes(v), fields=fields)
    r = F.col("resume")
    return parsed.select(
        "doc_id", r["full_name"].alias("full_name"), r["email"].alias("email"), r["total_experience_years"].alias("years"), r["highest_degree"].alias("degree"),
        F.size(r["experiences"]).alias("experiences"), F.size(r["certifications"]).alias("certifications"), F.array_join(r["languages"], ";").alias("languages"),
    )


@query("skills_csv_parse")
def skills_csv_parse(v):
    return skills_csv.parse_rows(v.spark.createDataFrame(skills_csv.SAMPLE, skills_csv.SAMPLE_COLUMNS))
