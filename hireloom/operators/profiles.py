"""Candidate records: texts for embedding, identity, upserts, skills from several sources, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hireloom.functions.text import normalize_key, title_case
from hireloom.operators.components import connected
from hireloom.functions.vectors import whole_embedding
from hireloom.operators.documents import chunk_text
from hireloom.operators.extract import let

UNKNOWN = "Unknown Candidate"


def labelled(label: str, value: Column) -> Column:
    """`Label: value`, null where there is no value."""
    return F.concat(F.lit(f"{label}: "), F.nullif(value.cast("string"), F.lit("")))


def document(parts: dict[str, Column], last: Column | None = None) -> Column:
    """Labelled lines of what is known, in order."""
    lines = [labelled(k, c) for k, c in parts.items()]
    return F.concat_ws("\n", *lines, *([F.nullif(last, F.lit(""))] if last is not None else []))


def candidate_document(rows: DataFrame) -> Column:
    """The text that stands for a candidate; list columns are joined, repeats in titles, companies and skills dropped."""
    has = lambda c, default: F.col(c) if c in rows.columns else default
    no_list, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")
    once = lambda c: F.array_join(F.array_distinct(has(c, no_list)), ", ")
    return document(
        {
            "Candidate": F.coalesce("full_name", F.lit("Unknown")), "Headline": has("headline", no_text),
            "Experience": F.concat(F.col("total_experience_years").cast("string"), F.lit(" years")), "Roles": once("titles"), "Companies": once("companies"),
            "Skills": once("skills"), "Projects": F.array_join(has("projects", no_list), "; "), "Certifications": F.array_join(has("certifications", no_list), ", "),
            "Education": F.array_join(has("educations", no_list), ", "), "Summary": has("summary", no_text),
        }
    )


def requirement_document(title: Column, required: Column, preferred: Column, certifications: Column, years: Column, domain: Column, description: Column) -> Column:
    """The text that stands for a requirement; 0 years count as none."""
    return document(
        {
            "Role": title, "Required skills": F.array_join(required, ", "), "Preferred skills": F.array_join(preferred, ", "), "Certifications": F.array_join(certifications, ", "),
            "Minimum experience": F.when(years > 0, F.concat(years.cast("string"), F.lit(" years"))), "Domain": domain,
        }, description,
    )


def embedding_texts(profiles: DataFrame, projects: DataFrame, certifications: DataFrame) -> DataFrame:
    """(candidate_id, kind, chunk_index, text): a profile, all chunks of its resume, each project and each certification."""
    whole = profiles.select("candidate_id", F.lit("profile").alias("kind"), F.lit(0).alias("chunk_index"), F.col("document").alias("text"))
    pieces = profiles.select("candidate_id", F.posexplode(chunk_text(F.coalesce("raw_text", F.lit("")))).alias("chunk_index", "text"))
    pieces = pieces.select("candidate_id", F.lit("resume_chunk").alias("kind"), "chunk_index", "text")
    numbered = lambda df, kind: df.select(
        "candidate_id", F.lit(kind).alias("kind"), (F.row_number().over(W.partitionBy("candidate_id").orderBy("text")) - 1).alias("chunk_index"), "text"
    )
    return whole.unionByName(pieces).unionByName(numbered(projects, "project")).unionByName(numbered(certifications, "certification"))


def embed_rows(texts: DataFrame) -> DataFrame:
    """The rows with the vectors of their whole texts; a zero vector (a text without features) is left out."""
    made = texts.withColumn("vector", whole_embedding("text"))
    return made.where(F.exists("vector", lambda x: x != 0))


def skill_texts(skills: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(skill_id, text) of the taxonomy: name, category, stack and synonyms."""
    known = synonyms.groupBy("skill_id").agg(F.array_sort(F.collect_set("synonym")).alias("s"))
    joined = skills.join(known, "skill_id", "left")
    return joined.select("skill_id", document({"Skill": F.col("name"), "Category": F.col("category"), "Stack": F.col("technology_stack"), "Also": F.array_join("s", ", ")}).alias("text"))


def index_stats(vectors: DataFrame) -> DataFrame:
    """Rows, candidates and width of each kind of vector."""
    return vectors.groupBy("kind").agg(
        F.count("*").alias("vectors"), F.countDistinct("candidate_id").alias("candidates"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim")
    )


def phone_key(phone: Column) -> Column:
    """The last ten digits; null for fewer than eight."""
    digits = F.regexp_replace(phone, r"\D", "")
    last = F.substring(digits, -10, 10)
    return F.when(F.length(last) >= 8, last)


def _left(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left join on a key that many rows lack: those are dealt by their resume, or all of them would meet in one task."""
    # Rows without the key stand under a text of their own; the second test keeps that from ever matching.
    stand_in = F.coalesce(F.col(f"l.{key}").cast("string"), F.concat(F.lit("no key "), F.col("l.resume_id").cast("string")))
    joined = rows.alias("l").join(known.alias("r"), (stand_in == F.col(f"r.{key}").cast("string")) & F.col(f"l.{key}").isNotNull(), "left")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in known.columns if c != key])


def find_person(incoming: DataFrame, people: DataFrame) -> DataFrame:
    """(resume_id, candidate_id, found_by): by the resume's own link, else its e-mail, else its phone; the smallest id where several fit.

    What is found by none stays null and is a new person; `new_person_groups` ties those to each other.
    """
    known = people.where("not is_deleted")
    by = lambda key, name: known.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.min("candidate_id").alias(f"by_{name}"))
    rows = incoming.withColumns({"mail": F.lower(F.nullif(F.col("email"), F.lit(""))), "number": phone_key(F.col("phone"))})
    linked = people.select(F.col("candidate_id").alias("linked_id"), F.col("candidate_id").alias("by_link"))
    joined = _left(_left(_left(rows, linked, "linked_id"), by(F.lower("email"), "mail"), "mail"), by(phone_key(F.col("phone")), "number"), "number")
    how = F.when(F.col("by_link").isNotNull(), "link").when(F.col("by_mail").isNotNull(), "email").when(F.col("by_number").isNotNull(), "phone")
    return joined.select("resume_id", F.coalesce("by_link", "by_mail", "by_number").alias("candidate_id"), how.alias("found_by"), "mail", "number")


def new_person_groups(found: DataFrame) -> DataFrame:
    """(resume_id, person): the new persons of a batch, those tied by shared e-mails and phones as one, named by the smallest resume.

    Resumes of a mail or a phone are tied to the smallest one that has it; persons are the connected components, chains of any length included.
    """
    rows = found.where("candidate_id is null").select("resume_id", "mail", "number")
    keys = rows.select("resume_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("mail", "number")])).alias("key")).where("key.value is not null")
    first = keys.groupBy("key").agg(F.min("resume_id").alias("b"))
    tied = connected(keys.join(first, "key").select(F.col("resume_id").alias("a"), "b"))
    return rows.select("resume_id").join(tied, F.col("resume_id") == F.col("node"), "left").select("resume_id", F.coalesce("root", "resume_id").alias("person"))


def merge_fields(old: DataFrame, new: DataFrame, key: str, lowered: tuple[str, ...] = ("email",)) -> DataFrame:
    """Rows of both: a new value wins unless it is null, empty or 0."""
    fields = [c for c in old.columns if c != key]
    types = dict(old.dtypes)

    def given(c: str) -> Column:
        value = F.col(f"n.{c}")
        if types[c] == "string":
            return F.nullif(F.trim(F.lower(value) if c in lowered else value), F.lit(""))
        return F.nullif(value, F.lit(0).cast(types[c])) if types[c] in ("int", "bigint", "double", "float") else value

    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(given(c), F.col(f"o.{c}")).alias(c) for c in fields])


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changes): map from each changed field to struct(from, to), unchanged rows left out."""
    joined = old.alias("o").join(new.alias("n"), key)
    entry = lambda c: F.struct(F.col(f"o.{c}").cast("string").alias("from"), F.col(f"n.{c}").cast("string").alias("to"))
    both = F.create_map(*[x for c in fields for x in (F.lit(c), entry(c))])
    return joined.select(key, F.map_filter(both, lambda _, v: ~v["from"].eqNullSafe(v["to"])).alias("changes")).where("size(changes) > 0")


def get_or_create_companies(names: DataFrame, known: DataFrame) -> DataFrame:
    """(company_id, key, name, created) of all companies; a new key gets the next ids in order of key, named as first by text."""
    fresh = names.select("name", normalize_key(F.col("name")).alias("key")).where("key != ''").groupBy("key").agg(F.min("name").alias("name")).join(known, "key", "left_anti")
    top = known.agg(F.coalesce(F.max("company_id"), F.lit(0)).alias("top"))
    order = W.orderBy("key")  # companies that are new in a batch
    made = fresh.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(order)).alias("company_id"), "key", "name", F.lit(True).alias("created"))
    return known.select("company_id", "key", "name", F.lit(False).alias("created")).unionByName(made)


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The child table with the rows of some parents replaced by the fresh ones."""
    return children.join(parents.select(key), key, "left_anti").unionByName(fresh.join(parents.select(key), key, "left_semi"))


def persist_skills(mentions: DataFrame, scans: DataFrame, sweeps: DataFrame, enough: int = 5) -> DataFrame:
    """One row per candidate and skill from three sources.

    Mentions of skills outside the taxonomy count 0.7 of their confidence, section scans 0.85 and at most 0.9,
    and the sweep of the whole text (0.7) only where the first two found fewer than `enough`. Of one skill the
    first gives text, years and evidence; the skills section wins as its source. Rows come in order of `place`.
    """
    columns = ["candidate_id", "skill_id", "raw_text", "source", "confidence", "evidence", "years", "mentions", "turn", "place"]
    told = mentions.withColumns({"confidence": F.col("confidence") * F.when(F.col("skill_id").isNull(), 0.7).otherwise(1.0), "turn": F.lit(1)})
    seen = scans.withColumns({"confidence": F.least(F.lit(0.9), F.col("confidence") * 0.85), "years": F.lit(None).cast("double"), "mentions": F.lit(1).cast("long"), "turn": F.lit(2)})
    both = told.select(columns).unionByName(seen.select(columns))
    key = F.coalesce(F.concat(F.lit("skill:"), F.col("skill_id").cast("string")), F.concat(F.lit("raw:"), normalize_key(F.col("raw_text"))))
    few = both.groupBy("candidate_id").agg(F.countDistinct(key).alias("found")).where(F.col("found") >= enough)
    swept = sweeps.join(few, "candidate_id", "left_anti").withColumns(
        {"source": F.lit("semantic_inference"), "confidence": F.lit(0.7), "years": F.lit(None).cast("double"), "mentions": F.lit(1).cast("long"), "turn": F.lit(3)}
    )
    order = F.struct("turn", "place")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    grouped = both.unionByName(swept.select(columns)).groupBy("candidate_id", key.alias("key")).agg(
        first("skill_id").alias("skill_id"), F.min_by("raw_text", order).alias("raw_text"),
        F.when(F.bool_or(F.col("source") == "skills_section"), F.lit("skills_section")).otherwise(F.min_by("source", order)).alias("source"),
        F.round(F.least(F.lit(1.0), F.max("confidence")), 3).alias("confidence"), first("evidence").alias("evidence"), first("years").alias("years"), F.sum("mentions").alias("mentions"),
    )
    return grouped.withColumn("is_primary", F.col("source") == "skills_section")


#: Fields of a parsed record that its completeness, and its highlights, are read from.
CHECKED = (
    "full_name", "email", "phone", "location", "current_title", "current_company", "total_experience_years", "highest_degree", "skills", "experiences", "educations", "projects", "certifications",
)
HIGHLIGHTED = ("total_experience_years", "current_title", "current_company", "skills", "certifications", "projects", "highest_degree")


def record_completeness(parsed: DataFrame, column: str = "resume") -> DataFrame:
    """(doc_id, completeness): share of twelve checks that a parsed record meets, to 3 places."""
    def share(r: Column) -> Column:
        tests = [
            r["full_name"].isNotNull() & (r["full_name"] != UNKNOWN), r["email"].isNotNull(), r["phone"].isNotNull(), r["location"].isNotNull(), r["current_title"].isNotNull(),
            r["current_company"].isNotNull(), r["total_experience_years"] > 0, r["highest_degree"].isNotNull(), F.size(r["skills"]) >= 3, F.size(r["experiences"]) > 0,
            F.size(r["educations"]) > 0, (F.size(r["projects"]) > 0) | (F.size(r["certifications"]) > 0),
        ]
        met = sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))
        return F.round(met / len(tests), 3)

    record = F.struct(*[F.col(column)[f].alias(f) for f in CHECKED])
    return parsed.select("doc_id", let(record, share).alias("completeness"))


def highlights(parsed: DataFrame, column: str = "resume") -> DataFrame:
    """(doc_id, highlights): up to six lines on a parsed record."""
    some = lambda n, what: let(F.size(n), lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit(what))))

    def lines(r: Column) -> Column:
        primary = F.slice(F.transform(F.filter(r["skills"], lambda s: s["source"] == "skills_section"), lambda s: s["name"]), 1, 6)
        return F.array(
            F.when(r["total_experience_years"] > 0, F.concat(r["total_experience_years"].cast("string"), F.lit(" years of professional experience"))),
            F.concat(F.lit("Currently "), r["current_title"], F.lit(" at "), r["current_company"]),
            let(primary, lambda names: F.when(F.size(names) > 0, F.concat(F.lit("Core stack: "), F.array_join(names, ", ")))),
            some(r["certifications"], " certification(s)"), some(r["projects"], " documented project(s)"), F.concat(F.lit("Education: "), r["highest_degree"]),
        )

    # The fields are bound to a variable: named twice in a plan, each would be parsed twice.
    record = F.struct(*[F.col(column)[f].alias(f) for f in HIGHLIGHTED])
    return parsed.select("doc_id", let(record, lambda r: F.slice(F.array_compact(lines(r)), 1, 6)).alias("highlights"))


def name_from_file(name: Column) -> Column:
    """A person's name from a file name: no ending, no numbers, title case."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[_-]", " ")
    words = F.filter(F.split(stem, r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    return F.coalesce(F.nullif(F.substring(title_case(F.array_join(words, " ")), 1, 120), F.lit("")), F.lit(UNKNOWN))


#: The stages of processing a resume in order; `failed` ends it at any of them.
STAGES = ["queued", "parsing", "embedding", "graph_sync", "completed"]


def latest_status(steps: DataFrame) -> DataFrame:
    """(resume_id, status, steps) of (resume_id, status, at): failed if the last step failed, else the furthest stage since the last restart."""
    order = W.partitionBy("resume_id").orderBy("at")
    runs = steps.withColumn("run", F.sum(F.when(F.col("status") == "queued", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = runs.groupBy("resume_id").agg(F.max("run").alias("run"))
    stage = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("status"))
    final = runs.join(last, ["resume_id", "run"]).groupBy("resume_id").agg(F.max_by("status", "at").alias("now"), F.max(stage).alias("furthest"), F.count("*").alias("steps"))
    names = F.array(*[F.lit(s) for s in STAGES])
    return final.select("resume_id", F.when(F.col("now") == "failed", "failed").otherwise(F.try_element_at(names, F.col("furthest").cast("int"))).alias("status"), "steps")


def reprocess(resumes: DataFrame) -> DataFrame:
    """The latest resume of each candidate, put back to `queued`."""
    newest = resumes.groupBy("candidate_id").agg(F.max_by("resume_id", F.struct("created_at", "resume_id")).alias("resume_id"))
    return newest.select("candidate_id", "resume_id", F.lit("queued").alias("status"))


def delete_candidates(gone: DataFrame, candidates: DataFrame, children: dict[str, DataFrame], hard: bool = False) -> dict[str, DataFrame]:
    """Candidates flagged (or removed) with their child tables and vectors; edges are in `graph.delete_node`."""
    out = {name: df.join(gone, "candidate_id", "left_anti") for name, df in children.items()}
    if hard:
        return out | {"candidate": candidates.join(gone, "candidate_id", "left_anti")}
    flagged = candidates.join(gone.select("candidate_id", F.lit(True).alias("__gone")), "candidate_id", "left")
    return out | {"candidate": flagged.withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")}
