"""The skills CSV: checks, header aliases, import and export."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireloom.functions.text import normalize_key, slugify, split_list

MAX_BYTES = 2 << 20
COLUMNS = [
    "skill_id", "skill_name", "category", "parent_skill", "related_skills", "technology_stack", "job_role", "experience_level", "skill_synonyms", "skill_description",
]
#: Header names of each column; the first that a file has counts.
ALIASES = {
    "skill_id": ["skill_id", "skillid", "id", "code"],
    "skill_name": ["skill_name", "skillname", "name", "skill"],
    "category": ["category", "skill_category", "categoryname", "category_name"],
    "parent_skill": ["parent_skill", "parentskill", "parent"],
    "related_skills": ["related_skills", "relatedskills", "related"],
    "technology_stack": ["technology_stack", "technologystack", "tech_stack", "stack"],
    "job_role": ["job_role", "jobrole", "job_roles", "roles", "role"],
    "experience_level": ["experience_level", "experiencelevel", "level"],
    "skill_synonyms": ["skill_synonyms", "synonyms", "skillsynonyms", "aliases", "alias"],
    "skill_description": ["skill_description", "description", "skilldescription", "definition"],
}
#: One of these must be there.
NAME_HEADERS = ["skill_name", "skillname"]
LISTS = ["related_skills", "job_role", "skill_synonyms"]

SAMPLE_COLUMNS = "`Skill-Name` string, Category string, parent string, related string, synonyms string"
SAMPLE = [("Python", "programming", None, "Django;Flask", "py | python3"), ("Django", "web framework", "Python", "", "")]


def check_files(spark: SparkSession, path: str) -> DataFrame:
    """Files and why each is refused (null: it isn't): size, signature, NUL bytes, markup."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    head = F.hex(F.substring("content", 1, 4))
    text = F.col("content").cast("string")
    lead = F.ltrim(F.substring(text, 1, 200))
    why = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too large")
        .when(head.startswith("504B0304"), "zip archive").when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0"), "office document")
        .when(F.hex("content").rlike("^(..)*00"), "binary").when(lead.rlike("^[<{\\[]"), "markup or json")
    )
    return files.select("path", "length", why.alias("refused"))


def sniff(line: str) -> str:
    return max(",;\t", key=line.count)


def header_name(name: str) -> str:
    return name.replace("\ufeff", "").strip().lower().replace(" ", "_").replace("-", "_")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def cells(contents: pd.Series) -> pd.Series:
    """Rows of a file's cells, the header first with its names in plain form; empty lines and sep= lines before it don't count."""

    def one(content: bytes) -> list[list[str]]:
        lines = bytes(content).decode("utf-8-sig").splitlines(keepends=True)
        at = next((i for i, x in enumerate(lines) if x.strip() and not x.strip().lower().startswith("sep=")), len(lines))
        rows = list(csv.reader(io.StringIO("".join(lines[at:])), delimiter=sniff(lines[at]) if at < len(lines) else ","))
        return [[header_name(c) for c in rows[0]], *[r for r in rows[1:] if r]] if rows else []

    return contents.map(one)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The canonical columns of skills CSV files, each with a header and a delimiter of its own.

    Raises ValueError for files that `check_files` refuses (none is over 2 MB) or that lack a name column.
    """
    files = check_files(spark, path)
    if files.isEmpty():  # files of no bytes aren't listed
        raise ValueError("no skills CSV with content")
    refused = [f"{r['path']}: {r['refused']}" for r in files.where("refused is not null").limit(10).collect()]
    if refused:
        raise ValueError("; ".join(refused))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    table = content.select("path", cells("content").alias("rows")).where("size(rows) > 0")
    heads = [r["h"] for r in table.select(F.col("rows")[0].alias("h")).distinct().collect()]  # one per kind of file
    for head in heads:
        if not set(NAME_HEADERS) & set(head):
            raise ValueError("a skills CSV needs a skill_name column")
    head = F.col("rows")[0]
    rows = table.select(head.alias("head"), F.explode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))).alias("row")).where("size(row) > 0")
    first = lambda c: F.get(F.filter(F.array(*[F.lit(a) for a in ALIASES[c]]), lambda a: F.array_contains("head", a)), F.lit(0))
    return parse_rows(rows.select(*[F.get("row", (F.array_position("head", first(c)) - 1).cast("int")).alias(c) for c in COLUMNS]))


def parse_rows(raw: DataFrame) -> DataFrame:
    """Alias headers, trim cells, split lists, title-case categories; rows without a name go."""
    plain = {header_name(c): c for c in raw.columns}
    found = {k: next((plain[a] for a in names if a in plain), None) for k, names in ALIASES.items()}
    if not set(NAME_HEADERS) & set(plain):
        raise ValueError("a skills CSV needs a skill_name column")
    cell = lambda k: F.nullif(F.trim(F.col(f"`{found[k]}`")), F.lit("")) if found[k] else F.lit(None).cast("string")
    out = raw.select(*[split_list(cell(k)).alias(k) if k in LISTS else cell(k).alias(k) for k in COLUMNS])
    return out.where("skill_name is not null").withColumn("category", F.initcap("category")).withColumn("experience_level", F.lower("experience_level"))


def import_skills(rows: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """Two-pass upsert against known (key, skill_id) skills; importing twice creates nothing."""
    keyed = rows.withColumn("key", normalize_key(F.col("skill_name"))).dropDuplicates(["key"])
    created, updated = keyed.join(known, "key", "left_anti"), keyed.join(known, "key")
    keys = keyed.select("key").unionByName(known.select("key")).distinct()
    pairs = lambda column, kind: keyed.select("key", F.explode(column).alias("name")).select("key", normalize_key(F.col("name")).alias("other"), "name", F.lit(kind).alias("kind"))
    related = pairs("related_skills", "related").join(keys.withColumnRenamed("key", "other"), "other", "left_semi").where("key != other").distinct()
    parents = keyed.where("parent_skill is not null").select("key", normalize_key(F.col("parent_skill")).alias("other"), F.col("parent_skill").alias("name"), F.lit("parent").alias("kind"))
    roles = keyed.select("key", F.explode("job_role").alias("role")).distinct()
    return {
        "created": created, "updated": updated, "synonyms": pairs("skill_synonyms", "synonym").dropDuplicates(["key", "other"]), "related": related,
        "parents": parents.join(keys.withColumnRenamed("key", "other"), "other", "left_semi"), "slugs": unique_slugs(created),
        "categories": keyed.where("category is not null").select("category").distinct(), "roles": roles,
    }


def import_report(rows: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row of counts of an import."""
    counts = {
        "rows_read": rows, "skills_created": parts["created"], "skills_updated": parts["updated"], "categories": parts["categories"], "synonyms": parts["synonyms"],
        "relations": parts["related"], "job_roles": parts["roles"].select("role").distinct(), "parents_linked": parts["parents"],
    }
    one = [df.agg(F.count("*").alias(name)) for name, df in counts.items()]
    out = one[0]
    for more in one[1:]:
        out = out.crossJoin(more)  # one row each
    return out


def unique_slugs(skills: DataFrame) -> DataFrame:
    """A slug per skill in order of name: of equal slugs the later ones end in their key with + and # spelt out, or in a number."""
    from pyspark.sql import Window as W

    spelt = F.replace(F.replace(normalize_key(F.col("skill_name")), F.lit("+"), F.lit("plus")), F.lit("#"), F.lit("sharp"))
    slugs = skills.select("key", "skill_name", slugify(F.col("skill_name")).alias("base"), spelt.alias("spelt"))
    n = F.row_number().over(W.partitionBy("base").orderBy("skill_name"))
    longer = F.when(F.col("spelt") != F.col("base"), slugify(F.concat_ws("-", "base", "spelt")))
    tried = slugs.withColumn("n", n).withColumn("slug", F.when(F.col("n") == 1, F.col("base")).otherwise(F.coalesce(longer, F.concat_ws("-", "base", "n"))))
    again = F.row_number().over(W.partitionBy("slug").orderBy("n", "skill_name"))
    return tried.withColumn("again", again).select("key", F.when(F.col("again") == 1, F.col("slug")).otherwise(F.concat_ws("-", "base", "n")).alias("slug"))


def write(skills: DataFrame, path: str) -> None:
    """The canonical columns in one file with a byte order mark, lists joined by ; without repeats (in any case), by id (none last) and name."""

    def joined(c: str):
        low = F.transform(c, lambda x: F.lower(x))
        return F.array_join(F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), ";").alias(c)

    quoted = lambda c: F.when(F.col(c).rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    rows = skills.select(*[joined(c) if c in LISTS else F.col(c).cast("string").alias(c) for c in COLUMNS])
    line = rows.select(F.concat_ws(",", *[quoted(c) for c in COLUMNS]).alias("value"), F.lit(1).alias("part"), "skill_id", F.lower("skill_name").alias("name"))
    head = skills.sparkSession.createDataFrame([("\ufeff" + ",".join(COLUMNS), 0, None, None)], "value string, part int, skill_id string, name string")
    ordered = head.unionByName(line).coalesce(1).sortWithinPartitions("part", F.asc_nulls_last("skill_id"), "name")  # a taxonomy, of some thousand rows
    ordered.select("value").write.mode("overwrite").option("compression", "none").format("text").save(path)
    _name_parts(skills.sparkSession, path)


def _name_parts(spark: SparkSession, path: str) -> None:
    """Text parts get the ending .csv."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".csv"))
