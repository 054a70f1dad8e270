"""Resolving phrases against the skill taxonomy, scanning texts, expanding skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hireloom.functions.text import ngrams, normalize_key, similarity, tokenize
from hireloom.operators.entities import symmetric

PARENT, CHILD, RELATED = 0.75, 0.7, 0.6


def resolve(phrases: DataFrame, skills: DataFrame, synonyms: DataFrame, fuzzy: bool = True, least: float = 0.9) -> DataFrame:
    """(phrase, skill_id, match_type, confidence) of each distinct phrase.

    An equal key is exact (1.0), then a synonym's key (0.95), then the most
    similar key of 4 letters or more, at most 4 longer or shorter, with 0.9 x
    its similarity. Only what the first two leave over is compared fuzzily.
    """
    asked = phrases.select("phrase").distinct().withColumn("key", normalize_key(F.col("phrase")))
    by_key = skills.select(normalize_key(F.col("name")).alias("key"), F.col("skill_id").alias("by_key")).groupBy("key").agg(F.max("by_key").alias("by_key"))
    by_synonym = synonyms.select(normalize_key(F.col("synonym")).alias("key"), F.col("skill_id").alias("by_synonym")).groupBy("key").agg(F.min("by_synonym").alias("by_synonym"))
    found = asked.join(F.broadcast(by_key), "key", "left").join(F.broadcast(by_synonym), "key", "left")
    sure = found.where("by_key is not null or by_synonym is not null").select(
        "phrase", F.coalesce("by_key", "by_synonym").alias("skill_id"), F.when(F.col("by_key").isNotNull(), "exact").otherwise("synonym").alias("match_type"),
        F.when(F.col("by_key").isNotNull(), 1.0).otherwise(0.95).alias("confidence"),
    )
    rest = found.where("by_key is null and by_synonym is null").select("phrase", "key")
    if not fuzzy:
        return sure.unionByName(rest.select("phrase", F.lit(None).cast("long").alias("skill_id"), F.lit("none").alias("match_type"), F.lit(0.0).alias("confidence")))
    # Keys of 4 letters or more that are 0.9 alike share three letters in a row, so only such pairs are compared.
    threes = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3)))
    names = by_key.where(F.length("key") >= 4).select(F.col("key").alias("other"), F.col("by_key").alias("skill_id"), F.explode(threes("key")).alias("three"))
    asked = rest.where(F.length("key") >= 4).select("phrase", "key", F.explode(threes("key")).alias("three"))
    near = asked.join(names, "three").where(F.abs(F.length("key") - F.length("other")) <= 4).select("phrase", "key", "other", "skill_id").distinct()
    scored = near.withColumn("s", similarity("key", "other")).where(F.col("s") >= least)
    best = scored.withColumn("n", F.row_number().over(W.partitionBy("phrase").orderBy(F.desc("s"), "skill_id"))).where("n = 1")
    close = best.select("phrase", "skill_id", F.lit("fuzzy").alias("match_type"), F.round(F.col("s") * 0.9, 3).alias("confidence"))
    none = rest.join(close, "phrase", "left_anti").select("phrase", F.lit(None).cast("long").alias("skill_id"), F.lit("none").alias("match_type"), F.lit(0.0).alias("confidence"))
    return sure.unionByName(close).unionByName(none)


EXACT, SYNONYM = 1.0, 0.95
#: Short keys that ordinary words have too.
AMBIGUOUS = ["go", "r", "c", "d", "ms", "ai", "ml", "dl", "cv", "sa", "ag", "bv"]
#: White space between the words of a line.
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def term_keys(skills: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(gram_key, skill_id, name, confidence) of all names and synonyms: of equal names the last skill's counts, a name before a synonym, of equal synonyms the first skill's."""
    one = lambda df, term, best, sure: df.groupBy(normalize_key(F.col(term)).alias("gram_key")).agg(best(F.struct("skill_id", "name")).alias("s")).select(
        "gram_key", "s.skill_id", "s.name", F.lit(sure).alias("confidence")
    )
    names = one(skills, "name", F.max, EXACT)
    if synonyms is None:
        return names
    others = one(synonyms.join(skills.select("skill_id", "name"), "skill_id"), "synonym", F.min, SYNONYM)
    return names.unionByName(others.join(names, "gram_key", "left_anti"))


def scan_text(docs: DataFrame, skills: DataFrame, most: int = 4, key: str = "doc_id", synonyms: DataFrame | None = None) -> DataFrame:
    """Skills named in texts by runs of 1..most tokens of a line: (key, skill_id, match_type, confidence, matched_text, line_no, mentions, evidence).

    Names count 1.0, `synonyms` (skill_id, synonym) 0.95. An ambiguous key counts only where the skill's name itself is a
    word of the line. Of several hits of a skill the surest gives text and evidence, then the first line, the shortest run, the first place.
    """
    known = term_keys(skills, synonyms)
    doubtful = F.col("gram_key").isin(AMBIGUOUS)
    bare = lambda c: F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(" "), F.lit(""))
    # At most one name for each ambiguous key: they come with the lines, so that runs need not carry their lines.
    unsure = known.where(doubtful).agg(F.collect_set("name").alias("unsure"))
    lines = docs.crossJoin(F.broadcast(unsure)).select(key, "unsure", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    cut = lines.select(key, "unsure", "line_no", "line", tokenize(F.col("line"), stopwords=False).alias("tokens"))
    # Tokens have two characters or more besides dots, so only a run of one can have an ambiguous key.
    asked = (F.size("unsure") > 0) & F.exists("tokens", lambda t: bare(t).isin(AMBIGUOUS))
    told = F.when(asked, F.array_intersect(F.split("line", SPACE), F.col("unsure")))
    runs = cut.select(key, "line_no", F.substring("line", 1, 140).alias("evidence"), "tokens", told.alias("told"))
    runs = runs.select(key, "line_no", "evidence", "told", F.posexplode(ngrams(F.col("tokens"), most)).alias("place", "matched_text"))
    # Tokens are lower-case ASCII: of what a key leaves out they have only dots, and a run the spaces between.
    hits = runs.withColumn("gram_key", bare("matched_text")).join(F.broadcast(known), "gram_key").where(~doubtful | F.array_contains("told", F.col("name")))
    first = F.min(F.struct((-F.col("confidence")).alias("doubt"), "line_no", "place", "matched_text", "evidence"))
    found = hits.groupBy(key, "skill_id").agg(first.alias("first"), F.count("*").alias("mentions"))
    how = F.when(F.col("first.doubt") == -EXACT, "exact").otherwise("synonym")
    return found.select(key, "skill_id", how.alias("match_type"), (-F.col("first.doubt")).alias("confidence"), "first.matched_text", "first.line_no", "mentions", "first.evidence")


def scan_terms(docs: DataFrame, terms: DataFrame, most: int = 4, key: str = "doc_id") -> DataFrame:
    """Terms named in whole texts by runs of 1..most tokens of a line: (key, term_id, confidence, line_no, mentions, evidence).

    `terms` (term_id, name, confidence): names count 1.0, synonyms less; of several hits of a term the surest, then
    the first line gives its evidence.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    keyed = lines.select(key, "line_no", "line", F.transform(tokenize(F.col("line"), stopwords=False), normalize_key).alias("keys"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("keys") - n + 1), lambda i: F.array_join(F.slice("keys", i, n), ""))
    grams = F.flatten(F.array(*[F.when(F.size("keys") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]))
    known = terms.select(normalize_key(F.col("name")).alias("gram"), "term_id", "confidence").groupBy("gram", "term_id").agg(F.max("confidence").alias("confidence"))
    hits = keyed.select(key, "line_no", "line", F.explode(grams).alias("gram")).join(known, "gram")
    first = F.struct(-F.col("confidence"), "line_no")
    return hits.groupBy(key, "term_id").agg(
        F.max("confidence").alias("confidence"), F.min_by("line_no", first).alias("line_no"), F.count("*").alias("mentions"), F.min_by(F.substring("line", 1, 140), first).alias("evidence")
    )


def expand_one(skills: DataFrame, relation: DataFrame) -> DataFrame:
    """One step from every skill: (skill_id, other, weight, kind), parents, then children, then related."""
    parents = skills.where("parent_skill_id is not null")
    up = parents.select("skill_id", F.col("parent_skill_id").alias("other"), F.lit(PARENT).alias("weight"), F.lit(0).alias("kind"))
    down = parents.select(F.col("parent_skill_id").alias("skill_id"), F.col("skill_id").alias("other"), F.lit(CHILD).alias("weight"), F.lit(1).alias("kind"))
    side = symmetric(relation).select("skill_id", "other", F.lit(RELATED).alias("weight"), F.lit(2).alias("kind"))
    return up.unionByName(down).unionByName(side)


def expand_kinds(skills: DataFrame, relation: DataFrame, depth: int, seeds: DataFrame | None = None) -> DataFrame:
    """(skill_id, other, depth, weight, kind) of `seeds` (skill_id), or of all skills: first visit breadth first, weights multiplied.

    A skill's neighbours are visited parent, children by id, related by id; a
    skill that several reach at one level counts for the one visited first.
    `kind` is that of the last step, as in `expand_one`.
    """
    hops = expand_one(skills, relation).withColumnRenamed("weight", "hop")
    order = W.partitionBy("seed", "node").orderBy("rank", "kind")
    start = skills if seeds is None else seeds
    level = start.select(F.col("skill_id").alias("seed"), F.col("skill_id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("weight"), F.lit(0).alias("rank"), F.lit(-1).alias("kind"))
    seen = level
    for d in range(1, depth + 1):
        step = level.drop("kind").join(hops, F.col("node") == F.col("skill_id")).select(
            "seed", F.col("other").alias("node"), F.lit(d).alias("depth"), F.round(F.col("weight") * F.col("hop"), 4).alias("weight"), "rank", "kind"
        )
        first = step.withColumn("n", F.row_number().over(order)).where("n = 1").join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy("rank", "kind", "node")))
        level = ranked.select("seed", "node", "depth", "weight", "rank", "kind")
        seen = seen.unionByName(level)
    return seen.where("depth > 0").select(F.col("seed").alias("skill_id"), F.col("node").alias("other"), "depth", "weight", "kind")


def expand(skills: DataFrame, relation: DataFrame, depth: int) -> DataFrame:
    """`expand_kinds` of all skills without the kinds."""
    return expand_kinds(skills, relation, depth).drop("kind")


def suggest(prefix: str, skills: DataFrame, candidates: DataFrame, experience: DataFrame, n: int = 5) -> DataFrame:
    """Completions of a prefix of 2 letters or more among skills, companies and people."""
    p = prefix.strip().lower()
    pick = lambda df, kind, column, test: df.select(F.lit(kind).alias("kind"), F.col(column).alias("value")).where(test(F.lower("value"))).distinct().orderBy("value").limit(n)
    out = pick(skills, "skill", "name", lambda c: c.startswith(p))
    out = out.unionByName(pick(experience, "company", "company_name", lambda c: c.contains(p)))
    out = out.unionByName(pick(candidates, "candidate", "full_name", lambda c: c.contains(p)))
    return out if len(p) >= 2 else out.limit(0)
