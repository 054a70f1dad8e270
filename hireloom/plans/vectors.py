"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hireloom.functions import vectors as fn
from hireloom.operators import vector_search
from hireloom.plans.registry import query

LEN = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (" + LEN.format("{0}") + " * " + LEN.format("{1}") + ")"
COS = COS.replace("{0}", "{a}").replace("{1}", "{b}")
QV = "(SELECT vector FROM embedding WHERE embedding_id = 0)"


def first_vector(v) -> list[float]:
    return [float(x) for x in v.embedding.where("embedding_id = 0").first()["vector"]]


@query("l2_norm", f"SELECT embedding_id, round({LEN.format('vector')}, 5) AS norm FROM embedding")
def l2_norm(v):
    return v.embedding.select("embedding_id", F.round(fn.norm(F.col("vector")), 5).alias("norm"))


@query("cosine_pair", f"SELECT a.embedding_id, round({COS.format(a='a.vector', b='b.vector')}, 5) AS cosine FROM embedding a JOIN embedding b ON b.embedding_id = a.embedding_id + 1")
def cosine_pair(v):
    after = v.embedding.select((F.col("embedding_id") - 1).alias("embedding_id"), F.col("vector").alias("other"))
    return v.embedding.join(after, "embedding_id").select("embedding_id", F.round(fn.cosine(F.col("vector"), F.col("other")), 5).alias("cosine"))


TOP = f"SELECT embedding_id, kind, candidate_id, round({COS.format(a='vector', b=QV)}, 5) AS score FROM embedding {{0}} ORDER BY score DESC, embedding_id LIMIT {{1}}"


@query("vector_topk", TOP.format("", 10))
def vector_topk(v):
    return vector_search.top_k(v.embedding, first_vector(v), 10)


@query("vector_topk_filtered", TOP.format("WHERE kind IN ('resume', 'project') AND candidate_id IN (1, 2, 3, 5, 8, 13, 21, 34)", 5))
def vector_topk_filtered(v):
    return vector_search.top_k(v.embedding, first_vector(v), 5, ["resume", "project"], [1, 2, 3, 5, 8, 13, 21, 34])


@query("vector_upsert", """SELECT embedding_id, kind, candidate_id, round(list_sum(list_transform(vector, lambda x: round(x::DOUBLE, 6))) * CASE WHEN embedding_id % 5 = 0 THEN 2 ELSE 1 END, 4) AS total FROM embedding
    UNION ALL SELECT embedding_id + 1000000, kind, candidate_id, round(2 * list_sum(list_transform(vector, lambda x: round(x::DOUBLE, 6))), 4) FROM embedding WHERE embedding_id % 50 = 0""")
def vector_upsert(v):
    twice = v.embedding.withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 6) * 2))
    new = twice.where("embedding_id % 5 = 0").unionByName(twice.where("embedding_id % 50 = 0").withColumn("embedding_id", F.col("embedding_id") + 1_000_000))
    merged = vector_search.upsert(v.embedding, new, ["embedding_id"])
    return merged.select("embedding_id", "kind", "candidate_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("vector_delete", "SELECT kind, count(*) AS n FROM embedding WHERE candidate_id NOT IN (SELECT candidate_id FROM candidate WHERE is_deleted) GROUP BY 1")
def vector_delete(v):
    gone = v.candidate.where("is_deleted").select("candidate_id")
    return vector_search.delete(v.embedding, gone, ["candidate_id"]).groupBy("kind").agg(F.count("*").alias("n"))


def _dealt(v):
    """Documents dealt over the tasks: where their file is one row group, one task would embed all of them."""
    return v.table("documents").select("doc_id", "text").repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


@query("hash_embed")
def hash_embed(v):
    made = _dealt(v).select("doc_id", fn.hash_embedding("text").alias("vector"))
    rounded = F.transform("vector", lambda x: F.round(x.cast("double"), 4))
    return made.select(
        "doc_id", F.size("vector").alias("dim"), F.round(fn.norm(F.col("vector")), 4).alias("norm"), F.size(F.filter("vector", lambda x: x != 0)).alias("filled"),
        F.slice(rounded, 1, 8).alias("head"), F.array_position(rounded, F.array_max(rounded)).alias("peak"),
    )


@query("hash_embed_search")
def hash_embed_search(v):
    """The documents closest to the first benchmark item by hash embedding."""
    text = v.table("benchmark").orderBy("item_id").first()["text"]
    docs = _dealt(v).select(F.col("doc_id").alias("embedding_id"), F.lit("document").alias("kind"), F.lit(None).cast("long").alias("candidate_id"), fn.hash_embedding("text").alias("vector"))
    return vector_search.top_k(docs, fn.embed_py(text).tolist(), 10)


@query("vector_maxpool", f"SELECT candidate_id, max(score) AS score, count(*) AS hits FROM ({TOP.format('', 50)}) GROUP BY 1")
def vector_maxpool(v):
    return vector_search.best_per_candidate(vector_search.top_k(v.embedding, first_vector(v), 50))
