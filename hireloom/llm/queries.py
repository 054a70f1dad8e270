"""Queries of the numbered operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(spark, _docs(spark, sf_dir), keep="largest")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(spark, _docs(spark, sf_dir), k=5, percent=75)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(spark, _docs(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts

    return score_texts(spark, _docs(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(spark, _docs(spark, sf_dir))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(spark, _docs(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(spark, _docs(spark, sf_dir), shards=24)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import token_files

    return token_files(spark, _docs(spark, sf_dir), end_id=2)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark, _docs(spark, sf_dir), capacity=2048, end_id=0)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(spark, _docs(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mine_phrases

    return mine_phrases(spark, _docs(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    from . import collocations, hard_negatives

    return {
        "op12_collocations": collocations.SQL,
        "op13_hard_negatives": hard_negatives.SQL,
        "op1_exact_dedup": """
            SELECT doc_id,
                   max(doc_id) OVER same AS keep_id,
                   count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents
            WINDOW same AS (PARTITION BY coalesce(text, ''))
        """,
    }
