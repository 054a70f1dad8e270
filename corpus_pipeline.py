"""The corpus pipeline: five stages over `documents`, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hireloom.llm._shared import Scratch
from hireloom.llm.exact_dedup import drop_exact_duplicates
from hireloom.llm.language_id import keep_identified
from hireloom.llm.mixing import take_mix
from hireloom.llm.ngram_join import drop_near_duplicates
from hireloom.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without text or letters go. The other cases are in `keep_identified`."""
    return keep_identified(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, null and empty texts as one; see `drop_exact_duplicates`."""
    return drop_exact_duplicates(spark, docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without words all stay. See `drop_near_duplicates`."""
    return drop_near_duplicates(spark, docs, k=5, percent=75)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; documents without words never. See `take_mix`."""
    return take_mix(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048; even an empty document has its end. See `pack_documents`."""
    return pack_documents(spark, docs, capacity=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: The models and the draws of the mix can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
