"""From raw documents to packed sequences: five stages over the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringfence.llm.exact import dedup_exact
from ringfence.llm.mixing import mix_sources, take_mix
from ringfence.llm.ngram_join import near_duplicates
from ringfence.llm.packing import pack
from ringfence.llm.quality import select_quality
from ringfence.llm.queries import KEEP, quality_model
from ringfence.llm.rows import keep_rows
from ringfence.session import cut, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the best grade; the classifier is fitted to the labelled ones among them."""
    ship(spark)
    return select_quality(docs, quality_model(spark, docs, sf_dir), KEEP)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id."""
    ship(spark)
    return keep_rows(docs, dedup_exact(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the smallest doc_id."""
    ship(spark)
    return keep_rows(docs, near_duplicates(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as far, as the mix takes them."""
    return take_mix(docs, mix_sources(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    ship(spark)
    return pack(docs)


STAGES = [("quality", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The fit, the seeded draw and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before it kept."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
