"""A training corpus from raw documents: filter, deduplicate, cut repeats, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The result of a stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fellwalk.llm import mixing, packing, quality_rules, simhash, substring_dedup
from fellwalk.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees are fitted on the labelled ones."""
    return quality_rules.filter_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on five-word shingles, at a similarity of 0.8."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 50 words that start in an earlier document as well."""
    return substring_dedup.dedup_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack_public(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("mixing", mix), ("packing", pack)]

#: The trees, the tokenizer and the packing rule cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
