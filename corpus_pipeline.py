"""The training-data pipeline: each stage's result is written and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import Tables, documents
from scriptorium.llm.decontaminate import decontaminate_stage
from scriptorium.llm.lines import lines_stage
from scriptorium.llm.mixing import mixing_stage
from scriptorium.llm.similar import similar_documents
from scriptorium.llm.simhash import near_duplicates_stage
from scriptorium.llm.toxicity import toxicity_stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted toxic."""
    return toxicity_stage(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines."""
    return lines_stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates: SimHash groups and MinHash
    candidates over 5-word shingles, verified by exact Jaccard similarity."""
    return near_duplicates_stage(spark, docs, sf_dir, similar_documents)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate_stage(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document so that sources meet their targets."""
    return mixing_stage(spark, docs, sf_dir)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: A trained classifier and XXH64 majorities have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what the stages keep of documents."""
    tables = Tables(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = tables.write(docs)
    return docs
