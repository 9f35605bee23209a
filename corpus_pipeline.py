"""Corpus pipeline: quality, toxicity, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are joined by Parquet in the shared folder,
so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard_join, packing, quality, toxicity
from tessera.runtime import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled documents, does not reject."""
    model = quality.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labelled documents, does not reject."""
    model = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return jaccard_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a benchmark item occurs."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("packing", packed)]

#: The classifiers and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k > 1:
            scratch.drop(STAGES[k - 2][0])
    return docs
