"""The corpus pipeline: five stages over documents, each an operator of ``tidemark.llm``.

Every stage takes (spark, docs, sf_dir), docs being all that the stage before kept, and returns a DataFrame; all
but the last keep the columns of documents. ``run`` writes each stage's rows in the shared folder before the next
stage reads them, so a lost executor repeats work of one stage at most. SQL can't express the stages, so there is
no oracle; tests/llm/test_pipeline.py holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, exact_dedup, mixing, simhash, toxicity
from tidemark.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model of the labelled rows under sf_dir."""
    return toxicity.drop_toxic(spark, docs, sf_dir)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest doc_id."""
    return exact_dedup.keep_first_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingle sets of similarity 0.8 or more."""
    return simhash.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark under sf_dir."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source to the same share of characters, one epoch in all, shuffled."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("simhash near-dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs)
    return docs
