"""All registered queries, each with the DuckDB SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import arms, calibration, corpus, evaluation, governance, lifecycle, retrieval, search, structure, trust

PARTS = (retrieval, trust, search, calibration, governance, lifecycle, structure, corpus, evaluation, arms)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.trusted_search(spark, sf_dir)


def queries() -> dict:
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
