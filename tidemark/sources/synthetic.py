"""A seeded corpus with known answers: facts, superseded pairs, expired notes and filler; no state, no files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, facts: int = 200, pairs: int = 150, expired: int = 100, filler: int = 1000, seed: int = 1234, today: str = "2024-06-01") -> DataFrame:
    """(file, supersedes, valid_until, text); the same rows for the same arguments on any cluster."""
    number = F.conv(F.substring(F.md5(F.concat_ws("-", "id", F.lit(seed))), 1, 8), 16, 10).cast("long") % 9000 + 1000
    fact = spark.range(facts).select(F.concat(F.lit("facts/s"), "id", F.lit(".md")).alias("file"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("valid_until"), F.concat(F.lit("The limit of service s"), "id", F.lit(" is "), number, F.lit(".")).alias("text"))
    old = spark.range(pairs).select(F.concat(F.lit("pairs/p"), "id", F.lit("_v1.md")).alias("file"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("valid_until"), F.concat(F.lit("Policy p"), "id", F.lit(" allows "), number).alias("text"))
    new = spark.range(pairs).select(F.concat(F.lit("pairs/p"), "id", F.lit("_v2.md")).alias("file"), F.concat(F.lit("p"), "id", F.lit("_v1.md")).alias("supersedes"), F.lit(None).cast("string").alias("valid_until"), F.concat(F.lit("Policy p"), "id", F.lit(" allows "), number + 1).alias("text"))
    gone = spark.range(expired).select(F.concat(F.lit("expired/x"), "id", F.lit(".md")).alias("file"), F.lit(None).cast("string").alias("supersedes"), F.date_sub(F.lit(today).cast("date"), 30).cast("string").alias("valid_until"), F.concat(F.lit("Offer x"), "id", F.lit(" costs "), number).alias("text"))
    rest = spark.range(filler).select(F.concat(F.lit("filler/notes_"), "id", F.lit(".md")).alias("file"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("valid_until"), F.concat(F.lit("note "), F.md5(F.concat_ws("-", "id", F.lit(seed)))).alias("text"))
    return fact.unionByName(old).unionByName(new).unionByName(gone).unionByName(rest)
