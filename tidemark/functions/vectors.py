"""Vector expressions as Column functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector its best dot product in the document, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def hashed_buckets(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, bucket, n): tokens counted in the 64 buckets of their MD5's last byte."""
    words = docs.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("token"))
    bucket = F.conv(F.right(F.md5("token"), F.lit(2)), 16, 10).cast("int") % 64
    return words.groupBy(id_col, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, embedding): L2-normalised hashed counts, 64 dimensions; texts without a token have no row."""
    counted = hashed_buckets(docs, id_col, text_col).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return counted.withColumn("raw", raw).withColumn("size", F.sqrt(dot(F.col("raw"), F.col("raw")))).select(id_col, F.transform("raw", lambda x: x / F.col("size")).alias("embedding"))
