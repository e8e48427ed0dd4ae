"""Mixing sources to target weights by Poisson replication.

Each document of source s is repeated Poisson(rate) times, rate being the target share of s over its share now;
the draw inverts the Poisson distribution at a number hashed from seed and identifier, so a rerun of a lost task
gives the same copies. A mean over PART_MEAN is drawn as a sum of equal parts; one over MOST_PARTS parts is drawn
from the normal quantile with its skewness term, which is then within a copy of the exact one. All copies are then
shuffled globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_unit, stored

#: Sources up to which the table of rates is broadcast; over it the join is shuffled with salted keys.
BROADCAST_SOURCES = 10_000
#: A larger mean is drawn as a sum of equal parts, since exp(-mean) would underflow.
PART_MEAN, MOST_PARTS = 64.0, 1024
SALTS = 64
#: Copies that a row is exploded to at once; rows with more are first dealt to tasks in blocks of as many.
COPY_BLOCK = 10_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, mass, rate): mass is the characters of a source, rate the mean number of copies of a document.

    ``weights`` maps sources to relative targets (a source not named, the null source too, gets 0); without it
    all sources weigh the same. The expected mass of the mixture is ``epochs`` times that of the input.
    """
    mass = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("mass"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0))
    weighed = mass.where("mass > 0").withColumn("weight", weight)
    total = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.lit(float(epochs)) * F.col("all_mass") * F.col("weight") / F.col("all_weight") / F.col("mass")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(total)).select("source", "mass", rate.alias("rate"))


def _with_tables(rates: DataFrame) -> DataFrame:
    """Adds parts and cdf: P(X <= k) of Poisson(rate / parts) for k from 0, as far as the tail is over 1e-15."""
    parts = F.least(F.ceil(F.col("rate") / PART_MEAN), F.lit(MOST_PARTS + 1)).cast("int")
    split = rates.withColumn("parts", F.greatest(F.lit(1), parts)).withColumn("mean", F.least(F.col("rate") / F.col("parts"), F.lit(PART_MEAN)))
    cdf = F.expr(
        "aggregate(sequence(1, cast(ceil(mean + 12 * sqrt(mean) + 20) as int)), "
        "struct(exp(-mean) as p, array(exp(-mean)) as cdf), "
        "(s, k) -> struct(s.p * mean / k as p, concat(s.cdf, array(element_at(s.cdf, -1) + s.p * mean / k)) as cdf)).cdf"
    )
    return split.withColumn("cdf", cdf).select("source", "rate", "parts", "cdf")


def _drawn(seed: str) -> Column:
    """Copies of a row with columns key, rate, parts and cdf."""
    unit = lambda what: hashed_unit(F.lit(seed), what, F.col("key"))
    # Most means are at most PART_MEAN, one part; its number is hashed once a row, outside the lambda.
    once = F.size(F.filter("cdf", lambda c: c <= F.col("unit"))).cast("long")
    summed = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0).cast("long"),
        lambda s, p: s + F.size(F.filter("cdf", lambda c: c <= unit(F.concat(F.lit("draw|"), p.cast("string"))))),
    )
    normal = F.sqrt(-2 * F.log(1 - F.col("unit"))) * F.cos(2 * F.pi() * unit(F.lit("angle")))
    large = F.floor(F.col("rate") + F.sqrt("rate") * normal + (normal * normal - 1) / 6 + 0.5).cast("long")
    return F.when(F.col("parts") == 1, once).when(F.col("parts") <= MOST_PARTS, summed).otherwise(large)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """The mixture: the columns of ``docs`` and repeats (copies drawn), copy (from 0), shuffle_key; shuffled.

    Documents of sources without a character in all, or with rate 0, have no copies. The null source is a source
    of its own. A document with a null identifier draws by the digest of its text; rows that repeat an identifier
    draw the same number each. An empty text is drawn like any other of its source; a long one counts by its
    characters. An empty table gives none. A column of ``docs`` named like an added one is returned as
    ``input_`` and its name; any other name is kept.
    """
    spark = docs.sparkSession
    for name in ("repeats", "copy", "shuffle_key"):
        if name in docs.columns:
            new = "input_" + name
            while new in docs.columns:
                new = "input_" + new
            docs = docs.withColumnRenamed(name, new)
    rates = stored(_with_tables(source_rates(docs, weights, epochs)))
    sizes = rates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("rate"), F.lit(0.0)).alias("top")).first()
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key"), F.col("source").alias("of"))
    same = F.col("of").eqNullSafe(F.col("source"))
    if sizes["n"] <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("row_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("row_salt") == F.col("salt")))
    counted = joined.withColumn("unit", hashed_unit(F.lit(seed), F.lit("draw"), F.lit("0"), F.col("key"))).select("doc", "key", _drawn(seed).alias("repeats")).where("repeats > 0")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))
    if sizes["top"] > COPY_BLOCK / 2:
        blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(repeats - 1) div {COPY_BLOCK}")))).repartition("key", "block")
        first = F.col("block") * COPY_BLOCK
        counted, copies = blocks, F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("repeats")) - 1))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col("copy").cast("string"), F.col("key")))
    out = counted.withColumn("copy", copies).select("doc.*", "repeats", "copy", order.alias("shuffle_key"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return out.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")
