"""Resampling and paired tests that any engine can repeat: draws are hashes of a seed, a replicate and a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import exact_two_sided
from tidemark.operators.calibration import quantile_by_index, running_totals

#: Cumulative Poisson(1) probabilities of 0 to 9 events: the weight of a unit in a replicate is inverted from them.
POISSON_1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217)
REPLICATES = 200


def draw(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _replicated(units: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    return units.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", draw(seed, F.col("replicate"), F.col(key)))


def bootstrap(units: DataFrame, by: list[str], key: str, value: str, n: int = REPLICATES, seed: str = "boot-1") -> DataFrame:
    """(by, n_units, mean, low, high): percentile interval of a mean over units by Poisson resampling.

    A unit weighs Poisson(1) in a replicate, so nothing is drawn from a list and replicates are sums that combine
    before the shuffle. A replicate without any unit counts as the mean. Bounds are the values at floor(0.025 n) and
    floor(0.975 n) - 1.
    """
    whole = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.avg(value).alias("mean"))
    weight = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON_1[1:]), F.when(F.col("u") >= POISSON_1[0], 1).otherwise(0))
    sums = _replicated(units, key, seed, n).withColumn("w", weight).groupBy(*by, "replicate").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(value)).alias("s"))
    means = sums.join(whole, by).select(*by, F.round(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("mean")), 12).alias("m"))
    low = quantile_by_index(means, by, "m", 0.025, "low")
    place = F.lit(int(0.975 * n) - 1)
    counts = running_totals(means.groupBy(*by, "m").agg(F.count(F.lit(1)).alias("times")), by, "m", {"at": "times"})
    high = counts.where((F.col("at") <= place) & (place < F.col("at") + F.col("times"))).select(*by, F.col("m").alias("high"))
    return whole.join(low, by).join(high, by)


def cluster_bootstrap(rows: DataFrame, n: int = REPLICATES, seed: str = "cluster-1") -> DataFrame:
    """One row (n_clusters, ratio, low, high): percentile interval of a stratified ratio of sums by whole clusters.

    ``rows`` are (stratum, cluster, num, den). A cluster has one Poisson(1) weight in a replicate, for all of its rows
    and in all strata. A stratum's ratio is that of its weighted totals (its own where no cluster of it is drawn);
    strata count by their totals of den. Rows are added up by cluster before they meet replicates.
    """
    totals = rows.groupBy("stratum", "cluster").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    strata = totals.groupBy("stratum").agg(F.sum("num").alias("all_num"), F.sum("den").alias("all_den"))
    weight = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON_1[1:]), F.when(F.col("u") >= POISSON_1[0], 1).otherwise(0))
    drawn = _replicated(totals, "cluster", seed, n).withColumn("w", weight)
    sums = drawn.groupBy("stratum", "replicate").agg(F.sum(F.col("w") * F.col("num")).alias("num"), F.sum(F.col("w") * F.col("den")).alias("den"))
    joined = sums.join(strata, "stratum").withColumn("r", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("all_num") / F.col("all_den")))
    means = joined.groupBy("replicate").agg(F.round(F.sum(F.col("r") * F.col("all_den")) / F.sum("all_den"), 12).alias("m"))
    low = quantile_by_index(means, [], "m", 0.025, "low")
    place = F.lit(int(0.975 * n) - 1)
    counts = running_totals(means.groupBy("m").agg(F.count(F.lit(1)).alias("times")), [], "m", {"at": "times"})
    high = counts.where((F.col("at") <= place) & (place < F.col("at") + F.col("times"))).select(F.col("m").alias("high"))
    whole = strata.agg((F.sum("all_num") / F.sum("all_den")).alias("ratio")).join(totals.agg(F.count_distinct("cluster").alias("n_clusters")))
    return whole.join(low).join(high).select("n_clusters", "ratio", "low", "high")  # one row each


def sign_flip(units: DataFrame, by: list[str], key: str, value: str, n: int = REPLICATES, seed: str = "flip-1") -> DataFrame:
    """(by, p): share of replicates with hashed signs whose mean is as far from 0 as the observed one, plus one."""
    flips = _replicated(units, key, seed, n).withColumn("f", F.when(F.col("u") < 0.5, F.col(value)).otherwise(-F.col(value)))
    per = flips.groupBy(*by, "replicate").agg(F.abs(F.round(F.sum("f"), 9)).alias("far"), F.abs(F.round(F.sum(value), 9)).alias("seen"))
    return per.groupBy(*by).agg(((F.count_if(F.col("far") >= F.col("seen")) + 1) / F.lit(n + 1.0)).alias("p"))


def sign_test(units: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, ups, downs, p): exact two-sided sign test of nonzero differences."""
    counted = units.groupBy(*by).agg(F.count_if(F.col(value) > 0).alias("ups"), F.count_if(F.col(value) < 0).alias("downs"))
    return counted.withColumn("p", exact_two_sided(F.col("ups"), F.col("downs")))


def wilcoxon(units: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, w, z): signed-rank sum of the positive differences and its normal deviate, with the tie correction.

    Zeros are left out; ranks of equal sizes are averaged.
    """
    some = units.where(F.col(value) != 0).withColumn("size", F.abs(F.col(value)))
    counts = some.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("times"), F.count_if(F.col(value) > 0).alias("ups"))
    placed = running_totals(counts, by, "size", {"lower": "times"}).withColumn("rank", F.col("lower") + (F.col("times") + 1) / 2)
    t = F.col("times").cast("double")
    sums = placed.groupBy(*by).agg(F.sum("times").alias("n"), F.sum(F.col("rank") * F.col("ups")).alias("w"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.select(*by, "n", "w", ((F.col("w") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0))).alias("z"))


def partial(r_xy: Column, r_xz: Column, r_yz: Column) -> Column:
    """Correlation of x and y with z held fixed; null where z explains one of them wholly."""
    rest = F.sqrt((1 - r_xz * r_xz) * (1 - r_yz * r_yz))
    return (r_xy - r_xz * r_yz) / F.nullif(rest, F.lit(0.0))


def promotion_failures(deltas: DataFrame, interval: DataFrame, *, least_delta: float = -0.02, alpha: float = 0.05) -> DataFrame:
    """(failure) of a retrieval candidate: the macro interval doesn't clear 0, a corpus regresses by over two points,
    or no improving corpus is significant. ``deltas`` is (corpus, delta, adjusted), ``interval`` one row (low)."""
    flat = interval.where("low <= 0").select(F.lit("macro interval does not clear zero").alias("failure"))
    worse = deltas.where(F.col("delta") < least_delta).select(F.concat(F.col("corpus"), F.lit(" regresses by more than two points")).alias("failure"))
    good = deltas.agg(F.count_if((F.col("adjusted") < alpha) & (F.col("delta") > 0)).alias("n"))
    none = good.where("n = 0").select(F.lit("no improving corpus is significant").alias("failure"))
    return flat.unionByName(worse).unionByName(none)
