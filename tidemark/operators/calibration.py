"""Fitting, certifying and watching the confidence threshold.

Samples are (label, score): label true for answerable queries. All figures are aggregates or ranks; classes may
be large, so no pair of samples is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.stats import auc_interval, certified, floor3
from tidemark.sources.shared import stored

ANSWERABLE_Q, UNANSWERABLE_Q = 0.05, 0.95
#: Rows up to which running sums are left to one window.
ONE_TASK = 200_000


def running_totals(df: DataFrame, by: list[str], value: str, columns: dict[str, str]) -> DataFrame:
    """Adds, for each new column of ``columns``, the sum of its source over the group's rows with a lesser ``value``.

    ``df`` has one row a group and value. A group over ONE_TASK rows in all is cut into ranges of values: each range
    sums its own rows and adds what the ranges before it hold, so no task orders a whole group.
    """
    sums = lambda window: {new: F.coalesce(F.sum(old).over(window), F.lit(0)) for new, old in columns.items()}
    if df.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return df.withColumns(sums(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)))
    parts = stored(df.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    held = parts.groupBy(*by, "_part").agg(*[F.sum(old).alias(f"_{new}") for new, old in columns.items()])
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)).alias(f"_{new}") for new in columns])
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = parts.withColumns(sums(W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)))
    joined = inside.join(starts, same)
    return joined.withColumns({new: F.col(new) + F.col(f"_{new}") for new in columns}).select(*df.columns, *columns)


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, times, at, n): rows of the group with that value, with lesser ones, and in all."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("times"))
    placed = running_totals(counts, by, value, {"at": "times"})
    if not by:
        return placed.join(F.broadcast(counts.agg(F.sum("times").alias("n"))))  # one row
    totals = counts.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.sum("times").alias("n"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return placed.join(totals, same).drop(*[f"_t_{c}" for c in by])


def quantile_by_index(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """sorted[min(n - 1, floor(q * n))] of each group; no interpolation."""
    place = F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    return ranked(df, by, value).where((F.col("at") <= place) & (place < F.col("at") + F.col("times"))).select(*by, F.col(value).alias(name))


def inclusive_quantile(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """(by, name): the value at q * (n - 1) of each group's sorted values, between two of them in proportion."""
    place = F.lit(q) * (F.col("n") - 1)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda at: F.max(F.when((F.col("at") <= at) & (at < F.col("at") + F.col("times")), F.col(value)))
    two = ranked(df.where(F.col(value).isNotNull()), by, value).where((F.col("at") <= high) & (low < F.col("at") + F.col("times")))
    return two.groupBy(*by).agg(holds(low).alias("_a"), holds(high).alias("_b"), F.max(place - low).alias("_f")).select(*by, (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias(name))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """sorted[ceil(q * n) - 1] of each group."""
    place = F.greatest(F.ceil(F.lit(q) * F.col("n")) - 1, F.lit(0))
    return ranked(df, by, value).where((F.col("at") <= place) & (place < F.col("at") + F.col("times"))).select(*by, F.col(value).alias(name))


def auc(samples: DataFrame) -> DataFrame:
    """(n_pos, n_neg, auc): chance that a positive outscores a negative, ties a half; null if a class is empty."""
    by_score = samples.groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("m"))
    wins = running_totals(by_score, [], "score", {"lower": "m"})
    sums = wins.agg(F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"), F.sum(F.col("p") * (F.col("lower") + 0.5 * F.col("m"))).alias("won"))
    both = F.col("n_pos") * F.col("n_neg")
    return sums.select(F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), F.when(both > 0, F.col("won") / both).alias("auc"))


def threshold_of(floor: Column, ceiling: Column) -> Column:
    """Middle of the gap, rounded down to 3 digits; one class alone gives its own bound, none gives 0.5."""
    return F.when(floor.isNull() & ceiling.isNull(), 0.5).when(floor.isNull(), floor3(ceiling)).when(ceiling.isNull(), floor3(floor)).otherwise(floor3((floor + ceiling) / 2))


def fit(samples: DataFrame) -> DataFrame:
    """One row: threshold, scale, n_pos, n_neg, auc, auc_low, auc_high, certified."""
    low = quantile_by_index(samples.where("label"), [], "score", ANSWERABLE_Q, "floor")
    high = quantile_by_index(samples.where("not label"), [], "score", UNANSWERABLE_Q, "ceiling")
    quart = samples.agg(F.count_if("label").alias("a"), F.count_if(~F.col("label")).alias("u"))
    q25 = inclusive_quantile(samples.where("label"), [], "score", 0.25, "q25")
    q75 = inclusive_quantile(samples.where("not label"), [], "score", 0.75, "q75")
    row = auc(samples).join(quart).join(low, how="left").join(high, how="left").join(q25, how="left").join(q75, how="left")  # one row each
    scale = F.when((F.col("a") >= 2) & (F.col("u") >= 2), F.round(F.greatest((F.col("q25") - F.col("q75")) / 4, F.lit(0.01)), 4)).otherwise(0.05)
    lo, hi = auc_interval(F.col("auc"), F.col("n_pos"), F.col("n_neg"))
    return row.select(threshold_of(F.col("floor"), F.col("ceiling")).alias("threshold"), scale.alias("scale"), "n_pos", "n_neg", "auc", lo.alias("auc_low"), hi.alias("auc_high"), certified(F.col("auc"), F.col("n_pos"), F.col("n_neg")).alias("certified"))


def error_rates(samples: DataFrame, threshold: float) -> DataFrame:
    """Confusion counts at a threshold and their rates (null for an empty class)."""
    return samples.agg(
        F.count_if(F.col("label") & (F.col("score") >= threshold)).alias("confirmed"), F.count_if(F.col("label") & (F.col("score") < threshold)).alias("false_abstain"),
        F.count_if(~F.col("label") & (F.col("score") >= threshold)).alias("false_confirm"), F.count_if(~F.col("label") & (F.col("score") < threshold)).alias("abstained"),
        F.avg(F.when(F.col("label"), (F.col("score") < threshold).cast("double"))).alias("false_abstain_rate"),
        F.avg(F.when(~F.col("label"), (F.col("score") >= threshold).cast("double"))).alias("false_confirm_rate"),
    )


def threshold_sweep(samples: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: share of negatives abstained, of positives falsely abstained, and their difference.

    A null score abstains.
    """
    steps = samples.select("label", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    abstains = F.coalesce(F.col("score") < F.col("threshold"), F.lit(True)).cast("double")
    out = steps.groupBy("threshold").agg(F.avg(F.when(~F.col("label"), abstains)).alias("abstained"), F.avg(F.when(F.col("label"), abstains)).alias("false_abstain"))
    return out.withColumn("separation", F.col("abstained") - F.col("false_abstain"))


def _folds(samples: DataFrame) -> DataFrame:
    """Distinct scores of each class with their places, and for both classes the quantile of all, and the two values of
    which one is the quantile of any fold."""
    q = F.when(F.col("label"), ANSWERABLE_Q).otherwise(UNANSWERABLE_Q)
    placed = stored(ranked(samples.select("label", "score"), ["label"], "score")).withColumn("less", F.least(F.col("n") - 2, F.floor(q * (F.col("n") - 1))))
    holds = lambda at: F.max(F.when((F.col("at") <= at) & (at < F.col("at") + F.col("times")), F.col("score")))
    whole = F.least(F.col("n") - 1, F.floor(q * F.col("n")))
    bounds = placed.groupBy("label").agg(holds(whole).alias("all"), holds(F.col("less")).alias("here"), holds(F.col("less") + 1).alias("next"))
    one = lambda label, p: bounds.where(F.col("label") == label).agg(*[F.max(c).alias(f"{p}_{c}") for c in ("all", "here", "next")])
    return placed.join(F.broadcast(one(True, "p"))).join(F.broadcast(one(False, "m")))  # one row each


def held_out_thresholds(samples: DataFrame) -> DataFrame:
    """(label, score, threshold): the threshold fitted to all ``samples`` (label, score) but one with that score."""
    own = lambda p: F.when(F.col("n") > 1, F.when(F.col("at") <= F.col("less"), F.col(f"{p}_next")).otherwise(F.col(f"{p}_here")))
    cut = F.when(F.col("label"), threshold_of(own("p"), F.col("m_all"))).otherwise(threshold_of(F.col("p_all"), own("m")))
    return _folds(samples).select("label", "score", cut.alias("threshold"))


def leave_one_out(samples: DataFrame) -> DataFrame:
    """(false_abstain, false_confirm): each sample judged at the threshold fitted without it.

    Without the i-th smallest value the quantile's place shifts by one at most, so every fold's threshold is one
    of two values of its class: no fold is refitted. Samples with one score are judged together: those up to the
    place at one threshold, those after it at the other.
    """
    judged = _folds(samples)
    alone = F.col("n") == 1

    def wrong(own: str) -> Column:
        p, m = F.when(~alone, F.col(f"p_{own}")), F.when(~alone, F.col(f"m_{own}"))
        cut = F.when(F.col("label"), threshold_of(p, F.col("m_all"))).otherwise(threshold_of(F.col("p_all"), m))
        return F.when(F.col("label"), F.col("score") < cut).otherwise(F.col("score") >= cut).cast("double")

    before = F.greatest(F.lit(0), F.least(F.col("times"), F.col("less") + 1 - F.col("at")))
    errors = before * wrong("next") + (F.col("times") - before) * wrong("here")
    rate = lambda label: F.sum(F.when(label, errors)) / F.sum(F.when(label, F.col("times")))
    return judged.agg(rate(F.col("label")).alias("false_abstain"), rate(~F.col("label")).alias("false_confirm"))


def drift_verdict(delta: Column, is_certified: Column, probed: Column, probe_failed: Column) -> Column:
    """stable, recalibration_recommended, recalibration_required or unknown (no baseline: null delta)."""
    return (
        F.when(delta.isNull(), "unknown").when(delta < 0.05, "stable").when(F.coalesce(probe_failed, F.lit(False)), "recalibration_required")
        .when(F.coalesce(~is_certified, F.lit(False)), "recalibration_required").when(~F.coalesce(probed, F.lit(False)), "recalibration_recommended").otherwise("stable")
    )
