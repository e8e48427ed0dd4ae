"""Closed-form statistics as Column functions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null where n is 0."""
    some = F.when(n > 0, n.cast("double"))
    p = successes / some
    scale = 1 + z * z / some
    middle = (p + z * z / (2 * some)) / scale
    half = F.sqrt(p * (1 - p) / some + z * z / (4 * some * some)) * z / scale
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def auc_interval(auc: Column, n1: Column, n2: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Hanley and McNeil's interval of an area under the curve; (0, 1) if a class is empty."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    spread = (auc * (1 - auc) + (n1 - 1) * (q1 - auc * auc) + (n2 - 1) * (q2 - auc * auc)) / (n1 * n2)
    half = F.sqrt(F.greatest(spread, F.lit(0.0))) * z
    empty = (n1 < 1) | (n2 < 1) | auc.isNull()
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), auc - half)), F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), auc + half))


def confidence(score: Column, threshold: Column, scale: Column) -> Column:
    """Logistic map that is 0.5 at the threshold; the exponent is held in [-60, 60]."""
    x = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (score - threshold) / scale))
    return 1 / (1 + F.exp(-x))


def floor3(x: Column) -> Column:
    return F.floor(x * 1000) / 1000


def certified(auc: Column, n1: Column, n2: Column, least: int = 20, bar: float = 0.9) -> Column:
    """True, false, or null where there is nothing to judge."""
    low, _ = auc_interval(auc, n1, n2)
    return F.when(auc.isNull() | n1.isNull() | n2.isNull(), F.lit(None).cast("boolean")).when(F.least(n1, n2) < least, F.lit(False)).otherwise(low >= bar)


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series ten places further up; good to 13 digits from 0 on."""
    x = n + F.lit(11.0)
    series = (x - 0.5) * F.ln(x) - x + math.log(2 * math.pi) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - reduce(lambda s, j: s + F.ln(n + float(j)), range(2, 11), F.ln(n + 1.0))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of Binomial(n, 1/2), k up to n / 2: the term of k, and the lesser ones as shares of it.

    The fold ends where terms are under 1e-17 of the first: after 40 roots of n at the latest.
    """
    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2))
    steps = F.least(k, F.ceil(40 * F.sqrt(n)) + 50).cast("int")
    shares = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1)).alias("term"), (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"],
    )
    return first * shares


def exact_two_sided(b: Column, c: Column) -> Column:
    """Exact McNemar or sign test: two-sided p of b against c discordant pairs; 1 without any."""
    n = (b + c).cast("double")
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.least(b, c).cast("double"), n)))
