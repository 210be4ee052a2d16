"""Closed forms over counts: rates, intervals, agreement of forms, power."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def z_value(confidence: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def rate(part: Column, whole: Column) -> Column:
    """0.0 on an empty denominator, as the scorecards have it."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def wilson(p: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of a share, within [0, 1]; (0, 1) without observations."""
    z = z_value(confidence)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    return low, F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation; null where a margin is empty. The product of the margins is one of doubles: that of counts leaves the range of a long from some 110,000 rows on."""
    margins = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(margins > 0, (tp * tn - fp * fn) / F.sqrt(margins))


def design_effect(mean_size: Column, icc: Column) -> Column:
    return 1 + (mean_size - 1) * icc


def effective_n(n: Column, mean_size: Column, icc: Column) -> Column:
    return n / design_effect(mean_size, icc)


def effective_raters(m: Column, kappa: Column) -> Column:
    return m / (1 + (m - 1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), kappa)))


def spearman_brown(icc: Column, repeats: Column) -> Column:
    return repeats * icc / (1 + (repeats - 1) * icc)


def repeats_for_reliability(icc: Column, target: Column) -> Column:
    """The least number of repeats whose reliability reaches the target."""
    n = F.ceil(target * (1 - icc) / (icc * (1 - target)) - 1e-9)
    fewer = F.when((n > 1) & (spearman_brown(icc, n - 1) >= target), n - 1).otherwise(n)
    return F.greatest(F.lit(1), fewer).cast("long")


def repeats_for_precision(error: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(1 + 1 / (2 * error * error))).cast("long")


def power_quantiles(alpha: float, power: float, two_sided: bool = False) -> tuple[float, float]:
    q = NormalDist().inv_cdf
    return q(1 - alpha / (2 if two_sided else 1)), q(power)


def required_pairs(effect: Column, discordant: Column, alpha: float = 0.05, power: float = 0.8, deff: Column | float = 1.0, two_sided: bool = False) -> Column:
    """Pairs that a paired binary comparison needs, inflated by the design effect before rounding up."""
    za, zb = power_quantiles(alpha, power, two_sided)
    n = F.pow((za * F.sqrt(discordant) + zb * F.sqrt(discordant - effect * effect)) / effect, F.lit(2.0))
    return F.ceil(n * deff).cast("long")


def detectable_effect(pairs: Column, discordant: Column, alpha: float = 0.05, power: float = 0.8, two_sided: bool = False, steps: int = 60) -> Column:
    """Inverse of ``required_pairs`` by bisection; null where even a full effect is not detectable."""
    za, zb = power_quantiles(alpha, power, two_sided)
    need = lambda d: F.pow((za * F.sqrt(discordant) + zb * F.sqrt(F.greatest(F.lit(0.0), discordant - d * d))) / d, F.lit(2.0))
    start = F.struct(F.lit(1e-9).alias("low"), discordant.cast("double").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        enough = need(middle) <= pairs
        return F.struct(F.when(enough, s["low"]).otherwise(middle).alias("low"), F.when(enough, middle).otherwise(s["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["high"]
    return F.when(need(discordant) <= pairs, found)


def relative_movement(base: Column, variant: Column) -> Column:
    return F.abs(variant - base) / F.abs(base)


def interval_state(low: Column, high: Column, threshold: float = 0.70) -> Column:
    return F.when(low >= threshold, "closes").when(high < threshold, "survives").otherwise("indeterminate")


def clustering_is_inert(n_items: Column, n_clusters: Column) -> Column:
    """Every cluster has one item: the interval is that of items."""
    return n_items == n_clusters


def within(point: Column, low: float, high: float) -> Column:
    return point.between(low, high)


def power_grid(spark: SparkSession, pairs: tuple[int, ...] = (50, 100, 200, 400, 800, 1600), discordant: tuple[float, ...] = (0.05, 0.10, 0.20, 0.30, 0.40), deff: float = 1.0, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """(pairs, discordant, effect): the detectable effect over a grid, in percentage points; null where none is detectable."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, pairs))).alias("pairs")).withColumn("discordant", F.explode(F.array(*map(F.lit, discordant))))
    return grid.withColumn("effect", 100 * detectable_effect(F.col("pairs") / deff, F.col("discordant"), alpha, power))
