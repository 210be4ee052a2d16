"""Scores of probability forecasts: f in [0, 1] against outcomes o of 0 or 1."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import require


#: Terms of the kernel's series in a box, and boxes on either side that a forecast looks at: what is left out is below 1e-14 of the nearest forecasts' weight.
TERMS, REACH = 32, 9


def checked(forecasts: DataFrame, f: str = "f", o: str = "o") -> DataFrame:
    """(f, o) as doubles; a forecast outside [0, 1], another outcome, or a null is refused."""
    rows = forecasts.select(F.col(f).cast("double").alias("f"), F.col(o).cast("double").alias("o"))
    return require(rows, forecast_out_of_range=F.coalesce(~F.col("f").between(0, 1), F.lit(True)), outcome_not_binary=F.coalesce(~F.col("o").isin(0.0, 1.0), F.lit(True)))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("f") - F.col("o")) * (F.col("f") - F.col("o"))).alias("brier"))


def log_score(rows: DataFrame, epsilon: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), F.col("f")))
    return rows.agg((-F.avg(F.when(F.col("o") == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_score"))


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.bround("f", 12).alias("f")).agg(F.count("*").alias("n"), F.sum("o").alias("hits"))


def murphy(rows: DataFrame) -> DataFrame:
    """Reliability, resolution, uncertainty, the Brier score they make up, and the skill; by distinct forecast."""
    at = _distinct(rows)
    total = at.agg(F.sum("n").alias("total"), (F.sum("hits") / F.sum("n")).alias("base"), F.count("*").alias("n_distinct"))
    mean = F.col("hits") / F.col("n")
    parts = at.join(F.broadcast(total)).groupBy("total", "base", "n_distinct").agg(
        (F.sum(F.col("n") * (F.col("f") - mean) * (F.col("f") - mean)) / F.first("total")).alias("reliability"),
        (F.sum(F.col("n") * (mean - F.col("base")) * (mean - F.col("base"))) / F.first("total")).alias("resolution"),
    )
    unc = F.col("base") * (1 - F.col("base"))
    score = F.col("reliability") - F.col("resolution") + unc
    return parts.select("n_distinct", "reliability", "resolution", unc.alias("uncertainty"), score.alias("brier"), F.when(unc > 0, 1 - score / unc).otherwise(F.lit(0.0)).alias("skill"))


def reliability_curve(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of bins of equal width by their edges k * (1 / bins); the last is closed, empty ones are left out."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    at = sum(((F.col("f") >= F.lit(e)).cast("int") for e in edges), F.lit(0)).alias("bin")
    return rows.select(at, "f", "o").groupBy("bin").agg(F.count("*").alias("n"), F.avg("f").alias("confidence"), F.avg("o").alias("accuracy"))


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    curve = reliability_curve(rows, bins)
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def smooth_calibration_error(rows: DataFrame, bandwidth: float | None = None) -> DataFrame:
    """Mean distance of the forecasts from a Gaussian kernel regression of the outcomes on them, by default with the bandwidth n^(-1/3) within [0.01, 0.25].

    Forecasts are put in boxes of one bandwidth. With s and t the distances of two forecasts from the middle of the box of the first, over the square root of 2
    bandwidths, the kernel is exp(-t^2) times the series of (2t)^k / k! s^k exp(-s^2): so a box's sums of s^k exp(-s^2), at most a hundred boxes of
    ``TERMS`` of them, give the weights of all its forecasts at any other. The work is in proportion to the forecasts, none meet each other, and
    the result is that of all pairs to rounding, at any size.
    """
    at = _distinct(rows)
    total = at.agg(F.sum("n").alias("total"))
    h = F.lit(bandwidth) if bandwidth else F.greatest(F.lit(0.01), F.least(F.lit(0.25), F.pow(F.col("total").cast("double"), F.lit(-1.0 / 3))))
    boxed = at.join(F.broadcast(total)).withColumn("h", h).withColumn("box", F.floor(F.col("f") / F.col("h")))
    from_middle = lambda box: (F.col("f") - (box + 0.5) * F.col("h")) / (F.col("h") * math.sqrt(2))
    inner = from_middle(F.col("box"))
    term = lambda q, k: F.sum(F.col(q) * F.pow(inner, F.lit(float(k))) * F.exp(-inner * inner) * (2.0**k / math.factorial(k)))
    sums = boxed.groupBy(F.col("box").alias("of")).agg(*[term(q, k).alias(f"{q}{k}") for q in ("n", "hits") for k in range(TERMS)])
    met = boxed.withColumn("of", F.explode(F.sequence(F.col("box") - REACH, F.col("box") + REACH))).join(F.broadcast(sums) if not bandwidth or bandwidth >= 0.001 else sums, "of")
    outer = from_middle(F.col("of"))
    series = lambda q: F.exp(-outer * outer) * reduce(lambda tail, k: tail * outer + F.col(f"{q}{k}"), range(TERMS - 2, -1, -1), F.col(f"{q}{TERMS - 1}"))
    fit = met.groupBy("f", "n").agg((F.sum(series("hits")) / F.sum(series("n"))).alias("y"))
    return fit.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("f"))) / F.sum("n")).alias("smooth_ce"))


def calibration_report(rows: DataFrame, least: int = 10) -> DataFrame:
    """One row: n forecasts with a verdict, of all; brier, reliability, resolution, uncertainty, skill, ece, smooth_ce. All null below ``least`` forecasts, where every measure is biased.

    ``rows``: p_fire, fired, should_fire.
    """
    told = rows.filter("p_fire is not null and fired is not null")
    counts = rows.agg(F.count("*").alias("n_all"), F.count_if(F.col("p_fire").isNotNull() & F.col("fired").isNotNull()).alias("n"))
    ready = checked(told.select(F.col("p_fire").alias("f"), F.col("should_fire").cast("int").alias("o")))
    both = counts.join(murphy(ready), how="left").join(expected_calibration_error(ready), how="left").join(smooth_calibration_error(ready), how="left")
    enough = F.col("n") >= least
    return both.select("n", "n_all", *[F.when(enough, F.col(c)).alias(c) for c in ("brier", "reliability", "resolution", "uncertainty", "skill", "ece", "smooth_ce")])


def identity_residual(rows: DataFrame) -> DataFrame:
    """(residual): the Brier score less what its decomposition makes of it; 0 but for the digits."""
    return brier(rows).join(murphy(rows).select("reliability", "resolution", "uncertainty")).select((F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty"))).alias("residual"))
