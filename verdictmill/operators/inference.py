"""Exact and large-sample tests: McNemar, Wilcoxon, Benjamini-Hochberg."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Nodes of the quadrature on [0, 1]: exact for the polynomials of n up to 128, and far beyond double precision for the smooth integrands above.
NODES, WEIGHTS = ((x.tolist()) for x in np.polynomial.legendre.leggauss(64))


def _stirling_error(n: Column) -> Column:
    """ln n! less Stirling's formula: from the factorial up to 20, by its series beyond."""
    n = n.cast("double")
    known = F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double")) - (n + 0.5) * F.ln(n) + n - 0.5 * math.log(2 * math.pi)
    square = n * n
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / square) / square) / square) / n
    return F.when(n <= 20, known).otherwise(series)


def _half_pmf(k: Column, n: Column) -> Column:
    """P(X = k) for X ~ Binomial(n, 1/2), to full relative precision at any size: the saddle-point form, in which no large logarithms cancel."""
    e = (2 * k - n) / n.cast("double")
    square = e * e
    near = reduce(lambda tail, j: (F.lit(1 / (j * (2 * j - 1))) + tail) * square, range(12, 0, -1), F.lit(0.0))
    far = (1 + e) * F.ln(1 + e) + (1 - e) * F.ln(1 - e)
    exponent = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - n / 2 * F.when(F.abs(e) < 0.1, near).otherwise(far)
    return F.when((k == n) | (k == 0), F.pow(F.lit(0.5), n)).otherwise(F.exp(exponent) * F.sqrt(n / (2 * math.pi * k * (n - k))))


def binomial_half_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, 1/2), in as many steps for any n.

    From the middle up the tail is P(X = k) times k times the integral of (1 - u)^(k - 1) (1 + u)^(n - k) over [0, 1]. That integrand falls from 1, at least as
    fast as exp(-(2k - 1 - n) u - (n - 1) u^2 / 2), so Gauss nodes over the part above exp(-40) give all of it. Below the middle the other tail is used.
    """
    upper = 2 * k >= n + 1
    far = F.when(upper, k).otherwise(n - k + 1)
    slope, bend = (2 * far - 1 - n).cast("double"), F.greatest(n - 1, F.lit(1)).cast("double")
    end = F.least(F.lit(1.0), 80 / (slope + F.sqrt(slope * slope + 80 * bend)))
    nodes = F.array(*[F.struct(F.lit((1 + x) / 2).alias("x"), F.lit(w / 2).alias("w")) for x, w in zip(NODES, WEIGHTS, strict=True)])
    # At u = 1 the integrand is 0, or 1 where k is 1: no node is there.
    value = lambda u: F.exp((far - 1) * F.log1p(-u) + (n - far) * F.log1p(u))
    tail = _half_pmf(far, n) * far * end * F.aggregate(nodes, F.lit(0.0), lambda a, p: a + p["w"] * value(end * p["x"]))
    return F.when(k > n, F.lit(0.0)).when(k <= 0, F.lit(1.0)).when(upper, F.least(F.lit(1.0), tail)).otherwise(F.greatest(F.lit(0.0), 1 - tail))


def mcnemar(pairs: DataFrame, control: str, treatment: str, alternative: str = "greater", by: Sequence[str] = ()) -> DataFrame:
    """(n_pairs, gains, losses, p) of paired booleans, per group: exact binomial over the discordant pairs; 1 without any."""
    a, b = F.col(control), F.col(treatment)
    counts = pairs.filter(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(~a & b).alias("gains"), F.count_if(a & ~b).alias("losses"))
    n = F.col("gains") + F.col("losses")
    tail = {"greater": binomial_half_tail(F.col("gains"), n), "less": binomial_half_tail(F.col("losses"), n), "two-sided": F.least(F.lit(1.0), 2 * binomial_half_tail(F.greatest("gains", "losses"), n))}[alternative]
    return counts.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(tail))


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "key", q: float = 0.1) -> DataFrame:
    """Adds rank, q_value and rejected; ties by key.

    Tests are put in parts by quantiles of p: a rank is one within the part and the tests of the parts below, and the least value from a rank on
    is that of the rest of the part and of the parts above. So no task sorts all tests.
    """
    cut, totals = in_parts(tests, p)
    few = W.partitionBy(F.lit(0)).orderBy("_part")  # at most as many rows as parts
    counts = totals.withColumn("_ahead", F.coalesce(F.sum("_n").over(few.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_m", F.sum("_n").over(W.partitionBy(F.lit(0))))
    own = W.partitionBy("_part")
    ranked = cut.join(F.broadcast(counts), "_part").withColumn("rank", (F.row_number().over(own.orderBy(p, key)) + F.col("_ahead")).cast("int"))
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("rank"))
    least = raw.groupBy("_part").agg(F.min("_raw").alias("_least"))
    above = least.select("_part", F.min("_least").over(few.rowsBetween(1, W.unboundedFollowing)).alias("_above"))
    rest = F.min("_raw").over(own.orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0))
    out = raw.withColumn("_rest", rest).join(F.broadcast(above), "_part").withColumn("q_value", F.least(F.lit(1.0), F.col("_rest"), F.col("_above")))
    return out.withColumn("rejected", F.col("q_value") <= q).select(*tests.columns, "rank", "q_value", "rejected")


def in_parts(rows: DataFrame, order: str, parts: int = 64) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_part``, ascending with a number by its quantiles, and (_part, _n)."""
    cuts = sorted({float(x) for x in rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01)})
    part = reduce(lambda a, b: a + b, [(F.col(order) > c).cast("int") for c in cuts], F.lit(0))
    cut = rows.withColumn("_part", part)
    return cut, cut.groupBy("_part").agg(F.count("*").alias("_n"))


def normal_cdf(x: Column) -> Column:
    """Of a standard normal, by a series near 0 and a continued fraction in the tails (better than 1e-12)."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(x.alias("t"), x.alias("s")), lambda a, i: F.struct((a["t"] * x * x / (2 * i + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * i + 1)).alias("s")))["s"]
    density = F.exp(-x * x / 2) / F.sqrt(2 * F.pi())
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda a, i: i / (F.abs(x) + a))
    tail = density / (F.abs(x) + fraction)
    return F.when(F.abs(x) < 5, 0.5 + density * series).when(x > 0, 1 - tail).otherwise(tail)


#: Signed-rank tests of at most so many pairs, none tied or equal, take the exact distribution.
EXACT_PAIRS = 50


def signed_rank_counts(n: Column) -> Column:
    """How many of the 2^n choices of ranks from 1..n sum to 0, 1, 2, ...: rank by rank, each adds the counts before it shifted by the rank."""
    whole = lambda x: F.floor(x).cast("int")
    add = lambda counts, i: F.zip_with(F.concat(counts, F.array_repeat(F.lit(0.0), i)), F.concat(F.array_repeat(F.lit(0.0), i), counts), lambda a, b: a + b)
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), whole(n))), F.array(F.lit(1.0)), add)).otherwise(F.array(F.lit(1.0)))


def wilcoxon(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided signed-rank test of paired rates, per group: (n, w, z, p, exact). Zeros are dropped, ties get mid-ranks.

    p is exact for up to ``EXACT_PAIRS`` pairs of which none are equal and no two move alike; else it is that of the normal approximation,
    corrected for ties. p is 1 where nothing moved. Differences are ranked at 12 digits.
    """
    d = F.round(F.col(b).cast("double") - F.col(a).cast("double"), 12)
    told = pairs.select(*by, d.alias("d")).filter("d is not null")
    at = told.groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    from .ranks import running

    moved = F.when(F.col("size") > 0, F.col("t")).otherwise(F.lit(0))
    ranked = running(at.withColumn("m", moved), by, "size", "m").withColumn("mid", F.col("m_below") + (F.col("m") + 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.sum(F.when(F.col("m") > 0, F.col("up") * F.col("mid")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("m") > 0, (F.col("t") - F.col("up")) * F.col("mid")).otherwise(0.0)).alias("minus"),
        F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).alias("ties"), F.sum(F.col("t") - F.col("m")).alias("zeros"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = (F.least("plus", "minus") - n * (n + 1) / 4) / spread
    few = (F.col("n") <= EXACT_PAIRS) & (F.col("ties") == 0) & (F.col("zeros") == 0) & (F.col("n") > 0)
    below = F.aggregate(F.slice(signed_rank_counts(F.when(few, F.col("n")).otherwise(F.lit(0))), F.lit(1), F.least("plus", "minus").cast("int") + 1), F.lit(0.0), lambda x, c: x + c)
    p = F.when(few, 2 * below / F.pow(F.lit(2.0), n)).otherwise(2 * normal_cdf(F.col("z")))
    told = sums.select(*by, "n", F.least("plus", "minus").alias("w"), F.when(n > 0, z).alias("z"), "plus", "minus", "ties", "zeros")
    return told.select(*by, "n", F.when(n > 0, F.col("w")).alias("w"), "z", F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), p)).alias("p"), F.coalesce(few, F.lit(False)).alias("exact"))
