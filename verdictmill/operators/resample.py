"""Resampling with a keyed hash as the random source: the same draws on any partitioning and in any engine.

A cluster bootstrap needs no items: the mean of the items of the drawn clusters is a ratio of two sums over
clusters, so (sum, n) per cluster is all that is resampled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rates import design_effect
from ..sources.scratch import written
from .guards import require


def draw(*parts: Column | str | int) -> Column:
    """A number in [0, 2^32) of an MD5 over the parts."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Up to so many clusters, their numbered sums (16 bytes each, in blocks of 2^BITS) are broadcast to the draws; more are joined by shuffle, with the same result.
BROADCAST_CLUSTERS = 1_000_000
BITS = 10
#: Draws of a task, at most.
TASK_DRAWS = 1 << 22
#: How clusters are drawn, at any number of them: ``draws`` takes K of K with replacement, ``poisson`` gives each cluster a Poisson number of mean 1.
SCHEMES = ("draws", "poisson")


def cluster_sums(rows: DataFrame, value: str, cluster: str) -> DataFrame:
    """(cluster, s, n): the sum and number of the values of each cluster."""
    return rows.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))


def sum_blocks(sums: DataFrame) -> DataFrame:
    """(block, s, n): the clusters numbered in order from 0, the sums of 2^BITS numbers in a row as arrays. Each task sorts one range of the clusters, and no task all of them."""
    dealt = written(sums.repartitionByRange("cluster").withColumn("_part", F.spark_partition_id()), "clusters")
    ahead = dealt.groupBy("_part").agg(F.count("*").alias("_size")).select(F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    placed = dealt.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy("cluster")) - 1).join(F.broadcast(ahead), F.col("_part") == F.col("_at"))  # a row per part
    at = F.col("_k") + F.col("_ahead")
    packed = placed.groupBy(F.shiftright(at, BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct(at.alias("k"), "s", "n"))).alias("x"))
    return packed.select("block", F.transform("x", lambda x: x["s"]).alias("s"), F.transform("x", lambda x: x["n"]).alias("n"))


def poisson_weight(u: Column, most: int = 12) -> Column:
    """How often a Poisson variable of mean 1 is drawn at a uniform ``u`` in [0, 1): its quantile."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += p
        steps.append(F.when(u >= total, 1).otherwise(0))
        p /= k + 1
    return reduce(lambda a, b: a + b, steps)


def replicate_means(rows: DataFrame, value: str, cluster: str, replicates: int, seed: int | str, scheme: str = "draws") -> DataFrame:
    """(r, mean) of the bootstrap replicates: K of K clusters with replacement, item-weighted. Refused below two clusters.

    By the ``poisson`` scheme each takes part in a replicate a Poisson number of times, of mean 1, by its own keyed hash: for many clusters the same
    distribution, in one pass over the clusters, without numbers, a join or a shuffle of the draws. The caller chooses; the number of clusters changes nothing.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}, not {scheme!r}")
    sums = written(cluster_sums(rows, value, cluster), "sums")
    n = sums.count()
    require(rows.sparkSession.range(1), fewer_than_two_clusters=F.lit(n < 2))
    if scheme == "poisson":
        spread = sums.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        weighted = spread.withColumn("w", poisson_weight(draw(seed, F.col("r"), F.col("cluster")) / F.lit(2.0**32)))
        return weighted.groupBy(F.col("r").cast("long").alias("r")).agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    blocks = sum_blocks(sums)
    blocks = F.broadcast(blocks) if n <= BROADCAST_CLUSTERS else blocks
    # The draws are a range that tasks count up: a sequence of n in a plan would be a literal that the driver holds and sends with each task.
    draws = rows.sparkSession.range(0, replicates * n, 1, max(rows.sparkSession.sparkContext.defaultParallelism, -(-replicates * n // TASK_DRAWS))).select(F.expr(f"id div {n}").alias("r"), F.expr(f"id % {n}").alias("j"))
    drawn = draws.select("r", F.coalesce(F.pmod(draw(seed, F.col("r"), F.col("j")), F.lit(n)), F.lit(0)).alias("k"))  # never null: a join tests a key that might be, and so would hash twice
    chosen = drawn.select("r", F.shiftright("k", BITS).alias("block"), F.col("k").bitwiseAND((1 << BITS) - 1).cast("int").alias("at")).join(blocks, "block")
    return chosen.groupBy("r").agg((F.sum(F.get("s", "at")) / F.sum(F.get("n", "at"))).alias("mean"))


def interval(means: DataFrame, column: str = "mean", confidence: float = 0.95) -> DataFrame:
    """(low, high, se): linear percentiles, and the standard deviation of the replicates, 0 for one."""
    low = (1 - confidence) / 2
    return means.agg(F.percentile(column, low).alias("low"), F.percentile(column, 1 - low).alias("high"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("se"))


def bootstrap_mean(rows: DataFrame, value: str, cluster: str, replicates: int = 1000, seed: int | str = 0, confidence: float = 0.95, scheme: str = "draws") -> DataFrame:
    """One row: point, low, high, se, n_items, n_clusters. For paired differences pass the difference as the value."""
    facts = rows.agg(F.avg(F.col(value).cast("double")).alias("point"), F.count(value).alias("n_items"), F.count_distinct(cluster).alias("n_clusters"))
    return facts.join(interval(replicate_means(rows, value, cluster, replicates, seed, scheme), confidence=confidence))


def bootstrap_two_sample(control: DataFrame, treatment: DataFrame, value: str, cluster: str, replicates: int = 1000, seed: int = 0, confidence: float = 0.95, scheme: str = "draws") -> DataFrame:
    """Difference of two disjoint groups, each resampled by itself."""
    a = replicate_means(control, value, cluster, replicates, f"{seed}c", scheme).withColumnRenamed("mean", "a")
    b = replicate_means(treatment, value, cluster, replicates, f"{seed}t", scheme).withColumnRenamed("mean", "b")
    both = a.join(b, "r").select((F.col("b") - F.col("a")).alias("mean"))
    mean = lambda df, name: df.agg(F.avg(F.col(value).cast("double")).alias(name))
    point = mean(control, "a").join(mean(treatment, "b")).select((F.col("b") - F.col("a")).alias("point"))
    return point.join(interval(both, confidence=confidence))


def intraclass_correlation(rows: DataFrame, value: str, cluster: str) -> DataFrame:
    """One row: icc (ICC(1), unequal sizes, within [0, 1]), n_items, n_clusters, mean_size. 0 if all clusters are single."""
    v = F.col(value).cast("double")
    per = rows.filter(v.isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))
    t = per.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    between = F.col("B") - F.col("S") * F.col("S") / F.col("N")
    within = F.col("SS") - F.col("B")
    msb, msw = F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("N") - F.col("k"))
    m0 = F.try_divide(F.col("N") - F.col("nn") / F.col("N"), F.col("k") - 1)
    below = msb + (m0 - 1) * msw
    icc = F.when((F.col("N") > F.col("k")) & (below > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (msb - msw) / below))).otherwise(F.lit(0.0))
    return t.select(icc.alias("icc"), F.col("N").alias("n_items"), F.col("k").alias("n_clusters"), (F.col("N") / F.col("k")).alias("mean_size"))


def bootstrap_rate(verdicts: DataFrame, cluster: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Accuracy by item with a cluster bootstrap, the ICC of items in clusters, the design effect and the effective number of items."""
    items = verdicts.groupBy(cluster, "case").agg(F.avg((F.col("fired") == F.col("should_fire")).cast("int")).alias("v")).filter("v is not null")
    icc = intraclass_correlation(items, "v", cluster).select("icc", "mean_size")
    out = bootstrap_mean(items, "v", cluster, replicates, seed).join(icc)
    return out.withColumn("deff", design_effect(F.col("mean_size"), F.col("icc"))).withColumn("n_effective", F.col("n_items") / F.col("deff")).drop("mean_size")


def bootstrap_rate_difference(control: DataFrame, treatment: DataFrame, cluster: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Difference of two groups of items; a case in both is refused."""
    require(control.select("case").distinct().join(treatment.select("case").distinct(), "case"), case_in_both_groups=F.lit(True))
    items = lambda df: df.groupBy(cluster, "case").agg(F.avg((F.col("fired") == F.col("should_fire")).cast("int")).alias("v")).filter("v is not null")
    return bootstrap_two_sample(items(control), items(treatment), "v", cluster, replicates, seed)


def permutation_test(rows: DataFrame, diff: str, item: str, replicates: int = 1000, seed: int = 0, alternative: str = "greater") -> DataFrame:
    """Sign flips of paired differences: observed mean and p = (hits + 1) / (replicates + 1)."""
    d = F.col(diff).cast("double")
    items = rows.filter(d.isNotNull()).select(F.col(item).alias("i"), d.alias("d"))
    sign = F.when(draw(seed, F.col("r"), F.col("i")) % 2 == 0, 1.0).otherwise(-1.0)
    flips = items.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).groupBy("r").agg((F.sum(F.col("d") * sign) / F.count("*")).alias("null"))
    seen = items.agg((F.sum("d") / F.count("*")).alias("observed"), F.count("*").alias("n"))
    e = 1e-12  # ties count as hits, whatever order the sums were taken in
    hit = {"greater": F.col("null") >= F.col("observed") - e, "less": F.col("null") <= F.col("observed") + e, "two-sided": F.abs("null") >= F.abs("observed") - e}[alternative]
    return flips.join(seen).groupBy("n", "observed").agg(((F.count_if(hit) + 1) / (F.count("*") + 1)).alias("p"))


