"""How much repeats of the same item scatter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import intraclass_correlation


def aptitude(rows: DataFrame, score: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(aptitude, unreliability, mean): the high percentile, its distance from the low one, the mean. Exact, linear."""
    s = F.col(score).cast("double")
    return rows.agg(F.percentile(s, high).alias("aptitude"), (F.percentile(s, high) - F.percentile(s, low)).alias("unreliability"), F.avg(s).alias("mean"))


def per_item(rows: DataFrame, score: str, item: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Means over the items with two repeats at least of the same three, and the ICC of items."""
    s = F.col(score).cast("double")
    items = rows.groupBy(item).agg(F.count(s).alias("n"), F.percentile(s, high).alias("a"), F.percentile(s, low).alias("b"), F.avg(s).alias("m")).filter("n >= 2")
    means = items.agg(F.count("*").alias("n_items"), F.avg("a").alias("aptitude"), F.avg(F.col("a") - F.col("b")).alias("unreliability"), F.avg("m").alias("mean"))
    return means.join(intraclass_correlation(rows, score, item).select("icc"))
