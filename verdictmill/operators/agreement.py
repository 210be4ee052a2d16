"""Agreement of raters over the long form (unit, rater, label). All from category counts per unit, never from pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import require


def category_counts(ratings: DataFrame) -> DataFrame:
    """(unit, label, c, m): count of a label in a unit and the unit's observed ratings."""
    counts = ratings.filter("label is not null").groupBy("unit", "label").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("unit").agg(F.sum("c").alias("m"))
    return counts.join(sizes, "unit")


def percent_agreement(ratings: DataFrame) -> DataFrame:
    """Agreeing over all pairs within units; null where no unit has two ratings."""
    per = category_counts(ratings).groupBy("unit").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("agree"), (F.max("m") * (F.max("m") - 1) / 2).alias("pairs"))
    return per.agg(F.sum("agree").alias("agree"), F.sum("pairs").alias("pairs")).withColumn("agreement", F.try_divide("agree", "pairs"))


def unanimity(ratings: DataFrame, require_complete: bool = True) -> DataFrame:
    """Share of all units whose ratings are one label; a gap fails a unit if completeness is required."""
    per = ratings.groupBy("unit").agg(F.count_distinct("label").alias("kinds"), F.count_if(F.col("label").isNull()).alias("gaps"))
    same = (F.col("kinds") == 1) & ((F.col("gaps") == 0) if require_complete else F.lit(True))
    return per.agg(F.count("*").alias("n_units"), F.count_if(same).alias("n_unanimous")).withColumn("rate", F.col("n_unanimous") / F.col("n_units"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters with margins of their own; kappa null where chance explains all."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("observed"))
    left = both.groupBy(F.col(a).alias("label")).agg(F.count("*").alias("x"))
    right = both.groupBy(F.col(b).alias("label")).agg(F.count("*").alias("y"))
    chance = left.join(right, "label").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    out = total.join(chance).withColumn("expected", F.col("xy") / (F.col("n") * F.col("n")))
    return out.select("n", "observed", "expected", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """(n_units, raters, observed, expected, kappa). Units must have equally many ratings, two at least, and no gaps."""
    sizes = ratings.groupBy("unit").agg(F.count("*").alias("m"), F.count("label").alias("seen"))
    width = sizes.agg(F.min("m").alias("low"), F.max("m").alias("high"), F.min(F.col("seen") - F.col("m")).alias("gap"))
    require(width, ragged_or_incomplete_units=(F.col("low") != F.col("high")) | (F.col("gap") != 0) | (F.col("low") < 2))
    counts = category_counts(ratings)
    per = counts.groupBy("unit").agg(((F.sum(F.col("c") * F.col("c")) - F.max("m")) / (F.max("m") * (F.max("m") - 1))).alias("p"), F.max("m").alias("m"))
    observed = per.agg(F.count("*").alias("n_units"), F.max("m").alias("raters"), F.avg("p").alias("observed"), F.sum("m").alias("total"))
    pooled = counts.groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    out = observed.join(pooled).withColumn("expected", F.col("cc") / (F.col("total") * F.col("total")))
    return out.select("n_units", "raters", "observed", "expected", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """(n_units, n_dropped, alpha) for nominal labels; units with fewer than two ratings are dropped and counted."""
    units = ratings.select("unit").distinct().agg(F.count("*").alias("all_units"))
    used = category_counts(ratings).filter("m >= 2")
    inner = used.groupBy("unit").agg(((F.max("m") * F.max("m") - F.sum(F.col("c") * F.col("c"))) / (F.max("m") - 1)).alias("off"), F.max("m").alias("m"))
    disagree = inner.agg(F.count("*").alias("n_units"), F.sum("off").alias("off"), F.sum("m").alias("n"))
    pooled = used.groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    expected = (F.col("n") * F.col("n") - F.col("cc")) / (F.col("n") - 1)
    out = disagree.join(pooled).join(units)
    return out.select("n_units", (F.col("all_units") - F.col("n_units")).alias("n_dropped"), F.when(expected > 0, 1 - F.col("off") / expected).alias("alpha"))


def complete(ratings: DataFrame) -> DataFrame:
    """The ratings, if none is missing and all units have as many raters, two at least; else refused."""
    sizes = ratings.groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("gaps"))
    ends = sizes.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("gaps").alias("gaps"))
    require(ends, missing_rating=F.col("gaps") > 0, ragged_units=F.col("low") != F.col("high"), fewer_than_two_raters=F.col("low") < 2)
    return ratings
