"""Item analysis over respondents (arm, repeat): difficulty, discrimination, broken items, joint outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .guards import require


def respondent_grid(verdicts: DataFrame) -> DataFrame:
    """(case, respondent, correct) of the parsed verdicts; nothing is imputed."""
    return verdicts.filter("fired is not null").select("case", "should_fire", F.concat_ws(":", "arm", "repeat").alias("respondent"), (F.col("fired") == F.col("should_fire")).cast("int").alias("correct"))


def item_difficulty(grid: DataFrame) -> DataFrame:
    return grid.groupBy("case").agg(F.avg("correct").alias("p"), F.count("*").alias("n"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate; null where either side is constant."""
    top = F.avg(x * y) - F.avg(x) * F.avg(y)
    below = F.sqrt((F.avg(x * x) - F.avg(x) * F.avg(x)) * (F.avg(y * y) - F.avg(y) * F.avg(y)))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(top, below))


def item_discrimination(grid: DataFrame) -> DataFrame:
    """Correlation of an item with the respondent's total over the other items; null for fewer than three respondents."""
    rest = F.sum("correct").over(W.partitionBy("respondent")) - F.col("correct")
    rows = grid.withColumns({"x": F.col("correct").cast("double"), "y": rest.cast("double")})
    return rows.groupBy("case").agg(F.count("*").alias("n"), pearson(F.col("x"), F.col("y")).alias("r")).withColumn("r", F.when(F.col("n") >= 3, F.col("r")))


def broken_items(grid: DataFrame) -> DataFrame:
    """Items that all or none got right, by label."""
    rated = grid.groupBy("case").agg(F.avg("correct").alias("p"), F.bool_or("should_fire").alias("label"))
    return rated.filter("p = 0 or p = 1").groupBy("label", F.col("p").cast("int").alias("p")).agg(F.count("*").alias("n_items"))


def broken_item_list(grid: DataFrame) -> DataFrame:
    """(case, label, p, n) of the items that all (p = 1) or none (p = 0) got right."""
    return grid.groupBy("case").agg(F.bool_or("should_fire").alias("label"), F.avg("correct").alias("p"), F.count("*").alias("n")).filter("p = 0 or p = 1")


def triple_joint(grid: DataFrame, triples: DataFrame) -> DataFrame:
    """Per triple, among respondents who answered all its items, the share that got all right; null if there is none. A row without a triple is refused."""
    require(triples, case_without_triple=F.col("triple").isNull())
    sizes = triples.groupBy("triple").agg(F.count_distinct("case").alias("size"))
    per = grid.join(triples.select("case", "triple").distinct(), "case").groupBy("triple", "respondent").agg(F.count_distinct("case").alias("answered"), F.min("correct").alias("all_right"))
    joined = per.join(sizes, "triple")
    whole = F.col("answered") == F.col("size")
    return joined.groupBy("triple").agg(F.count_if(whole).alias("n_complete"), F.avg(F.when(whole, F.col("all_right"))).alias("joint"))


def item_analysis(grid: DataFrame) -> DataFrame:
    """One row: items, medians of difficulty and discrimination, items without a discrimination."""
    both = item_difficulty(grid).select("case", "p").join(item_discrimination(grid).select("case", "r"), "case")
    return both.agg(F.count("*").alias("n_items"), F.percentile("p", 0.5).alias("median_p"), F.percentile("r", 0.5).alias("median_r"), F.count_if(F.col("r").isNull()).alias("undefined_r"))
