"""Rank statistics: can a single number tell the label? Sorted counts and running sums, never pairs of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def running(df: DataFrame, by: Sequence[str], order: str, *columns: str, parts: int = 64, once: bool = True) -> DataFrame:
    """Adds ``<column>_below``: the sum over rows of the group with a smaller ``order`` (a number, unique in the group).

    The order of all rows is cut at its quantiles. Running sums are taken within a group's part, and the totals of the parts below, of which a
    group has at most ``parts``, are added. So no task sorts a whole group, however many rows it has. ``once``: the rows are written first, since quantiles,
    totals and sums each read them; not needed where they are.
    """
    df = written(df, "running") if once else df
    below = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    value = F.col(order).cast("double")
    cuts = sorted({float(x) for x in df.select(value.alias("o")).approxQuantile("o", [k / parts for k in range(1, parts)], 0.01)})
    if not cuts:
        return df.withColumns({f"{c}_below": F.lit(0) for c in columns})
    cut = df.withColumn("_part", reduce(lambda a, b: a + b, [F.coalesce(value > c, F.lit(False)).cast("int") for c in cuts]))
    totals = cut.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    first = W.partitionBy(*(by or [F.lit(0)])).orderBy("_part")
    ahead = totals.select(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], F.col("_part").alias("_at"), *[below(f"_{c}", first).alias(f"_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col("_part") == F.col("_at"), *[F.col(b).eqNullSafe(F.col(f"_by{k}")) for k, b in enumerate(by)]])
    w = W.partitionBy(*by, "_part").orderBy(order)
    summed = cut.withColumns({f"{c}_below": below(c, w) for c in columns}).join(ahead if by else F.broadcast(ahead), same)  # without a group at most ``parts`` rows
    return summed.withColumns({f"{c}_below": F.col(f"{c}_below") + F.col(f"_{c}") for c in columns}).select(*df.columns, *[f"{c}_below" for c in columns])


def auc(rows: DataFrame, value: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """P(positive above negative) + P(tie) / 2, per group; 0.5 where a class is empty. Null values are left out."""
    at = rows.filter(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    summed = running(at, by, "_v", "q").groupBy(*by).agg(F.sum(F.col("p") * (F.col("q_below") + F.col("q") * 0.5)).alias("won"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    whole = F.col("n_pos") * F.col("n_neg")
    return summed.select(*by, "n_pos", "n_neg", F.when(whole > 0, F.col("won") / whole).otherwise(F.lit(0.5)).alias("auc"))


def folded(column: Column) -> Column:
    return F.greatest(column, 1 - column)


def attainable_auc(rows: DataFrame, value: str, label: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """The range of the AUC over relabellings within clusters, per group: only pairs of clusters of one value each are fixed.

    A row without a cluster leaves everything attainable, (0, 1). Clusters of one value are summed by that value, so
    no pairs of clusters are formed.
    """
    per = rows.groupBy(*by, cluster).agg(F.min(value).alias("v"), (F.min(value) == F.max(value)).alias("still"), F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    total = per.groupBy(*by).agg((F.sum("p") * F.sum("q")).alias("total"), F.bool_or(F.col(cluster).isNull()).alias("loose"), (F.sum(F.when(F.col("still"), F.col("p"))) * F.sum(F.when(F.col("still"), F.col("q")))).alias("fixed_pairs"))
    at = per.filter("still").groupBy(*by, "v").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    fixed = running(at, by, "v", "q").groupBy(*by).agg(F.sum(F.col("p") * (F.col("q_below") + F.col("q") * 0.5)).alias("fixed"))
    low = F.coalesce(F.col("fixed"), F.lit(0.0)) / F.col("total")
    high = (F.coalesce(F.col("fixed"), F.lit(0.0)) + F.col("total") - F.coalesce(F.col("fixed_pairs"), F.lit(0))) / F.col("total")
    joined = total.join(fixed, list(by), "left") if by else total.join(fixed)  # one row each
    pick = lambda x, loose: F.when(F.coalesce("loose", F.lit(False)), F.lit(loose)).when(F.coalesce("total", F.lit(0)) == 0, F.lit(0.5)).otherwise(x)
    return joined.select(*by, pick(low, 0.0).alias("low"), pick(high, 1.0).alias("high"))


def candidate_scores(rows: DataFrame, value: str, label: str, cluster: str) -> DataFrame:
    """(cluster, v, c, chosen, score): per cluster with exactly one positive and some negative, and per value there, how many members hold it, whether the
    positive does, and the score that each of them would have as the positive: its mid-rank among the others. Null values are left out.

    Mid-ranks come from sorted counts by value, in parts, so a cluster may be of any size.
    """
    known = rows.filter(F.col(cluster).isNotNull() & F.col(value).isNotNull() & F.col(label).isNotNull())
    at = known.groupBy(F.col(cluster).alias("_k"), F.col(value).alias("v")).agg(F.count("*").alias("c"), F.count_if(F.col(label)).alias("p"))
    whole = at.groupBy(F.col("_k").alias("_of")).agg(F.sum("p").alias("_p"), F.sum("c").alias("_n")).filter("_p = 1 and _n > 1")
    kept = at.join(whole, F.col("_k") == F.col("_of"))
    score = (F.col("c_below") + 0.5 * (F.col("c") - 1)) / (F.col("_n") - 1)
    return running(kept, ["_k"], "v", "c").select(F.col("_k").alias(cluster), "v", "c", (F.col("p") == 1).alias("chosen"), score.alias("score"))


def matched(rows: DataFrame, value: str, label: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Matched AUC and its exact null: SE, attainable range, z, and the z of the dispersion."""
    source = rows.filter(F.col(cluster).isNotNull()).withColumn("_c", F.struct(*by, cluster) if by else F.col(cluster))
    scored = candidate_scores(source, value, label, "_c")
    square = (F.col("score") - 0.5) * (F.col("score") - 0.5)
    mean = lambda x: F.sum(F.col("c") * x) / F.sum("c")
    observed = F.max(F.when(F.col("chosen"), F.col("score")))
    per = scored.groupBy("_c").agg(observed.alias("observed"), mean(square).alias("e2"), mean(square * square).alias("e4"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    per = per.withColumn("d", (F.col("observed") - 0.5) * (F.col("observed") - 0.5))
    names = [F.col(f"_c.{b}").alias(b) for b in by]
    out = per.groupBy(*names).agg(
        F.count("*").alias("n_clusters"), F.avg("observed").alias("matched_auc"), (F.sqrt(F.sum("e2")) / F.count("*")).alias("null_se"), F.avg("lo").alias("low"), F.avg("hi").alias("high"),
        (F.sum("d") - F.sum("e2")).alias("_excess"), F.sum(F.col("e4") - F.col("e2") * F.col("e2")).alias("_var"),
    )
    z = F.when(F.col("null_se") > 0, F.abs(F.col("matched_auc") - 0.5) / F.col("null_se")).otherwise(F.lit(0.0))
    return out.withColumns({"z": z, "dispersion_z": F.when(F.col("_var") > 1e-12, F.col("_excess") / F.sqrt("_var")).otherwise(F.lit(0.0))}).drop("_excess", "_var")


def long_form(rows: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """One row per row and feature: (feature, value, *keep)."""
    return rows.select(*keep, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("feature", "value"))


def depth1(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most training rows (feature, value, label) that one threshold on one feature, or none, gets right, per group."""
    at = written(rows.groupBy(*by, "feature", "value").agg(F.count_if(F.col("label")).alias("p"), F.count_if(~F.col("label")).alias("q")), "depth1")
    keys = [*by, "feature"]
    whole = at.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    cut = running(at, keys, "value", "p", "q", once=False).join(whole, same).withColumns({"lp": F.col("p_below") + F.col("p"), "lq": F.col("q_below") + F.col("q")})
    right = F.greatest("lp", "lq") + F.greatest(F.col("np") - F.col("lp"), F.col("nq") - F.col("lq"))
    return cut.groupBy(*by).agg(F.max(right).alias("right"))


def stump(rows: DataFrame, names: Sequence[str], label: str, row_id: str, outer_cuts: int = 16) -> DataFrame:
    """(n, majority, depth1, depth2): accuracies of the best stumps. Outer cuts are at each n // 16th row where the value changes.

    Counts by value give all cuts of a feature, and the sides of all cuts are then searched at once as groups of ``depth1``.
    """
    slim = written(rows.select(row_id, F.col(label).alias("label"), *names), "stump")  # read four times
    n = slim.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "n long, majority double, depth1 double, depth2 double")
    long = long_form(slim, names, row_id, "label")
    step = max(1, n // outer_cuts)
    # The row after which the value changes is the last of its value: its place is the number of rows up to the value.
    counted = running(long.groupBy("feature", "value").agg(F.count("*").alias("c")), ["feature"], "value", "c").withColumn("at", F.col("c_below") + F.col("c"))
    cuts = counted.filter((F.col("at") % step == 0) & (F.col("at") < n)).select(F.col("feature").alias("outer"), F.col("value").alias("edge"))
    # At most 2 * outer_cuts cuts a feature: a small table, met by each row once per cut.
    sides = slim.join(F.broadcast(cuts), F.lit(True)).withColumn("left", F.element_at(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))]), F.col("outer")) <= F.col("edge"))
    inner = depth1(long_form(sides, names, "outer", "edge", "left", "label"), ["outer", "edge", "left"])
    best2 = inner.groupBy("outer", "edge").agg(F.sum("right").alias("right")).agg(F.max("right").alias("two"))
    best1 = depth1(long).select(F.col("right").alias("one"))
    base = slim.agg(F.count("*").alias("n"), F.greatest(F.count_if(F.col("label")), F.count_if(~F.col("label"))).alias("major"))
    return base.join(best1).join(best2).select("n", (F.col("major") / F.col("n")).alias("majority"), (F.col("one") / F.col("n")).alias("depth1"), (F.greatest(F.col("one"), F.coalesce("two", F.lit(0))) / F.col("n")).alias("depth2"))
