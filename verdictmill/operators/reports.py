"""Results as lines of fixed width, made by the engine so that a report is a table like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("    n/a")).otherwise(F.format_string("%6.1f%%", value * 100))


def rate_lines(rates: DataFrame, name: str) -> DataFrame:
    """A line per group of a scorecard."""
    body = F.concat(F.rpad(F.coalesce(F.col(name).cast("string"), F.lit("-")), 12, " "), *[percent(F.col(c)) for c in ("accuracy", "precision", "recall", "fpr")], F.when(F.col("mcc").isNull(), F.lit("     n/a")).otherwise(F.format_string("%8.3f", "mcc")))
    return rates.select(name, body.alias("line"))


def confusion_lines(rates: DataFrame) -> DataFrame:
    lines = F.array(F.format_string("%-12s%10s%10s", F.lit(""), F.lit("fires"), F.lit("silent")), F.format_string("%-12s%10.1f%10.1f", F.lit("should"), F.col("tp").cast("double"), F.col("fn").cast("double")), F.format_string("%-12s%10.1f%10.1f", F.lit("should not"), F.col("fp").cast("double"), F.col("tn").cast("double")))
    return rates.select(F.posexplode(lines).alias("at", "line"))


def kind_lines(kinds: DataFrame) -> DataFrame:
    return kinds.select("kind", F.concat(F.rpad("kind", 16, " "), F.lpad(F.col("n_items").cast("string"), 6, " "), percent(F.col("fpr")), F.lit("  ["), percent(F.col("low")), F.lit(","), percent(F.col("high")), F.lit("]")).alias("line"))


def interval_lines(estimates: DataFrame, name: str) -> DataFrame:
    return estimates.select(name, F.format_string("%s %.4f [%.4f, %.4f]", name, "point", "low", "high").alias("line"))


def routing_lines(routing: DataFrame) -> DataFrame:
    """A line per procedure of ``routing_by_procedure``: items, records, and the three rates."""
    share = lambda c: F.when(F.col(c).isNull(), F.lit("     --")).otherwise(F.format_string("%7.3f", c))
    return routing.select("target", F.concat(F.format_string("%-10s %6d %5d ", "target", "n_items", "n_records"), share("item_mean"), F.lit(" "), share("record_mean"), F.lit(" "), share("answered_mean")).alias("line"))


def comparison_lines(items: DataFrame, a: str, b: str, p: DataFrame) -> DataFrame:
    """(at, line) of two arms over shared items (case, <a>, <b>: shares right) and the row (p) of their test."""
    facts = items.agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.count("*").alias("n"), F.count_if(F.col(a) > F.col(b)).alias("wins_a"), F.count_if(F.col(b) > F.col(a)).alias("wins_b")).join(p.select("p"))
    lines = F.array(
        F.format_string("%-24s accuracy %.4f", F.lit(a), F.col("a")), F.format_string("%-24s accuracy %.4f", F.lit(b), F.col("b")),
        F.format_string(f"%d of %d item(s) differ -- %d favour {a}, %d favour {b}", F.col("wins_a") + F.col("wins_b"), F.col("n"), F.col("wins_a"), F.col("wins_b")), F.format_string("paired test over %d item(s): p = %.4f", F.col("n"), F.col("p")),
    )
    return facts.select(F.posexplode(lines).alias("at", "line"))


def item_lines(analysis: DataFrame) -> DataFrame:
    """(at, line) of the row of ``item_analysis``."""
    number = lambda c: F.when(F.col(c).isNull(), F.lit("--")).otherwise(F.format_string("%.3f", c))
    lines = F.array(F.format_string("items scored          %d", "n_items"), F.concat(F.lit("median difficulty     "), number("median_p")), F.concat(F.lit("median discrimination "), number("median_r")), F.format_string("undefined             %d", "undefined_r"))
    return analysis.select(F.posexplode(lines).alias("at", "line"))
