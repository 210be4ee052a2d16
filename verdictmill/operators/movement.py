"""Movement of quantities between a base and its variants: threshold, falsifiers, Youden's J."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import interval_state, relative_movement
from .guards import require
from .resample import bootstrap_mean


def base_pairs(rows: DataFrame) -> DataFrame:
    """(triplet_id, q0, q1) from rows of repeats 0 and 1; an incomplete pair is refused."""
    wide = rows.groupBy("triplet_id").pivot("repeat", [0, 1]).agg(F.max("quantity")).withColumnsRenamed({"0": "q0", "1": "q1"})
    return require(wide, incomplete_pair=F.col("q0").isNull() | F.col("q1").isNull(), zero_base=F.col("q0") == 0)


def movement_threshold(pairs: DataFrame) -> DataFrame:
    """(threshold, triplet_id): the largest movement between two repeats of a base; of equals the smallest id."""
    moved = pairs.select("triplet_id", relative_movement(F.col("q0"), F.col("q1")).alias("m"))
    return moved.agg(F.max("m").alias("threshold"), F.min_by("triplet_id", F.struct(-F.col("m"), F.col("triplet_id"))).alias("triplet_id"))


def changes(events: DataFrame, threshold: DataFrame) -> DataFrame:
    """Adds ``governing`` and ``matched``: did the variant move by more than the threshold (one row)."""
    rows = events.join(F.broadcast(threshold.select("threshold")))
    return rows.withColumns({k: (relative_movement(F.col("q_base"), F.col(f"q_{k}")) > F.col("threshold")) for k in ("governing", "matched")}).drop("threshold")


def falsifier_battery(cases: DataFrame, threshold: DataFrame) -> DataFrame:
    """(n_cases, sensitivity, specificity, passed) over planted cases: the share whose governing verdict is as expected, and the same
    of the matched one. No case is refused."""
    told = changes(cases, threshold)
    as_wanted = lambda c: F.avg((F.col(c) == F.col(f"expect_{c}_change")).cast("int"))
    out = told.agg(F.count("*").alias("n_cases"), as_wanted("governing").alias("sensitivity"), as_wanted("matched").alias("specificity"))
    out = require(out, no_case=F.col("n_cases") == 0)
    return out.withColumn("passed", (F.col("sensitivity") == 1.0) & (F.col("specificity") == 1.0))


def youden_j(events: DataFrame, threshold: DataFrame, replicates: int = 1000, seed: int = 0, kill: float = 0.70) -> DataFrame:
    """J = P(governing moved) - P(matched moved), bootstrapped over triplets, and the state of its interval."""
    diff = changes(events, threshold).withColumn("d", F.col("governing").cast("int") - F.col("matched").cast("int"))
    out = bootstrap_mean(diff, "d", "triplet_id", replicates, seed)
    return out.select(F.col("point").alias("j"), "low", "high", "se", (F.col("point") >= kill).alias("kill"), interval_state(F.col("low"), F.col("high"), kill).alias("state"))


def phase_result(events: DataFrame, threshold: DataFrame, battery: DataFrame, replicates: int = 1000, seed: int = 0, kill: float = 0.70, adequate: float = 0.85) -> DataFrame:
    """(j, low, high, se, state, sensitivity, specificity, kill, least, disposition) of events; refused unless the one row of ``battery`` (passed) has passed:
    an extractor that misses known movements measures nothing."""
    require(battery, falsifier_battery_not_passed=~F.coalesce("passed", F.lit(False)))
    require(battery.agg(F.count("*").alias("n")), no_falsifier_battery=F.col("n") == 0)
    j = youden_j(events, threshold, replicates, seed, kill).drop("kill")
    rates = rates_of_change(events, threshold).select("n", "sensitivity", "specificity")
    return disposition(j.join(rates), kill, adequate)  # a row each


def disposition(results: DataFrame, kill: float = 0.70, adequate: float = 0.85) -> DataFrame:
    """Adds ``kill``, ``least`` and ``disposition`` to rows (j, low, high, sensitivity, specificity): J is never told without the lesser of the two."""
    least = F.least("sensitivity", "specificity")
    base = F.format_string("J = %.3f [%.3f, %.3f], min(sensitivity, specificity) = %.3f", "j", "low", "high", least)
    end = F.when(F.col("j") < kill, "the venue survives").when(least < adequate, "killed, but not both arms are adequate").otherwise("the venue closes")
    return results.withColumns({"kill": F.col("j") >= kill, "least": least, "disposition": F.concat(base, F.lit(": "), end)})


def rates_of_change(events: DataFrame, threshold: DataFrame) -> DataFrame:
    """(n, n_governing, n_matched, sensitivity, specificity, j) of events."""
    told = changes(events, threshold).agg(F.count("*").alias("n"), F.count_if("governing").alias("n_governing"), F.count_if("matched").alias("n_matched"))
    sensitivity, specificity = F.col("n_governing") / F.col("n"), 1 - F.col("n_matched") / F.col("n")
    return told.withColumns({"sensitivity": sensitivity, "specificity": specificity, "j": sensitivity + specificity - 1})
