"""Scorecards over verdicts (case, repeat, fired, should_fire, ...). ``fired`` is null where a reply could not be read:
such rows are counted and left out of every rate, never taken for "did not fire"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import mcc, rate, wilson

BANDS = ("s", "m", "l", "xl")
CELLS = ("tp", "fp", "tn", "fn")


def in_order(column: Column, order: Sequence[str] = BANDS) -> Column:
    """Sort key of a vocabulary; values outside it come last."""
    position = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1))


def _cells(fired: Column, label: Column, weight: Column | None = None) -> list[Column]:
    """The confusion cells, counted, or summed by weight."""
    conditions = (fired & label, fired & ~label, ~fired & ~label, ~fired & label)
    if weight is None:
        return [F.count_if(c).alias(n) for n, c in zip(CELLS, conditions, strict=True)]
    return [F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0)).alias(n) for n, c in zip(CELLS, conditions, strict=True)]


def rates_of(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, FPR, MCC, base rate and majority baseline beside the cells."""
    tp, fp, tn, fn = map(F.col, CELLS)
    n = tp + fp + tn + fn
    return cells.withColumns(
        {
            "accuracy": rate(tp + tn, n), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "fpr": rate(fp, fp + tn),
            "mcc": mcc(tp, fp, tn, fn), "base_rate": rate(tp + fn, n), "majority": F.greatest(rate(tp + fn, n), rate(fp + tn, n)),
        }
    )


def per_item_fire_rates(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(case, should_fire, fire_rate, n_parsed) of the cases with a parsed verdict."""
    return verdicts.groupBy(*by, "case").agg(F.bool_or("should_fire").alias("should_fire"), F.avg(F.col("fired").cast("int")).alias("fire_rate"), F.count("fired").alias("n_parsed")).filter("n_parsed > 0")


def per_item_correctness(verdicts: DataFrame) -> DataFrame:
    """(case, correct): share of the parsed verdicts that are right."""
    return verdicts.groupBy("case").agg(F.avg((F.col("fired") == F.col("should_fire")).cast("int")).alias("correct")).filter("correct is not null")


def summarise(verdicts: DataFrame, by: Sequence[str] = (), weight: str = "record") -> DataFrame:
    """The scorecard, per group: by record, or with every item counted once (its shares of fired and not fired).

    One pass over the verdicts; item weights are a second, partial aggregate on the case.
    """
    unread = F.count_if(F.col("fired").isNull()).alias("unparseable")
    if weight == "record":
        return rates_of(verdicts.groupBy(*by).agg(*_cells(F.col("fired"), F.col("should_fire")), unread))
    items = verdicts.groupBy(*by, "case").agg(F.bool_or("should_fire").alias("label"), F.avg(F.col("fired").cast("int")).alias("p"), unread)
    label, p = F.col("label"), F.col("p")
    cells = {"tp": F.when(label, p), "fp": F.when(~label, p), "tn": F.when(~label, 1 - p), "fn": F.when(label, 1 - p)}
    summed = items.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in cells.items()], F.sum("unparseable").alias("unparseable"))
    return rates_of(summed)


def missed(verdicts: DataFrame) -> DataFrame:
    """Positive cases with a parsed verdict that never fired."""
    return verdicts.groupBy("case").agg(F.bool_or("should_fire").alias("label"), F.bool_or("fired").alias("ever")).filter("label and not ever").select("case")


def covers_rates(verdicts: DataFrame, n_entries: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    covers = F.col("covers").cast("int")
    chance = F.lit(1.0 / n_entries if n_entries else None).cast("double")
    return verdicts.groupBy(*by).agg(F.count("covers").alias("n_labelled"), F.avg(covers).alias("covers_all"), F.avg(F.when(F.col("fired"), covers)).alias("covers_fired")).withColumn("chance", chance)


def acceptable_routes(routes: Column, rule: str) -> Column:
    """``first`` accepts the first route alone, ``any`` all of them."""
    return F.slice(routes, 1, 1) if rule == "first" else routes


def routing_by_procedure(verdicts: DataFrame, rule: str) -> DataFrame:
    """Per acceptable procedure: hit rate by item, by record, and over records that named a procedure."""
    hit = F.array_contains(F.col("accepted"), F.col("procedure"))
    rows = verdicts.filter(F.size("routes") > 0).withColumn("accepted", acceptable_routes(F.col("routes"), rule)).withColumn("hit", F.coalesce(hit, F.lit(False)).cast("int"))
    spread = rows.select("case", "procedure", "hit", F.explode("accepted").alias("target"))
    items = spread.groupBy("target", "case").agg(F.avg("hit").alias("item_rate"), F.sum("hit").alias("hits"), F.count("*").alias("n"), F.count("procedure").alias("answered"))
    return items.groupBy("target").agg(
        F.count("*").alias("n_items"), F.sum("n").alias("n_records"), F.avg("item_rate").alias("item_mean"),
        (F.sum("hits") / F.sum("n")).alias("record_mean"), rate(F.sum("hits"), F.sum("answered")).alias("answered_mean"),
    )


def fpr_by_kind(verdicts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """False-positive rate per kind of negative, with a score interval over items."""
    items = verdicts.filter("not should_fire and kind is not null").groupBy("kind", "case").agg(F.avg(F.col("fired").cast("int")).alias("p"), F.count("fired").alias("n")).filter("n > 0")
    kinds = items.groupBy("kind").agg(F.count("*").alias("n_items"), F.sum("n").alias("n_records"), F.avg("p").alias("fpr"))
    low, high = wilson(F.col("fpr"), F.col("n_items"), confidence)
    return kinds.withColumns({"low": low, "high": high}).orderBy(F.desc("n_items"), "kind")


def evaluate_routing(verdicts: DataFrame) -> DataFrame:
    """Right, wrong and unlabelled choices of the rows that chose a procedure."""
    chosen = verdicts.filter("procedure is not null")
    right = F.array_contains("routes", F.col("procedure"))
    labelled = F.size("routes") > 0
    return chosen.agg(F.count_if(labelled & right).alias("correct"), F.count_if(labelled & ~right).alias("wrong"), F.count_if(~labelled).alias("unlabelled"))


def stability(verdicts: DataFrame) -> DataFrame:
    """Cases whose parsed verdict or procedure varies over their repeats."""
    per = verdicts.groupBy("case").agg(F.count_distinct("fired").alias("verdicts"), F.count_distinct("procedure").alias("procedures"))
    return per.agg(F.count("*").alias("n_cases"), F.count_if(F.col("verdicts") > 1).alias("fired_varies"), F.count_if(F.col("procedures") > 1).alias("procedure_varies"))


def parse_rate(cases: DataFrame, verdicts: DataFrame, repeats: int) -> DataFrame:
    """Readable verdicts over the whole grid of cases and repeats: a missing row counts as unread."""
    grid = cases.select("case").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    told = verdicts.groupBy("case", "repeat").agg(F.count("fired").alias("read"))
    joined = grid.join(told, ["case", "repeat"], "left")
    return joined.agg(F.count("*").alias("cells"), F.count_if(F.coalesce("read", F.lit(0)) > 0).alias("parsed"))


def top_cues(rows: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k most common lower-cased values; of equals the alphabetically first."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias("cue")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cue").limit(k)


def band_adjusted_gap(verdicts: DataFrame, band: str = "band") -> DataFrame:
    """Mean of the within-band gaps between positives and negatives, weighted by rows; bands without either are left out."""
    value = F.col("fired").cast("int")
    bands = verdicts.filter("fired is not null").groupBy(band).agg(F.avg(F.when(F.col("should_fire"), value)).alias("p"), F.avg(F.when(~F.col("should_fire"), value)).alias("q"), F.count("*").alias("n"))
    both = bands.filter("p is not null and q is not null")
    return both.agg((F.sum((F.col("p") - F.col("q")) * F.col("n")) / F.sum("n")).alias("gap"), F.count("*").alias("n_bands"))


def votes(ledger: DataFrame) -> DataFrame:
    """Adjudication per case: how the panel's readable votes move, contest or confirm the label."""
    agree = F.count_if(F.col("adjudicated") == F.col("label"))
    per = ledger.groupBy("case").agg(F.count("adjudicated").alias("n_votes"), agree.alias("agree"), F.count("*").alias("n_judges"))
    moves = (F.col("n_votes") > 0) & (2 * F.col("agree") < F.col("n_votes"))
    unanimous = (F.col("agree") == F.col("n_judges")) & (F.col("n_judges") > 0)
    return per.withColumns({"moves": moves, "unanimous": unanimous}).withColumn("contested", ~F.col("moves") & ~F.col("unanimous"))


def separated(kinds: DataFrame) -> DataFrame:
    """(kind, other): pairs of kinds (kind, fpr, low, high; a row each, few) where the rate of the other lies outside the kind's interval."""
    other = kinds.select(F.col("kind").alias("other"), F.col("fpr").alias("_fpr"))
    pairs = kinds.join(F.broadcast(other), F.col("kind") != F.col("other"))
    return pairs.filter(~F.col("_fpr").between(F.col("low"), F.col("high"))).select("kind", "other")


def mean_confidence(rows: DataFrame, verdict: str = "verdict", confidence: str = "confidence") -> DataFrame:
    """Mean of the confidences that are given, per verdict; null where none is."""
    return rows.filter(F.col(verdict).isNotNull()).groupBy(verdict).agg(F.avg(confidence).alias("confidence"), F.count(confidence).alias("n"))


def losses(rows: DataFrame, by: str) -> DataFrame:
    """(by, lost, n): rows without a readable verdict of each slice, over all rows."""
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias(by)).agg(F.count_if(F.col("fired").isNull()).alias("lost"), F.count("*").alias("n"))


def calibration_gate(records: DataFrame, floor: float = 0.95, band: tuple[float, float] = (0.35, 0.75)) -> DataFrame:
    """Two gates over records (template_id, n_distractors, position, correct, parsed), as rows (scope, name, clean, loaded, n, passes).

    Every template's records without distractors have to reach the floor, the rest as a whole has to lie in the band. One pass, by grouping sets.
    """
    right = F.coalesce(F.col("correct").cast("int"), F.lit(0))
    clean, loaded = F.avg(F.when(F.col("n_distractors") == 0, right)), F.avg(F.when(F.col("n_distractors") > 0, right))
    sets = records.select("template_id", F.col("n_distractors").cast("string").alias("n_distractors"), F.when(F.col("n_distractors") > 0, F.col("position")).alias("position"), right.alias("right"), (F.col("n_distractors") == 0).alias("is_clean"))
    clean, loaded = F.avg(F.when(F.col("is_clean"), F.col("right"))), F.avg(F.when(~F.col("is_clean"), F.col("right")))
    keys = ["template_id", "n_distractors", "position"]
    out = sets.groupingSets([[F.col(k)] for k in keys] + [[]], *keys).agg(F.grouping_id().alias("g"), clean.alias("clean"), loaded.alias("loaded"), F.count("*").alias("n"))
    scope = F.when(F.col("g") == 3, "template").when(F.col("g") == 5, "distractors").when(F.col("g") == 6, "position").otherwise("all")
    passes = F.when(F.col("g") == 3, F.coalesce(F.col("clean") >= floor, F.lit(True))).when(F.col("g") == 7, F.col("loaded").between(*band))
    named = F.when(F.col("g") == 3, F.col("template_id")).when(F.col("g") == 5, F.col("n_distractors")).when(F.col("g") == 6, F.col("position"))
    return out.filter("g <> 6 or position is not null").select(scope.alias("scope"), named.alias("name"), "clean", "loaded", "n", passes.alias("passes"))


def template_spread(records: DataFrame) -> DataFrame:
    """(n_templates, spread): standard deviation of the templates' accuracies; null for one."""
    per = records.groupBy("template_id").agg(F.avg(F.coalesce(F.col("correct").cast("int"), F.lit(0))).alias("a"))
    return per.agg(F.count("*").alias("n_templates"), F.stddev_samp("a").alias("spread"))


def corpus_weighted(verdicts: DataFrame, positive: float = 1 / 3) -> DataFrame:
    """(rate): the fire rates of positives and negatives at the corpus's shares; null where a class has no readable verdict."""
    value = F.col("fired").cast("int")
    both = verdicts.agg(F.avg(F.when(F.col("should_fire"), value)).alias("p"), F.avg(F.when(~F.col("should_fire"), value)).alias("q"))
    return both.select((F.col("p") * positive + F.col("q") * (1 - positive)).alias("rate"))


def rates_by(verdicts: DataFrame, by: str, confidence: float = 0.95) -> DataFrame:
    """(by, n, rate, low, high): the fire rate of each slice over its readable verdicts, with a score interval."""
    per = verdicts.filter("fired is not null").groupBy(F.coalesce(F.col(by).cast("string"), F.lit("None")).alias(by)).agg(F.count("*").alias("n"), F.avg(F.col("fired").cast("int")).alias("rate"))
    low, high = wilson(F.col("rate"), F.col("n"), confidence)
    return per.withColumns({"low": low, "high": high})
