"""Scoring replies about casefiles by set logic: what was required, prohibited, unjustified; which conditions govern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("critical", "high", "moderate", "low", "none")


#: The sections of a reply.
SECTIONS = ("CONDITIONS", "EXPOSURE", "MISSING", "ACTIONS")


def sections(text: Column, names: tuple[str, ...] = SECTIONS) -> Column:
    """Struct of the text below each heading line, up to the next heading; empty without it."""
    any_name = "|".join(names)
    return F.struct(*[F.regexp_replace(F.regexp_extract(text, rf"(?ims)^\W*{n}\W*$\s*(.*?)(?=^\W*(?:{any_name})\W*$|\z)", 1), r"^\s+|\s+$", "").alias(n.lower()) for n in names])


def references(text: Column, pattern: str = r"(?i)\b(A\d+)\b") -> Column:
    """Distinct references in the order of their first mention, upper-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper))


def first_band(text: Column, bands: tuple[str, ...] = BANDS) -> Column:
    """The most severe band that the text names; null if it names none."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, bands)), lambda b: F.contains(F.lower(text), b)), F.lit(1))


def score(rows: DataFrame) -> DataFrame:
    """From arrays recommended, required, prohibited, unjustified, voted, governing: the verdict and its graded form."""
    taken = F.array_distinct("recommended")
    share = lambda part, whole, empty: F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(F.lit(empty))
    forbidden = F.array_union("prohibited", "unjustified")
    out = rows.withColumns(
        {
            "missing_required": F.array_sort(F.array_except("required", taken)), "took_prohibited": F.array_sort(F.array_intersect(taken, "prohibited")),
            "required_taken": share(F.array_intersect("required", taken), F.array_distinct("required"), 1.0), "forbidden_avoided": share(F.array_except(forbidden, taken), forbidden, 1.0),
            "condition_precision": share(F.array_intersect("voted", "governing"), F.array_distinct("voted"), 0.0), "condition_recall": share(F.array_intersect("voted", "governing"), F.array_distinct("governing"), 0.0),
        }
    )
    clean = (F.size("missing_required") == 0) & (F.size("took_prohibited") == 0) & ~F.arrays_overlap("recommended", "unjustified")
    return out.withColumns({"admissible": clean, "graded": (F.col("required_taken") + F.col("forbidden_avoided") + F.col("condition_recall")) / 3})


def diagnose(rows: DataFrame) -> DataFrame:
    """Adds what a verdict says besides admissibility: trap_hit, unjustified_hit, pivot_ok, named_an_unknown, exposure_ok, exposure_first_order, blocks_complete.

    ``rows``: recommended, traps, unjustified (arrays), missing (the text of that section), pivot_present, pivot_accepts (array), exposure, exposure_band,
    first_order_band, and blocks_found (array of section names). Without a pivot, the right answer is NONE.
    """
    missing = F.trim(F.coalesce("missing", F.lit("")))
    none = F.upper(missing).startswith("NONE")
    accepted = F.exists(F.coalesce("pivot_accepts", F.array().cast("array<string>")), lambda p: F.contains(F.lower(missing), F.lower(p)))
    same = lambda c: F.coalesce(F.col("exposure") == F.col(c), F.lit(False))
    return rows.withColumns(
        {
            "trap_hit": F.arrays_overlap("recommended", "traps"), "unjustified_hit": F.arrays_overlap("recommended", "unjustified"),
            "pivot_ok": F.when(F.coalesce("pivot_present", F.lit(False)), accepted).otherwise(none), "named_an_unknown": (missing != "") & ~none,
            "exposure_ok": same("exposure_band"), "exposure_first_order": same("first_order_band"), "blocks_complete": F.size(F.array_except(F.array(*map(F.lit, SECTIONS)), F.col("blocks_found"))) == 0,
        }
    )


def integrity_findings(cases: DataFrame) -> DataFrame:
    """(key, message): actions licensed by conditions that do not exist, conditions of unknown documents, duplicate ids.

    ``cases``: case_id, documents array<string>, conditions array<struct<id, source>>, actions array<struct<id, licensed_by array<string>>>.
    """
    ids = F.transform("conditions", lambda c: c["id"])
    bad = [
        F.transform(F.filter("conditions", lambda c: ~F.array_contains("documents", c["source"])), lambda c: F.concat(F.lit("unknown document of "), c["id"])),
        F.transform(F.filter("actions", lambda a: F.size(F.array_except(a["licensed_by"], ids)) > 0), lambda a: F.concat(F.lit("unknown licence of "), a["id"])),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.array(F.lit("duplicate condition"))).otherwise(F.array().cast("array<string>")),
    ]
    return cases.select(F.col("case_id").alias("key"), F.explode(F.concat(*bad)).alias("message"))


# Fixed values of a casefile.
STATUSES, TRAP_ORDERS = ("required", "prohibited", "optional"), ("none", "1", "2", "3")


def validate(cases: DataFrame) -> DataFrame:
    """(key, message) of hand-written casefiles; see ``integrity_findings`` for references.

    ``cases``: case_id, trap_order, documents array<string>, conditions array<struct<id, source, governs boolean>>, actions array<struct<id, status, failure_kind, licensed_by array<string>>>,
    exposure_band, first_order_band, pivot_present, pivot_accepts array<string>.
    """
    ids = F.transform("actions", lambda a: a["id"])
    of = lambda field, value: F.filter("actions", lambda a: F.coalesce(a[field] == value, F.lit(False)))
    governing = F.transform(F.filter("conditions", lambda c: c["governs"]), lambda c: c["id"])
    trap, none = F.size(of("failure_kind", "trap")) > 0, F.col("trap_order") == "none"
    plain = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("trap_order").isin(*TRAP_ORDERS), F.lit(False)), "unknown trap order"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate action"), F.when(F.size(of("status", "required")) == 0, "no required action"),
            F.when(F.size(of("failure_kind", "unjustified")) == 0, "no unjustified action"), F.when(F.size(governing) == 0, "no governing condition"), F.when(~F.coalesce(F.col("exposure_band").isin(*BANDS), F.lit(False)), "unknown exposure band"),
            F.when(F.col("first_order_band") == F.col("exposure_band"), "the wrong answer is the right one"), F.when(none & trap, "a control with a trap"), F.when(~none & ~trap, "no trap"),
            F.when(F.coalesce("pivot_present", F.lit(False)) & (F.coalesce(F.size("pivot_accepts"), F.lit(0)) <= 0), "a pivot without phrasings"),
        )
    )
    status = F.transform(F.filter("actions", lambda a: ~F.coalesce(a["status"].isin(*STATUSES), F.lit(False))), lambda a: F.concat(F.lit("unknown status of "), a["id"]))
    kind = F.transform(F.filter(of("status", "prohibited"), lambda a: a["failure_kind"].isNull()), lambda a: F.concat(F.lit("no failure kind of "), a["id"]))
    licensed = F.transform(F.filter(of("failure_kind", "unjustified"), lambda a: F.arrays_overlap(a["licensed_by"], governing)), lambda a: F.concat(F.lit("a governing condition licenses "), a["id"]))
    own = cases.select(F.col("case_id").alias("key"), F.explode(F.concat(plain, status, kind, licensed)).alias("message"))
    return own.unionByName(integrity_findings(cases))


def report(scored: DataFrame, ceiling: float = 0.9) -> DataFrame:
    """Rows (scope, n, admissible, trap_rate, graded, passes) by trap order and of all; the gates: admissibility below the ceiling, and traps of the second order and above that catch someone."""
    agg = [F.count("*").alias("n"), F.avg(F.col("admissible").cast("int")).alias("admissible"), F.avg(F.col("trap_hit").cast("int")).alias("trap_rate"), F.avg("graded").alias("graded")]
    per = scored.groupBy(F.concat(F.lit("order "), F.col("trap_order")).alias("scope")).agg(*agg).withColumn("passes", F.lit(None).cast("boolean"))
    whole = scored.agg(*agg).select(F.lit("all").alias("scope"), "n", "admissible", "trap_rate", "graded", (F.col("admissible") < ceiling).alias("passes"))
    deep = scored.filter(F.col("trap_order").isin("2", "3")).agg(*agg).select(F.lit("deep").alias("scope"), "n", "admissible", "trap_rate", "graded", (F.coalesce("trap_rate", F.lit(0.0)) > 0).alias("passes"))
    return per.unionByName(whole).unionByName(deep)


def rescore_report(pairs: DataFrame) -> DataFrame:
    """One row over (case_id, was boolean, admissible boolean, graded): rates before and after, verdicts that flipped each way, distinct graded values."""
    was, now = F.col("was"), F.col("admissible")
    return pairs.agg(F.count("*").alias("n"), F.avg(was.cast("int")).alias("was"), F.avg(now.cast("int")).alias("now"), F.count_if(~was & now).alias("to_ok"), F.count_if(was & ~now).alias("to_fail"), F.count_distinct(F.round("graded", 3)).alias("graded_values"))


def flipped(pairs: DataFrame) -> DataFrame:
    """(case_id, change): the verdicts of (case_id, was boolean, admissible boolean) that a re-score turned over, or gave where there was none."""
    was, now = F.col("was"), F.col("admissible")
    change = F.when(was.isNull() & now.isNotNull(), "new").when(~was & now, "now admissible").when(was & ~now, "no longer admissible").when(was.isNotNull() & now.isNull(), "lost")
    return pairs.withColumn("change", change).filter("change is not null").select("case_id", "change")
