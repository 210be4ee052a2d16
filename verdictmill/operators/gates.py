"""Whole gates: documents that have fallen behind, modules that nothing calls, published numbers, runs that may not start. Each gives rows (key, message) and is empty when it passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import anchor_findings, normalise_markup
from .guards import require, union_issues
from .integrity import apply_baseline, reachable

#: How many commits a document's subject may move past its review; what decorates a published number.
CEILING = 10
DECORATION = "~%,"


def drift_findings(living: DataFrame, reviewed: DataFrame, movements: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """Over documents (document) that people are expected to have read, reviews (document, sha) and movements (document, commits: null where the review's commit is
    unknown): documents without a review, reviews of no such document, unknown commits, and documents whose subject moved more than ``ceiling`` commits."""
    docs, told = living.select("document").distinct(), reviewed.select("document", "sha").dropDuplicates(["document"])
    rows = lambda df, message: df.select(F.col("document").alias("key"), message.alias("message"))
    unread = rows(docs.join(told, "document", "left_anti"), F.lit("no review on record"))
    gone = rows(told.join(docs, "document", "left_anti"), F.lit("a review of no living document"))
    moved = movements.join(told, "document").join(docs, "document", "left_semi")
    unknown = rows(moved.filter("commits is null"), F.concat(F.lit("reviewed at an unknown commit "), F.col("sha")))
    behind = rows(moved.filter(F.col("commits") > ceiling), F.concat(F.col("commits").cast("string"), F.lit(f" commits behind, over {ceiling}")))
    return union_issues(unread, gone, unknown, behind)


def wiring_findings(floored: DataFrame, edges: DataFrame, entries: DataFrame, unwired: DataFrame) -> DataFrame:
    """Over modules with a floor (id), imports (src, dst), entry points (id) and modules declared unreachable (id): floored modules that no entry point reaches and
    nobody declares, and declared ones that are reached."""
    reached = reachable(edges, entries).select("id")
    rows = lambda df, message: df.select(F.col("id").cast("string").alias("key"), F.lit(message).alias("message"))
    inert = floored.select("id").distinct().join(reached, "id", "left_anti").join(unwired.select("id"), "id", "left_anti")
    return rows(inert, "has a floor and no caller").unionByName(rows(unwired.select("id").distinct().join(reached, "id", "left_semi"), "declared unwired and reached"))


def wiring_census(floored: DataFrame, edges: DataFrame, entries: DataFrame, unwired: DataFrame) -> DataFrame:
    """(floored, reached, unwired): how many modules have a floor, how many of them are reached, and how many are declared unreachable."""
    reached = reachable(edges, entries).select("id", F.lit(True).alias("there"))
    own = floored.select("id").distinct().join(reached, "id", "left").agg(F.count("*").alias("floored"), F.count_if("there").alias("reached"))
    return own.join(unwired.select("id").distinct().agg(F.count("*").alias("unwired")))  # a row each


def numeric_findings(claims: DataFrame) -> DataFrame:
    """Of claims (claim_id, value, quote, source_text, latest: a pattern or null, rounded: a number as written or null).

    The value has to stand in its quote. The last match of ``latest`` in the source, or of its group where it has one, has to be the value: corrections are
    appended. ``rounded`` has to be the value rounded to as many places as it is written with, half to even on the digits as written.
    """
    inside = F.contains(normalise_markup(F.col("quote")), normalise_markup(F.col("value")))
    bare = lambda c: F.translate(c, DECORATION, "")
    value, shown = bare(F.col("value")), bare(F.col("rounded"))
    # A pattern with an empty alternative always matches once, and tells whether it has a group.
    last = F.try_element_at(F.regexp_extract_all("source_text", F.col("latest"), F.when(F.regexp_count(F.regexp_replace("latest", r"\\.|\(\?(?!P?<[A-Za-z])", ""), F.lit(r"\(")) > 0, 1).otherwise(0)), F.lit(-1))
    stale = F.when(last.isNull(), "no match of the pattern for later figures").when(last != F.col("value"), F.concat(F.lit("superseded by "), last))
    places = F.when(F.contains(shown, F.lit(".")), F.length(F.substring_index(shown, ".", -1))).otherwise(F.lit(0))
    exact, told = value.try_cast("decimal(38,15)"), shown.try_cast("decimal(38,15)")
    # Digits as written: the value lies within half a unit of the last place shown, and at the half the digit shown is even.
    unit = F.pow(F.lit(10.0), -places).cast("decimal(38,15)")
    off = F.abs(exact - told) * 2
    even = F.pmod((told / unit).cast("decimal(38,0)"), F.lit(2)) == 0
    right = (off < unit) | ((off == unit) & even)
    wrong = F.when(exact.isNull() | told.isNull(), "rounded is no number").when(~right, "wrongly rounded")
    messages = F.when(~inside, F.array(F.lit("value not in quote"))).otherwise(F.array_compact(F.array(F.when(F.col("latest").isNotNull(), stale), F.when(F.col("rounded").isNotNull(), wrong))))
    return claims.select("claim_id", F.explode(messages).alias("message"))


def claim_findings(claims: DataFrame) -> DataFrame:
    """(claim_id, message): whether each quote stands in its source once, and the numbers; what ``numeric_findings`` says of columns holds."""
    return anchor_findings(claims).filter("message <> 'value not in quote'").unionByName(numeric_findings(claims))


def reference_findings(claims: DataFrame, published: DataFrame) -> DataFrame:
    """Of a register's claims (claim_id, source) and what documents publish (claim_id, document): claims that nothing publishes, published ids (one row each, at their first
    document) that are not declared, and claims that their own source publishes, whose anchor would be rewritten from what it is to check."""
    declared, told = claims.select("claim_id", "source").distinct(), published.select("claim_id", "document").distinct()
    rows = lambda df, key, message: df.select(F.col(key).cast("string").alias("key"), F.lit(message).alias("message"), F.col("claim_id").cast("string").alias("claim"))
    idle = declared.select("claim_id").distinct().join(told, "claim_id", "left_anti")
    unknown = told.join(declared.select("claim_id"), "claim_id", "left_anti").groupBy("claim_id").agg(F.min("document").alias("document"))
    own = declared.join(told.withColumnRenamed("document", "source"), ["claim_id", "source"], "left_semi")
    return union_issues(rows(idle, "claim_id", "declared and not published"), rows(unknown, "document", "published and not declared"), rows(own, "source", "published by its own source"))


def trigger_set_findings(skills: DataFrame, sets: DataFrame, cases: DataFrame) -> DataFrame:
    """(key, message) of skills (skill), sets as filed (name, skill: as declared, error: why it does not read, or null) and their cases (name, should_fire): skills
    without a set, sets of no skill, and of the others those that do not read, declare another skill than they are filed under, or have no negative case."""
    known, filed = skills.select(F.col("skill").alias("name")).distinct(), sets.select("name", "skill", "error")
    rows = lambda df, message: df.select(F.col("name").alias("key"), message.alias("message"))
    bare = rows(known.join(filed, "name", "left_anti"), F.lit("no trigger set"))
    orphan = rows(filed.join(known, "name", "left_anti"), F.lit("a set of no skill"))
    held = filed.join(known, "name", "left_semi")
    torn, sound = rows(held.filter("error is not null"), F.col("error")), held.filter("error is null")
    other = rows(sound.filter(~F.col("skill").eqNullSafe(F.col("name"))), F.concat(F.lit("declares "), F.coalesce("skill", F.lit("no skill"))))
    negative = cases.filter("should_fire = false").select("name").distinct()
    return union_issues(bare, orphan, torn, other, rows(sound.join(negative, "name", "left_anti"), F.lit("no negative cases")))


def check_trigger_sets(skills: DataFrame, sets: DataFrame, cases: DataFrame, separability: DataFrame, routes: DataFrame, corpus_findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, message): everything wrong with the trigger sets. The findings of sets, lengths and routes (key, message) always count; those of the corpus rules only
    where the ``baseline`` (key) does not know them, and what the baseline knows and no longer occurs counts too: it may only shrink."""
    state = apply_baseline(corpus_findings, baseline)
    new = corpus_findings.join(state.filter("state = 'issue'").select("key"), "key", "left_semi").select("key", "message")
    stale = state.filter("state = 'stale'").select("key", F.lit("in the baseline and no longer found").alias("message"))
    return union_issues(trigger_set_findings(skills, sets, cases), separability, routes, new, stale)


def run_findings(plans: DataFrame) -> DataFrame:
    """Of planned runs (run, committed, skill, skill_sha256, analysis, analysis_sha256, baseline, low, high, budget, cost): why each may not start, in the order in which it
    is easiest to mend. An unknown baseline, cost or hash is a reason too; a baseline at an end of its band is within it, and a cost of the whole budget is affordable."""
    changed = lambda text, told: ~F.sha2(F.col(text), 256).eqNullSafe(F.col(told))
    why = [
        F.when(~F.coalesce("committed", F.lit(False)), "not committed"),
        F.when(changed("skill", "skill_sha256"), "the skill has changed"),
        F.when(changed("analysis", "analysis_sha256"), "the analysis has changed"),
        F.when(~F.coalesce(F.col("baseline").between(F.col("low"), F.col("high")), F.lit(False)), "the baseline leaves no room for a difference"),
        F.when(~F.coalesce(F.col("cost") <= F.col("budget"), F.lit(False)), "over its budget"),
    ]
    return plans.select(F.col("run").cast("string").alias("key"), F.explode(F.array_compact(F.array(*why))).alias("message"))


def assert_runnable(plans: DataFrame) -> DataFrame:
    """The plans, if none has a reason against it."""
    require(run_findings(plans), run_that_may_not_start=F.lit(True))
    return plans
