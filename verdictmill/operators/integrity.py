"""Joins that keep records honest: re-scoring, baselines, coverage, last write wins, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Written
from .guards import require, union_issues


def last_write_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest ``order`` per key (unique per key); a partial aggregate, no sort of whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def rescore(verdicts: DataFrame, key: DataFrame, version: int, source: str) -> DataFrame:
    """Verdicts with label and route of another version of the key; ``covers`` is emptied where the route changed.

    ``key``: case, new_label, new_route. A verdict whose case the key lacks is refused.
    """
    joined = verdicts.join(key, "case", "left")
    require(joined, case_not_in_key=F.col("new_label").isNull())
    stale = ~F.col("route").eqNullSafe(F.col("new_route"))
    return joined.select(
        *[c for c in verdicts.columns if c not in ("should_fire", "route", "covers", "set_version")],
        F.col("new_label").alias("should_fire"), F.col("new_route").alias("route"), F.when(~stale, F.col("covers")).alias("covers"),
        F.lit(version).alias("set_version"), F.lit(source).alias("rescored_from"), F.col("set_version").alias("rescored_from_set_version"), (stale & F.col("covers").isNotNull()).alias("covers_stale"),
    )


def stamp(rows: DataFrame, version: int) -> DataFrame:
    """Sets the version of unstamped rows; another one already there is refused."""
    require(rows, stamped_otherwise=F.col("set_version").isNotNull() & (F.col("set_version") != version))
    return rows.withColumn("set_version", F.lit(version))


def stale_labels(rows: DataFrame, key: DataFrame) -> DataFrame:
    """Distinct cases whose stored label or route is not the key's (case, new_label, new_route)."""
    joined = rows.join(key, "case")
    return joined.filter((F.col("should_fire") != F.col("new_label")) | ~F.col("route").eqNullSafe(F.col("new_route"))).select("case").distinct()


def apply_baseline(findings: DataFrame, baseline: DataFrame, key: str = "key") -> DataFrame:
    """(key, state): new findings are issues, known ones deferred, and entries that nothing finds any more are stale."""
    f, b = findings.select(key).distinct().withColumn("_f", F.lit(True)), baseline.select(key).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "issue").when(F.col("_f").isNull(), "stale").otherwise("deferred")
    return f.join(b, key, "full_outer").select(key, state.alias("state"))


def panels(ledger: DataFrame) -> DataFrame:
    """(case, judges): judges whose last verdict of the case is readable."""
    return last_write_wins(ledger, ["case", "judge"], "line_no").filter("adjudicated is not null").groupBy("case").agg(F.array_sort(F.collect_set("judge")).alias("judges"))


def adjudicated_cases(ledger: DataFrame, least: int = 3) -> DataFrame:
    return panels(ledger).filter(F.size("judges") >= least).select("case")


def unbridged(runs: DataFrame, bridges: DataFrame) -> DataFrame:
    """(a, va, b, vb): pairs of runs (name, version, case) that share cases under different versions, with no bridge (name, version) between them.

    What a case says of two versions is the same for all runs that have it: cases are reduced to the sets of runs by version that share them, which are few,
    before runs meet.
    """
    per = runs.select("case", "name", "version").distinct().groupBy("case").agg(F.array_sort(F.collect_set(F.struct("name", "version"))).alias("_runs"))
    kinds = per.groupBy("_runs").agg(F.count("*").alias("shared"))
    each = kinds.select("shared", "_runs", F.explode("_runs").alias("x")).select("shared", F.col("x.name").alias("a"), F.col("x.version").alias("va"), F.explode("_runs").alias("y"))
    met = each.select("shared", "a", "va", F.col("y.name").alias("b"), F.col("y.version").alias("vb")).filter((F.col("a") < F.col("b")) & (F.col("va") != F.col("vb")))
    pairs = met.groupBy("a", "va", "b", "vb").agg(F.sum("shared").alias("shared"))
    over = bridges.select(F.col("name").alias("a"), F.col("version").alias("vb"))
    back = bridges.select(F.col("name").alias("b"), F.col("version").alias("va"))
    return pairs.join(over, ["a", "vb"], "left_anti").join(back, ["b", "va"], "left_anti")


def containing_key(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """Names of keys (name, id) that hold every one of ``ids`` (id)."""
    wanted = ids.select("id").distinct()
    n = wanted.agg(F.count("*").alias("n"))
    return keys.join(wanted, "id").groupBy("name").agg(F.count_distinct("id").alias("held")).join(n, F.col("held") == F.col("n")).select("name")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): what only the left or only the right has."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed entries of two manifests."""
    both = before.select(key, F.col(value).alias("_x"), F.lit(True).alias("_a")).join(after.select(key, F.col(value).alias("_y"), F.lit(True).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def agreement_share(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Over common keys: how many values agree (null agrees with null)."""
    both = left.select(key, F.col(value).alias("_x")).join(right.select(key, F.col(value).alias("_y")), key)
    same = F.col("_x").eqNullSafe(F.col("_y"))
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.avg(same.cast("int")).alias("share"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) that edges (src, dst) lead to from roots (id), breadth first; each id at its least depth.

    Each level is written and is the next one's front, so neither the plan nor the lineage grows with the depth. A null end of an edge leads nowhere.
    """
    seen = Written(edges.sparkSession, "reachable")
    links = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    n, depth = seen.add(roots.select("id").filter("id is not null").distinct().withColumn("depth", F.lit(0))), 0
    while n:
        depth += 1
        ahead = seen.last.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        n = seen.add(ahead.join(seen.read().select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
    return seen.read()


def longest_prefix(names: DataFrame, prefixes: DataFrame, name: str = "name", prefix: str = "prefix", shortest: int = 1) -> DataFrame:
    """Per name the longest registered prefix. Each name is looked up by its own prefixes, an equi-join."""
    own = names.select(name, F.explode(F.transform(F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.length(name))), lambda k: F.substr(F.col(name), F.lit(1), k))).alias(prefix))
    return own.join(prefixes.select(prefix).distinct(), prefix).groupBy(name).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


def running_budget(rows: DataFrame, by: str, order: str, cost: str, limit: float) -> DataFrame:
    """Rows up to the limit of the running cost in their group, and whether each is affordable."""
    from pyspark.sql import Window as W

    spent = F.sum(cost).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).withColumn("affordable", F.col("spent") <= limit)


def identified(control: DataFrame, ablated: DataFrame, ablate: str) -> DataFrame:
    """Breaches of an ablation (node_name, report): other nodes, the ablated one still reporting, a survivor that differs."""
    both = control.select("node_name", F.col("report").alias("x"), F.lit(True).alias("a")).join(ablated.select("node_name", F.col("report").alias("y"), F.lit(True).alias("b")), "node_name", "full_outer")
    gone = F.col("node_name") == ablate
    why: Column = F.when(F.col("a").isNull() | F.col("b").isNull(), "node set differs").when(gone & F.col("y").isNotNull(), "ablated node reports").when(~gone & ~F.col("x").eqNullSafe(F.col("y")), "survivor differs")
    return both.select("node_name", why.alias("why")).filter("why is not null")


def sparse_attributes(*columns: str) -> Column:
    """A map of the columns that are not null."""
    entries = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def occurrences(text: Column, quote: Column) -> Column:
    return F.when(F.length(quote) > 0, (F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).otherwise(F.lit(0)).cast("long")


def adjudication_findings(keys: DataFrame, runs: DataFrame, covered: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, message): keys (key, case) and runs (run, key, case) with cases that no panel covers (case), but for baselined keys (key); and baselined keys that are covered, or are none."""
    exempt = baseline.select("key").distinct()
    open_keys = keys.join(covered.select("case"), "case", "left_anti").groupBy("key").agg(F.count_distinct("case").alias("n"))
    open_runs = runs.join(covered.select("case"), "case", "left_anti").join(exempt, "key", "left_anti").groupBy(F.col("run").alias("key")).agg(F.count_distinct("case").alias("n"))
    say = lambda df, text: df.select("key", F.lit(text).alias("message"))
    known = keys.select("key").distinct()
    return union_issues(
        say(open_keys.join(exempt, "key", "left_anti"), "cases without a panel"), say(open_runs, "a run with cases without a panel"),
        say(exempt.join(known, "key", "left_semi").join(open_keys, "key", "left_anti"), "is baselined and covered"), say(exempt.join(known, "key", "left_anti"), "is baselined and no key"),
    )
