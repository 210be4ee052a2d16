"""Published runs and what vouches for them: directories, answer keys, predictions, corrections, decisions, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .guards import require, union_issues
from .integrity import apply_baseline, unbridged
from .ranks import running

# Names of run directories, lines of a README, links to notes.
RUN_NAME = r"^(\d{4}-\d{2}-\d{2})-([0-9a-f]{7})(?:-[a-z0-9-]+)?$"
ANSWER_KEY = r"(?m)^\*\*Answer key:\*\*\s*\[?`?([^`\]\s]+)`?\]?[^\n]*?\bv(\d+)\b"
PREDICTION = r"(?m)^Prediction:[^\n]*?(notebook/[a-z0-9-]+\.md)"
OUTCOME = r"(?m)^(?:Outcome|Write-up):[^\n]*?(notebook/[a-z0-9-]+\.md)"
NOTE = r"notebook/[a-z0-9-]+\.md"


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """(path, name): the directories two levels below ``root``, whatever is in them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    below = lambda p: [x.getPath() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []
    rows = [(str(run.toUri().getPath()), run.getName()) for skill in below(at) for run in below(skill)]
    return spark.createDataFrame(sorted(rows), "path string, name string")


def record_versions(rows: DataFrame, file: str = "path", line: str = "value") -> DataFrame:
    """(path, versions) from JSON lines: a line that is no object counts for nothing, one without a version has 1, one that is no whole number counts for nothing."""
    v = F.try_parse_json(line)
    at = F.try_variant_get(v, "$.set_version", "variant")
    version = F.when(at.isNull(), F.lit(1)).when(F.schema_of_variant(at) == "BIGINT", F.try_variant_get(v, "$.set_version", "int"))
    told = rows.filter(F.schema_of_variant(v).startswith("OBJECT")).select(F.col(file).alias("path"), version.alias("version"))
    return told.groupBy("path").agg(F.array_sort(F.collect_set("version")).alias("versions"))


def answer_key(readme: Column) -> Column:
    """Struct (path, version) that a README declares; null without such a line."""
    return F.when(readme.rlike(ANSWER_KEY), F.struct(F.regexp_extract(readme, ANSWER_KEY, 1).alias("path"), F.regexp_extract(readme, ANSWER_KEY, 2).cast("int").alias("version")))


def links(readme: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(readme, F.lit(pattern), F.lit(0 if pattern == NOTE else 1))))


def run_issues(runs: DataFrame, notes: DataFrame, ancestry: DataFrame | None = None) -> DataFrame:
    """(key, message) of runs (path, name, readme, versions array<int>): name, README, answer key, prediction, dead links.

    ``notes``: path, first_commit of the notes there are. ``ancestry`` (older, younger) holds pairs of commits; without it, the order is not checked.
    """
    key = answer_key(F.col("readme"))
    first = F.try_element_at(F.regexp_extract_all("readme", F.lit(PREDICTION), F.lit(1)), F.lit(1))
    rows = runs.select("path", "name", "readme", F.coalesce("versions", F.array().cast("array<int>")).alias("versions"), key.alias("declared"), first.alias("prediction"), F.nullif(F.regexp_extract("name", RUN_NAME, 2), F.lit("")).alias("commit"))
    has = F.col("readme").isNotNull()
    others = F.filter("versions", lambda v: v != F.col("declared.version"))
    plain = F.array_compact(
        F.array(
            F.when(F.col("commit").isNull(), "name"), F.when(~has, "no README"), F.when(has & F.col("declared").isNull(), "no answer key"), F.when(F.size(others) > 0, "records of another version"),
            F.when(has & F.col("prediction").isNull(), "no prediction"),
        )
    )
    told = rows.select(F.col("path").alias("key"), F.explode(plain).alias("message"))
    known = notes.select(F.col("path").alias("note"), "first_commit")
    predicted = rows.filter("prediction is not null").join(known, F.col("prediction") == F.col("note"), "left")
    gone = predicted.filter("note is null").select(F.col("path").alias("key"), F.lit("prediction does not exist").alias("message"))
    dead = rows.filter(has).select("path", F.explode(links(F.col("readme"), NOTE)).alias("note")).join(known, "note", "left_anti").select(F.col("path").alias("key"), F.concat(F.lit("dead link "), F.col("note")).alias("message"))
    issues = [told, gone, dead]
    if ancestry is not None:
        dated = predicted.filter("note is not null and commit is not null")
        issues.append(dated.filter("first_commit is null").select(F.col("path").alias("key"), F.lit("prediction is not committed").alias("message")))
        later = dated.filter("first_commit is not null").join(ancestry.select(F.col("older").alias("first_commit"), F.col("younger").alias("commit")), ["first_commit", "commit"], "left_anti")
        issues.append(later.select(F.col("path").alias("key"), F.lit("prediction does not predate the run").alias("message")))
    return union_issues(*issues)


def provenance(runs: DataFrame, issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, state): runs with issues against the baseline (key) of run names; a baselined name without an issue is stale."""
    names = issues.join(runs.select(F.col("path").alias("key"), "name"), "key", "left").select(F.coalesce("name", "key").alias("key"))
    return apply_baseline(names, baseline)


def run_index(runs: DataFrame) -> DataFrame:
    """(path, version, predictions, outcomes): a line per run."""
    text = F.coalesce("readme", F.lit(""))
    return runs.select("path", answer_key(text)["version"].alias("version"), links(text, PREDICTION).alias("predictions"), links(text, OUTCOME).alias("outcomes"))


def note_index(runs: DataFrame) -> DataFrame:
    """(note, runs): from a note to the runs that name it as prediction or outcome."""
    named = run_index(runs).select("path", F.explode(F.array_union("predictions", "outcomes")).alias("note"))
    return named.groupBy("note").agg(F.array_sort(F.collect_set("path")).alias("runs"))


def correction_findings(corrections: DataFrame, headings: DataFrame, corpus_version: int | None) -> DataFrame:
    """(key, message) of corrections (to_version, decision): decisions without a heading (heading), versions from 2 on that no line accounts for, and lines ahead of the corpus.

    Without a corpus version only the decisions are checked.
    """
    spark = corrections.sparkSession
    lost = corrections.join(headings.select(F.col("heading").alias("decision")).distinct(), "decision", "left_anti")
    issues = [lost.select(F.col("to_version").cast("string").alias("key"), F.lit("no such decision").alias("message"))]
    if corpus_version is not None:
        reached = spark.range(2, corpus_version + 1).select(F.col("id").cast("int").alias("to_version"))
        issues.append(reached.join(corrections.select("to_version").distinct(), "to_version", "left_anti").select(F.col("to_version").cast("string").alias("key"), F.lit("no line accounts for it").alias("message")))
        issues.append(corrections.filter(F.col("to_version") > corpus_version).select(F.col("to_version").cast("string").alias("key"), F.lit("ahead of the corpus").alias("message")))
    return union_issues(*issues)


def decision_findings(entries: DataFrame, governed: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, message) of a register's entries (date, title, body, commits) against governed commits (sha) and a baseline (key), in both directions."""
    named = entries.select("date", F.explode("commits").alias("sha"))
    shas = governed.select("sha").distinct()
    known, explained = baseline.select(F.col("key").alias("sha")).distinct(), named.select("sha").distinct()
    say = lambda df, key, message: df.select(F.col(key).cast("string").alias("key"), F.lit(message).alias("message"))
    return union_issues(
        say(entries.filter(F.size("commits") == 0), "title", "names no commit"), say(entries.filter(F.trim(F.coalesce("body", F.lit(""))) == ""), "title", "has no body"),
        say(named.join(shas, "sha", "left_anti"), "sha", "is no governed commit"), say(shas.join(explained, "sha", "left_anti").join(known, "sha", "left_anti"), "sha", "has no entry"),
        say(known.join(shas, "sha", "left_anti"), "sha", "is baselined and not governed"), say(known.join(explained, "sha", "left_semi"), "sha", "is baselined and explained"),
    )


def checkpoint_findings(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, message) of checkpoints: rows (file, case, set_version, record_kind, rescored_from, should_fire), keys (version, case, label).

    Every row of a file has one version; a run holds no re-scored rows, a re-scored file only such, names a run that there is, and agrees with its key;
    two runs that share cases under different versions need a re-scored file of one at the version of the other.
    """
    again = F.col("record_kind") == "rescore"
    per = rows.groupBy("file").agg(
        F.count_if(F.col("set_version").isNull()).alias("unstamped"), F.count_distinct("set_version").alias("versions"), F.max("set_version").alias("version"), F.count_if(F.coalesce(again, F.lit(False))).alias("rescored"),
        F.count("*").alias("n"), F.max("rescored_from").alias("source"), F.max(F.col("file").startswith("rescored-")).alias("is_bridge"),
    )
    why = F.array_compact(
        F.array(
            F.when(F.col("unstamped") > 0, "rows without a version"), F.when(F.col("versions") > 1, "several versions"), F.when(~F.col("is_bridge") & (F.col("rescored") > 0), "a run with re-scored rows"),
            F.when(F.col("is_bridge") & (F.col("rescored") < F.col("n")), "a re-scored file with other rows"),
        )
    )
    plain = per.select(F.col("file").alias("key"), F.explode(why).alias("message"))
    runs = per.filter("not is_bridge and unstamped = 0 and versions = 1 and rescored = 0").select("file", "version")
    bridges = per.filter("is_bridge and unstamped = 0 and versions = 1").select("file", "version", "source")
    orphans = bridges.join(runs.select(F.col("file").alias("source")), "source", "left_anti").select(F.col("file").alias("key"), F.lit("re-scored from no run").alias("message"))
    held = rows.join(bridges.select("file", "version"), "file").join(keys.select("version", "case", "label"), ["version", "case"])
    stale = held.filter("should_fire <> label").select(F.col("file").alias("key")).distinct().withColumn("message", F.lit("labels differ from the key"))
    cases = rows.join(runs, "file").select("case", F.col("file").alias("name"), "version").distinct()
    pairs = unbridged(cases, bridges.select(F.col("source").alias("name"), "version")).select(F.concat_ws(" ", "a", "b").alias("key"), F.lit("no bridge between").alias("message"))
    return union_issues(plain, orphans, stale, pairs)


def reconcile(rows: DataFrame, declared: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stamped, bridges): rows with the version that ``declared`` (file, version) tells where a file has none, and the rows of older runs re-scored at the highest version.

    An unstamped file that is not declared, and an older run with a case that the highest key lacks, are refused.
    """
    told = rows.join(declared.select("file", F.col("version").alias("_told")), "file", "left")
    require(told, undeclared_file=F.col("set_version").isNull() & F.col("_told").isNull())
    stamped = told.withColumn("set_version", F.coalesce("set_version", "_told")).drop("_told")
    highest = stamped.agg(F.max("set_version")).first()[0] or 0
    old = stamped.filter(F.col("set_version") < highest).join(keys.filter(F.col("version") == highest).select("case", F.col("label").alias("_label")), "case", "left")
    require(old, case_not_in_key=F.col("_label").isNull())
    bridges = old.withColumns({"should_fire": F.col("_label"), "rescored_from": F.col("file"), "record_kind": F.lit("rescore"), "file": F.concat(F.lit(f"rescored-v{highest}-"), F.col("file")), "set_version": F.lit(highest)}).drop("_label")
    return stamped, bridges


#: Children of a node of the fingerprint's tree, and levels of nodes below its root.
FANOUT, LEVELS = 256, 3


def corpus_fingerprint(items: DataFrame, order: str, *parts: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(fingerprint, n): the root of a hash tree over the items in ``order`` (a number; ties by digest).

    An item's digest is the SHA-256 of its parts, a node's that of its children's digests. The items' places, not their partitions, make the tree: the first
    ``fanout`` items are the first node, and so on up, ``levels`` times; the root takes the nodes that are left, n / fanout ** levels of them. Places
    come from counts in parts of the order, so nothing holds all digests. No items have the fingerprint of an empty text.
    """
    own = items.select(F.col(order).cast("double").alias("o"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256).alias("d"))
    at = own.groupBy("o").agg(F.count("*").alias("c"))
    first = running(at, (), "o", "c").select(F.col("o").alias("of"), "c_below")
    # Items of one place in the order are numbered by digest; nulls come first.
    numbered = own.withColumn("i", F.row_number().over(W.partitionBy("o").orderBy("d")) - 1)
    nodes = numbered.join(first, F.col("o").eqNullSafe(F.col("of"))).select((F.col("i") + F.col("c_below")).alias("at"), "d", F.lit(1).alias("n"))
    child = F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda s: s["d"])
    for _ in range(levels):
        up = nodes.groupBy(F.expr(f"`at` div {fanout}").alias("up")).agg(F.sha2(F.array_join(child, ""), 256).alias("d"), F.sum("n").alias("n"))
        nodes = up.withColumnRenamed("up", "at")
    return nodes.agg(F.sha2(F.array_join(child, ""), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def matching_floor(files: DataFrame, floors: DataFrame) -> DataFrame:
    """Files (path, ...) with the floor (pattern, line, branch) of the longest pattern that the path contains, of equals the last in order (at); floors are few."""
    met = files.join(F.broadcast(floors), F.contains(F.col("path"), F.col("pattern")))
    return met.groupBy(*files.columns).agg(F.max_by(F.struct("pattern", "line", "branch"), F.struct(F.length("pattern"), "at")).alias("floor")).select(*files.columns, "floor.*")


def floor_violations(files: DataFrame, floors: DataFrame) -> DataFrame:
    """(path, pattern, kind, percent, floor): files (path, covered_lines, missing_lines, covered_branches, num_branches) below their floor; nothing to cover is all covered."""
    percent = lambda part, whole: F.when(whole == 0, F.lit(100.0)).otherwise(100.0 * part / whole)
    line = percent(F.col("covered_lines"), F.col("covered_lines") + F.col("missing_lines"))
    branch = percent(F.coalesce("covered_branches", F.lit(0)), F.coalesce("num_branches", F.lit(0)))
    both = F.array(F.struct(F.lit("line").alias("kind"), line.alias("percent"), F.col("line").cast("double").alias("floor")), F.struct(F.lit("branch").alias("kind"), branch.alias("percent"), F.col("branch").cast("double").alias("floor")))
    return matching_floor(files, floors).select("path", "pattern", F.explode(both).alias("v")).select("path", "pattern", "v.*").filter(F.col("percent") + 1e-9 < F.col("floor"))


def render_manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of files (path, content) with line ends of one kind."""
    return files.select("path", F.sha2(F.replace(F.col("content").cast("string"), F.lit("\r\n"), F.lit("\n")), 256).alias("sha256"))


def allowed_models(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests (arena, model) that their arena's policy (arena, models array) does not allow; an arena without one allows none."""
    return requests.join(policies.select("arena", "models"), "arena", "left").filter(~F.coalesce(F.array_contains("models", F.col("model")), F.lit(False))).select("arena", "model")


def span_name(operation: Column, model: Column) -> Column:
    return F.concat_ws(" ", operation, model)
