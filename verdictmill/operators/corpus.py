"""Screening a corpus of labelled texts in matched triples: views, shortcut battery, structural checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DELTA_FEATURES, FEATURES, featured, sentences, word_count
from ..sources.scratch import written
from .guards import union_issues
from .ranks import attainable_auc, auc, folded, long_form, matched, running
from .resample import draw

# Word limits of the bands, the band of an AUC that tells nothing, the z that tells something.
LIMITS = {"s": (1, 25), "m": (40, 90), "l": (200, 400), "xl": (900, 1500)}
BAND = (0.40, 0.60)
Z_LEAK = 3.0
VIEWS = ("turn", "ask", "close", "open")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving: about twenty comparisons whatever the length."""
    longest = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.lit(20), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= longest) & (F.substr(a, F.lit(1), n + s) == F.substr(b, F.lit(1), n + s)), n + s).otherwise(n))


def shared_body(turns: DataFrame, triple: str = "triple", text: str = "turn") -> DataFrame:
    """(triple, body_length): what all members begin with, cut back after its last line feed, else after its last space.

    The common prefix of all members is that of the alphabetically first and last, so two aggregates find it.
    """
    ends = turns.filter(F.col(triple).isNotNull()).groupBy(triple).agg(F.min(text).alias("a"), F.max(text).alias("b"))
    head = F.substr(F.col("a"), F.lit(1), common_prefix(F.col("a"), F.col("b")))
    upto = lambda mark: F.length(head) - F.locate(mark, F.reverse(head)) + 1
    at = F.when(F.contains(head, F.lit("\n")), upto("\n")).when(F.contains(head, F.lit(" ")), upto(" ")).otherwise(F.lit(0))
    return ends.select(triple, at.alias("body_length"))


def with_views(turns: DataFrame, triple: str = "triple", text: str = "turn") -> DataFrame:
    """Adds ask (without the body that the triple shares), close (last sentence), open (first sentence of the ask)."""
    joined = turns.join(shared_body(turns, triple, text), triple, "left")
    rest = F.trim(F.substr(F.col(text), F.coalesce(F.col("body_length"), F.lit(0)) + 1))
    asked = joined.withColumn("ask", F.when(rest != "", rest).otherwise(F.col(text))).drop("body_length")
    return asked.withColumns({"close": F.element_at(sentences(F.col(text)), -1), "open": F.element_at(sentences(F.col("ask")), 1)})


def battery(turns: DataFrame, label: str = "should_fire", triple: str = "triple", text: str = "turn") -> DataFrame:
    """(view, feature, auc, folded, leaks, matched_auc, z, matched_leaks, cancels) for every view and feature, in one pass over the texts."""
    long = long_form(viewed(turns.drop("band"), label, triple, text), list(FEATURES), "view", label, triple)
    pooled = auc(long, "value", label, ["view", "feature"]).select("view", "feature", "auc", folded(F.col("auc")).alias("folded"), (~F.col("auc").between(*BAND)).alias("leaks"))
    pairs = matched(long, "value", label, triple, ["view", "feature"]).select("view", "feature", "matched_auc", "z", (F.col("z") > Z_LEAK).alias("matched_leaks"), (F.col("dispersion_z") > Z_LEAK).alias("cancels"))
    return pooled.join(pairs, ["view", "feature"], "left")


def inert(low: Column, high: Column, null_se: Column, matched_low: Column, matched_high: Column) -> Column:
    """Neither statistic could have left its band, whatever the labels: a pass of such a check says nothing."""
    reach = F.greatest(F.abs(matched_low - 0.5), F.abs(matched_high - 0.5))
    return (low >= BAND[0]) & (high <= BAND[1]) & ((F.coalesce(null_se, F.lit(0.0)) == 0) | (reach <= Z_LEAK * null_se))


def reach(rows: DataFrame, names: list[str], by: list[str], label: str = "should_fire", triple: str = "triple") -> DataFrame:
    """(*by, feature, low, high, matched_low, matched_high, null_se, inert): what each check could have shown."""
    long = long_form(rows, names, *by, label, triple)
    keys = [*by, "feature"]
    pooled = attainable_auc(long, "value", label, triple, keys)
    pairs = matched(long, "value", label, triple, keys).select(*keys, "null_se", F.col("low").alias("matched_low"), F.col("high").alias("matched_high"))
    out = pooled.join(pairs, keys, "left").na.fill(0.5, ["matched_low", "matched_high"]).na.fill(0.0, ["null_se"])
    return out.withColumn("inert", inert(F.col("low"), F.col("high"), F.col("null_se"), F.col("matched_low"), F.col("matched_high")))


def viewed(turns: DataFrame, label: str = "should_fire", triple: str = "triple", text: str = "turn") -> DataFrame:
    """(label, triple, view, features): a row per text and view."""
    views = with_views(turns, triple, text).withColumnRenamed(text, "turn")
    keep = [label, triple, *(["band"] if "band" in turns.columns else [])]
    rows = views.select(*keep, F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("t")) for v in VIEWS])).alias("x")).select(*keep, "x.*")
    return featured(rows, "t", FEATURES).drop("t")


def inert_findings(checks: DataFrame) -> DataFrame:
    """(key, message): features that are inert in every view (checks: view, feature, low, high, inert)."""
    told = F.array_sort(F.collect_list(F.format_string("%s could only reach [%.3f, %.3f]", "view", "low", "high")))
    dead = checks.groupBy("feature").agg(F.bool_and("inert").alias("dead"), F.array_join(told, "; ").alias("where")).filter("dead")
    return dead.select(F.concat(F.lit("inert:"), F.col("feature")).alias("key"), F.col("where").alias("message"))


def delta_battery(rows: DataFrame, delta: str = "delta", label: str = "should_fire", triple: str = "triple") -> DataFrame:
    """(feature, auc, leaks, inert, matched_auc, z) of the delta features of one text per row."""
    valued = featured(rows.select(label, triple, delta), delta, DELTA_FEATURES).drop(delta)
    names = list(DELTA_FEATURES)
    pooled = auc(long_form(valued, names, label), "value", label, ["feature"]).select("feature", "auc", (~F.col("auc").between(*BAND)).alias("leaks"))
    pairs = matched(long_form(valued, names, label, triple), "value", label, triple, ["feature"]).select("feature", "matched_auc", "z")
    return pooled.join(reach(valued, names, [], label, triple).select("feature", "inert"), "feature").join(pairs, "feature", "left")


def leak_findings(checks: DataFrame, least: int = 3) -> DataFrame:
    """(key, message): each leaking feature of whole turns, and derived views in which several leak."""
    leaks = checks.filter("leaks")
    whole = leaks.filter("view = 'turn'").select(F.concat(F.lit("leak:turn:"), F.col("feature")).alias("key"), F.format_string("%s alone reaches AUC %.3f", "feature", "auc").alias("message"))
    derived = leaks.filter("view <> 'turn'").groupBy("view").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return union_issues(whole, derived.select(F.concat(F.lit("leak:"), F.col("view")).alias("key"), F.format_string("%d features leak", "n").alias("message")))


def band_findings(turns: DataFrame, limits: Mapping[str, tuple[int, int]] = LIMITS, text: str = "turn") -> DataFrame:
    """Texts whose words are outside the limits of their band."""
    low, high = (F.create_map(*[x for b, ends in limits.items() for x in (F.lit(b), F.lit(ends[k]))])[F.col("band")] for k in (0, 1))
    n = word_count(F.col(text)).cast("long")
    return turns.filter(F.col("band").isNotNull() & ~n.between(low, high)).select(F.col("id").cast("string").alias("key"), F.format_string("%d words in band %s", n, "band").alias("message"))


def triple_findings(turns: DataFrame, text: str = "turn") -> DataFrame:
    """Triples that are not one positive and two negatives of one band with words within max(3, a tenth of the longest)."""
    n = word_count(F.col(text)).cast("long")
    per = turns.groupBy("triple").agg(F.count_if(F.col("should_fire")).alias("p"), F.count("*").alias("n"), F.count_distinct("band").alias("bands"), F.max(n).alias("most"), F.min(n).alias("least"))
    spread = F.col("most") - F.col("least") > F.greatest(F.lit(3), F.bround(F.col("most") * 0.1, 0).cast("long"))
    found = F.array_compact(F.array(F.when((F.col("p") != 1) | (F.col("n") != 3), "shape"), F.when(F.col("bands") > 1, "bands"), F.when(spread, "spread")))
    return per.select(F.col("triple").cast("string").alias("key"), F.explode(found).alias("message"))


def ratio_findings(turns: DataFrame) -> DataFrame:
    """Bands without exactly two negatives for each positive."""
    per = turns.groupBy("band").agg(F.count_if(F.col("should_fire")).alias("p"), F.count_if(~F.col("should_fire")).alias("q"))
    return per.filter("q <> 2 * p").select(F.col("band").alias("key"), F.format_string("%d positives, %d negatives", "p", "q").alias("message"))


def null_leak_rate(rows: DataFrame, names: list[str], label: str, triple: str, draws: int = 200, leaks: int = 3, seed: int = 0) -> DataFrame:
    """Share of label-free draws (a random positive in each triple) in which several features leave the band.

    Only for triples of equal size with one positive each: otherwise no row is returned.
    """
    members = written(rows.groupBy(triple).agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("p"), F.array_sort(F.collect_list(F.struct(*names))).alias("m")), "members")
    shape = members.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("p").alias("p0"), F.max("p").alias("p1")).filter("low = high and p0 = 1 and p1 = 1").select(F.col("low").alias("size"))
    long = long_form(members.select(triple, F.posexplode("m").alias("i", "x")).select(triple, "i", "x.*"), names, triple, "i").filter("value is not null")
    # A value's doubled mid-rank among all members is the same in every draw: it is found once, and a draw only sums those of its positives.
    counts = written(long.groupBy("feature", "value").agg(F.count("*").alias("c")), "counts")
    ranks = running(counts, ["feature"], "value", "c", once=False).select("feature", "value", (2 * F.col("c_below") + F.col("c")).alias("rank"))
    picked = [F.max(F.when(F.col("feature") == name, F.col("rank"))).alias(f"_{k}") for k, name in enumerate(names)]
    ranked = long.join(ranks, ["feature", "value"]).repartition(triple).groupBy(triple, "i").agg(*picked)
    per_triple = ranked.groupBy(triple).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*[f"_{k}" for k in range(len(names))]).alias("x")))).alias("m"))
    drawn = per_triple.join(F.broadcast(shape)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    chosen = drawn.select("r", F.try_element_at("m", (draw(seed, F.col("r"), F.col(triple)) % F.col("size")).cast("int")).alias("x")).select("r", "x.*")
    sums = chosen.groupBy("r").agg(*[f(f"_{k}").alias(f"{f.__name__}{k}") for k in range(len(names)) for f in (F.sum, F.count)])
    told = sums.select("r", F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.col(f"sum{k}").alias("s"), F.col(f"count{k}").alias("p")) for k, name in enumerate(names)])).alias("x")).select("r", "x.*")
    p, q = F.col("p"), F.col("all") - F.col("p")
    won = (F.col("s") - p * p) / 2  # the positives' ranks, without those among themselves
    found = told.join(F.broadcast(counts.groupBy("feature").agg(F.sum("c").alias("all"))), "feature").select("r", F.when(p * q > 0, won / (p * q)).otherwise(F.lit(0.5)).alias("auc"))
    per = found.groupBy("r").agg(F.count_if(~F.col("auc").between(*BAND)).alias("n"))
    return per.agg(F.count("*").alias("draws"), F.avg((F.col("n") >= leaks).cast("int")).alias("rate"))


def matched_findings(checks: DataFrame) -> DataFrame:
    """(key, message): features whose rank within a triple tells the positive, and those that only go to its extremes."""
    told = F.format_string("matched %.3f, %.2f standard errors from chance", "matched_auc", "z")
    leaks = checks.filter("matched_leaks").select(F.concat_ws(":", F.lit("matched"), "view", "feature").alias("key"), told.alias("message"))
    return leaks.unionByName(checks.filter("cancels and not matched_leaks").select(F.concat_ws(":", F.lit("cancel"), "view", "feature").alias("key"), told.alias("message")))


def length_finding(sets: DataFrame, target: float = 0.70) -> DataFrame:
    """(key, message) of sets (key, auc, ceiling, banded): length alone separates the labels above the set's ceiling, or above the target without one; banded sets have checks of their own."""
    limit = F.coalesce(F.col("ceiling") + 1e-9, F.lit(target))
    bad = sets.filter(~F.coalesce("banded", F.lit(False)) & (F.col("auc") > limit))
    why = F.when(F.col("ceiling").isNull(), "above the target and no ceiling is declared").otherwise("above its ceiling")
    return bad.select("key", F.concat(F.format_string("AUC %.3f, ", "auc"), why).alias("message"))


#: The arms of a triplet of prompts.
ARMS = ("base", "governing", "matched")


def delta_cases(triplets: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, warnings) of triplets (id, files: array of paths) and files (path, arm, prompt, error or null).

    A triplet whose list is not of three, one of whose files is missing or does not read, or that lacks an arm is left out with a warning (id, message), the first
    that applies; each of the others gives two cases (id, triple, should_fire, delta): what the governing and the matched prompt insert into the base.
    """
    from ..functions.prompts import extract_delta

    listed = triplets.select("id", F.explode_outer("files").alias("path"), F.coalesce(F.size("files"), F.lit(-1)).alias("_n"))
    read = listed.join(files.select("path", F.lit(True).alias("_there"), "arm", "prompt", "error"), "path", "left")
    bad = F.when(F.col("_there").isNull(), F.concat(F.lit("no file "), F.col("path"))).when(F.col("error").isNotNull(), F.concat(F.col("path"), F.lit(": "), F.col("error"))).when(F.col("arm").isNull() | F.col("prompt").isNull(), F.concat(F.col("path"), F.lit(": no arm or prompt")))
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("prompt"))).alias(arm)
    per = read.groupBy("id").agg(F.max("_n").alias("_n"), F.min(bad).alias("_bad"), *[pick(a) for a in ARMS])
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(a).isNull(), a) for a in ARMS])), ", ")
    why = F.when(F.col("_n") != 3, "not three files").when(F.col("_bad").isNotNull(), F.col("_bad")).when(missing != "", F.concat(F.lit("missing arms: "), missing))
    told = per.withColumn("message", why)
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("prompt")) for a in ARMS[1:]])).alias("v")
    sound = told.filter("message is null").select("id", "base", arm)
    cases = sound.select(F.concat_ws("-", "id", "v.arm").alias("id"), F.col("id").alias("triple"), (F.col("v.arm") == ARMS[1]).alias("should_fire"), extract_delta(F.col("base"), F.col("v.prompt")).alias("delta"))
    return cases, told.filter("message is not null").select("id", "message")


#: Fixed value: how far a stump may do better than the majority.
MAX_LIFT = 0.10


def stump_findings(valued: DataFrame, names: list[str], label: str, row_id: str, max_lift: float = MAX_LIFT) -> DataFrame:
    """(key, message): the best stump over the features does better than the majority by more than ``max_lift``."""
    from .ranks import stump

    lift = stump(valued, names, label, row_id).withColumn("lift", F.greatest("depth1", "depth2") - F.col("majority"))
    return lift.filter(F.col("lift") > max_lift + 1e-9).select(F.lit("stump").alias("key"), F.format_string("a lift of %.3f over the majority", "lift").alias("message"))


def check_corpus(turns: DataFrame, max_lift: float = MAX_LIFT, text: str = "turn") -> DataFrame:
    """(key, message): everything wrong with a corpus of triples (id, triple, band, should_fire, turn): bands, shape, ratio, leaks, matched leaks, inert features, and a stump that does too well."""
    checks = battery(turns, text=text)
    structure = [f(turns) for f in (band_findings, triple_findings, ratio_findings)]
    seen = reach(viewed(turns.drop("band"), text=text), list(FEATURES), ["view"])
    valued = featured(turns.select("id", "should_fire", text), text, FEATURES)
    over = stump_findings(valued, list(FEATURES), "should_fire", "id", max_lift)
    return union_issues(*structure, leak_findings(checks), matched_findings(checks), inert_findings(seen), over)
