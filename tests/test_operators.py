"""Operators against hand-worked cases, properties, and results published for recorded runs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from verdictmill.functions import calls, expressions, parsing, text
from verdictmill.functions import rates as forms
from verdictmill.operators import agreement, calibration, casefiles, corpus, documents, generate, guards, inference, integrity, items, movement, ranks, rates, reports, resample, simulation
from verdictmill.sources import keys, records
from verdictmill.streaming import verdicts as streams


def one(df):
    return df.first().asDict()


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("x")).first().x


VERDICTS = "`case` string, repeat int, fired boolean, should_fire boolean, band string"


def verdicts(spark, rows):
    return spark.createDataFrame(rows, VERDICTS)


# --- scorecards


def test_unreadable_is_counted_and_never_taken_for_silence(spark):
    rows = [("a", 0, True, True, "s"), ("a", 1, None, True, "s"), ("b", 0, False, False, "s"), ("c", 0, True, False, "m"), ("d", 0, None, True, "m")]
    got = one(rates.summarise(verdicts(spark, rows)))
    assert (got["tp"], got["fp"], got["tn"], got["fn"], got["unparseable"]) == (1, 1, 1, 0, 2)
    assert got["accuracy"] == pytest.approx(2 / 3) and got["precision"] == 0.5 and got["recall"] == 1.0 and got["mcc"] == pytest.approx(0.5)
    by = {r.band: r for r in rates.summarise(verdicts(spark, rows), ["band"]).collect()}
    assert by["m"].recall == 0.0 and by["m"].mcc is None and by["m"].precision == 0.0


@pytest.mark.parametrize("by", [[], ["band"]])
def test_margins_beyond_a_long(spark, by):
    """400,000 rows in one band: the product of the margins is 7e20."""
    rows = spark.range(400_000).select(F.lit("s").alias("band"), (F.col("id") % 4 < 2).alias("should_fire"), (F.col("id") % 8 < 1).alias("fired"))
    got = rates.summarise(rows, by)
    assert one(got)["mcc"] == pytest.approx((50_000 * 200_000) / (50_000 * 200_000 * 200_000 * 350_000) ** 0.5)
    if by:
        assert one(reports.rate_lines(got, "band"))["line"].split() == ["s", "62.5%", "100.0%", "25.0%", "0.0%", "0.378"]


def test_item_weights_count_every_item_once(spark):
    rows = [("a", k, k < 1, True, "s") for k in range(4)] + [("b", 0, False, False, "s")]
    got = one(rates.summarise(verdicts(spark, rows), weight="item"))
    assert got["tp"] == 0.25 and got["fn"] == 0.75 and got["accuracy"] == pytest.approx(0.625)
    assert rates.missed(verdicts(spark, [("a", 0, False, True, "s"), ("b", 0, None, True, "s"), ("c", 0, True, True, "s")])).collect()[0].case == "a"


def test_band_order(spark):
    df = spark.createDataFrame([("xl",), ("z",), ("s",), ("l",), ("m",)], "band string")
    assert [r.band for r in df.orderBy(rates.in_order(F.col("band")), "band").collect()] == ["s", "m", "l", "xl", "z"]


def test_wilson_published_value(spark):
    low, high = (value(spark, c) for c in forms.wilson(F.lit(26 / 86), F.lit(86)))
    assert round(low, 3) == 0.215 and round(high, 3) == 0.406
    assert [value(spark, c) for c in forms.wilson(F.lit(0.0), F.lit(0))] == [0.0, 1.0]


def test_power_round_trip_and_reliability(spark):
    n = value(spark, forms.required_pairs(F.lit(0.1), F.lit(0.3)))
    assert value(spark, forms.detectable_effect(F.lit(n), F.lit(0.3))) == pytest.approx(0.1, abs=2e-3)
    assert value(spark, forms.detectable_effect(F.lit(3), F.lit(0.1))) is None
    for icc, target in itertools.product((0.1, 0.5, 0.8), (0.8, 0.9)):
        k = value(spark, forms.repeats_for_reliability(F.lit(icc), F.lit(target)))
        assert k * icc / (1 + (k - 1) * icc) >= target - 1e-9 and (k == 1 or (k - 1) * icc / (1 + (k - 2) * icc) < target)
    assert value(spark, forms.repeats_for_precision(F.lit(0.5))) == 3


def test_votes(spark):
    ledger = spark.createDataFrame([("a", True, False), ("a", True, False), ("a", None, False), ("b", True, True), ("c", True, True), ("c", False, True)], "`case` string, adjudicated boolean, label boolean")
    got = {r.case: (r.moves, r.unanimous, r.contested) for r in rates.votes(ledger).collect()}
    assert got == {"a": (True, False, False), "b": (False, True, False), "c": (False, False, True)}


# --- guards


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    with pytest.raises(guards.Refused, match="no value: 1 rows"):
        guards.require(df, no_value=F.col("v").isNull())
    with pytest.raises(guards.Refused):
        guards.one_value_per(df, "k", "v")
    assert guards.one_value_per(df.filter("v = 'a'"), "k", "v").count() == 1
    with pytest.raises(guards.Refused):
        calibration.checked(spark.createDataFrame([(1.2, 1)], "f double, o int"))
    with pytest.raises(guards.Refused):
        agreement.fleiss_kappa(spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "unit int, rater int, label string"))
    with pytest.raises(guards.Refused):
        integrity.rescore(spark.createDataFrame([("x", True, "r", None, 1)], "`case` string, should_fire boolean, route string, covers boolean, set_version int"), spark.createDataFrame([], "`case` string, new_label boolean, new_route string"), 2, "s")
    with pytest.raises(guards.Refused):
        resample.replicate_means(spark.createDataFrame([(1.0, "a")], "v double, c string"), "v", "c", 5, 0)


def test_comparability_sees_nulls(spark):
    schema = "set_version int, in_situ boolean, model string, skill_version string"
    a = spark.createDataFrame([(None, None, "m", None)], schema)
    same = one(guards.comparable(a, spark.createDataFrame([(1, False, "m", None)], schema)))
    assert set(same.values()) == {None}
    got = one(guards.comparable(a, spark.createDataFrame([(2, True, None, "v")], schema)))
    assert got == {"versions_differ": "1,2", "venues_differ": "false,true", "models_differ": "m,unknown", "skills_differ": "v,unknown"}


# --- ranks


def brute_auc(rows):
    p, q = [v for v, y in rows if y], [v for v, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q)) if p and q else 0.5


@pytest.mark.parametrize("seed", range(3))
def test_auc_and_range_and_stump_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randint(0, 6) / 2, rng.randint(0, 4), rng.random() < 0.4, rng.choice("abcd")) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, v double, w int, y boolean, c string")
    assert one(ranks.auc(df, "v", "y"))["auc"] == pytest.approx(brute_auc([(r[1], r[3]) for r in rows]))
    cl = {c: [r for r in rows if r[4] == c] for c in "abcd"}
    fixed = movable = 0.0
    for a, b in itertools.product(cl.values(), cl.values()):
        pairs = sum(r[3] for r in a) * sum(not r[3] for r in b)
        va, vb = {r[2] // 5 for r in a}, {r[2] // 5 for r in b}
        if len(va) == len(vb) == 1:
            fixed += pairs * ((min(va) > min(vb)) + 0.5 * (va == vb))
        else:
            movable += pairs
    total = sum(r[3] for r in rows) * sum(not r[3] for r in rows)
    got = one(ranks.attainable_auc(df.withColumn("w", F.floor(F.col("w") / 5)), "w", "y", "c"))
    assert (got["low"], got["high"]) == (pytest.approx(fixed / total), pytest.approx((fixed + movable) / total))

    def depth1(rs):
        best = max(sum(r[3] for r in rs), sum(not r[3] for r in rs)) if rs else 0
        for k in (1, 2):
            for cut in {r[k] for r in rs}:
                best = max(best, sum(max(sum(r[3] for r in s), sum(not r[3] for r in s)) for s in ([r for r in rs if r[k] <= cut], [r for r in rs if r[k] > cut]) if s))
        return best

    best = depth1(rows)
    for k in (1, 2):
        order, step = sorted(rows, key=lambda r: r[k]), max(1, len(rows) // 16)
        for cut in range(step - 1, len(rows) - 1, step):
            if order[cut][k] != order[cut + 1][k]:
                best = max(best, depth1(order[: cut + 1]) + depth1(order[cut + 1 :]))
    got = one(ranks.stump(df, ["v", "w"], "y", "id"))
    assert got["depth1"] == pytest.approx(depth1(rows) / 40) and got["depth2"] == pytest.approx(best / 40)


def test_matched_statistics_of_one_triple(spark):
    df = spark.createDataFrame([("t", 3.0, True), ("t", 2.0, False), ("t", 1.0, False), ("u", 1.0, True), ("u", 1.0, False), ("u", 5.0, False), ("w", 1.0, True)], "c string, v double, y boolean")
    got = one(ranks.matched(df, "v", "y", "c"))
    assert got["n_clusters"] == 2 and got["matched_auc"] == pytest.approx((1 + 0.25) / 2)
    variance = (0.25 + 0 + 0.25) / 3 + (0.0625 + 0.0625 + 0.25) / 3
    assert got["null_se"] == pytest.approx(math.sqrt(variance) / 2) and got["low"] == pytest.approx((0 + 0.25) / 2) and got["high"] == 1.0


# --- inference


def test_null_leaks_rank_once_for_all_draws(spark, monkeypatch):
    """The rate of a brute force, with ties and without values, and no table of a row per draw and value on the way."""
    import hashlib

    from verdictmill.sources import scratch

    most = []

    def recorded(rows, name="kept"):
        out = scratch.written(rows, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(ranks, "written", recorded)
    monkeypatch.setattr(corpus, "written", recorded, raising=False)
    rng = random.Random(11)
    rows = [(t, i == 0, float(rng.randrange(6)), rng.choice([None, 1.0, 2.5, rng.random()]), 3.0) for t in range(9) for i in range(3)]
    got = one(corpus.null_leak_rate(spark.createDataFrame(rows, "t int, label boolean, a double, b double, c double"), ["a", "b", "c"], "label", "t", draws=40, leaks=1, seed=6))
    order = lambda x: [(v is not None, v or 0.0) for v in x]
    members = {t: sorted((r[2:] for r in rows if r[0] == t), key=order) for t in range(9)}
    hits = 0
    for r in range(40):
        k = {t: int(hashlib.md5(f"6:{r}:{t}".encode()).hexdigest()[:8], 16) % 3 for t in members}
        leaks = 0
        for f in range(3):
            pos = [m[k[t]][f] for t, m in members.items() if m[k[t]][f] is not None]
            neg = [x[f] for t, m in members.items() for i, x in enumerate(m) if i != k[t] and x[f] is not None]
            auc = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg)) if pos and neg else 0.5
            leaks += not 0.4 <= auc <= 0.6
        hits += leaks >= 1
    assert got == {"draws": 40, "rate": pytest.approx(hits / 40)} and 0 < hits < 40
    assert max(most) <= len(rows) * 3


def test_mcnemar_hand_case(spark):
    rows = [(False, True)] * 8 + [(True, False)] * 2 + [(True, True)] * 5
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    assert one(inference.mcnemar(df, "a", "b"))["p"] == pytest.approx(0.0546875)
    assert one(inference.mcnemar(df, "a", "b", "two-sided"))["p"] == pytest.approx(0.109375)
    assert one(inference.mcnemar(df.filter("a and b"), "a", "b"))["p"] == 1.0
    big = spark.range(1).select(inference.binomial_half_tail(F.lit(520), F.lit(1000)).alias("p")).first().p
    assert big == pytest.approx(sum(math.comb(1000, k) for k in range(520, 1001)) / 2**1000)


def test_binomial_tails_of_any_size(spark):
    from fractions import Fraction

    rows = [(k, n) for n in (1, 2, 3, 10, 20, 21, 128, 129, 1000, 4001) for k in sorted({0, 1, n // 3, n // 2, n // 2 + 1, 2 * n // 3, n - 1, n, n + 1})]
    got = spark.createDataFrame(rows, "k long, n long").withColumn("p", inference.binomial_half_tail(F.col("k"), F.col("n"))).collect()
    for r in got:
        assert r.p == pytest.approx(float(Fraction(sum(math.comb(r.n, j) for j in range(r.k, r.n + 1)), 2**r.n)), rel=1e-11)
    large = spark.createDataFrame([(500_000_000, 1_000_000_000), (50_100_000, 100_000_000)], "k long, n long").withColumn("p", inference.binomial_half_tail(F.col("k"), F.col("n"))).collect()
    assert large[0].p == pytest.approx(0.5 + 0.5 / math.sqrt(math.pi * 5e8), rel=1e-9) and 1e-90 < large[1].p < 1e-88
    pairs = spark.createDataFrame([("x", False, True)] * 6 + [("x", True, False)] * 1 + [(None, True, False)] * 2, "g string, a boolean, b boolean")
    by = {r.g: r.p for r in inference.mcnemar(pairs, "a", "b", by=["g"]).collect()}
    assert by == {"x": pytest.approx(8 / 128), None: pytest.approx(1.0)}


def test_signed_ranks_exact_and_beyond(spark):
    # Tabled: the largest rank sums that a two-sided test of 5 % rejects, for 6 to 10, 20, 30 and 50 pairs.
    for n, w in ((6, 0), (7, 2), (8, 3), (9, 5), (10, 8), (20, 52), (30, 137), (50, 434)):
        counts = one(spark.range(1).select(inference.signed_rank_counts(F.lit(n)).alias("c")))["c"]
        assert len(counts) == n * (n + 1) // 2 + 1 and sum(counts) == 2**n
        assert 2 * sum(counts[: w + 1]) / 2**n <= 0.05 < 2 * sum(counts[: w + 2]) / 2**n
    rows = [("few", 0.0, x) for x in (1.0, 2.0, -3.0, 4.0, 5.0)] + [("tied", 0.0, x) for x in (1.0, 1.0, -3.0, 4.0, 5.0)] + [("equal", 0.0, x) for x in (0.0, 2.0, -3.0)] + [("many", 0.0, float(x)) for x in range(1, 60)] + [("none", 1.0, 1.0), ("none", None, 1.0)]
    got = {r.g: r for r in inference.wilcoxon(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect()}
    assert {g: r.exact for g, r in got.items()} == {"few": True, "tied": False, "equal": False, "many": False, "none": False}
    # Of five ranks the sums up to 3 come from {}, {1}, {2}, {3}, {1, 2}.
    assert got["few"].w == 3.0 and got["few"].p == pytest.approx(2 * 5 / 32)
    assert got["none"].p == 1.0 and got["none"].n == 0 and got["many"].p < 1e-10


def test_running_sums_of_groups_in_parts(spark):
    rng = random.Random(5)
    rows = [("hot", float(v), v % 7) for v in rng.sample(range(10**6), 4000)] + [(None, float(v), 1) for v in range(50)] + [("one", 3.0, 5)]
    got = ranks.running(spark.createDataFrame(rows, "g string, v double, c int"), ["g"], "v", "c").collect()
    assert len(got) == len(rows)
    below = {}
    for g in ("hot", None, "one"):
        total = 0
        for _, v, c in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            below[g, v] = total
            total += c
    assert all(r.c_below == below[r.g, r.v] for r in got)


def test_matched_ranks_of_a_large_cluster(spark):
    """A million members with one positive: its score is its mid-rank among the others."""
    df = spark.range(1_000_000).select(F.lit("k").alias("c"), (F.col("id") % 1000).cast("double").alias("v"), (F.col("id") == 250).alias("y"))
    got = one(ranks.matched(df, "v", "y", "c"))
    assert got["matched_auc"] == pytest.approx((250 * 1000 + 0.5 * 999) / 999_999)
    assert got["low"] == pytest.approx(0.5 * 999 / 999_999) and got["null_se"] == pytest.approx(math.sqrt(1 / 12), abs=1e-3)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "key int, p double")
    got = [r.q_value for r in inference.benjamini_hochberg(df).orderBy("key").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_normal_cdf(spark):
    from statistics import NormalDist

    xs = [-8.0, -5.0, -2.3, -0.1, 0.0, 1.96, 6.0]
    got = [r.x for r in spark.createDataFrame([(x,) for x in xs], "v double").select(inference.normal_cdf(F.col("v")).alias("x")).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-12)


def test_wilcoxon(spark):
    df = spark.createDataFrame([(0.0, d) for d in (1.0, 2.0, -3.0, 4.0, 5.0, 0.0, 2.0)], "a double, b double")
    got = one(inference.wilcoxon(df, "a", "b"))
    assert got["n"] == 6 and got["w"] == 4.0 and 0 < got["p"] < 1
    assert one(inference.wilcoxon(df.filter("b = 0"), "a", "b"))["p"] == 1.0


def test_bootstrap_is_reproducible_and_contains_the_point(spark):
    rng = random.Random(4)
    rows = [(rng.random() + 0.1 * (k % 7), k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, "v double, c int")
    a, b = (one(resample.bootstrap_mean(x, "v", "c", 300, 1)) for x in (df, df.repartition(7)))
    assert a == pytest.approx(b) and a["low"] <= a["point"] <= a["high"] and a["se"] > 0
    single = one(resample.intraclass_correlation(df.withColumn("c", F.monotonically_increasing_id()), "v", "c"))
    assert single["icc"] == 0.0
    tight = spark.createDataFrame([(float(k // 5), k // 5) for k in range(50)], "v double, c int")
    assert one(resample.intraclass_correlation(tight, "v", "c"))["icc"] == pytest.approx(1.0)
    p = one(resample.permutation_test(spark.createDataFrame([(k, 1.0) for k in range(12)], "i int, d double"), "d", "i", 400, 2))["p"]
    assert 1 / 401 <= p < 0.02


def test_bootstrap_draws_are_counted_up_by_tasks(spark, monkeypatch):
    """No list of the clusters stands in the plan, which the driver would hold; the draws are those of the numbered clusters, however these are dealt."""
    import hashlib

    many = spark.range(30_000).select(F.col("id").alias("c"), F.lit(1.0).alias("v"))
    assert "Range (0, 90000," in resample.replicate_means(many, "v", "c", 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    rng = random.Random(8)
    rows = [(f"c{rng.randrange(500):03}", float(rng.randrange(9))) for _ in range(1500)]
    sums = {}
    for c, v in rows:
        s, n = sums.get(c, (0.0, 0))
        sums[c] = s + v, n + 1
    order = [sums[c] for c in sorted(sums)]
    want = []
    for r in range(4):
        drawn = [order[int(hashlib.md5(f"7:{r}:{j}".encode()).hexdigest()[:8], 16) % len(order)] for j in range(len(order))]
        want.append(sum(s for s, _ in drawn) / sum(n for _, n in drawn))
    df = spark.createDataFrame(rows, "c string, v double").repartition(5)
    for most in (1_000_000, 10):
        monkeypatch.setattr(resample, "BROADCAST_CLUSTERS", most)
        got = {x.r: x["mean"] for x in resample.replicate_means(df, "v", "c", 4, 7).collect()}
        assert [got[r] for r in range(4)] == pytest.approx(want)


# --- agreement, calibration, reliability


FLEISS = [(0, 0, 0, 0, 14), (0, 2, 6, 4, 2), (0, 0, 3, 5, 6), (0, 3, 9, 2, 0), (2, 2, 8, 1, 1), (7, 7, 0, 0, 0), (3, 2, 6, 3, 0), (2, 5, 3, 2, 2), (6, 5, 2, 1, 0), (0, 2, 2, 3, 7)]


def test_fleiss_worked_example(spark):
    rows = [(u, r, str(label)) for u, counts in enumerate(FLEISS) for r, label in enumerate(x for k, n in enumerate(counts) for x in [k] * n)]
    df = spark.createDataFrame(rows, "unit int, rater int, label string")
    assert round(one(agreement.fleiss_kappa(df))["kappa"], 3) == 0.210
    alpha = one(agreement.krippendorff_alpha(df))["alpha"]
    kappa, n = one(agreement.fleiss_kappa(df))["kappa"], 140
    assert alpha == pytest.approx(1 - (1 - kappa) * (n - 1) / n)
    perfect = df.withColumn("label", F.col("unit").cast("string"))
    assert one(agreement.fleiss_kappa(perfect))["kappa"] == pytest.approx(1.0) and one(agreement.unanimity(perfect))["rate"] == 1.0


def test_murphy_identity_and_bins(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 10) / 10, float(rng.random() < 0.4)) for _ in range(60)]
    df = calibration.checked(spark.createDataFrame(rows, "f double, o double"))
    got = one(calibration.murphy(df))
    assert got["brier"] == pytest.approx(one(calibration.brier(df))["brier"])
    at = {r.bin: r.n for r in calibration.reliability_curve(spark.createDataFrame([(0.3, 1.0), (1.0, 1.0)], "f double, o double")).collect()}
    assert at == {2: 1, 9: 1}


# --- items, movement, generation, records


def test_discrimination_is_null_where_undefined(spark):
    rows = [("a", True, f"r{k}", k % 2) for k in range(4)] + [("b", True, f"r{k}", 1) for k in range(4)] + [("c", True, "r0", 1)]
    grid = spark.createDataFrame(rows, "`case` string, should_fire boolean, respondent string, correct int")
    got = {r.case: r.r for r in items.item_discrimination(grid).collect()}
    assert got["b"] is None and got["c"] is None


def test_movement(spark):
    pairs = movement.base_pairs(spark.createDataFrame([("t", 0, 10.0), ("t", 1, 12.0), ("u", 0, 5.0), ("u", 1, 6.0)], "triplet_id string, repeat int, quantity double"))
    assert one(movement.movement_threshold(pairs)) == {"threshold": pytest.approx(0.2), "triplet_id": "t"}
    with pytest.raises(guards.Refused):
        movement.base_pairs(spark.createDataFrame([("t", 0, 10.0)], "triplet_id string, repeat int, quantity double"))
    assert value(spark, forms.interval_state(F.lit(0.6), F.lit(0.8))) == "indeterminate"


def test_simulation_answers_what_is_known(spark):
    grid = simulation.build_grid(spark, [20, 40], [0.5, 1.0], [0.0, 0.2])
    assert grid.count() == 6
    cells = simulation.run_cells(grid, sims=60, resamples=100).persist()
    assert simulation.known_answers(cells).count() == 0
    full = cells.filter("j = 1.0").first()
    assert full.mean_point == 1.0 and full.p_closes == 1.0
    assert simulation.table(cells, "n", "icc", "mean_width").count() == 2 and simulation.smallest_usable_n(cells).count() == 3


def test_last_write_wins_and_reachability(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "k string, at int, v string")
    assert {tuple(r) for r in integrity.last_write_wins(df, ["k"], "at").collect()} == {("a", 3, None), ("b", 2, "y")}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    assert {(r.id, r.depth) for r in integrity.reachable(edges, spark.createDataFrame([(1,)], "id long")).collect()} == {(1, 0), (2, 1), (3, 2)}
    tree = lambda rows: spark.createDataFrame(rows, "node_name string, report string")
    assert [tuple(r) for r in integrity.identified(tree([("a", "x"), ("b", "y")]), tree([("a", "x"), ("b", "y")]), "a").collect()] == [("a", "ablated node reports")]


def test_generation(spark):
    placed = lambda p, d="xy": "".join(value(spark, generate.arrange(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, d)) if d else F.array().cast("array<string>"), F.lit(p))))
    assert [placed(p) for p in ("early", "late", "middle")] == ["xyabc", "abcxy", "axybc"] and placed("middle", "") == "abc"
    with pytest.raises(Exception, match="unknown position"):
        placed("centre")
    import hashlib

    want = str(int.from_bytes(hashlib.sha256(b"t:1:2").digest()[:8], "big"))
    assert value(spark, generate.derive_seed(F.lit("t"), F.lit(1), F.lit(2))) == want
    assert value(spark, generate.render(F.lit("{a} and {b}{c}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))) == "1 and 2{c}"
    assert generate.strata(spark, [0, 2], ["early", "late"]).count() == 3
    rows = spark.createDataFrame([(d, f"{d}{k}", y, f"{d}{k}{y}") for d in "pq" for k in range(4) for y in (True, False, False)], "d string, t string, y boolean, c string")
    got = generate.alternating_sample(rows, "d", "t", "y", "c").collect()
    assert len(got) == 8 and sum(r.y for r in got) == 4


def test_weaving_reads_the_padding_once_for_its_total(spark):
    def woven(core, pad):
        total, out, used, at = sum(len(x) + 1 for x in core + pad), [], 0, 0
        for i, c in enumerate(core):
            while at < len(pad) and used + len(pad[at]) + 1 <= 0.3 * float(total) + (0.6 - 0.3) * float(total) * (i + 0.5) / len(core):
                used, at, out = used + len(pad[at]) + 1, at + 1, [*out, pad[at]]
            used, out = used + len(c) + 1, [*out, c]
        return out + pad[at:]

    rng = random.Random(3)
    rows = [(["c" * rng.randrange(30) for _ in range(rng.randrange(6))], ["p" * rng.randrange(25) + str(j) for j in range(rng.randrange(40))]) for _ in range(200)]
    rows.append((["one", "two"], [f"pad {j}" for j in range(5000)]))
    df = spark.createDataFrame(rows, "c array<string>, p array<string>").select("c", "p", generate.weave(F.col("c"), F.col("p")).alias("w"))
    assert df._jdf.queryExecution().analyzed().toString().count("concat(c#") == 1
    assert all(x.w == woven(x.c, x.p) for x in df.collect())


def test_expressions(spark):
    names = {"x": F.lit(-7), "y": F.lit(2.5), "s": F.lit("ab")}
    for e in ("x // 2 + x % 3", "max(x, 3, y) if not x > 0 and y != 2 else 0", "abs(x) ** 2", "round(y)", "len(s) in (2, 3)", "min([x, 1]) - -y", "1 < y <= 2.5", "int(y) * float(x)"):
        assert value(spark, expressions.compile_expression(e, names)) == eval(e, {}, {"x": -7, "y": 2.5, "s": "ab"}), e  # noqa: S307
    assert value(spark, expressions.compile_expression("round(y * 1.05, 1)", names)) == 2.6 and value(spark, expressions.compile_expression("sorted([3, 1, x])", names)) == [-7, 1, 3]
    for e in ("x.real", "__import__('os')", "[k for k in s]", "lambda: 1", "x[0]", "unknown + 1", "max(x, key=abs)", "f'{x}'", "x +"):
        with pytest.raises(expressions.UnsafeExpression):
            expressions.compile_expression(e, names)
    assert expressions.names_in("max(x, y) + z") == {"x", "y", "z"}


# --- text, parsing


def test_decisions(spark):
    told = lambda t: tuple(value(spark, parsing.decision(F.lit(t), ("p", "q"))))
    assert told('so {"fire": true, "procedure": "p", "p_fire": 0.7} or {"fire": false}') == (True, "p", 0.7)
    assert told('{"fire": false, "tool": "q", "p_fire": 3}') == (False, "q", None)
    assert told('{"fire": "yes"}') == told('{"fire": 1}') == told("{broken}{}") == told("none") == (None, None, None)
    assert told('{"fire": true, "procedure": "z", "p_fire": "0.5"}') == (True, None, None)


def test_answers(spark):
    told = lambda t: tuple(value(spark, parsing.parse_answer(F.lit(t), F.array(F.lit("Do it"), F.lit("wait")))))
    assert told("ANSWER: wait\nthen\n**Answer**: `do-it`.")[:2] == ("parsed", "Do it")
    assert told("ANSWER: never") == ("unlisted_option", None, "never") and told("no")[0] == "no_answer_line"
    assert value(spark, parsing.last_number(F.lit("from $1,200.50 to 3"))) == 3.0 and value(spark, parsing.gold_answer(F.lit("x #### 1,234"))) == 1234.0
    assert value(spark, parsing.first_select(F.lit("```sql\nSELECT a\nFROM t; more"))) == "SELECT a\nFROM t"
    assert told("so\nANSWER:\n  wait\n")[:2] == ("parsed", "wait")
    assert [value(spark, parsing.parse_number(F.lit(x))) for x in ("1 2", "$1,234.5", " 7", "x")] == [None, 1234.5, 7.0, None]
    flat = lambda q: value(spark, parsing.normalise_sql(F.lit(q)))
    assert flat('SELECT  "A"\n FROM `b`;;') == "select 'a' from 'b'" and flat("a = b") != flat("a = 'b'") and flat('a = "b"') == flat("a = 'B' ") == "a = 'b'"
    assert value(spark, parsing.last_line_vote(F.lit("VERDICT: real\nx\nverdict: Composed"))) == "composed"
    assert [value(spark, parsing.confidence(F.lit(x))) for x in ("0.4", "true", '"0.4"', "1.5", "x")] == [0.4, None, None, None, None]


def test_calls(spark):
    outcome = lambda reply, key: value(spark, calls.match_calls(F.lit(reply), F.lit(key)))
    key = '[{"f": {"a": [1], "b": ["x", "y"], "c": ["", 2]}}, {"f": {"a": [2], "b": ["z"]}}]'
    reply = 'ok [{"name": "f", "arguments": {"a": 2, "b": " Z"}}, {"name": "f", "arguments": {"a": 1.0, "b": "Y"}}]'
    assert outcome(reply, key) == "matched" and outcome(reply.replace("1.0", "true"), key) == "wrong"
    assert outcome("none", key) == "unreadable" and outcome('[{"name": "f"}]', key) == "wrong" and outcome(None, key) == "unreadable"
    assert outcome('[{"name": "f", "arguments": 3}]', key) == outcome('[{"nam": "f"}]', key) == "unreadable"
    assert outcome('[{"name": " g", "arguments": {"v": [1.0, ["A ", true]]}}]', '[{"g": {"v": [[1, ["a", true]]]}}]') == "matched"
    assert outcome('[{"name": "g", "arguments": {"v": [1, true]}}]', '[{"g": {"v": [[1, 1]]}}]') == "wrong"
    assert outcome('[{"name": "g", "arguments": {"v": 1, "z": 1}}]', '[{"g": {"v": [1]}}]') == "wrong"
    two = '[{"name": "g", "arguments": {"v": 1}}, {"name": "g", "arguments": {"v": 1}}]'
    assert outcome(two, '[{"g": {"v": [1]}}, {"g": {"v": [1, 2]}}]') == "matched" and outcome(two, '[{"g": {"v": [1]}}, {"g": {"v": [2]}}]') == "wrong"


def test_text_features(spark):
    get = lambda c, t: value(spark, c(F.lit(t)))
    assert get(text.FEATURES["sentence_count"], "One. Two! Three?  ") == 3.0 and get(text.FEATURES["word_count"], "") == 0.0
    assert get(text.FEATURES["first_person_rate"], "I'm here, we go") == 0.5 and get(text.FEATURES["imperative_opener"], "Fix it") == 1.0 and get(text.FEATURES["imperative_opener"], "") == 0.0
    assert get(text.FEATURES["says_should_i"], "What SHOULD we do") == 1.0 and get(text.FEATURES["terminal_question"], "so? \n") == 1.0
    assert get(text.load_bearing_tokens, "See § 4.2, by 2024-01-02, pay 1,500 to Acme Ltd, not 12.") == sorted(["§ 4.2", "2024-01-02", "1,500", "Acme Ltd", "2024"])
    names = spark.createDataFrame([("s10",), ("s2",), ("a",), ("s",), ("s0",), ("s123456789012345678901",), ("s123456789012345678900",), ("s10b",)], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["a", "s", "s0", "s2", "s10", "s10b", "s123456789012345678900", "s123456789012345678901"]


def test_shared_bodies(spark):
    rows = [("t", "Intro line.\nShould I go"), ("t", "Intro line.\nShould I stay"), ("u", "Should I tell her"), ("u", "Should I take it"), ("v", "abc"), ("v", "xyz"), (None, "alone")]
    df = spark.createDataFrame(rows, "triple string, turn string")
    got = {r.turn: r.ask for r in corpus.with_views(df).collect()}
    assert got == {"Intro line.\nShould I go": "Should I go", "Intro line.\nShould I stay": "Should I stay", "Should I tell her": "tell her", "Should I take it": "take it", "abc": "abc", "xyz": "xyz", "alone": "alone"}


def test_casefiles(spark):
    reply = "**CONDITIONS**\nC1 governs\nEXPOSURE\nI'd say High risk\nMISSING\nNONE\nACTIONS\na2 then A1, a2"
    parts = value(spark, casefiles.sections(F.lit(reply)))
    assert parts.conditions == "C1 governs" and parts.missing == "NONE"
    assert value(spark, casefiles.references(F.lit(parts.actions))) == ["A2", "A1"] and value(spark, casefiles.first_band(F.lit(parts.exposure))) == "high"
    row = spark.createDataFrame([(["A1"], ["A1", "A2"], ["A3"], ["A4"], ["C1"], ["C1", "C2"])], "recommended array<string>, required array<string>, prohibited array<string>, unjustified array<string>, voted array<string>, governing array<string>")
    got = one(casefiles.score(row))
    assert not got["admissible"] and got["missing_required"] == ["A2"] and got["graded"] == pytest.approx((0.5 + 1 + 0.5) / 3)


def test_documents(spark):
    register = spark.createDataFrame([("# R\n## 2026-01-02 — First one\nText\n**Commits:** abcdef1, 1234567\n## Not an entry\n",)], "text string")
    assert [tuple(r) for r in documents.register_entries(register).collect()] == [("2026-01-02", "First one", ["abcdef1", "1234567"])]
    bib = documents.bib_entries(spark.createDataFrame([("@misc{a,\n eprint = {2401.00001},\n quote = {x}\n}\n@misc{b,\n eprint={2401.00001}}\n@misc{c,\n eprint={2401.00002}}\n",)], "text string"))
    assert {(r.arxiv, r.key, r.has_quote) for r in bib.collect()} == {("2401.00001", "a", True), ("2401.00002", "c", False)}
    text_ = spark.createDataFrame([("d", "It is 40% (2401.00001).\n\nNo number (2401.00002).\n\nBut 7% (2401.00002), 2401.00003.")], "path string, text string")
    assert {tuple(r)[1:] for r in documents.uncited_numbers(text_, bib).collect()} == {("2401.00002", "number without a quote"), ("2401.00003", "unknown paper")}
    table = value(spark, documents.router_rows(F.lit("| a | b | c |\n|---|---|---|\n| `x` | when | out |\n")))
    assert [tuple(x) for x in table] == [("x", "when", "out")]


def test_report_lines(spark):
    rows = verdicts(spark, [("a", 0, True, True, "s"), ("b", 0, False, False, "s")])
    lines = [r.line for r in reports.confusion_lines(rates.summarise(rows)).orderBy("at").collect()]
    assert lines[1].split() == ["should", "1.0", "0.0"] and len({len(x) for x in lines}) == 1
    assert "100.0%" in reports.rate_lines(rates.summarise(rows, ["band"]), "band").first().line


# --- sources and streams


def test_records(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"item_id": "a", "arm": "x"}\n\n{"item_id": "b", "arm": "x"}\n{"item_id": "c", "ar')
    got = records.read_checkpoint(spark, str(path), records.RUN)
    assert [(r.line_no, r.item_id) for r in got.orderBy("line_no").collect()] == [(0, "a"), (2, "b")]
    assert records.completed_keys(spark, str(path), records.RUN, ["item_id", "arm"]).count() == 2
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        records.read_records(spark, str(path), records.RUN).collect()
    path.write_text('{"item_id": "a"\n{"item_id": "b"}\n')
    with pytest.raises(guards.Refused):
        records.read_checkpoint(spark, str(path), records.RUN)
    out = tmp_path / "out"
    records.write_records(spark.createDataFrame([("a", 1)], "`case` string, judge int"), str(out))
    assert records.read_records(spark, str(out), records.LEDGER).first().judge == 1


def test_registers(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('# head\n{"kind": "moved", "to_version": 2, "date": "2026-01-02"}\n{"kind": "odd", "to_version": 2, "date": "2026-01-02"}\n{nope\n')
    rows, issues = records.read_corrections(spark, str(path))
    assert rows.count() == 1 and {r.message for r in issues.collect()} == {"unknown kind", "not JSON"}
    path.write_text("a # why\n# all\n\nb\na\n")
    assert {r.key for r in records.read_baseline(spark, str(path)).collect()} == {"a", "b"}
    path.write_text('[{"task_id": "t", "task": "x", "shards": ["a", {"shard": "b"}]}]')
    assert records.read_corpus(spark, str(path)).first().shards == ["a", "b"]
    with pytest.raises(guards.Refused):
        records.verify_file(spark, str(path), 3, "00")


def test_keys(spark, tmp_path):
    cases, issues = keys.load_key(spark, "version: 3\nshould_fire:\n- {id: a, turn: go, routes: [p, p]}\nshould_not_fire:\n- {id: b, turn: stop, route: p}\n- {id: a, turn: ''}\n")
    assert cases.count() == 3 and {r.set_version for r in cases.collect()} == {3}
    assert {tuple(r) for r in issues.collect()} == {("a", "duplicate route"), ("b", "a negative has a route"), ("a", "duplicate id"), ("a", "no turn")}
    assert keys.parse_only("a, b#1 ,,c") == ("a", "b#1", "c")
    (tmp_path / "ids.txt").write_text("a, b\n# c\n\n d #e\n")
    assert keys.parse_only(f"@{tmp_path}/ids.txt", spark) == ("a, b", "d #e")
    only = spark.createDataFrame([("zz",)], "id string")
    with pytest.raises(guards.Refused):
        keys.select_cases(cases, only)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 5, "y"), ("b", 2, "z"), ("a", 3, "w")]
    df = spark.createDataFrame(rows, "k string, at int, v string")
    for part in (df.limit(2), df.filter("at in (2, 3)")):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {tuple(r) for r in streams.stream_last_write_wins(stream, ["k"], "at").collect()}
    assert got == {("a", 5, "y"), ("b", 2, "z")}


def test_claim_numbers_are_not_any_digit(spark):
    told = lambda line: value(spark, documents.asserts_a_number(F.lit(line)))
    assert all(map(told, ["up +16.6pp on it", "39%", "-1.3 pp", "kappa = 0.88", "κ: .7", "AUC 0.679", "auc=.9", "2605.23950 has 5 %"]))
    assert not any(map(told, ["12 runs", "in 2024", "v3.1", "see https://x.org/5%", "arXiv:2605.23950", "3 pp. of notes", "kappa is high", "AUC of it"]))


def test_falsifier_battery_counts_each_verdict_by_itself(spark):
    half = spark.createDataFrame([(0.5,)], "threshold double")
    rows = [("a", 1.0, 2.0, 2.0, True, False), ("b", 1.0, 2.0, 2.0, True, False)]
    df = spark.createDataFrame(rows, "triplet_id string, q_base double, q_governing double, q_matched double, expect_governing_change boolean, expect_matched_change boolean")
    assert tuple(movement.falsifier_battery(df, half).first()) == (2, 1.0, 0.0, False)
    with pytest.raises(guards.Refused):
        movement.falsifier_battery(df.limit(0), half)


def test_draws_from_a_library_that_is_too_small_are_refused(spark):
    library = spark.createDataFrame([(k, 10) for k in range(10)], "id long, size long")
    assert generate.budget_draw(library, "id", "size", 35, 1, max_share=0.5).count() == 4
    for budget, share in ((101, 1.0), (35, 0.3)):
        with pytest.raises(guards.Refused):
            generate.budget_draw(library, "id", "size", budget, 1, max_share=share)


def test_casefile_diagnosis(spark):
    schema = "recommended array<string>, traps array<string>, unjustified array<string>, missing string, pivot_present boolean, pivot_accepts array<string>, exposure string, exposure_band string, first_order_band string, blocks_found array<string>"
    rows = [(["A1"], ["A1"], [], "The Lease date is open", True, ["lease DATE"], "high", "high", "low", ["CONDITIONS", "EXPOSURE", "MISSING", "ACTIONS"]), (["A2"], [], ["A2"], "None.", None, None, "low", "high", "low", ["ACTIONS"])]
    out = casefiles.diagnose(spark.createDataFrame(rows, schema)).select("trap_hit", "unjustified_hit", "pivot_ok", "named_an_unknown", "exposure_ok", "exposure_first_order", "blocks_complete").collect()
    assert [tuple(r) for r in out] == [(True, False, True, True, True, False, True), (False, True, True, False, False, True, False)]
