"""Item analysis, rank statistics, agreement, calibration, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rates as forms
from ..operators import agreement, calibration, integrity, items, ranks, reliability, resample
from .proxies import DOCS_SQL, FORECAST_SQL, LINES_SQL, RATERS_SQL, doc_verdicts, forecasts, line_verdicts, ratings
from .registry import Tables, query, r

#: Items are event types, respondents are users with their last event of the type; every third user counts as positive.
GRID_SQL = """lww AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
 grid AS (SELECT event_type AS item, user_id AS who, ((value > 20) = (user_id % 3 = 0))::INT AS correct, user_id % 3 = 0 AS label FROM lww)"""


def event_grid(t: Tables) -> DataFrame:
    last = integrity.last_write_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")
    verdicts = last.select(F.col("event_type").alias("case"), F.lit("a").alias("arm"), F.col("user_id").alias("repeat"), (F.col("value") > 20).alias("fired"), (F.col("user_id") % 3 == 0).alias("should_fire"))
    return items.respondent_grid(verdicts)


@query(f"WITH {GRID_SQL} SELECT item, {r('avg(correct)')} AS p, count(*) AS n FROM grid GROUP BY 1")
def item_difficulty(t: Tables) -> DataFrame:
    return items.item_difficulty(event_grid(t)).withColumnRenamed("case", "item")


REST_SQL = f"""WITH {GRID_SQL}, x AS (SELECT item, correct::DOUBLE AS x, (sum(correct) OVER (PARTITION BY who) - correct)::DOUBLE AS y FROM grid),
 d AS (SELECT item, count(*) AS n, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN {{r}} END AS r FROM x GROUP BY 1)"""


@query(REST_SQL.format(r=r("corr(x, y)")) + " SELECT item, n, r FROM d")
def item_discrimination(t: Tables) -> DataFrame:
    return items.item_discrimination(event_grid(t)).withColumnRenamed("case", "item")


@query(f"WITH {LINES_SQL}, p AS (SELECT l_orderkey, avg((fired = should_fire)::INT) AS p, bool_or(should_fire) AS label FROM linev WHERE fired IS NOT NULL GROUP BY 1) SELECT label, p::INT AS p, count(*) AS n_items FROM p WHERE p = 0 OR p = 1 GROUP BY 1, 2")
def broken_items(t: Tables) -> DataFrame:
    return items.broken_items(items.respondent_grid(line_verdicts(t).withColumn("arm", F.lit("a"))))


@query(
    f"""WITH {LINES_SQL}, g AS (SELECT l_orderkey, triple, l_linenumber, (bool_or(fired) = bool_or(should_fire))::INT AS correct FROM linev WHERE fired IS NOT NULL GROUP BY 1, 2, 3),
 size AS (SELECT triple, count(DISTINCT l_orderkey) AS size FROM linev GROUP BY 1),
 per AS (SELECT triple, l_linenumber, count(DISTINCT l_orderkey) AS answered, min(correct) AS all_right FROM g GROUP BY 1, 2)
 SELECT triple, count(*) FILTER (WHERE answered = size) AS n_complete, {r("avg(all_right) FILTER (WHERE answered = size)")} AS joint FROM per JOIN size USING (triple) GROUP BY 1"""
)
def triple_joint(t: Tables) -> DataFrame:
    rows = line_verdicts(t).withColumn("arm", F.lit("a"))
    one = integrity.last_write_wins(rows.filter("fired is not null").select("case", "arm", "repeat", "fired", "should_fire"), ["case", "arm", "repeat"], "fired")
    return items.triple_joint(items.respondent_grid(one), rows.select("case", "triple"))


@query(REST_SQL.format(r="corr(x, y)") + f", p AS (SELECT item, avg(correct) AS p FROM grid GROUP BY 1) SELECT count(*) AS n_items, {r('quantile_cont(p, 0.5)')} AS median_p, {r('quantile_cont(r, 0.5)')} AS median_r, count(*) FILTER (WHERE r IS NULL) AS undefined_r FROM p JOIN d USING (item)")
def item_analysis(t: Tables) -> DataFrame:
    return items.item_analysis(event_grid(t))


def auc_sql(source: str, value: str, label: str, group: str = "") -> str:
    by, part = (f"{group}, ", f"PARTITION BY {group} ") if group else ("", "")
    return f"""vals AS (SELECT {by}{value} AS v, count(*) FILTER (WHERE {label}) AS p, count(*) FILTER (WHERE NOT {label}) AS q FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}v),
 b AS (SELECT *, coalesce(sum(q) OVER ({part}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals)
 SELECT {by}sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg, {r("CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (below + q * 0.5::DOUBLE)) / (sum(p) * sum(q)) ELSE 0.5 END")} AS auc FROM b {f"GROUP BY {group}" if group else ""}"""


@query(f"WITH {DOCS_SQL}, " + auc_sql("docv", "n_chars", "should_fire"))
def auc_pooled(t: Tables) -> DataFrame:
    return ranks.auc(doc_verdicts(t), "n_chars", "should_fire")


@query(f"WITH {DOCS_SQL}, " + auc_sql("docv", "n_chars", "should_fire", "lang"))
def auc_by_language(t: Tables) -> DataFrame:
    return ranks.auc(doc_verdicts(t), "n_chars", "should_fire", ["lang"])


#: Triples: orders with exactly three lines, the first line number of which is the positive.
TRIPLES_SQL = """tri AS (SELECT l_orderkey AS c, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1 AS label FROM lineitem
   WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 3))"""


def triples(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey")
    place = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.withColumns({"n": F.count("*").over(w), "place": place}).filter("n = 3").select(F.col("l_orderkey").alias("c"), F.col("l_extendedprice").alias("v"), (F.col("place") == 1).alias("label"))


SCORES_SQL = f"""{TRIPLES_SQL}, s AS (SELECT a.c, a.label, (sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END)::DOUBLE - 0.5) / 2 AS s
   FROM (SELECT *, row_number() OVER () AS i FROM tri) a JOIN tri b ON a.c = b.c GROUP BY a.c, a.i, a.label),
 g AS (SELECT c, max(s) FILTER (WHERE label) AS observed, min(s) AS lo, max(s) AS hi, avg((s - 0.5) ** 2) AS e2, avg((s - 0.5) ** 4) AS e4 FROM s GROUP BY c),
 t AS (SELECT count(*) AS n_clusters, avg(observed) AS m, sqrt(sum(e2)) / count(*) AS se, avg(lo) AS low, avg(hi) AS high, sum((observed - 0.5) ** 2) - sum(e2) AS excess, sum(e4 - e2 ** 2) AS var FROM g)"""


@query(f"WITH {SCORES_SQL} SELECT n_clusters, {r('m')} AS matched_auc, {r('se')} AS null_se, {r('low')} AS low, {r('high')} AS high, {r('CASE WHEN se > 0 THEN abs(m - 0.5) / se ELSE 0.0 END')} AS z, {r('CASE WHEN var > 1e-12 THEN excess / sqrt(var) ELSE 0.0 END')} AS dispersion_z FROM t")
def matched_auc(t: Tables) -> DataFrame:
    return ranks.matched(triples(t), "v", "label", "c")


#: Suppliers as clusters of parts' sizes: a constant one is fixed.
ATTAIN_SQL = """cl AS (SELECT l_orderkey AS c, l_quantity AS v, l_linenumber = 1 AS label FROM lineitem), per AS (SELECT c, min(v) AS v, min(v) = max(v) AS still, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS q FROM cl GROUP BY c),
 f AS (SELECT sum(a.p * b.q * CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END)::DOUBLE AS fixed, sum(a.p * b.q) AS pairs FROM (SELECT v, sum(p) AS p FROM per WHERE still GROUP BY v) a, (SELECT v, sum(q) AS q FROM per WHERE still GROUP BY v) b),
 t AS (SELECT sum(p) * sum(q) AS total FROM per)"""


@query(f"WITH {ATTAIN_SQL} SELECT {r('fixed / total')} AS low, {r('(fixed + total - pairs) / total')} AS high FROM f, t")
def attainable_auc(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("c"), F.col("l_quantity").alias("v"), (F.col("l_linenumber") == 1).alias("label"))
    return ranks.attainable_auc(rows, "v", "label", "c")


RATINGS = f"WITH {RATERS_SQL}, k AS (SELECT unit, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY unit) AS m FROM raters GROUP BY 1, 2)"
GAPPED = f"WITH {RATERS_SQL}, k AS (SELECT unit, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY unit) AS m FROM raters WHERE NOT missing GROUP BY 1, 2)"


@query(GAPPED + f", u AS (SELECT unit, sum(c * (c - 1) / 2) AS agree, max(m) * (max(m) - 1) / 2 AS pairs FROM k GROUP BY 1) SELECT {r('sum(agree)')} AS agree, {r('sum(pairs)')} AS pairs, {r('sum(agree) / sum(pairs)')} AS agreement FROM u")
def percent_agreement(t: Tables) -> DataFrame:
    return agreement.percent_agreement(ratings(t, gaps=True)).select(F.col("agree").cast("double").alias("agree"), F.col("pairs").cast("double").alias("pairs"), "agreement")


@query(GAPPED.replace(", k AS", ", u AS (SELECT unit, count(DISTINCT label) FILTER (WHERE NOT missing) AS kinds, count(*) FILTER (WHERE missing) AS gaps FROM raters GROUP BY 1), k AS") + f" SELECT count(*) AS n_units, count(*) FILTER (WHERE kinds = 1 AND gaps = 0) AS n_unanimous, {r('avg((kinds = 1 AND gaps = 0)::INT)')} AS rate FROM u")
def unanimity(t: Tables) -> DataFrame:
    return agreement.unanimity(ratings(t, gaps=True))


@query(f"WITH p AS (SELECT count(*)::DOUBLE AS n, avg((quality = toxic)::INT) AS o, (avg((quality = 1)::INT) * avg((toxic = 1)::INT) + avg((quality = 0)::INT) * avg((toxic = 0)::INT)) AS e FROM labels) SELECT n::BIGINT AS n, {r('o')} AS observed, {r('e')} AS expected, {r('(o - e) / (1 - e)')} AS kappa FROM p")
def cohen_kappa(t: Tables) -> DataFrame:
    return agreement.cohen_kappa(t.labels, "quality", "toxic")


FLEISS_SQL = "u AS (SELECT unit, (sum(c * c) - max(m)) / (max(m) * (max(m) - 1))::DOUBLE AS p, max(m) AS m FROM k GROUP BY 1), o AS (SELECT count(*) AS n_units, max(m)::BIGINT AS raters, avg(p) AS observed, sum(m) AS total FROM u), e AS (SELECT sum(c * c) AS cc FROM (SELECT label, sum(c) AS c FROM k GROUP BY 1)), x AS (SELECT *, cc / (total * total)::DOUBLE AS expected FROM o, e)"


@query(RATINGS + f", {FLEISS_SQL} SELECT n_units, raters, {r('observed')} AS observed, {r('expected')} AS expected, {r('(observed - expected) / (1 - expected)')} AS kappa FROM x")
def fleiss_kappa(t: Tables) -> DataFrame:
    return agreement.fleiss_kappa(ratings(t))


@query(RATINGS + f", {FLEISS_SQL} SELECT {r('raters / (1 + (raters - 1) * greatest(0, least(1, (observed - expected) / (1 - expected))))')} AS effective FROM x")
def effective_raters(t: Tables) -> DataFrame:
    return agreement.fleiss_kappa(ratings(t)).select(forms.effective_raters(F.col("raters"), F.col("kappa")).alias("effective"))


@query(GAPPED + f", i AS (SELECT unit, (max(m) * max(m) - sum(c * c)) / (max(m) - 1)::DOUBLE AS off, max(m) AS m FROM k WHERE m >= 2 GROUP BY 1), d AS (SELECT count(*) AS n_units, sum(off) AS off, sum(m) AS n FROM i), p AS (SELECT sum(c * c) AS cc FROM (SELECT label, sum(c) AS c FROM k WHERE m >= 2 GROUP BY 1)), a AS (SELECT count(DISTINCT unit) AS all_units FROM raters) SELECT n_units, all_units - n_units AS n_dropped, {r('1 - off / ((n * n - cc) / (n - 1)::DOUBLE)')} AS alpha FROM d, p, a")
def krippendorff_alpha(t: Tables) -> DataFrame:
    return agreement.krippendorff_alpha(ratings(t, gaps=True))


@query(f"WITH {FORECAST_SQL} SELECT {r('avg((f - o) ** 2)')} AS brier FROM fc")
def brier(t: Tables) -> DataFrame:
    return calibration.brier(calibration.checked(forecasts(t)))


@query(f"WITH {FORECAST_SQL}, c AS (SELECT greatest(1e-15, least(1 - 1e-15, f)) AS p, o FROM fc) SELECT {r('-avg(CASE WHEN o = 1 THEN ln(p) ELSE ln(1 - p) END)')} AS log_score FROM c")
def log_score(t: Tables) -> DataFrame:
    return calibration.log_score(calibration.checked(forecasts(t)))


@query(f"WITH {FORECAST_SQL}, a AS (SELECT f, count(*) AS n, sum(o) AS hits FROM fc GROUP BY 1), t AS (SELECT sum(n) AS N0, sum(hits) / sum(n) AS base, count(*) AS n_distinct FROM a), m AS (SELECT n_distinct, base * (1 - base) AS unc, sum(n * (f - hits / n) ** 2) / any_value(N0) AS rel, sum(n * (hits / n - base) ** 2) / any_value(N0) AS res FROM a, t GROUP BY 1, 2) SELECT n_distinct, {r('rel')} AS reliability, {r('res')} AS resolution, {r('unc')} AS uncertainty, {r('rel - res + unc')} AS brier, {r('1 - (rel - res + unc) / unc')} AS skill FROM m")
def murphy(t: Tables) -> DataFrame:
    return calibration.murphy(calibration.checked(forecasts(t)))


BINS_SQL = "+".join(f"(f >= {k * 0.1!r}::DOUBLE)::INT" for k in range(1, 10))


@query(f"WITH {FORECAST_SQL} SELECT ({BINS_SQL})::INT AS bin, count(*) AS n, {r('avg(f)')} AS confidence, {r('avg(o)')} AS accuracy FROM fc GROUP BY 1")
def reliability_curve(t: Tables) -> DataFrame:
    return calibration.reliability_curve(calibration.checked(forecasts(t)))


@query(f"WITH {FORECAST_SQL}, b AS (SELECT ({BINS_SQL}) AS bin, count(*) AS n, avg(f) AS c, avg(o) AS a FROM fc GROUP BY 1) SELECT {r('sum(n * abs(c - a)) / sum(n)')} AS ece FROM b")
def calibration_error(t: Tables) -> DataFrame:
    return calibration.expected_calibration_error(calibration.checked(forecasts(t)))


@query(f"WITH {FORECAST_SQL}, a AS (SELECT f, count(*) AS n, sum(o) AS hits FROM fc GROUP BY 1), h AS (SELECT greatest(0.01, least(0.25, pow(sum(n)::DOUBLE, -1.0 / 3))) AS h FROM a), y AS (SELECT x.f, x.n, sum(exp(-0.5 * ((x.f - z.f) / h) ** 2) * z.hits) / sum(exp(-0.5 * ((x.f - z.f) / h) ** 2) * z.n) AS y FROM a x, a z, h GROUP BY 1, 2) SELECT {r('sum(n * abs(y - f)) / sum(n)')} AS smooth_ce FROM y")
def smooth_calibration(t: Tables) -> DataFrame:
    return calibration.smooth_calibration_error(calibration.checked(forecasts(t)))


@query(f"SELECT {r('quantile_cont(value, 0.9)')} AS aptitude, {r('quantile_cont(value, 0.9) - quantile_cont(value, 0.1)')} AS unreliability, {r('avg(value)')} AS mean FROM events")
def aptitude(t: Tables) -> DataFrame:
    return reliability.aptitude(t.events, "value")


def icc_sql(source: str, value: str, cluster: str) -> str:
    return f"""per AS (SELECT {cluster}, count(*) AS n, sum({value}) AS s, sum({value} * {value}) AS ss FROM {source} GROUP BY 1),
 tt AS (SELECT count(*) AS k, sum(n) AS nn, sum(s) AS S1, sum(ss) AS S2, sum(s * s / n) AS B, sum(n * n) AS n2 FROM per),
 ms AS (SELECT k, nn, (B - S1 * S1 / nn) / (k - 1) AS msb, (S2 - B) / (nn - k) AS msw, (nn - n2 / nn::DOUBLE) / (k - 1) AS m0 FROM tt),
 ic AS (SELECT *, greatest(0, least(1, (msb - msw) / (msb + (m0 - 1) * msw))) AS icc FROM ms)"""


@query(f"WITH {icc_sql('events', 'value', 'user_id')}, it AS (SELECT user_id, quantile_cont(value, 0.9) AS a, quantile_cont(value, 0.1) AS b, avg(value) AS m FROM events GROUP BY 1 HAVING count(value) >= 2) SELECT count(*) AS n_items, {r('avg(a)')} AS aptitude, {r('avg(a - b)')} AS unreliability, {r('avg(m)')} AS mean, {r('any_value(icc)')} AS icc FROM it, ic")
def reliability_per_user(t: Tables) -> DataFrame:
    return reliability.per_item(t.events, "value", "user_id")


@query(f"WITH o AS (SELECT o_totalprice / 1000 AS v, o_custkey FROM orders), {icc_sql('o', 'v', 'o_custkey')} SELECT {r('icc')} AS icc, nn::BIGINT AS n_items, k AS n_clusters, {r('nn / k')} AS mean_size, {r('1 + (nn / k - 1) * icc')} AS deff, {r('nn / (1 + (nn / k - 1) * icc)')} AS n_effective FROM ic")
def icc_by_customer(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_totalprice") / 1000).alias("v"), "o_custkey")
    icc = resample.intraclass_correlation(rows, "v", "o_custkey")
    return icc.withColumns({"deff": forms.design_effect(F.col("mean_size"), F.col("icc")), "n_effective": forms.effective_n(F.col("n_items"), F.col("mean_size"), F.col("icc"))})
