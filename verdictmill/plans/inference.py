"""Resampling, tests, power and movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rates as forms
from ..operators import inference, movement, resample
from .analysis import icc_sql
from .proxies import DOCS_SQL, doc_verdicts
from .registry import Tables, query, r

REPLICATES = 400


def boot_sql(source: str, value: str, cluster: str, seed: str, name: str = "") -> str:
    """Replicate means of a cluster bootstrap, in CTEs with ``name`` behind their names."""
    return f"""cs{name} AS (SELECT {cluster} AS cluster, sum({value})::DOUBLE AS s, count({value}) AS n, row_number() OVER (ORDER BY {cluster}) - 1 AS k FROM {source} GROUP BY {cluster}),
 kk{name} AS (SELECT count(*) AS kk FROM cs{name}),
 dr{name} AS (SELECT r, ('0x' || substr(md5('{seed}:' || r || ':' || j), 1, 8))::BIGINT % kk AS k FROM (SELECT unnest(range(0, {REPLICATES})) AS r), (SELECT unnest(range(0, kk)) AS j, kk FROM kk{name})),
 rm{name} AS (SELECT r, sum(s) / sum(n) AS mean FROM dr{name} JOIN cs{name} USING (k) GROUP BY r)"""


ENDS = f"{r('quantile_cont(mean, 0.025)')} AS low, {r('quantile_cont(mean, 0.975)')} AS high, {r('stddev_samp(mean)')} AS se"
ITEMS_SQL = "it AS (SELECT source AS c, doc_id, avg((fired = should_fire)::INT) AS v FROM docv GROUP BY 1, 2 HAVING count(fired) > 0)"


@query(f"WITH {DOCS_SQL}, {ITEMS_SQL}, {boot_sql('it', 'v', 'c', '11')}, {icc_sql('it', 'v', 'c')}, p AS (SELECT avg(v) AS point, count(v) AS n_items, count(DISTINCT c) AS n_clusters FROM it) SELECT {r('any_value(point)')} AS point, any_value(n_items) AS n_items, any_value(n_clusters) AS n_clusters, {ENDS}, {r('any_value(icc)')} AS icc, {r('1 + (any_value(nn / k) - 1) * any_value(icc)')} AS deff, {r('any_value(n_items) / (1 + (any_value(nn / k) - 1) * any_value(icc))')} AS n_effective FROM rm, p, ic")
def boot_rate(t: Tables) -> DataFrame:
    return resample.bootstrap_rate(doc_verdicts(t), "source", REPLICATES, 11)


@query(f"WITH {DOCS_SQL}, {ITEMS_SQL}, a AS (SELECT v, c FROM it JOIN documents USING (doc_id) WHERE lang = 'en'), b AS (SELECT v, c FROM it JOIN documents USING (doc_id) WHERE lang <> 'en'), {boot_sql('a', 'v', 'c', '12c', '1')}, {boot_sql('b', 'v', 'c', '12t', '2')}, m AS (SELECT x.r, y.mean - x.mean AS mean FROM rm1 x JOIN rm2 y USING (r)), p AS (SELECT (SELECT avg(v) FROM b) - (SELECT avg(v) FROM a) AS point) SELECT {r('any_value(point)')} AS point, {ENDS} FROM m, p")
def boot_rate_difference(t: Tables) -> DataFrame:
    rows = doc_verdicts(t)
    return resample.bootstrap_rate_difference(rows.filter("lang = 'en'"), rows.filter("lang <> 'en'"), "source", REPLICATES, 12)


DIFF_SQL = "df AS (SELECT (l_linestatus = 'O')::INT - (l_returnflag = 'R')::INT AS d, l_suppkey AS c FROM lineitem)"


def _differences(t: Tables) -> DataFrame:
    return t.lineitem.select(((F.col("l_linestatus") == "O").cast("int") - (F.col("l_returnflag") == "R").cast("int")).alias("d"), F.col("l_suppkey").alias("c"))


@query(f"WITH {DIFF_SQL}, {boot_sql('df', 'd', 'c', '7')}, p AS (SELECT avg(d) AS point, count(d) AS n_items, count(DISTINCT c) AS n_clusters FROM df) SELECT {r('any_value(point)')} AS point, any_value(n_items) AS n_items, any_value(n_clusters) AS n_clusters, {ENDS} FROM rm, p")
def boot_difference(t: Tables) -> DataFrame:
    return resample.bootstrap_mean(_differences(t), "d", "c", REPLICATES, 7)


@query(f"WITH a AS (SELECT l_quantity AS v, l_suppkey AS c FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_quantity AS v, l_suppkey AS c FROM lineitem WHERE l_linestatus = 'O'), {boot_sql('a', 'v', 'c', '3c', '1')}, {boot_sql('b', 'v', 'c', '3t', '2')}, m AS (SELECT x.r, y.mean - x.mean AS mean FROM rm1 x JOIN rm2 y USING (r)), p AS (SELECT (SELECT avg(v) FROM b) - (SELECT avg(v) FROM a) AS point) SELECT {r('any_value(point)')} AS point, {ENDS} FROM m, p")
def boot_two_sample(t: Tables) -> DataFrame:
    part = lambda s: t.lineitem.filter(F.col("l_linestatus") == s).select(F.col("l_quantity").alias("v"), F.col("l_suppkey").alias("c"))
    return resample.bootstrap_two_sample(part("F"), part("O"), "v", "c", REPLICATES, 3)


@query(f"WITH d AS (SELECT l.doc_id AS i, (l.quality - (d.n_chars > 1500)::INT)::DOUBLE AS d FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS (SELECT r, sum(d * CASE WHEN ('0x' || substr(md5('5:' || r || ':' || i), 1, 8))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) / count(*) AS nul FROM d, (SELECT unnest(range(0, {REPLICATES})) AS r) GROUP BY r), o AS (SELECT count(*) AS n, sum(d) / count(*) AS observed FROM d) SELECT n, {r('observed')} AS observed, {r('(count(*) FILTER (WHERE nul >= observed - 1e-12) + 1) / (count(*) + 1)::DOUBLE')} AS p FROM f, o GROUP BY n, observed")
def permutation_test(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", (F.col("quality") - (F.col("n_chars") > 1500).cast("int")).alias("d"))
    return resample.permutation_test(rows, "d", "doc_id", REPLICATES, 5)


PAIRS_SQL = "pr AS (SELECT d.lang, d.n_chars > 1500 AS a, l.quality = 1 AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
DISCORDANT = "count(*) AS n_pairs, count(*) FILTER (WHERE NOT a AND b) AS gains, count(*) FILTER (WHERE a AND NOT b) AS losses"
TAIL = "(SELECT sum(exp(lgamma(gains + losses + 1) - lgamma(j + 1) - lgamma(gains + losses - j + 1) - (gains + losses) * ln(2))) FROM (SELECT unnest(range({k}, gains + losses + 1)) AS j))"
TWO_SIDED = f"CASE WHEN gains + losses = 0 THEN 1.0 ELSE least(1.0, 2 * least(1.0, {TAIL.format(k='greatest(gains, losses)')})) END"


def _outcomes(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("n_chars") > 1500).alias("a"), (F.col("quality") == 1).alias("b"))


@query(f"WITH {PAIRS_SQL}, ct AS (SELECT {DISCORDANT} FROM pr) SELECT n_pairs, gains, losses, {r(TWO_SIDED)} AS p FROM ct")
def mcnemar(t: Tables) -> DataFrame:
    return inference.mcnemar(_outcomes(t), "a", "b", "two-sided")


@query(f"WITH {PAIRS_SQL}, ct AS (SELECT lang, {DISCORDANT} FROM pr GROUP BY lang) SELECT lang, n_pairs, gains, losses, {r(TWO_SIDED)} AS p FROM ct")
def mcnemar_by_language(t: Tables) -> DataFrame:
    return inference.mcnemar(_outcomes(t), "a", "b", "two-sided", ["lang"])


BH_SQL = "p AS (SELECT l_suppkey AS key, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) ** 3 AS p FROM lineitem GROUP BY 1)"


@query(f"WITH {BH_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY p, key) AS rank, count(*) OVER () AS m FROM p), q AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k) SELECT key, {r('p')} AS p, rank::INT AS rank, {r('q')} AS q_value, q <= 0.1 AS rejected FROM q")
def benjamini_hochberg(t: Tables) -> DataFrame:
    tests = t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(F.pow(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), F.lit(3.0)).alias("p"))
    return inference.benjamini_hochberg(tests)


@query(
    f"""WITH pr AS (SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O') - avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 12) AS d FROM lineitem GROUP BY 1),
 a AS (SELECT abs(d) AS size, count(*) AS t, count(*) FILTER (WHERE d > 0) AS up FROM pr WHERE d <> 0 GROUP BY 1),
 k AS (SELECT *, coalesce(sum(t) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS mid FROM a),
 s AS (SELECT sum(t)::BIGINT AS n, least(sum(up * mid), sum((t - up) * mid)) AS w, sum(t * t * t - t) AS ties FROM k)
 SELECT n, {r("w")} AS w, {r("(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24 - ties / 48.0)")} AS z FROM s"""
)
def wilcoxon(t: Tables) -> DataFrame:
    flag = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    pairs = t.lineitem.groupBy("l_suppkey").agg(flag("F").alias("a"), flag("O").alias("b"))
    return inference.wilcoxon(pairs, "a", "b").drop("p", "exact")


#: Pairs of a supplier: the quantities of a part's lines on either side of a status. The exact distribution has one row per rank, from the counts of the row before.
RANKS_SQL = """RECURSIVE x(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda s: coalesce(c[s + 1], 0) + CASE WHEN s > n THEN coalesce(c[s - n], 0) ELSE 0 END) FROM x WHERE n < 50),
 pr AS (SELECT o_orderpriority AS g, l_suppkey, round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') - avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 12) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
  UNION ALL SELECT 'of the part ' || l_partkey % 5, l_suppkey, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O') - avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 12) FROM lineitem WHERE l_suppkey % 7 = 0 GROUP BY 1, 2),
 a AS (SELECT g, abs(d) AS size, count(*) AS t, count(*) FILTER (WHERE d > 0) AS up FROM pr WHERE d IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY g ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS mid FROM a WHERE size > 0),
 s AS (SELECT g, sum(t)::BIGINT AS n, least(sum(up * mid), sum((t - up) * mid)) AS w, sum(t * t * t - t) AS ties FROM k GROUP BY g),
 e AS (SELECT s.*, n <= 50 AND ties = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.g = s.g AND size = 0) AS exact FROM s)"""


@query(f"WITH {RANKS_SQL} SELECT g, n, {r('w')} AS w, exact, CASE WHEN exact THEN {r('least(1.0, 2 * list_sum(x.c[1:w::INT + 1]) / 2.0::DOUBLE ** n)')} END AS p FROM e LEFT JOIN x USING (n)")
def wilcoxon_by_group(t: Tables) -> DataFrame:
    """Exact where a group's pairs are few and untied, the normal approximation (whose p DuckDB has no function for) elsewhere."""
    side = lambda s, v: F.avg(F.when(F.col("l_linestatus") == s, F.col(v)))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("g"), "l_suppkey").agg(side("F", "l_extendedprice").alias("a"), side("O", "l_extendedprice").alias("b"))
    few = t.lineitem.filter("l_suppkey % 7 = 0").groupBy(F.concat(F.lit("of the part "), (F.col("l_partkey") % 5).cast("string")).alias("g"), "l_suppkey").agg(side("F", "l_quantity").alias("a"), side("O", "l_quantity").alias("b"))
    out = inference.wilcoxon(lines.unionByName(few), "a", "b", ["g"]).filter("n > 0")
    return out.select("g", "n", "w", "exact", F.when(F.col("exact"), F.col("p")).alias("p"))


ZA, ZB = forms.power_quantiles(0.05, 0.8)
GRID_SQL = "g AS (SELECT DISTINCT l_quantity::INT * 20 AS pairs, 0.10 + 0.05 * l_linenumber::DOUBLE AS pd FROM lineitem)"


@query(f"WITH {GRID_SQL} SELECT pairs, {r('pd')} AS discordant, ceil((({ZA!r} * sqrt(pd) + {ZB!r} * sqrt(pd - 0.05::DOUBLE * 0.05::DOUBLE)) / 0.05::DOUBLE) ** 2 * 1.5::DOUBLE)::BIGINT AS required FROM g")
def required_pairs(t: Tables) -> DataFrame:
    grid = t.lineitem.select((F.col("l_quantity").cast("int") * 20).alias("pairs"), (F.lit(0.10) + F.lit(0.05) * F.col("l_linenumber")).alias("discordant")).distinct()
    return grid.withColumn("required", forms.required_pairs(F.lit(0.05), F.col("discordant"), deff=1.5))


def _halved(steps: int = 60) -> str:
    need = f"(({ZA!r} * sqrt(pd) + {ZB!r} * sqrt(greatest(0, pd - m * m))) / m) ** 2"
    return f"""RECURSIVE {GRID_SQL}, h AS (SELECT pairs, pd, 0 AS k, 1e-9::DOUBLE AS low, pd AS high FROM g UNION ALL
 SELECT pairs, pd, k + 1, CASE WHEN ok THEN low ELSE m END, CASE WHEN ok THEN m ELSE high END FROM (SELECT *, {need} <= pairs AS ok FROM (SELECT *, (low + high) / 2 AS m FROM h WHERE k < {steps})))"""


@query(f"WITH {_halved()} SELECT pairs, {r('pd')} AS discordant, CASE WHEN (({ZA!r} * sqrt(pd) + {ZB!r} * sqrt(greatest(0, pd - pd * pd))) / pd) ** 2 <= pairs THEN {r('high')} END AS effect FROM h WHERE k = 60")
def detectable_effect(t: Tables) -> DataFrame:
    grid = t.lineitem.select((F.col("l_quantity").cast("int") * 20).alias("pairs"), (F.lit(0.10) + F.lit(0.05) * F.col("l_linenumber")).alias("discordant")).distinct()
    return grid.withColumn("effect", forms.detectable_effect(F.col("pairs"), F.col("discordant")))


#: A customer's mean order is the base, its largest and smallest orders the variants; two statuses are repeats.
MOVE_SQL = """ev AS (SELECT o_custkey AS id, avg(o_totalprice) AS b, max(o_totalprice) AS g, min(o_totalprice) AS m FROM orders GROUP BY 1 HAVING count(*) > 1),
 bp AS (SELECT o_custkey AS id, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS q0, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS q1 FROM orders GROUP BY 1),
 mv AS (SELECT id, abs(q1 - q0) / abs(q0) AS m FROM bp WHERE q0 IS NOT NULL AND q1 IS NOT NULL)"""


def _pairs(t: Tables) -> DataFrame:
    at = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return t.orders.groupBy(F.col("o_custkey").alias("triplet_id")).agg(at("F").alias("q0"), at("O").alias("q1")).filter("q0 is not null and q1 is not null")


def _events(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("triplet_id")).agg(F.avg("o_totalprice").alias("q_base"), F.max("o_totalprice").alias("q_governing"), F.min("o_totalprice").alias("q_matched"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query(f"WITH {MOVE_SQL} SELECT {r('max(m)')} AS threshold, arg_min(id, (-m, id)) AS triplet_id FROM mv")
def movement_threshold(t: Tables) -> DataFrame:
    return movement.movement_threshold(_pairs(t))


@query(f"WITH {MOVE_SQL}, df AS (SELECT id, (abs(g - b) / abs(b) > 0.5)::INT - (abs(m - b) / abs(b) > 0.5)::INT AS d FROM ev), {boot_sql('df', 'd', 'id', '9')}, p AS (SELECT avg(d) AS j FROM df), i AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, stddev_samp(mean) AS se FROM rm) SELECT {r('j')} AS j, {r('low')} AS low, {r('high')} AS high, {r('se')} AS se, j >= 0.7 AS kill, CASE WHEN low >= 0.7 THEN 'closes' WHEN high < 0.7 THEN 'survives' ELSE 'indeterminate' END AS state FROM p, i")
def youden_j(t: Tables) -> DataFrame:
    half = t.spark.range(1).select(F.lit(0.5).alias("threshold"))
    return movement.youden_j(_events(t), half, REPLICATES, 9)


@query(f"WITH {MOVE_SQL}, s AS (SELECT count(*) AS n_cases, avg(((abs(g - b) / abs(b) > 0.5) = (id % 2 = 0))::INT) AS sens, avg(((abs(m - b) / abs(b) > 0.5) = (id % 3 = 0))::INT) AS spec FROM ev) SELECT n_cases, {r('sens')} AS sensitivity, {r('spec')} AS specificity, sens = 1.0 AND spec = 1.0 AS passed FROM s")
def falsifier_battery(t: Tables) -> DataFrame:
    half = t.spark.range(1).select(F.lit(0.5).alias("threshold"))
    return movement.falsifier_battery(_events(t).withColumns({"expect_governing_change": F.col("triplet_id") % 2 == 0, "expect_matched_change": F.col("triplet_id") % 3 == 0}), half)


@query(f"WITH {DOCS_SQL}, s AS (SELECT source, avg((fired = should_fire)::INT) AS icc FROM docv WHERE fired IS NOT NULL GROUP BY 1), u AS (SELECT source, 0.3 + 0.4 * icc AS icc FROM s) SELECT source, {r('4 * icc / (1 + 3 * icc)')} AS reliability_of_4, {r('icc')} AS icc FROM u")
def spearman_brown(t: Tables) -> DataFrame:
    rows = doc_verdicts(t).filter("fired is not null").groupBy("source").agg((F.lit(0.3) + 0.4 * F.avg((F.col("fired") == F.col("should_fire")).cast("int"))).alias("icc"))
    return rows.select("source", forms.spearman_brown(F.col("icc"), F.lit(4)).alias("reliability_of_4"), "icc")
