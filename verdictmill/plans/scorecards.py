"""Scorecards: rates by record and by item, bands, kinds, routing, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import z_value
from ..operators import rates
from .proxies import DOCS_SQL, LINES_SQL, doc_verdicts, line_verdicts
from .registry import Tables, query, r

CELLS_SQL = """count(*) FILTER (WHERE fired AND should_fire) AS tp, count(*) FILTER (WHERE fired AND NOT should_fire) AS fp,
  count(*) FILTER (WHERE NOT fired AND NOT should_fire) AS tn, count(*) FILTER (WHERE NOT fired AND should_fire) AS fn, count(*) FILTER (WHERE fired IS NULL) AS unparseable"""


def rates_sql(cells: str, *group: str) -> str:
    """SELECT over a relation with the four cells."""
    n = "(tp + fp + tn + fn)"
    share = lambda a, b: r(f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0.0 END")
    margins = "((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"
    columns = [*group, *(f"{c} AS {c}" for c in ("tp", "fp", "tn", "fn", "unparseable"))]
    columns += [f"{share(a, b)} AS {name}" for name, a, b in (("accuracy", "tp + tn", n), ("precision", "tp", "(tp + fp)"), ("recall", "tp", "(tp + fn)"), ("fpr", "fp", "(fp + tn)"), ("base_rate", "tp + fn", n))]
    columns += [f"CASE WHEN {margins} > 0 THEN {r(f'(tp * tn - fp * fn) / sqrt({margins})')} END AS mcc", r(f"CASE WHEN {n} > 0 THEN greatest(tp + fn, fp + tn)::DOUBLE / {n} ELSE 0.0 END") + " AS majority"]
    return f"SELECT {', '.join(columns)} FROM {cells}"


@query(f"WITH {DOCS_SQL}, c AS (SELECT {CELLS_SQL} FROM docv) " + rates_sql("c"))
def arm_summary(t: Tables) -> DataFrame:
    return rates.summarise(doc_verdicts(t))


@query(f"WITH {DOCS_SQL}, c AS (SELECT band, {CELLS_SQL} FROM docv GROUP BY band) " + rates_sql("c", "band"))
def rates_by_band(t: Tables) -> DataFrame:
    return rates.summarise(doc_verdicts(t), ["band"]).orderBy(rates.in_order(F.col("band")), "band")


ITEMS_SQL = """i AS (SELECT l_orderkey, bool_or(should_fire) AS label, avg(fired::INT) AS p, count(*) FILTER (WHERE fired IS NULL) AS u FROM linev GROUP BY l_orderkey),
 c0 AS (SELECT coalesce(sum(p) FILTER (WHERE label), 0) AS tp, coalesce(sum(p) FILTER (WHERE NOT label), 0) AS fp, coalesce(sum(1 - p) FILTER (WHERE NOT label), 0) AS tn,
   coalesce(sum(1 - p) FILTER (WHERE label), 0) AS fn, sum(u)::BIGINT AS unparseable FROM i)"""


@query(f"WITH {LINES_SQL}, {ITEMS_SQL}, s AS ({rates_sql('c0')}) SELECT * REPLACE ({r('tp')} AS tp, {r('fp')} AS fp, {r('tn')} AS tn, {r('fn')} AS fn) FROM s")
def arm_summary_item(t: Tables) -> DataFrame:
    return rates.summarise(line_verdicts(t), weight="item")


@query(f"WITH {LINES_SQL} SELECT l_orderkey AS item, bool_or(should_fire) AS should_fire, {r('avg(fired::INT)')} AS fire_rate, count(fired) AS n_parsed FROM linev GROUP BY 1 HAVING count(fired) > 0")
def item_fire_rates(t: Tables) -> DataFrame:
    return rates.per_item_fire_rates(line_verdicts(t)).withColumnRenamed("case", "item")


@query(f"WITH {LINES_SQL} SELECT l_orderkey AS item, {r('avg((fired = should_fire)::INT)')} AS correct FROM linev GROUP BY 1 HAVING count(fired) > 0")
def item_correctness(t: Tables) -> DataFrame:
    return rates.per_item_correctness(line_verdicts(t)).withColumnRenamed("case", "item")


@query(f"WITH {LINES_SQL} SELECT l_orderkey AS item FROM linev GROUP BY 1 HAVING bool_or(should_fire) AND NOT bool_or(fired)")
def missed_items(t: Tables) -> DataFrame:
    return rates.missed(line_verdicts(t)).withColumnRenamed("case", "item")


@query(f"WITH {LINES_SQL} SELECT procedure, count(covers) AS n_labelled, {r('avg(covers::INT)')} AS covers_all, {r('avg(covers::INT) FILTER (WHERE fired)')} AS covers_fired, {r('1.0 / 3')} AS chance FROM linev GROUP BY 1")
def covers_by_procedure(t: Tables) -> DataFrame:
    return rates.covers_rates(line_verdicts(t), 3, ["procedure"])


def routing_sql(accepted: str) -> str:
    return f"""WITH {LINES_SQL}, a AS (SELECT l_orderkey, procedure, {accepted} AS accepted FROM linev WHERE len(routes) > 0),
 s AS (SELECT l_orderkey, procedure, coalesce(list_contains(accepted, procedure), false)::INT AS hit, unnest(accepted) AS target FROM a),
 i AS (SELECT target, l_orderkey, avg(hit) AS item_rate, sum(hit) AS hits, count(*) AS n, count(procedure) AS answered FROM s GROUP BY 1, 2)
 SELECT target, count(*) AS n_items, sum(n)::BIGINT AS n_records, {r("avg(item_rate)")} AS item_mean, {r("sum(hits)::DOUBLE / sum(n)")} AS record_mean,
  {r("CASE WHEN sum(answered) > 0 THEN sum(hits)::DOUBLE / sum(answered) ELSE 0.0 END")} AS answered_mean FROM i GROUP BY 1"""


@query(routing_sql("routes[1:1]"))
def routing_first(t: Tables) -> DataFrame:
    return rates.routing_by_procedure(line_verdicts(t), "first")


@query(routing_sql("routes"))
def routing_any(t: Tables) -> DataFrame:
    return rates.routing_by_procedure(line_verdicts(t), "any")


@query(f"WITH {LINES_SQL} SELECT count(*) FILTER (WHERE len(routes) > 0 AND list_contains(routes, procedure)) AS correct, count(*) FILTER (WHERE len(routes) > 0 AND NOT list_contains(routes, procedure)) AS wrong, count(*) FILTER (WHERE len(routes) = 0) AS unlabelled FROM linev WHERE procedure IS NOT NULL")
def routing_report(t: Tables) -> DataFrame:
    return rates.evaluate_routing(line_verdicts(t))


Z = z_value()


@query(
    f"""WITH {DOCS_SQL}, i AS (SELECT kind, doc_id, avg(fired::INT) AS p, count(fired) AS n FROM docv WHERE NOT should_fire AND kind IS NOT NULL GROUP BY 1, 2 HAVING count(fired) > 0),
 k AS (SELECT kind, count(*) AS n_items, sum(n)::BIGINT AS n_records, avg(p) AS fpr FROM i GROUP BY 1),
 w AS (SELECT *, 1 + {Z * Z!r} / n_items AS scale, fpr + {Z * Z!r} / (2 * n_items) AS centre, {Z!r} * sqrt(fpr * (1 - fpr) / n_items + {Z * Z!r} / (4 * n_items * n_items)) AS half FROM k)
 SELECT kind, n_items, n_records, {r("fpr")} AS fpr, {r("greatest(0, (centre - half) / scale)")} AS low, {r("least(1, (centre + half) / scale)")} AS high FROM w"""
)
def fpr_by_kind(t: Tables) -> DataFrame:
    return rates.fpr_by_kind(doc_verdicts(t))


@query(f"WITH {LINES_SQL}, p AS (SELECT l_orderkey, count(DISTINCT fired) AS f, count(DISTINCT procedure) AS q FROM linev GROUP BY 1) SELECT count(*) AS n_cases, count(*) FILTER (WHERE f > 1) AS fired_varies, count(*) FILTER (WHERE q > 1) AS procedure_varies FROM p")
def repeat_stability(t: Tables) -> DataFrame:
    return rates.stability(line_verdicts(t))


@query(f"WITH {LINES_SQL}, g AS (SELECT o_orderkey, unnest(range(0, 3)) AS k FROM orders), v AS (SELECT l_orderkey, l_linenumber, count(fired) AS n FROM linev GROUP BY 1, 2) SELECT count(*) AS cells, count(*) FILTER (WHERE coalesce(n, 0) > 0) AS parsed FROM g LEFT JOIN v ON l_orderkey = o_orderkey AND l_linenumber = k")
def grid_parse_rate(t: Tables) -> DataFrame:
    return rates.parse_rate(t.orders.select(F.col("o_orderkey").alias("case")), line_verdicts(t), 3)


@query(f"WITH {DOCS_SQL}, b AS (SELECT band, avg(fired::INT) FILTER (WHERE should_fire) AS p, avg(fired::INT) FILTER (WHERE NOT should_fire) AS q, count(*) AS n FROM docv WHERE fired IS NOT NULL GROUP BY 1) SELECT {r('sum((p - q) * n) / sum(n)')} AS gap, count(*) AS n_bands FROM b WHERE p IS NOT NULL AND q IS NOT NULL")
def band_adjusted_gap(t: Tables) -> DataFrame:
    return rates.band_adjusted_gap(doc_verdicts(t))


@query("SELECT lower(source) AS cue, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, cue LIMIT 8")
def top_sources(t: Tables) -> DataFrame:
    return rates.top_cues(t.documents, "source")


@query(
    f"""WITH {LINES_SQL}, v AS (SELECT l_orderkey, count(fired) AS n_votes, count(*) FILTER (WHERE fired = should_fire) AS agree, count(*) AS n_judges FROM linev GROUP BY 1),
 m AS (SELECT *, n_votes > 0 AND 2 * agree < n_votes AS moves, agree = n_judges AS unanimous FROM v)
 SELECT count(*) AS n_cases, {r("avg(moves::INT)")} AS movement_rate, {r("avg(unanimous::INT)")} AS unanimous_rate, count(*) FILTER (WHERE NOT moves AND NOT unanimous) AS contested FROM m"""
)
def adjudication(t: Tables) -> DataFrame:
    ledger = line_verdicts(t).select("case", F.col("fired").alias("adjudicated"), F.col("should_fire").alias("label"))
    return rates.votes(ledger).agg(F.count("*").alias("n_cases"), F.avg(F.col("moves").cast("int")).alias("movement_rate"), F.avg(F.col("unanimous").cast("int")).alias("unanimous_rate"), F.count_if(F.col("contested")).alias("contested"))
