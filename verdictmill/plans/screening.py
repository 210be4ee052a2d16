"""Screening of matched triples, scoring by sets and calls, compiled expressions, report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calls, expressions, text
from ..operators import casefiles, corpus, documents, ranks, rates, reports
from .proxies import DOCS_SQL, doc_verdicts
from .registry import Tables, query, r
from .texts import FEATURES_SQL, SENTENCES

#: A conversation is a cluster of texts; its first turn is the positive.
TURNS_SQL = "tu AS (SELECT conv_id AS triple, turn AS id, text AS t, turn = 0 AS should_fire FROM conversations)"
BODY_SQL = """ab AS (SELECT triple, min(t) AS a, max(t) AS b FROM tu GROUP BY 1), hd AS (SELECT triple, a[1:list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: a[1:k] = b[1:k]))] AS h FROM ab),
 bo AS (SELECT triple, CASE WHEN contains(h, chr(10)) THEN length(h) - strpos(reverse(h), chr(10)) + 1 WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') + 1 ELSE 0 END AS body_length FROM hd)"""


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("triple"), F.col("turn").alias("id"), F.col("text").alias("turn"), (F.col("turn") == 0).alias("should_fire"))


@query(f"WITH {TURNS_SQL}, {BODY_SQL} SELECT triple, body_length FROM bo")
def shared_bodies(t: Tables) -> DataFrame:
    return corpus.shared_body(turns(t))


OPEN = SENTENCES.replace("(t,", "(ask,").replace("regexp_replace(t", "regexp_replace(ask")


@query(
    f"""WITH {TURNS_SQL}, {BODY_SQL}, v AS (SELECT tu.triple, id, t, CASE WHEN trim(t[body_length + 1:]) <> '' THEN trim(t[body_length + 1:]) ELSE t END AS ask FROM tu JOIN bo ON tu.triple = bo.triple)
 SELECT triple, id, length(ask) AS ask_length, length(CASE WHEN len({SENTENCES}) > 0 THEN ({SENTENCES})[-1] ELSE t END) AS close_length, length(CASE WHEN len({OPEN}) > 0 THEN ({OPEN})[1] ELSE ask END) AS open_length FROM v"""
)
def text_views(t: Tables) -> DataFrame:
    seen = corpus.with_views(turns(t))
    return seen.select("triple", "id", F.length("ask").alias("ask_length"), F.length("close").alias("close_length"), F.length("open").alias("open_length"))


VALS = ", ".join(f"{sql} AS {name}" for name, sql in FEATURES_SQL.items())
BATTERY_SQL = f"""WITH {TURNS_SQL}, {BODY_SQL}, v0 AS (SELECT tu.triple, id, should_fire, t, CASE WHEN trim(t[body_length + 1:]) <> '' THEN trim(t[body_length + 1:]) ELSE t END AS ask FROM tu JOIN bo ON tu.triple = bo.triple),
 v1 AS (SELECT *, CASE WHEN len({SENTENCES}) > 0 THEN ({SENTENCES})[-1] ELSE t END AS cl, CASE WHEN len({OPEN}) > 0 THEN ({OPEN})[1] ELSE ask END AS op FROM v0),
 v2 AS (SELECT triple, should_fire, 'turn' AS view, t FROM v1 UNION ALL SELECT triple, should_fire, 'ask', ask FROM v1 UNION ALL SELECT triple, should_fire, 'close', cl FROM v1 UNION ALL SELECT triple, should_fire, 'open', op FROM v1),
 ft AS (SELECT triple, should_fire, view, {VALS} FROM v2), lf AS (UNPIVOT ft ON {", ".join(FEATURES_SQL)} INTO NAME feature VALUE value),
 vals AS (SELECT view, feature, value, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM lf GROUP BY ALL),
 be AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY view, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals),
 au AS (SELECT view, feature, sum(p * (below + q * 0.5::DOUBLE)) / (sum(p) * sum(q)) AS auc FROM be GROUP BY ALL)
 SELECT view, feature, {r("auc")} AS auc, {r("greatest(auc, 1 - auc)")} AS folded, auc < 0.4 OR auc > 0.6 AS leaks FROM au"""


@query(BATTERY_SQL)
def view_battery(t: Tables) -> DataFrame:
    return corpus.battery(turns(t)).select("view", "feature", "auc", "folded", "leaks")


BANDS_SQL = "bd AS (SELECT d.doc_id, d.doc_id // 3 AS triple, d.doc_id % 3 = 0 AS should_fire, CASE d.lang WHEN 'en' THEN 's' WHEN 'fr' THEN 'm' WHEN 'de' THEN 'l' ELSE 'xl' END AS band, len(regexp_extract_all(text, '\\S+')) AS n FROM documents d)"


def _banded(t: Tables) -> DataFrame:
    band = F.when(F.col("lang") == "en", "s").when(F.col("lang") == "fr", "m").when(F.col("lang") == "de", "l").otherwise("xl")
    return t.documents.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 3).alias("triple"), (F.col("doc_id") % 3 == 0).alias("should_fire"), band.alias("band"), F.col("text").alias("turn"))


@query(f"WITH {BANDS_SQL} SELECT doc_id::VARCHAR AS key, n || ' words in band ' || band AS message FROM bd WHERE NOT CASE band WHEN 's' THEN n BETWEEN 1 AND 25 WHEN 'm' THEN n BETWEEN 40 AND 90 WHEN 'l' THEN n BETWEEN 200 AND 400 ELSE n BETWEEN 900 AND 1500 END")
def band_findings(t: Tables) -> DataFrame:
    return corpus.band_findings(_banded(t))


@query(
    f"""WITH {BANDS_SQL}, p AS (SELECT triple, count(*) FILTER (WHERE should_fire) AS p, count(*) AS c, count(DISTINCT band) AS bands, max(n) AS most, min(n) AS least FROM bd GROUP BY 1)
 SELECT triple::VARCHAR AS key, 'shape' AS message FROM p WHERE p <> 1 OR c <> 3 UNION ALL SELECT triple::VARCHAR, 'bands' FROM p WHERE bands > 1 UNION ALL SELECT triple::VARCHAR, 'spread' FROM p WHERE most - least > greatest(3, round_even(most * 0.1::DOUBLE, 0)::BIGINT)"""
)
def triple_findings(t: Tables) -> DataFrame:
    return corpus.triple_findings(_banded(t))


@query(f"WITH {BANDS_SQL}, p AS (SELECT band, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM bd GROUP BY 1) SELECT band AS key, p || ' positives, ' || q || ' negatives' AS message FROM p WHERE q <> 2 * p")
def ratio_findings(t: Tables) -> DataFrame:
    return corpus.ratio_findings(_banded(t))


def _thirds(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n = 3").select("l_orderkey")
    return t.lineitem.join(n, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("triple"), *[F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "extendedprice", "partkey")], F.lit(False).alias("none"))


DRAW_SQL = "('0x' || substr(md5('6:' || r || ':' || triple), 1, 8))::BIGINT"


@query(
    f"""WITH li AS (SELECT l_orderkey AS triple, l_quantity AS quantity, l_extendedprice AS extendedprice, l_partkey::DOUBLE AS partkey, count(*) OVER (PARTITION BY l_orderkey) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_partkey) - 1 AS i FROM lineitem),
 dr AS (SELECT r, triple, quantity, extendedprice, partkey, {DRAW_SQL} % 3 = i AS label FROM (SELECT * FROM li WHERE c = 3), (SELECT unnest(range(0, 50)) AS r)),
 lf AS (UNPIVOT dr ON quantity, extendedprice, partkey INTO NAME feature VALUE value), vals AS (SELECT r, feature, value, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS q FROM lf GROUP BY ALL),
 be AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY r, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals),
 au AS (SELECT r, feature, sum(p * (below + q * 0.5::DOUBLE)) / (sum(p) * sum(q)) AS auc FROM be GROUP BY ALL), pr AS (SELECT r, count(*) FILTER (WHERE auc < 0.4 OR auc > 0.6) AS n FROM au GROUP BY 1)
 SELECT count(*) AS draws, {r("avg((n >= 1)::INT)")} AS rate FROM pr"""
)
def null_leaks(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("triple").orderBy("quantity", "extendedprice", "partkey")) == 1
    return corpus.null_leak_rate(_thirds(t).withColumn("label", first), ["quantity", "extendedprice", "partkey"], "label", "triple", draws=50, leaks=1, seed=6)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'wrong' WHEN p_size % 5 = 4 THEN 'unreadable' ELSE 'matched' END AS outcome FROM part")
def call_matching(t: Tables) -> DataFrame:
    size = F.col("p_size")
    name = F.when(size % 3 == 1, "drop").otherwise("find")
    reply = F.when((size % 5 == 4) & (size % 3 != 1), F.lit("no calls here")).otherwise(F.concat(F.lit('So: [{"name": "'), name, F.lit('", "arguments": {"size": '), size.cast("string"), F.lit('.0, "brand": " '), F.upper("p_brand"), F.lit(' "}}]')))
    key = F.concat(F.lit('[{"find": {"size": ['), size.cast("string"), F.lit('], "brand": ["x", "'), F.col("p_brand"), F.lit('"], "page": ["", 1]}}]'))
    return t.part.select("p_partkey", calls.match_calls(reply, key).alias("outcome"))


CASES_SQL = """ca AS (SELECT c_custkey, ['A' || (c_custkey % 5), 'A' || (c_nationkey % 5)] AS rec, ['A' || (c_custkey % 3), 'A1'] AS req, ['A' || (c_custkey % 7)] AS pro, CASE WHEN c_custkey % 4 = 0 THEN ['A2'] ELSE []::VARCHAR[] END AS unj, ['C1', 'C' || (c_custkey % 3)] AS vot, ['C0', 'C2'] AS gov FROM customer),
 sc AS (SELECT c_custkey, list_distinct(list_filter(req, lambda x: NOT list_contains(rec, x))) AS missing, list_intersect(list_distinct(rec), pro) AS took, list_distinct(pro || unj) AS forb, *, FROM ca),
 s2 AS (SELECT c_custkey, len(missing) AS n_missing, len(took) AS n_took, len(missing) = 0 AND len(took) = 0 AND NOT list_has_any(rec, unj) AS admissible,
  len(list_intersect(list_distinct(req), rec))::DOUBLE / len(list_distinct(req)) AS taken, len(list_filter(forb, lambda x: NOT list_contains(rec, x)))::DOUBLE / len(forb) AS avoided, len(list_intersect(list_distinct(vot), gov))::DOUBLE / 2 AS rec_c FROM sc)"""


@query(f"WITH {CASES_SQL} SELECT c_custkey, n_missing::INT AS n_missing, n_took::INT AS n_took, admissible, {r('(taken + avoided + rec_c) / 3')} AS graded FROM s2")
def casefile_scores(t: Tables) -> DataFrame:
    ref = lambda letter, c, k: F.concat(F.lit(letter), F.pmod(F.col(c), F.lit(k)).cast("string"))
    none = F.array().cast("array<string>")
    rows = t.customer.select(
        "c_custkey", F.array(ref("A", "c_custkey", 5), ref("A", "c_nationkey", 5)).alias("recommended"), F.array(ref("A", "c_custkey", 3), F.lit("A1")).alias("required"), F.array(ref("A", "c_custkey", 7)).alias("prohibited"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("A2"))).otherwise(none).alias("unjustified"), F.array(F.lit("C1"), ref("C", "c_custkey", 3)).alias("voted"), F.array(F.lit("C0"), F.lit("C2")).alias("governing"),
    )
    return casefiles.score(rows).select("c_custkey", F.size("missing_required").alias("n_missing"), F.size("took_prohibited").alias("n_took"), "admissible", "graded")


@query(f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND NOT p_size > 40 THEN 'low' ELSE 'high' END AS answer, {r('greatest(p_retailprice - p_size * 2, 7) / 4')} AS value FROM part")
def compiled_expressions(t: Tables) -> DataFrame:
    names = {"size": F.col("p_size"), "price": F.col("p_retailprice")}
    return t.part.select("p_partkey", expressions.compile_expression("'low' if size % 3 == 0 and not size > 40 else 'high'", names).alias("answer"), expressions.compile_expression("max(price - size * 2, 7) / 4", names).alias("value"))


CLAIM_SQL = r"(?i)[+-]?\d+(?:\.\d+)?\s*(?:pp(?:$|[^\p{L}\p{N}_.])|%)|(?:^|[^\p{L}\p{N}_])(?:kappa|κ)\s*[=:]\s*\d?\.\d+|(?:^|[^\p{L}\p{N}_])AUC\s*[=:]?\s*\d?\.\d+"
SAID_SQL = "p_name || [' at ' || p_size || ' % of', ' by +' || p_size || 'pp', ' with ' || p_size || ' parts', ' in 3 pp. of', ' κ = .' || p_size, ' AUC 0.' || p_size, ' see https://x.org/' || p_size || '% and arXiv:1234.56789'][p_partkey % 7 + 1]"


@query(f"WITH s AS (SELECT p_brand, {SAID_SQL} AS line FROM part UNION ALL SELECT source, text FROM documents) SELECT p_brand AS source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(regexp_replace(line, '(?i)https?://\\S+|arxiv[:/]\\S+|\\b\\d{{4}}\\.\\d{{4,5}}\\b', ' ', 'g'), '{CLAIM_SQL}')) AS with_number FROM s GROUP BY 1")
def number_assertions(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit(" at "), size, F.lit(" % of")), F.concat(F.lit(" by +"), size, F.lit("pp")), F.concat(F.lit(" with "), size, F.lit(" parts")), F.lit(" in 3 pp. of"), F.concat(F.lit(" κ = ."), size), F.concat(F.lit(" AUC 0."), size), F.concat(F.lit(" see https://x.org/"), size, F.lit("% and arXiv:1234.56789")))
    said = t.part.select(F.col("p_brand").alias("source"), F.concat("p_name", F.element_at(forms, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("line"))
    lines = said.unionByName(t.documents.select("source", F.col("text").alias("line")))
    return lines.groupBy("source").agg(F.count("*").alias("n"), F.count_if(documents.asserts_a_number(F.col("line"))).alias("with_number"))


@query(f"WITH {DOCS_SQL}, c AS (SELECT count(*) FILTER (WHERE fired AND should_fire) AS tp, count(*) FILTER (WHERE fired AND NOT should_fire) AS fp, count(*) FILTER (WHERE NOT fired AND NOT should_fire) AS tn, count(*) FILTER (WHERE NOT fired AND should_fire) AS fn FROM docv) SELECT 0 AS at, format('{{:<12}}{{:>10}}{{:>10}}', '', 'fires', 'silent') AS line FROM c UNION ALL SELECT 1, format('{{:<12}}{{:>10.1f}}{{:>10.1f}}', 'should', tp::DOUBLE, fn::DOUBLE) FROM c UNION ALL SELECT 2, format('{{:<12}}{{:>10.1f}}{{:>10.1f}}', 'should not', fp::DOUBLE, tn::DOUBLE) FROM c")
def confusion_report(t: Tables) -> DataFrame:
    return reports.confusion_lines(rates.summarise(doc_verdicts(t)))


@query(f"WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[A-Za-z'']+') AS w FROM conversations) SELECT conv_id, turn, {r('CASE WHEN len(w) >= 100 THEN list_avg(list_transform(range(0, len(w) // 100), lambda k: len(list_distinct(w[k * 100 + 1:k * 100 + 100])) / 100.0::DOUBLE)) ELSE coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0) END')} AS ttr FROM t")
def standardised_ttr(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.standardised_ttr(text.words(F.col("text"))).alias("ttr"))


@query(f"WITH ps AS (SELECT p_size AS v, p_brand = 'Brand#1' AS label FROM part), at0 AS (SELECT v, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS q FROM ps GROUP BY 1), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM at0), a AS (SELECT sum(p * (below + q * 0.5::DOUBLE)) / (sum(p) * sum(q)) AS auc FROM b) SELECT {r('greatest(auc, 1 - auc)')} AS folded FROM a")
def auc_folded(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_size").alias("v"), (F.col("p_brand") == "Brand#1").alias("label"))
    return ranks.auc(rows, "v", "label").select(ranks.folded(F.col("auc")).alias("folded"))
