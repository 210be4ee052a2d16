"""Gates, candidates in replies, sinks and states, and the battery of deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..functions import rates as forms
from ..operators import casefiles, conversations, corpus, documents, gates, generate, provenance
from ..sources import keys
from ..sources.scratch import shared_path
from ..streaming import sinks
from .proxies import doc_verdicts
from .registry import SQL, Tables, query, r
from .texts import DELTA_SQL

s = lambda c: F.col(c).cast("string")

#: Customers are documents: some are not read, some reviewed under an unknown commit, some far behind.
DRIFT_SQL = f"""lv AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0), rv AS (SELECT c_custkey AS k, c_nationkey AS sha FROM customer WHERE c_custkey % 5 <> 0),
 mv AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 11 <> 0 THEN count(*) END AS n FROM orders GROUP BY o_custkey)"""


@query(
    f"""WITH {DRIFT_SQL} SELECT k::VARCHAR AS key, 'no review on record' AS message FROM lv WHERE k NOT IN (SELECT k FROM rv) UNION ALL SELECT k::VARCHAR, 'a review of no living document' FROM rv WHERE k NOT IN (SELECT k FROM lv)
 UNION ALL SELECT mv.k::VARCHAR, 'reviewed at an unknown commit ' || sha FROM mv JOIN rv ON mv.k = rv.k WHERE n IS NULL AND mv.k IN (SELECT k FROM lv)
 UNION ALL SELECT mv.k::VARCHAR, n || ' commits behind, over {gates.CEILING}' FROM mv JOIN rv ON mv.k = rv.k WHERE n > {gates.CEILING} AND mv.k IN (SELECT k FROM lv)"""
)
def drift_findings(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    living = t.customer.filter(k % 7 != 0).select(s("c_custkey").alias("document"))
    reviewed = t.customer.filter(k % 5 != 0).select(s("c_custkey").alias("document"), s("c_nationkey").alias("sha"))
    moved = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).select(s("o_custkey").alias("document"), F.when(F.col("o_custkey") % 11 != 0, F.col("n")).alias("commits"))
    return gates.drift_findings(living, reviewed, moved)


EDGES_SQL = "ed AS (SELECT DISTINCT l_partkey AS src, (l_partkey * 7 + l_linenumber) % 500 AS dst FROM lineitem), rc(id) AS (SELECT 1::BIGINT UNION SELECT dst FROM rc JOIN ed ON src = id)"


def _modules(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 500).alias("dst"))
    ids = t.part.select(F.col("p_partkey").alias("id"))
    return ids.filter("id % 3 = 0"), edges, t.spark.range(1, 2), ids.filter("id % 10 = 9")


@query(f"WITH RECURSIVE {EDGES_SQL} SELECT p_partkey::VARCHAR AS key, 'has a floor and no caller' AS message FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 10 <> 9 AND p_partkey NOT IN (SELECT id FROM rc) UNION ALL SELECT p_partkey::VARCHAR, 'declared unwired and reached' FROM part WHERE p_partkey % 10 = 9 AND p_partkey IN (SELECT id FROM rc)")
def wiring_findings(t: Tables) -> DataFrame:
    return gates.wiring_findings(*_modules(t))


@query(f"WITH RECURSIVE {EDGES_SQL} SELECT count(*) FILTER (WHERE p_partkey % 3 = 0) AS floored, count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_partkey IN (SELECT id FROM rc)) AS reached, count(*) FILTER (WHERE p_partkey % 10 = 9) AS unwired FROM part")
def wiring_census(t: Tables) -> DataFrame:
    return gates.wiring_census(*_modules(t))


@query(
    """WITH c AS (SELECT o_orderkey AS k, (o_orderkey * 137 % 100000) AS cents, o_orderkey % 6 AS how FROM orders)
 SELECT k AS claim_id, CASE how WHEN 1 THEN 'superseded by ~' || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || '9' WHEN 2 THEN 'no match of the pattern for later figures' WHEN 3 THEN 'value not in quote' ELSE 'rounded is no number' END AS message
 FROM c WHERE how IN (1, 2, 3, 5)
 UNION ALL SELECT k, 'wrongly rounded' FROM c WHERE how IN (0, 4) AND (cents // 100 + CASE WHEN cents % 100 > 50 OR (cents % 100 = 50 AND (cents // 100) % 2 = 1) THEN 1 ELSE 0 END) <> cents // 100"""
)
def numeric_findings(t: Tables) -> DataFrame:
    """Prices as published figures: superseded, without a match, not in the quote, or cut off where they had to be rounded."""
    k, cents = F.col("o_orderkey"), F.col("o_orderkey") * 137 % 100000
    whole, how = F.floor(cents / 100).cast("string"), k % 6
    value = F.concat(F.lit("~"), whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    quote = F.when(how == 3, "no figure").otherwise(F.concat(F.lit("it is **"), value, F.lit("**")))
    later = F.when(how == 1, F.concat(F.lit("; now costs "), value, F.lit("9"))).otherwise(F.lit(""))
    latest = F.when(how == 1, r"costs (~\d+\.\d+)").when(how == 2, "never so").when(how == 0, r"costs ~\d+\.(?:\d+)".replace("costs ", ""))
    rows = t.orders.select(k.alias("claim_id"), value.alias("value"), quote.alias("quote"), F.concat(F.lit("costs "), value, later).alias("source_text"), latest.alias("latest"), F.when(how.isin(0, 4), F.concat(F.lit("~"), whole)).when(how == 5, "about").alias("rounded"))
    return gates.numeric_findings(rows)


@query(
    """WITH p AS (SELECT p_partkey AS k FROM part) SELECT k::VARCHAR AS key, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'not committed' END, CASE WHEN k % 7 = 0 THEN 'the skill has changed' END, CASE WHEN k % 11 = 0 THEN 'the analysis has changed' END,
 CASE WHEN k % 10 < 2 THEN 'the baseline leaves no room for a difference' END, CASE WHEN k % 13 > 9 THEN 'over its budget' END], lambda x: x IS NOT NULL)) AS message FROM p"""
)
def run_findings(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    told = lambda c, wrong: F.when(wrong, "-").otherwise(F.sha2(c, 256))
    plans = t.part.select(k.alias("run"), F.nullif(k % 5 != 0, F.lit(False)).alias("committed"), F.col("p_name").alias("skill"), told("p_name", k % 7 == 0).alias("skill_sha256"), F.col("p_brand").alias("analysis"), told("p_brand", k % 11 == 0).alias("analysis_sha256"), ((k % 10) / 10).alias("baseline"), F.lit(0.2).alias("low"), F.lit(0.9).alias("high"), F.lit(9.0).alias("budget"), (k % 13).cast("double").alias("cost"))
    return gates.run_findings(plans)


@query(
    """WITH x AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 <> 1 END AS was, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 = 1 END AS now FROM orders),
 y AS (SELECT case_id, CASE WHEN was IS NULL THEN CASE WHEN now IS NOT NULL THEN 'new' END WHEN now IS NULL THEN 'lost' WHEN now AND NOT was THEN 'now admissible' WHEN was AND NOT now THEN 'no longer admissible' END AS change FROM x) SELECT * FROM y WHERE change IS NOT NULL"""
)
def flipped_verdicts(t: Tables) -> DataFrame:
    was = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 4 != 1)
    now = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3 == 1)
    return casefiles.flipped(t.orders.select(F.col("o_orderkey").alias("case_id"), was.alias("was"), now.alias("admissible")))


#: Replies of six shapes: bare, in prose, with braces in the prose after it, in two objects of which the second counts, nested beside braces, and none.
@query("SELECT event_id, CASE WHEN event_id % 6 < 4 THEN event_type END AS verdict, CASE WHEN event_id % 6 < 4 AND event_id % 13 <= 10 THEN " + r("(event_id % 13) / 10.0") + " END AS confidence, CASE WHEN event_id % 6 < 5 THEN event_type END AS nested FROM events")
def reply_candidates(t: Tables) -> DataFrame:
    e = F.col("event_id")
    body = F.concat(F.lit('"verdict": "'), F.col("event_type"), F.lit('", "why": "a } or \\" in a text", "confidence": '), ((e % 13) / F.lit(10.0)).cast("string"))
    flat = F.concat(F.lit('{"verdict": "'), F.col("event_type"), F.lit('", "confidence": '), ((e % 13) / F.lit(10.0)).cast("string"), F.lit("}"))
    reply = (
        F.when(e % 6 == 0, F.concat(F.lit(" \n{"), body, F.lit("}\n")))
        .when(e % 6 == 1, F.concat(F.lit("I say {"), body, F.lit("} of it.")))
        .when(e % 6 == 2, F.concat(flat, F.lit(" because {the phrasing}")))
        .when(e % 6 == 3, F.concat(F.lit('{"verdict": "none of them"} or rather '), flat))
        .when(e % 6 == 4, F.concat(F.lit("{"), body, F.lit(', "of": {"x": 1}} since {the phrasing}')))
        .otherwise("{no object} and a } too many {")
    )
    names = t.events.select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("names"))  # a handful
    known = [x for x in names.first()["names"] if x]
    told = t.events.select("event_id", parsing.judged(reply, known).alias("d"), parsing.judged(reply, known, nested=True).alias("n"))
    return told.select("event_id", "d.verdict", "d.confidence", F.col("n.verdict").alias("nested"))


DELTAS_SQL = f"""WITH dl AS (SELECT l.doc_id, l.doc_id // 3 AS triple, l.quality = 1 AS should_fire, d.text AS t FROM labels l JOIN documents d ON l.doc_id = d.doc_id), ft AS (SELECT should_fire, {", ".join(f"{sql} AS {name}" for name, sql in DELTA_SQL.items())} FROM dl),
 lf AS (UNPIVOT ft ON {", ".join(DELTA_SQL)} INTO NAME feature VALUE value), vals AS (SELECT feature, value AS v, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM lf GROUP BY 1, 2),
 b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals),
 a AS (SELECT feature, sum(p * (below + q * 0.5::DOUBLE)) / (sum(p) * sum(q)) AS auc FROM b GROUP BY 1) SELECT feature, {r("auc")} AS auc, auc < 0.4 OR auc > 0.6 AS leaks FROM a"""


@query(DELTAS_SQL)
def delta_battery(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(F.floor(F.col("doc_id") / 3).alias("triple"), (F.col("quality") == 1).alias("should_fire"), F.col("text").alias("delta"))
    return corpus.delta_battery(rows).select("feature", "auc", "leaks")


@query("WITH s AS (" + SQL["decision_stump"].replace("AS majority", "AS base_").replace("AS depth1", "AS d1").replace("AS depth2", "AS d2") + f") SELECT 'stump' AS key FROM s WHERE greatest(d1, d2) - base_ > {corpus.MAX_LIFT}")
def stump_findings(t: Tables) -> DataFrame:
    valued = text.featured(doc_verdicts(t).select("doc_id", "should_fire", "text"), "text").drop("text")
    return corpus.stump_findings(valued, list(text.FEATURES), "should_fire", "doc_id").select("key")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS keys, sum(user_id)::BIGINT AS total FROM events")
def appended_once(t: Tables) -> DataFrame:
    """Events in three batches that share rows, one of them sent again."""
    path, e = shared_path(t.spark, "appended"), F.col("event_id")
    rows = t.events.select("event_id", "user_id")
    for name, part in (("a", e % 3 != 2), ("b", e % 3 != 0), ("a", e % 3 != 2), ("c", F.lit(True))):
        sinks.append_once(rows.filter(part), path, ["event_id"], name)
    return sinks.read_appended(t.spark, path, "event_id long, user_id long").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"), F.sum("user_id").alias("total"))


@query("SELECT event_type AS run, count(*) AS rows, count(DISTINCT user_id % 2) > 1 AND event_type < 'm' AS refused FROM events GROUP BY 1")
def resumed_runs(t: Tables) -> DataFrame:
    """Event types are runs; those before m change their stamp on the way."""
    root = shared_path(t.spark, "runs")
    stamp = F.when(F.col("event_type") < "m", F.col("user_id") % 2).otherwise(F.lit(0))
    t.events.select("event_type", "event_id", stamp.alias("version")).write.parquet(root)
    stream = t.spark.readStream.schema("event_type string, event_id long, version long").parquet(root)
    return sinks.resume(stream, "event_type", "event_id", ["version"]).select("run", "rows", "refused")


#: Parts are triplets of prompts; some lists are short, some files missing, broken, or of one arm twice.
@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 6 = 1 THEN 'not three files' WHEN p_partkey % 6 = 2 THEN 'no file ' || p_partkey || '/2' WHEN p_partkey % 6 = 3 THEN p_partkey || '/1: torn' ELSE 'missing arms: matched' END AS message FROM part WHERE p_partkey % 6 BETWEEN 1 AND 4")
def delta_warnings(t: Tables) -> DataFrame:
    return corpus.delta_cases(*_triplets(t))[1]


@query("SELECT p_partkey || '-' || arm AS id, should_fire, CASE WHEN should_fire THEN 'governs ' ELSE 'matches ' END || p_brand AS delta FROM part, (VALUES ('governing', true), ('matched', false)) v(arm, should_fire) WHERE p_partkey % 6 IN (0, 5)")
def delta_cases(t: Tables) -> DataFrame:
    return corpus.delta_cases(*_triplets(t))[0].drop("triple")


def _triplets(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, how = F.col("p_partkey"), F.col("p_partkey") % 6
    path = lambda i: F.concat(s("p_partkey"), F.lit(f"/{i}"))
    triplets = t.part.select(s("p_partkey").alias("id"), F.when(how == 1, F.array(path(0), path(1))).otherwise(F.array(path(0), path(1), path(2))).alias("files"))
    base = F.concat(F.lit("First line.\n- of "), F.col("p_name"), F.lit("\nLast line."))
    variant = lambda word: F.concat(F.lit("First line.\n- of "), F.col("p_name"), F.lit(f"\n- {word} "), F.col("p_brand"), F.lit("\nLast line."))
    arms = F.array(F.struct(F.lit(0).alias("i"), F.lit("base").alias("arm"), base.alias("prompt")), F.struct(F.lit(1).alias("i"), F.lit("governing").alias("arm"), variant("governs").alias("prompt")), F.struct(F.lit(2).alias("i"), F.when(how == 4, "governing").otherwise("matched").alias("arm"), variant("matches").alias("prompt")))
    files = t.part.select(k, F.explode(arms).alias("f")).filter((how != 2) | (F.col("f.i") != 2))
    return triplets, files.select(F.concat_ws("/", s("p_partkey"), F.col("f.i").cast("string")).alias("path"), "f.arm", "f.prompt", F.when((how == 3) & (F.col("f.i") == 1), "torn").alias("error"))


@query("SELECT r_name, grp::INT AS \"group\", string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM (SELECT 'all' AS r_name, n_nationkey, n_name, ntile(4) OVER (ORDER BY n_nationkey) AS grp FROM nation) GROUP BY 1, 2 UNION ALL SELECT 'customers', grp::INT, min(c_custkey) || '..' || max(c_custkey) FROM (SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey) AS grp FROM customer) GROUP BY 2")
def entries_of_all(t: Tables) -> DataFrame:
    few = generate.partition_entries(t.nation, "n_nationkey", "n_name", 4).select(F.lit("all").alias("r_name"), "group", F.array_join("names", "|").alias("names"))
    many = generate.partition_entries(t.customer.select("c_custkey", s("c_custkey").alias("name")), "c_custkey", "name", 7)
    return few.unionByName(many.select(F.lit("customers").alias("r_name"), "group", F.concat_ws("..", F.element_at("names", 1), F.element_at("names", -1)).alias("names")))


@query(
    """WITH d AS (SELECT c_custkey AS k, c_nationkey AS src FROM customer WHERE c_custkey % 3 <> 0), p AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 25 AS doc FROM orders)
 SELECT k::VARCHAR AS key, 'declared and not published' AS message, k::VARCHAR AS claim FROM d WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT min(doc)::VARCHAR, 'published and not declared', k::VARCHAR FROM p WHERE k NOT IN (SELECT k FROM d) GROUP BY k
 UNION ALL SELECT src::VARCHAR, 'published by its own source', d.k::VARCHAR FROM d JOIN p ON p.k = d.k AND p.doc = d.src"""
)
def reference_findings(t: Tables) -> DataFrame:
    claims = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("claim_id"), F.col("c_nationkey").cast("long").alias("source"))
    return gates.reference_findings(claims, t.orders.select(F.col("o_custkey").alias("claim_id"), (F.col("o_orderkey") % 25).alias("document")))


SETS_SQL = "sk AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0), st AS (SELECT s_suppkey AS k, s_suppkey % 7 = 1 AS torn, s_suppkey % 7 = 2 AS other FROM supplier WHERE s_suppkey % 4 <> 0), ne AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R')"


@query(
    f"""WITH {SETS_SQL} SELECT k::VARCHAR AS key, 'no trigger set' AS message FROM sk WHERE k NOT IN (SELECT k FROM st) UNION ALL SELECT k::VARCHAR, 'a set of no skill' FROM st WHERE k NOT IN (SELECT k FROM sk)
 UNION ALL SELECT k::VARCHAR, 'torn' FROM st WHERE torn AND k IN (SELECT k FROM sk) UNION ALL SELECT k::VARCHAR, 'declares x' || k FROM st WHERE other AND k IN (SELECT k FROM sk) UNION ALL SELECT k::VARCHAR, 'no negative cases' FROM st WHERE NOT torn AND k IN (SELECT k FROM sk) AND k NOT IN (SELECT k FROM ne)"""
)
def trigger_set_findings(t: Tables) -> DataFrame:
    """Suppliers are skills and sets, their lines the cases."""
    k, name = F.col("s_suppkey"), s("s_suppkey")
    sets = t.supplier.filter(k % 4 != 0).select(name.alias("name"), F.when(k % 7 == 2, F.concat(F.lit("x"), name)).otherwise(name).alias("skill"), F.when(k % 7 == 1, "torn").alias("error"))
    cases = t.lineitem.select(s("l_suppkey").alias("name"), (~((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))).alias("should_fire"))
    return gates.trigger_set_findings(t.supplier.filter(k % 5 != 0).select(name.alias("skill")), sets, cases)


# --- small operators: each over a whole table, and each wrong if the operator is


@query("SELECT conv_id, turn, turn % 3 <> 0 AND turn % 4 <> 1 AS transformed FROM conversations")
def transformed_reports(t: Tables) -> DataFrame:
    report = F.when(F.col("turn") % 4 != 1, F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("~"), "text")))
    return t.conversations.select("conv_id", "turn", conversations.was_transformed(report, F.col("text")).alias("transformed"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linestatus AS name FROM lineitem")
def span_names(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", provenance.span_name(F.col("l_returnflag"), F.col("l_linestatus")).alias("name"))


@query("WITH m AS (SELECT o_custkey AS document, CASE WHEN o_custkey % 11 <> 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F') END AS commits FROM orders GROUP BY 1) SELECT document, commits FROM m WHERE commits IS NULL OR commits <> 0")
def review_worklist(t: Tables) -> DataFrame:
    moved = t.orders.groupBy(F.col("o_custkey").alias("document")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return documents.worklist(moved.select("document", F.when(F.col("document") % 11 != 0, F.col("n")).alias("commits")))


@query(f"SELECT l_suppkey, count(*) = count(DISTINCT l_orderkey) AS inert, {r('avg(l_discount)')} AS point, avg(l_discount) BETWEEN 0.045 AND 0.055 AS within FROM lineitem GROUP BY 1")
def inert_clusters(t: Tables) -> DataFrame:
    """Where a mean lies on the edge of a rounding, the order of its sum decides. So discounts are summed as the rows lie in the file, apart from the distinct
    orders (beside these they would be summed by order first); the sums of a table's splits are added in the order of their places."""
    told = t.lineitem.filter("l_discount IS NOT NULL").select(F.col("l_suppkey").alias("key"), "l_discount", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    splits = told.groupBy("key", "path", "start").agg(F.sum("l_discount").alias("s"), F.count("*").alias("n"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("path", "start", "s"))), F.lit(0.0), lambda a, x: a + x["s"])
    points = splits.groupBy("key").agg((total / F.sum("n")).alias("point"))
    per = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("k"))
    both = per.join(points, F.col("l_suppkey").eqNullSafe(F.col("key")), "left")
    return both.select("l_suppkey", forms.clustering_is_inert(F.col("n"), F.col("k")).alias("inert"), "point", forms.within(F.col("point"), 0.045, 0.055).alias("within"))


@query("SELECT doc_id, should_fire, count(*) AS n FROM (SELECT doc_id, quality = 1 AS should_fire FROM labels) WHERE should_fire IS NOT NULL GROUP BY 1, 2")
def split_cases(t: Tables) -> DataFrame:
    cases = t.labels.select("doc_id", (F.col("quality") == 1).alias("should_fire"))
    return keys.positives(cases).unionByName(keys.negatives(cases)).groupBy("doc_id", "should_fire").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name || chr(10) || s_nationkey || chr(10) || chr(10) || chr(10) || repeat('=', 60) || chr(10) || chr(10) || 'Who?' || chr(10) AS prompt FROM supplier")
def ablated_prompts(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", generate.ablate(F.array(F.col("s_name"), s("s_nationkey")), F.lit("Who?")).alias("prompt"))


@query("SELECT c_custkey, c_custkey % 10 BETWEEN 3 AND 6 AS inside FROM customer")
def marks_within_band(t: Tables) -> DataFrame:
    """A mark after as many tenths of a prompt as the last digit of the key says."""
    k = F.col("c_custkey") % 10
    pad = lambda n: F.repeat(F.lit("x"), n.cast("int"))
    prompt = F.concat(pad(k * 100), F.lit("MARK"), pad(996 - k * 100))
    return t.customer.select("c_custkey", generate.within_band(prompt, F.array(F.lit("MARK"))).alias("inside"))
