"""Files and streams that Spark derives from the tables, read back through the sources; and small operators over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing, prompts, text
from ..functions import rates as forms
from ..operators import casefiles, conversations, corpus, documents, generate, guards, integrity, rates, reports
from ..sources import keys, records
from ..streaming import verdicts as streams
from .proxies import DOCS_SQL, doc_verdicts
from .registry import Tables, query, r
from .screening import BATTERY_SQL, turns

s = lambda c: F.col(c).cast("string")


def _lines(t: Tables, lines: DataFrame) -> str:
    """A folder with the lines (value) as text, in the shared folder."""
    path = streams.shared_path(t.spark, "lines")
    lines.write.text(path)
    return path


def _log(t: Tables) -> Column:
    """A verdict per event as a JSON line."""
    e = F.col("event_id")
    return F.to_json(F.struct(F.col("event_type").alias("case"), (e % 50).cast("int").alias("repeat"), F.when(e % 6 > 0, F.col("value") > 20).alias("fired"), F.when(e % 3 == 0, 2).alias("set_version"), F.concat(F.lit("u"), s("user_id")).alias("model")))


LOG_SQL = "lg AS (SELECT event_id, event_type AS c, (event_id % 50)::INT AS repeat, CASE WHEN event_id % 6 > 0 THEN value > 20 END AS fired, CASE WHEN event_id % 3 = 0 THEN 2 END AS v, 'u' || user_id AS model FROM events)"


@query(f"WITH {LOG_SQL} SELECT c AS \"case\", count(*) AS n, count(fired) AS told, count(*) FILTER (WHERE fired) AS fired, sum(v)::BIGINT AS versions, count(DISTINCT model) AS models FROM lg GROUP BY 1")
def read_records(t: Tables) -> DataFrame:
    rows = records.read_records(t.spark, _lines(t, t.events.select(_log(t).alias("value"))), records.VERDICT)
    return rows.groupBy("case").agg(F.count("*").alias("n"), F.count("fired").alias("told"), F.count_if("fired").alias("fired"), F.sum(F.col("set_version").cast("long")).alias("versions"), F.count_distinct("model").alias("models"))


@query(f"WITH {LOG_SQL} SELECT c AS \"case\", count(*) AS n FROM lg WHERE event_id % 11 <> 0 GROUP BY 1")
def read_readable(t: Tables) -> DataFrame:
    torn = F.when(F.col("event_id") % 11 == 0, F.substring(_log(t), 1, 20)).otherwise(_log(t))
    return records.read_readable(t.spark, _lines(t, t.events.select(torn.alias("value"))), records.VERDICT).groupBy("case").agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL} SELECT DISTINCT c AS \"case\", repeat FROM lg WHERE event_id % 11 <> 0")
def completed_keys(t: Tables) -> DataFrame:
    torn = F.when(F.col("event_id") % 11 == 0, "{").otherwise(_log(t))
    return records.completed_keys(t.spark, _lines(t, t.events.select(torn.alias("value"))), records.VERDICT, ["case", "repeat"])


@query("SELECT c_nationkey AS nation, count(*) - 1 AS n, sum(c_custkey)::BIGINT - max(c_custkey) AS ids FROM customer GROUP BY 1")
def torn_checkpoints(t: Tables) -> DataFrame:
    """A checkpoint per nation, whose last line is torn."""
    path = streams.shared_path(t.spark, "checkpoints")
    last = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))) == 1
    line = F.to_json(F.struct(s("c_custkey").alias("case"), F.col("c_nationkey").cast("int").alias("repeat")))
    lines = t.customer.withColumn("_line", F.when(last, F.substring(line, 1, 9)).otherwise(line)).groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "_line"))), lambda x: x["_line"]), "\n").alias("value"))
    lines.repartition(lines.count(), "c_nationkey").write.partitionBy("c_nationkey").text(path)
    rows = records.read_checkpoint(t.spark, f"{path}/*", records.VERDICT)
    return rows.groupBy(F.col("repeat").alias("nation")).agg(F.count("*").alias("n"), F.sum(F.col("case").cast("long")).alias("ids"))


@query("SELECT CASE c_custkey % 5 WHEN 0 THEN 'moved' WHEN 1 THEN 'none' WHEN 2 THEN 'unknown kind' WHEN 3 THEN 'bad date' ELSE 'not JSON' END AS told, count(*) AS n FROM customer GROUP BY 1")
def read_corrections(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    row = F.to_json(F.struct(F.when(k == 0, "moved").when(k == 2, "odd").otherwise("none").alias("kind"), (F.col("c_custkey") % 9 + 2).cast("int").alias("to_version"), F.when(k == 3, "soon").otherwise("2026-01-02").alias("date"), F.col("c_name").alias("reason")))
    line = F.when(k == 4, F.lit("{no")).otherwise(row)
    rows, issues = records.read_corrections(t.spark, _lines(t, t.customer.select(F.explode(F.array(F.concat(F.lit("# "), line), line)).alias("value"))))
    return rows.select(F.col("kind").alias("told")).unionByName(issues.select(F.col("message").alias("told"))).groupBy("told").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_mktsegment || c_nationkey % 4 AS key FROM customer")
def read_baseline(t: Tables) -> DataFrame:
    name = F.concat("c_mktsegment", (F.col("c_nationkey") % 4).cast("string"))
    return records.read_baseline(t.spark, _lines(t, t.customer.select(F.explode(F.array(F.concat(F.lit(" "), name, F.lit("  # why")), F.lit("# "), F.lit(""))).alias("value"))))


@query("SELECT conv_id::VARCHAR AS task_id, 't' || conv_id % 3 AS task, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1, 2, conv_id")
def read_corpus(t: Tables) -> DataFrame:
    own = t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("shards"))
    item = F.to_json(F.struct(s("conv_id").alias("task_id"), F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("task"), F.transform("shards", lambda x: F.struct(x.alias("shard"))).alias("shards")))
    path = _lines(t, own.select(F.concat(F.lit("["), item, F.lit("]")).alias("value")))
    rows = records.corpus_rows(t.spark.read.text(path).select("value"))
    return rows.select("task_id", "task", F.size("shards").cast("long").alias("n"), F.aggregate("shards", F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("chars"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(t: Tables) -> DataFrame:
    path = streams.shared_path(t.spark, "events")
    t.events.select("event_type", "ts").repartition(4).write.parquet(path)
    stream = t.spark.readStream.schema("event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return streams.stream_counts(stream, "ts", "1 day", "event_type", "10000 days").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_last_write_wins(t: Tables) -> DataFrame:
    path = streams.shared_path(t.spark, "events")
    t.events.select("user_id", "event_type", "event_id", "value").repartition(4).write.parquet(path)
    stream = t.spark.readStream.schema("user_id long, event_type string, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(path)
    return streams.stream_last_write_wins(stream, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("SELECT '2026-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS date, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE substr(md5(c_name), 1, 9) END AS commits FROM customer")
def register_entries(t: Tables) -> DataFrame:
    head = F.concat(F.lit("# Register\n## 2026-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" — "), F.col("c_name"), F.lit("\nWhy.\n"))
    body = F.concat(head, F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("**Commits:** `"), F.substring(F.md5("c_name"), 1, 9), F.lit("`\n"))).otherwise(""), F.lit("## Not dated\n"))
    return documents.register_entries(t.customer.select(body.alias("text"))).select("date", "title", F.array_join("commits", " ").alias("commits"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '|' || c_mktsegment ELSE '' END AS names FROM customer")
def router_tables(t: Tables) -> DataFrame:
    row = lambda a, b: F.concat(F.lit("| `"), a, F.lit("` | when "), b, F.lit(" | x |\n"))
    table = F.concat(F.lit("Text | no\n| name | when | what |\n|---|:-:|--|\n"), row(F.col("c_name"), F.lit("a")), row(F.col("c_mktsegment"), F.lit("b")))
    told = F.when(F.col("c_custkey") % 3 == 0, table).otherwise("no table")
    rows = t.customer.select("c_custkey", documents.router_rows(told).alias("x"))
    return rows.select("c_custkey", F.array_join(F.transform("x", lambda e: e["name"]), "|").alias("names"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a-b' WHEN 1 THEN 'c-' || lower(p_type) END AS entry FROM part")
def covering_entries(t: Tables) -> DataFrame:
    entries = F.array(F.lit("a-b"), F.concat(F.lit("c-"), F.lower("p_type")), F.lit("b-d"))
    wanted = F.when(F.col("p_partkey") % 3 == 0, "b").when(F.col("p_partkey") % 3 == 1, F.lower("p_type")).otherwise("x")
    return t.part.select("p_partkey", documents.covering(entries, wanted).alias("entry"))


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 's' ELSE 's' || p_size || CASE p_partkey % 2 WHEN 0 THEN 'b' ELSE '' END END AS name, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_size END AS n, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 2 = 0 THEN 'b' ELSE '' END AS rest FROM part) SELECT p_partkey, row_number() OVER (ORDER BY n, rest, p_partkey) AS place FROM x")
def natural_order(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "s").otherwise(F.concat(F.lit("s"), s("p_size"), F.when(k % 2 == 0, "b").otherwise("")))
    named = t.part.select("p_partkey", name.alias("name"))
    order = named.select("name").distinct().withColumn("_k", text.natural_key(F.col("name")))
    counts = named.groupBy("name").agg(F.count("*").alias("n"))
    ahead = order.join(counts, "name").withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per name
    return named.join(ahead.select("name", "before"), "name").select("p_partkey", (F.col("before") + F.row_number().over(W.partitionBy("name").orderBy("p_partkey"))).alias("place"))


@query(f"SELECT event_id, {r('CASE WHEN event_id % 4 < 2 AND event_id % 13 <= 10 THEN (event_id % 13) / 10.0 END')} AS confidence FROM events")
def confidences(t: Tables) -> DataFrame:
    e, number = F.col("event_id"), ((F.col("event_id") % 13) / F.lit(10.0)).cast("string")
    said = F.when(e % 4 < 2, number).when(e % 4 == 2, F.concat(F.lit('"'), number, F.lit('"'))).otherwise("true")
    return t.events.select("event_id", parsing.confidence(said).alias("confidence"))


@query(r"WITH w AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS n FROM documents) SELECT doc_id, " + r(r"coalesce(len(regexp_extract_all(text, '[,;]'))::DOUBLE * 100 / nullif(n, 0), 0.0)") + " AS commas FROM w")
def commas_per_hundred_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.per_hundred_words(F.col("text"), "[,;]").alias("commas"))


@query("SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND p_size >= 20 AS ok FROM part")
def placebo_matches(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    body = lambda n: F.repeat(F.lit("word "), n)
    skill = F.concat(F.lit("# Head\n"), body(F.col("p_size")), F.lit("\n```\ncode\n```\n"))
    more = F.when(F.col("p_size") >= 20, body(F.col("p_size") + 3)).otherwise(body(F.col("p_size") * 2 + 10))
    placebo = F.when(k == 0, F.concat(body(F.col("p_size")), F.lit("\n# Other\n```\ncode\n```\n"))).when(k == 1, F.concat(F.lit("# H\n"), more, F.lit("\n```\ncode\n```\n"))).otherwise(F.concat(F.lit("no head "), body(F.col("p_size")), F.lit("\n```\ncode\n```\n")))
    return t.part.select("p_partkey", text.placebo_match(skill, placebo).alias("ok"))


@query("SELECT l_returnflag, count(*) AS n, sum(7)::BIGINT AS versions FROM lineitem GROUP BY 1")
def stamped(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, 7).alias("set_version"))
    return integrity.stamp(rows, 7).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("set_version").cast("long")).alias("versions"))


@query("WITH w AS (SELECT DISTINCT c_nationkey AS id FROM customer WHERE c_acctbal > 9900), k AS (SELECT DISTINCT c_mktsegment AS name, c_nationkey AS id FROM customer WHERE c_custkey % 4 > 0) SELECT name FROM k WHERE id IN (SELECT id FROM w) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w)")
def containing_keys(t: Tables) -> DataFrame:
    sets = t.customer.filter("c_custkey % 4 > 0").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("id"))
    return integrity.containing_key(sets, t.customer.filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("id")))


@query("WITH a AS (SELECT l_linenumber AS k, min(l_partkey) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_linenumber AS k, CASE WHEN l_linenumber = 2 THEN 5 WHEN l_linenumber = 3 THEN NULL ELSE min(l_partkey) END AS y FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1) SELECT 'n' || a.k AS node_name, CASE WHEN b.k IS NULL THEN 'node set differs' WHEN a.k = 1 AND y IS NOT NULL THEN 'ablated node reports' WHEN a.k <> 1 AND x IS DISTINCT FROM y THEN 'survivor differs' END AS why FROM a LEFT JOIN b ON a.k = b.k WHERE b.k IS NULL OR (a.k = 1 AND y IS NOT NULL) OR (a.k <> 1 AND x IS DISTINCT FROM y)")
def ablation_breaches(t: Tables) -> DataFrame:
    name = F.concat(F.lit("n"), s("l_linenumber"))
    nodes = t.lineitem.groupBy("l_linenumber").agg(F.min("l_partkey").cast("string").alias("report"))
    second = nodes.filter("l_linenumber <> 4").withColumn("report", F.when(F.col("l_linenumber") == 2, "5").when(F.col("l_linenumber") != 3, F.col("report")))
    return integrity.identified(nodes.select(name.alias("node_name"), "report"), second.select(name.alias("node_name"), "report"), "n1")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'priority=' || o_orderpriority ELSE '' END || CASE WHEN o_orderkey % 6 = 0 THEN ',' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'status=' || o_orderstatus ELSE '' END AS attributes FROM orders")
def span_attributes(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("status"))
    told = F.transform(F.array_sort(F.map_entries(integrity.sparse_attributes("priority", "status"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("o_orderkey", F.array_join(told, ",").alias("attributes"))


@query("SELECT conv_id, count(*) AS turns, max(turn) FILTER (WHERE role = 'assistant') AS last FROM conversations GROUP BY 1 HAVING max(turn) > 2")
def closing_turns(t: Tables) -> DataFrame:
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("top"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last")).filter("top > 2")
    return n.select("conv_id", (conversations.shard_turns(F.col("n") + 1, F.lit("x"))).alias("turns"), "last")


@query("SELECT CASE WHEN count(*) > 0 THEN count(*) || ' sharded conversations have no closing turn' END AS reason FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 2 AND conv_id % 3 = 0)")
def comparable_responses(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.when(F.col("n") > 2, "sharded").otherwise("full").alias("condition"), F.col("n").alias("n_turns"), F.when(F.col("conv_id") % 3 != 0, "x").alias("final_turn"))
    return conversations.responses_comparable(rows)


@query("SELECT l_orderkey AS conversation_id, string_agg('n' || l_linenumber || '=' || f, ',' ORDER BY 'n' || l_linenumber) AS reports FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem WHERE l_linenumber > 1 AND l_partkey % 5 > 0 GROUP BY 1, 2) GROUP BY 1")
def pinned_reports(t: Tables) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "root").otherwise(F.concat(F.lit("n"), s("l_linenumber")))
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("conversation_id"), name.alias("node_name")).agg(F.max(F.when(F.col("l_partkey") % 5 > 0, F.col("l_returnflag"))).alias("report_seen_by_parent"))
    told = conversations.pinned_reports(nodes, "root")
    return told.select("conversation_id", F.array_join(F.transform(F.map_entries("reports"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("reports"))


@query(f"SELECT c_mktsegment, {r('count(*) * 3 * 2 * 0.01')} AS usd FROM customer GROUP BY 1")
def run_costs(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).select("c_mktsegment", conversations.run_cost(F.col("n"), F.lit(3), F.lit(0.01)).alias("usd"))


LEAKS_SQL = BATTERY_SQL.replace("SELECT view, feature, " + r("auc") + " AS auc, " + r("greatest(auc, 1 - auc)") + " AS folded, auc < 0.4 OR auc > 0.6 AS leaks FROM au", "{}")


@query(LEAKS_SQL.replace("{}", "SELECT 'leak:turn:' || feature AS key, printf('%s alone reaches AUC %.3f', feature, auc) AS message FROM au WHERE view = 'turn' AND (auc < 0.4 OR auc > 0.6) UNION ALL SELECT 'leak:' || view, printf('%d features leak', count(*)) FROM au WHERE view <> 'turn' AND (auc < 0.4 OR auc > 0.6) GROUP BY view HAVING count(*) >= 3"))
def leak_findings(t: Tables) -> DataFrame:
    return corpus.leak_findings(corpus.battery(turns(t)))


@query("SELECT 'day' AS guard, EXISTS (SELECT l_shipdate FROM lineitem GROUP BY l_shipdate HAVING count(DISTINCT strftime(l_shipdate, '%Y-%m-%d')) > 1) AS refused UNION ALL SELECT 'order', EXISTS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1) UNION ALL SELECT 'gap', EXISTS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber > 1))")
def one_value_per_day(t: Tables) -> DataFrame:
    """What the guard makes of a day's name, of an order's suppliers, and of a value that some lines of an order lack."""

    def refused(key: str, value: Column) -> bool:
        try:
            guards.one_value_per(t.lineitem.select(F.col(key).alias("key"), value.alias("value")), "key", "value")
        except guards.Refused:
            return True
        return False

    told = {"day": refused("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")), "order": refused("l_orderkey", F.col("l_suppkey")), "gap": refused("l_orderkey", F.when(F.col("l_linenumber") == 1, 1))}
    return t.spark.createDataFrame(list(told.items()), "guard string, refused boolean")


@query("SELECT n, target, greatest(1, ceil(target * (1 - icc) / (icc * (1 - target)) - 1e-9))::BIGINT AS repeats, greatest(2, ceil(1 + 1 / (2 * icc * icc)))::BIGINT AS for_scatter FROM (SELECT DISTINCT l_linenumber AS n, 0.5 + 0.05::DOUBLE * l_linenumber AS target, 0.1::DOUBLE * l_linenumber AS icc FROM lineitem)".replace("SELECT n, target,", f"SELECT n, {r('target')} AS target,"))
def repeats_needed(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_linenumber").alias("n"), (0.5 + 0.05 * F.col("l_linenumber")).alias("target"), (0.1 * F.col("l_linenumber")).alias("icc")).distinct()
    return rows.select("n", "target", forms.repeats_for_reliability(F.col("icc"), F.col("target")).alias("repeats"), forms.repeats_for_precision(F.col("icc")).alias("for_scatter"))


@query("SELECT p_partkey, CASE (p_partkey % 3)::INT WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'none' END AS target, p_size <= 10 OR p_size > 20 AS fixed, p_size > 5 AS swaps FROM part")
def variant_targets(t: Tables) -> DataFrame:
    options = F.array(F.col("p_brand"), F.col("p_type"), F.lit("none"))
    columns = {"size": F.col("p_size")}
    near = generate.stable_nearby("'in' if size > 10 and size <= 20 else 'out'", {"size": F.when((F.col("p_size") <= 10) | (F.col("p_size") > 20), F.when(F.col("p_size") <= 10, 5).otherwise(30)).otherwise(F.lit(11))}, ["size"])
    swaps = generate.swap_changes_answer("'big' if size > 5 else 'small'", columns, {"size": F.lit(5)})
    return t.part.select("p_partkey", generate.answer_target(options, F.col("p_partkey")).alias("target"), near.alias("fixed"), swaps.alias("swaps"))


@query("SELECT n_name, 'core of ' || n_name || chr(10) || chr(10) || 'p' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || 'Q?' AS prompt, (strpos('core of ' || n_name || chr(10) || chr(10) || 'p' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || 'Q?', 'Q?') - 1)::DOUBLE / length('core of ' || n_name || chr(10) || chr(10) || 'p' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || 'Q?') < 0.9 AS inside FROM nation")
def assembled_prompts(t: Tables) -> DataFrame:
    prompt = generate.assemble(F.concat(F.lit("core of "), F.col("n_name")), F.array(F.lit("p"), F.col("n_name")), F.lit("Q?"))
    return t.nation.select("n_name", prompt.alias("prompt"), (generate.depths(prompt, F.array(F.lit("Q?")))[0] < 0.9).alias("inside"))


@query("WITH tr AS (SELECT DISTINCT c_mktsegment AS d, c_nationkey AS t FROM customer), k AS (SELECT d, t, (dense_rank() OVER (ORDER BY d) + row_number() OVER (PARTITION BY d ORDER BY t)) % 2 = 0 AS want FROM tr) SELECT d AS domain, t AS triple, min(c_custkey) AS \"case\", want AS label FROM k JOIN customer ON c_mktsegment = d AND c_nationkey = t AND (c_custkey % 2 = 0) = want GROUP BY ALL")
def alternating_sample(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_mktsegment").alias("domain"), F.col("c_nationkey").alias("triple"), (F.col("c_custkey") % 2 == 0).alias("label"), F.col("c_custkey").alias("case"))
    return generate.alternating_sample(rows, "domain", "triple", "label", "case")


@query("SELECT c_custkey, 'C' || c_nationkey || ' governs' AS conditions, 'NONE' AS missing, 'A' || c_custkey % 7 || '|A1' AS actions, 'high' AS band FROM customer WHERE c_custkey % 7 <> 1")
def casefile_sections(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("**CONDITIONS**\nC"), s("c_nationkey"), F.lit(" governs\n\nEXPOSURE\nI'd say High, not low\nMISSING\nNONE\n## Actions\ntake a"), (F.col("c_custkey") % 7).cast("string"), F.lit(" then A1, and A1"))
    rows = t.customer.filter("c_custkey % 7 <> 1").select("c_custkey", casefiles.sections(reply).alias("x"))
    return rows.select("c_custkey", "x.conditions", "x.missing", F.array_join(casefiles.references(F.col("x.actions")), "|").alias("actions"), casefiles.first_band(F.col("x.exposure")).alias("band"))


RATES_SQL = f"WITH {DOCS_SQL}, ce AS (SELECT band, count(*) FILTER (WHERE fired AND should_fire) AS tp, count(*) FILTER (WHERE fired AND NOT should_fire) AS fp, count(*) FILTER (WHERE NOT fired AND NOT should_fire) AS tn, count(*) FILTER (WHERE NOT fired AND should_fire) AS fn FROM docv GROUP BY 1), ra AS (SELECT *, (tp + tn) / nullif(tp + fp + tn + fn, 0) AS acc, coalesce(tp / nullif(tp + fp, 0), 0) AS pre, coalesce(tp / nullif(tp + fn, 0), 0) AS rec, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS mar, tp * tn - fp * fn AS top FROM ce)"


@query(RATES_SQL + " SELECT band, rpad(band, 12, ' ') || printf('%6.1f%%', round(acc * 100, 1)) || printf('%6.1f%%', round(pre * 100, 1)) || printf('%6.1f%%', round(rec * 100, 1)) || printf('%6.1f%%', round(fpr * 100, 1)) || CASE WHEN mar > 0 THEN printf('%8.3f', round(top / sqrt(mar::DOUBLE), 3)) ELSE '     n/a' END AS line FROM ra")
def band_report(t: Tables) -> DataFrame:
    return reports.rate_lines(rates.summarise(doc_verdicts(t), ["band"]), "band")


Z95 = forms.z_value()


@query(
    f"""WITH g AS (SELECT p_brand, avg((p_size > 25)::INT) AS p, count(*) AS n FROM part GROUP BY 1), w AS (SELECT *, (p + {Z95 * Z95!r} / (2 * n)) / (1 + {Z95 * Z95!r} / n) AS c, {Z95!r} * sqrt(p * (1 - p) / n + {Z95 * Z95!r} / (4.0::DOUBLE * n * n)) / (1 + {Z95 * Z95!r} / n) AS h FROM g)
 SELECT p_brand, printf('%s %.4f [%.4f, %.4f]', p_brand, p, greatest(0, c - h), least(1, c + h)) AS line FROM w"""
)
def interval_report(t: Tables) -> DataFrame:
    """The share of large parts of a brand with its score interval."""
    per = t.part.groupBy("p_brand").agg(F.avg((F.col("p_size") > 25).cast("int")).alias("point"), F.count("*").alias("n"))
    low, high = forms.wilson(F.col("point"), F.col("n"))
    return reports.interval_lines(per.withColumns({"low": low, "high": high}).drop("n"), "p_brand")


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey <> 3")
def selected_cases(t: Tables) -> DataFrame:
    cases = t.customer.select(F.col("c_custkey").alias("id"))
    return keys.select_cases(cases, t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")), t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("id")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'empty group' WHEN 2 THEN 'unknown name,missing name' ELSE 'duplicate name' END AS problems FROM part")
def grouping_problems(t: Tables) -> DataFrame:
    k, a, b = F.col("p_partkey") % 4, F.col("p_brand"), F.col("p_type")
    none = F.array().cast("array<string>")
    groups = F.when(k == 0, F.array(F.array(a), F.array(b))).when(k == 1, F.array(F.array(a, b), none)).when(k == 2, F.array(F.array(a, F.lit("x")))).otherwise(F.array(F.array(a, b), F.array(a)))
    return t.part.select("p_partkey", F.array_join(prompts.grouping_problems(groups, F.array(a, b)), ",").alias("problems"))


@query("SELECT band, should_fire, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 's' WHEN 'fr' THEN 'm' WHEN 'de' THEN 'l' ELSE 'xl' END AS band, doc_id % 3 = 0 AS should_fire FROM documents) WHERE band = 'm' GROUP BY ALL")
def band_subset(t: Tables) -> DataFrame:
    band = F.when(F.col("lang") == "en", "s").when(F.col("lang") == "fr", "m").when(F.col("lang") == "de", "l").otherwise("xl")
    rows = t.documents.select(band.alias("band"), (F.col("doc_id") % 3 == 0).alias("should_fire"))
    return rows.filter("band = 'm'").groupBy("band", "should_fire").agg(F.count("*").alias("n"))


OPTION_SQL = "CASE WHEN event_id % 9 = 0 THEN 'infrastructure' WHEN event_type IN ('click', 'view', 'error') AND event_type = ['click', 'view'][event_id % 2 + 1] THEN NULL WHEN event_type IN ('click', 'view', 'error') THEN 'wrong_answer' ELSE 'format' END"


def _scored(t: Tables) -> DataFrame:
    from .texts import _replies

    told = _replies(t).withColumns({"options": F.array(F.lit("click"), F.lit("view"), F.lit("error")), "answer": F.when(F.col("event_id") % 2 == 0, "click").otherwise("view")})
    return parsing.scored_items(told, "reply", "options", "answer", F.col("event_id") % 9 == 0)


@query(f"SELECT event_id, {OPTION_SQL} AS zero_cause FROM events")
def scored_items(t: Tables) -> DataFrame:
    return _scored(t).select("event_id", "zero_cause")


@query(f"WITH x AS (SELECT event_type, event_type IN ('click', 'view', 'error') AS ok, event_type = ['click', 'view'][event_id % 2 + 1] AS hit FROM events) SELECT event_type, count(*) AS total, count(*) FILTER (WHERE ok AND hit) AS correct, count(*) FILTER (WHERE NOT ok) AS parse_failures, {r('avg((ok AND hit)::INT)')} AS accuracy FROM x GROUP BY 1")
def score_summary(t: Tables) -> DataFrame:
    return parsing.score_summary(_scored(t), "event_type")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'price,size' ELSE '' END AS shared FROM part")
def shared_variables(t: Tables) -> DataFrame:
    from ..functions.expressions import shared_variables as shared

    said = F.concat(F.when(F.col("p_partkey") % 3 == 0, "{size} of {size}, {name} ").when(F.col("p_partkey") % 3 == 1, "{size} at {price} ").otherwise("{name} {max}"), F.col("p_name"))
    return t.part.select("p_partkey", F.array_join(shared(said, "'a' if max(size, 3) > price else 'b'"), ",").alias("shared"))


@query(f"WITH {DOCS_SQL} SELECT {r('avg(fired::INT) FILTER (WHERE should_fire) / 3 + avg(fired::INT) FILTER (WHERE NOT should_fire) * 2 / 3')} AS rate FROM docv")
def corpus_weighted_rate(t: Tables) -> DataFrame:
    return rates.corpus_weighted(doc_verdicts(t))


Z = forms.z_value()


@query(f"WITH {DOCS_SQL}, s AS (SELECT lang, count(*) AS n, avg(fired::INT) AS f FROM docv WHERE fired IS NOT NULL GROUP BY 1) SELECT lang, n, {r('f')} AS rate, {r(f'greatest(0, (f + {Z!r} ** 2 / (2 * n) - {Z!r} * sqrt(f * (1 - f) / n + {Z!r} ** 2 / (4 * n * n))) / (1 + {Z!r} ** 2 / n))')} AS low, {r(f'least(1, (f + {Z!r} ** 2 / (2 * n) + {Z!r} * sqrt(f * (1 - f) / n + {Z!r} ** 2 / (4 * n * n))) / (1 + {Z!r} ** 2 / n))')} AS high FROM s")
def rates_by_language(t: Tables) -> DataFrame:
    return rates.rates_by(doc_verdicts(t), "lang")


@query("WITH a AS (SELECT c_mktsegment AS key, c_custkey AS c FROM customer), b AS (SELECT o_orderpriority AS run, c_mktsegment AS key, o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey), cov AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 50 > 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')), ex AS (SELECT unnest(['BUILDING', 'HOUSEHOLD', 'NONE']) AS key) SELECT DISTINCT key, 'cases without a panel' AS message FROM a WHERE c NOT IN (SELECT c FROM cov) AND key NOT IN (SELECT key FROM ex) UNION ALL SELECT DISTINCT run, 'a run with cases without a panel' FROM b WHERE c NOT IN (SELECT c FROM cov) AND key NOT IN (SELECT key FROM ex) UNION ALL SELECT key, 'is baselined and covered' FROM ex WHERE key IN (SELECT key FROM a) AND key NOT IN (SELECT key FROM a WHERE c NOT IN (SELECT c FROM cov)) UNION ALL SELECT key, 'is baselined and no key' FROM ex WHERE key NOT IN (SELECT key FROM a)")
def adjudication_findings(t: Tables) -> DataFrame:
    cases = t.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("case"))
    runs = t.orders.select(F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("case")).join(cases, "case")
    covered = t.customer.filter("c_custkey % 50 > 0 or c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("case"))
    exempt = t.spark.createDataFrame([("BUILDING",), ("HOUSEHOLD",), ("NONE",)], "key string")
    return integrity.adjudication_findings(cases, runs, covered, exempt)


@query("WITH g AS (SELECT source AS key, avg(n_chars % 100) / 100 AS auc, CASE WHEN source LIKE '%1%' THEN 0.48 END AS ceiling, source LIKE '%2' AS banded FROM documents GROUP BY 1) SELECT key, printf('AUC %.3f, ', round(auc, 3)) || CASE WHEN ceiling IS NULL THEN 'above the target and no ceiling is declared' ELSE 'above its ceiling' END AS message FROM g WHERE NOT banded AND auc > coalesce(ceiling + 1e-9, 0.49)")
def length_findings(t: Tables) -> DataFrame:
    sets = t.documents.groupBy(F.col("source").alias("key")).agg((F.avg(F.col("n_chars") % 100) / 100).alias("auc")).withColumns({"ceiling": F.when(F.contains("key", F.lit("1")), 0.48), "banded": F.col("key").endswith("2")})
    return corpus.length_finding(sets, 0.49)


@query("WITH k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5('5:' || doc_id), 1, 8))::BIGINT, doc_id) AS r FROM documents) SELECT lang, doc_id FROM k WHERE r <= 3 AND lang IN ('de', 'fr')")
def selected_per_family(t: Tables) -> DataFrame:
    return generate.select_per_family(t.documents.select("lang", "doc_id"), "lang", "doc_id", 3, 5, ("de", "fr"))


ITEMS_SQL = "rg AS (SELECT r_regionkey AS k, r_name FROM region), fa AS (SELECT n_regionkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 2, ('0x' || substr(md5('3:' || n_regionkey || ':' || n_name), 1, 8))::BIGINT, n_name) AS plc FROM nation), po AS (SELECT k, list(n_name ORDER BY plc) AS pool FROM fa WHERE plc <= 3 GROUP BY 1), gr AS (SELECT 0 AS n, 'early' AS pos UNION ALL SELECT unnest([1, 1, 3, 3]), unnest(['early', 'middle', 'early', 'middle']))"


@query(f"WITH {ITEMS_SQL} SELECT rg.k || '#v' || v || '-d' || n || '-' || pos AS item_id, array_to_string(CASE WHEN n = 0 THEN [r_name, 'x'] WHEN pos = 'early' THEN pool[1:n] || [r_name, 'x'] ELSE [r_name] || pool[1:n] || ['x'] END, '|') AS facts FROM rg JOIN po ON rg.k = po.k, gr, (SELECT unnest([0, 1]) AS v)")
def generated_items(t: Tables) -> DataFrame:
    facts = t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("fact_id"), F.col("n_name").alias("text"), (F.col("n_nationkey") % 2 == 0).alias("collides"))
    templates = t.region.select(F.col("r_regionkey").alias("k"), F.array(F.col("r_name"), F.lit("x")).alias("facts"))
    made = generate.items(templates, generate.draw_pool(facts, "k", 3, 3), generate.strata(t.spark, [0, 1, 3], ["early", "middle"]), "k", 2)
    return made.select("item_id", F.array_join("facts", "|").alias("facts"))
