"""Conversations, trees and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, prompts
from ..functions.text import load_bearing_tokens
from ..operators import conversations, documents, generate
from .registry import Tables, query, r

SHARDS_SQL = "sh AS (SELECT conv_id, conv_id % 4 AS task, count(*) AS n FROM conversations GROUP BY 1)"


def _shards(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("shards")).withColumn("task", F.concat(F.lit("t"), (F.col("conv_id") % 4).cast("string")))


@query(f"WITH {SHARDS_SQL} SELECT count(*) AS n, count(DISTINCT task) AS n_tasks, {r('min(n)')} AS least, {r('quantile_cont(n, 0.5)')} AS median, {r('avg(n)')} AS mean, {r('max(n)')} AS most FROM sh")
def shard_summary(t: Tables) -> DataFrame:
    return conversations.shard_summary(_shards(t))


@query(f"WITH {SHARDS_SQL} SELECT 't' || task AS task, task < 2 AS planned, count(*) AS n, (CASE WHEN task < 2 THEN sum((n + 1) * 3) ELSE 0 END)::BIGINT AS calls FROM sh GROUP BY task")
def run_plan(t: Tables) -> DataFrame:
    return conversations.plan_run(_shards(t), ("t0", "t1"), 3, True)


@query("SELECT conv_id, max(text) FILTER (WHERE role = 'assistant') AS assistant, max(text) FILTER (WHERE role = 'user') AS user_ FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'assistant') > 0 AND count(*) FILTER (WHERE role = 'user') > 0")
def condition_pairs(t: Tables) -> DataFrame:
    return conversations.condition_pairs(t.conversations, "conv_id", "role", "text", "user", "assistant").select("conv_id", "assistant", F.col("user").alias("user_"))


PILOT_SQL = "pi AS (SELECT o_orderkey AS k, o_custkey % 7 AS gold, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS a, o_custkey % 3 AS b FROM orders)"


@query(f"WITH {PILOT_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(a = gold, false) AND b = gold) AS both, count(*) FILTER (WHERE coalesce(a = gold, false) AND b <> gold) AS left_only, count(*) FILTER (WHERE NOT coalesce(a = gold, false) AND b = gold) AS right_only, count(*) FILTER (WHERE NOT coalesce(a = gold, false) AND b <> gold) AS neither, count(*) FILTER (WHERE a IS NULL) AS unreadable FROM pi".replace("AS both", 'AS "both"'))
def pilot_concordance(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("It is $"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".")))
    rows = t.orders.select(F.concat(F.lit("#### "), (F.col("o_custkey") % 7).cast("string")).alias("gold"), F.coalesce(said, F.lit("unsure")).alias("a"), F.concat(F.lit("first 9, then "), (F.col("o_custkey") % 3).cast("string")).alias("b"))
    return conversations.concordance(rows, parsing.gold_answer(F.col("gold")), parsing.last_number(F.col("a")), parsing.last_number(F.col("b")))


NODES_SQL = "no AS (SELECT l_orderkey AS conversation_id, l_returnflag AS node_name, l_tax AS cost_usd, l_quantity::BIGINT AS tokens, l_linenumber::BIGINT AS duration_ms FROM lineitem)"


@query(f"WITH {NODES_SQL} SELECT node_name, count(*) AS nodes, count(DISTINCT conversation_id) AS trees, {r('sum(cost_usd)')} AS cost_usd, sum(tokens)::BIGINT AS tokens, sum(duration_ms)::BIGINT AS duration_ms, {r('sum(cost_usd) / count(DISTINCT conversation_id)')} AS usd_per_tree FROM no GROUP BY ROLLUP (node_name)")
def tree_budget(t: Tables) -> DataFrame:
    nodes = t.lineitem.select(F.col("l_orderkey").alias("conversation_id"), F.col("l_returnflag").alias("node_name"), F.col("l_tax").alias("cost_usd"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_linenumber").cast("long").alias("duration_ms"))
    return conversations.tree_budget(nodes)


@query(f"SELECT conv_id, turn, {r('greatest(length(text) / 4.0 * 2.5e-6, 0.005)')} AS usd FROM conversations")
def call_costs(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", conversations.call_cost(F.length("text")).alias("usd"))


@query("SELECT p_partkey, 'levy ' || p_brand || ' on ' || p_size AS delta FROM part")
def extracted_deltas(t: Tables) -> DataFrame:
    insert = F.concat(F.lit("- levy "), F.col("p_brand"), F.lit(" on "), F.col("p_size").cast("string"), F.lit("\n"))
    base = F.concat(F.lit("Facts:\n- "), F.col("p_name"), F.lit("\n"), F.lit("- price is open\nWhat now?"))
    variant = F.concat(F.lit("Facts:\n- "), F.col("p_name"), F.lit("\n"), insert, F.lit("- price is open\nWhat now?"))
    return t.part.select("p_partkey", prompts.extract_delta(base, variant).alias("delta"))


@query(f"SELECT doc_id, {r('floor(length(text) * 0.1) / (length(text) + 12)')} AS first_depth, true AS verbatim FROM documents WHERE length(text) > 0 AND NOT contains(text, 'MARK')")
def canary_prompts(t: Tables) -> DataFrame:
    marks = F.array(F.lit("MARK"), F.lit("MARQ"))
    rows = t.documents.filter((F.length("text") > 0) & ~F.contains("text", F.lit("MARK"))).select("doc_id", prompts.insert_at(F.col("text"), marks, (0.1, 0.9)).alias("p"))
    return rows.select("doc_id", ((F.position(F.lit("MARK"), F.col("p")) - 2) / F.length("p")).alias("first_depth"), parsing.markers(F.col("p"), marks)["verbatim"].alias("verbatim"))


@query("SELECT c_custkey, (c_nationkey % 2 = 1)::INT + (c_custkey % 3 = 0)::INT AS n_held, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-02' END AS date_held FROM customer")
def invariance_violations(t: Tables) -> DataFrame:
    core = F.lit("Pay 1,500 to Acme Ltd by 2024-01-02.")
    padding = F.concat(F.lit("Notes. "), F.when(F.col("c_nationkey") % 2 == 1, "It cost 1,500. ").otherwise(""), F.when(F.col("c_custkey") % 3 == 0, "Due 2024-01-02.").otherwise(""))
    held = prompts.tokens_held(F.filter(load_bearing_tokens(core), lambda k: k.isin("1,500", "2024-01-02", "Acme Ltd")), padding)
    rows = t.customer.select("c_custkey", held.alias("h"))
    return rows.select("c_custkey", F.size("h").alias("n_held"), F.when(F.array_contains("h", "2024-01-02"), "2024-01-02").alias("date_held"))


@query("SELECT regexp_extract(url, '^(https?)', 1) AS link, count(DISTINCT page_id) AS n FROM pages GROUP BY 1")
def link_index(t: Tables) -> DataFrame:
    return documents.link_index(t.pages.select(F.col("page_id").cast("string").alias("path"), F.regexp_extract("url", "^(https?)", 1).alias("text")), "https?").select("link", F.size("documents").cast("long").alias("n"))


@query("SELECT c_custkey AS claim_id, CASE c_custkey % 4 WHEN 0 THEN 'quote not found' WHEN 1 THEN 'quote found more than once' ELSE 'value not in quote' END AS message FROM customer WHERE c_custkey % 4 < 3")
def claim_anchors(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    quote = F.concat(F.lit("the rate is "), F.col("c_nationkey").cast("string"), F.lit(" of all"))
    source = F.when(k == 0, "nothing here").when(k == 1, F.concat(quote, F.lit("; *"), quote, F.lit("*"))).otherwise(F.concat(F.lit("So **the  rate** is "), F.col("c_nationkey").cast("string"), F.lit(" of all.")))
    rows = t.customer.select(F.col("c_custkey").alias("claim_id"), quote.alias("quote"), source.alias("source_text"), F.when(k == 2, "none").otherwise(F.col("c_nationkey").cast("string")).alias("value"))
    return documents.anchor_findings(rows)


@query("SELECT n_name, '{' || n_name || '} of ' || r_name AS told FROM nation JOIN region ON n_regionkey = r_regionkey")
def rendered_templates(t: Tables) -> DataFrame:
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", generate.render(F.concat(F.lit("{"), F.col("n_name"), F.lit("} of {region}")), F.create_map(F.lit("region"), F.col("r_name"))).alias("told"))
