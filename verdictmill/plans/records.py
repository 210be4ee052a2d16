"""Record keeping: last write wins, resumption, re-scoring, baselines, guards, generation, graphs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generate, guards, integrity
from ..operators.resample import draw
from ..streaming import verdicts as streams
from .proxies import LINES_SQL, line_verdicts
from .registry import Tables, query, r

LWW = "SELECT user_id, event_type, max(event_id) AS event_id, " + r("arg_max(value, event_id)") + " AS value FROM events GROUP BY 1, 2"


@query(LWW)
def last_write_wins(t: Tables) -> DataFrame:
    return integrity.last_write_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(LWW)
def stream_last_write_wins(t: Tables) -> DataFrame:
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*").select("user_id", "event_type", "event_id", "value")
    return streams.stream_last_write_wins(stream, ["user_id", "event_type"], "event_id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(t: Tables) -> DataFrame:
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = streams.stream_counts(stream, "ts", "1 day", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def resume_pending(t: Tables) -> DataFrame:
    return integrity.pending(t.orders.select("o_orderkey"), t.lineitem.filter("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query(
    f"""WITH {LINES_SQL}, v AS (SELECT l_orderkey, l_linenumber, should_fire, procedure AS route, covers, l_orderkey % 4 = 0 AS new_label, CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'R' END AS new_route FROM linev)
 SELECT new_label AS should_fire, new_route AS route, count(*) AS n, count(*) FILTER (WHERE CASE WHEN route = new_route THEN covers END) AS covered, count(*) FILTER (WHERE route <> new_route AND covers IS NOT NULL) AS stale FROM v GROUP BY 1, 2"""
)
def rescore(t: Tables) -> DataFrame:
    rows = line_verdicts(t).select("case", "repeat", "should_fire", F.col("procedure").alias("route"), "covers", F.lit(1).alias("set_version"))
    key = t.lineitem.select(F.col("l_orderkey").alias("case")).distinct().withColumns({"new_label": F.col("case") % 4 == 0, "new_route": F.when(F.col("case") % 2 == 0, "A").otherwise("R")})
    out = integrity.rescore(rows, key, 2, "v1")
    return out.groupBy("should_fire", "route").agg(F.count("*").alias("n"), F.count_if(F.col("covers")).alias("covered"), F.count_if(F.col("covers_stale")).alias("stale"))


@query("WITH f AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_acctbal < 0) SELECT coalesce(f.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'issue' WHEN f.key IS NULL THEN 'stale' ELSE 'deferred' END AS state FROM f FULL OUTER JOIN b ON f.key = b.key")
def baseline_split(t: Tables) -> DataFrame:
    return integrity.apply_baseline(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")), t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("key")))


@query(
    """WITH runs AS (SELECT DISTINCT o_custkey AS cs, o_orderpriority AS name, ascii(o_orderpriority) % 2 AS version FROM orders), br AS (SELECT '5-LOW' AS name, 0 AS version)
 SELECT a.name AS a, b.name AS b, count(*) AS shared FROM runs a JOIN runs b ON a.cs = b.cs AND a.name < b.name AND a.version <> b.version
 WHERE NOT EXISTS (SELECT 1 FROM br WHERE br.name = a.name AND br.version = b.version) AND NOT EXISTS (SELECT 1 FROM br WHERE br.name = b.name AND br.version = a.version) GROUP BY 1, 2"""
)
def bridge_missing(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_custkey").alias("case"), F.col("o_orderpriority").alias("name"), F.pmod(F.ascii("o_orderpriority"), F.lit(2)).alias("version")).distinct()
    bridges = t.spark.range(1).select(F.lit("5-LOW").alias("name"), F.lit(0).alias("version"))
    return integrity.unbridged(runs, bridges).select("a", "b", "shared")


@query("SELECT CASE WHEN count(DISTINCT l_linenumber % 2) > 1 THEN '0,1' END AS versions_differ, NULL::VARCHAR AS venues_differ, 'A,unknown' AS models_differ, NULL::VARCHAR AS skills_differ FROM lineitem")
def comparability(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_linenumber") % 2).alias("set_version"), F.lit(None).cast("boolean").alias("in_situ"), F.when(F.col("l_returnflag") == "A", "A").alias("model"), F.lit("x").alias("skill_version"))
    return guards.comparable(rows.filter("set_version = 0"), rows.filter("set_version = 1"))


@query("SELECT c_custkey AS key, 'c_mktsegment: ' || c_mktsegment AS message FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def vocabulary_issues(t: Tables) -> DataFrame:
    return guards.outside_vocabulary(t.customer, "c_custkey", c_mktsegment=("BUILDING", "MACHINERY"))


@query("WITH a AS (SELECT DISTINCT ps AS k FROM (SELECT l_suppkey AS ps FROM lineitem WHERE l_quantity > 49)), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) SELECT k AS suppkey, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)")
def set_differences(t: Tables) -> DataFrame:
    return integrity.set_differences(t.lineitem.filter("l_quantity > 49").select(F.col("l_suppkey").alias("suppkey")), t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("suppkey")), "suppkey")


@query("WITH a AS (SELECT DISTINCT doc_id AS k, quality AS v FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS k, toxic AS v FROM labels WHERE doc_id % 3 <> 1) SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def manifest_changes(t: Tables) -> DataFrame:
    return integrity.changed(t.labels.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("v")), t.labels.filter("doc_id % 3 <> 1").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS agree, {r('avg((quality = toxic)::INT)')} AS share FROM labels")
def equal_answers(t: Tables) -> DataFrame:
    return integrity.agreement_share(t.labels.select("doc_id", F.col("quality").alias("v")), t.labels.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


EDGES = "ed AS (SELECT DISTINCT l_partkey AS src, (l_partkey * 7 + l_linenumber) % 500 AS dst FROM lineitem)"


@query(f"WITH RECURSIVE {EDGES}, rc(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM rc JOIN ed ON src = id WHERE depth < 12) SELECT id, min(depth)::INT AS depth FROM rc GROUP BY 1")
def reachability(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 500).alias("dst")).distinct()
    return integrity.reachable(edges, t.spark.range(1).select(F.lit(1).cast("long").alias("id")))


@query("WITH p AS (SELECT unnest(['STANDARD', 'STAND', 'PROMO', 'ECO', 'E', 'SMALL']) AS prefix) SELECT p_partkey, arg_max(prefix, length(prefix)) AS prefix FROM part JOIN p ON starts_with(p_type, prefix) GROUP BY 1")
def longest_prefix(t: Tables) -> DataFrame:
    prefixes = t.spark.range(1).select(F.explode(F.array(*map(F.lit, ("STANDARD", "STAND", "PROMO", "ECO", "E", "SMALL")))).alias("prefix"))
    names = t.part.select("p_partkey", F.col("p_type").alias("name"))
    return names.join(integrity.longest_prefix(names.select("name").distinct(), prefixes), "name").select("p_partkey", "prefix")


@query("SELECT o_orderkey, " + r("sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)") + " AS spent, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 1000000 AS affordable FROM orders")
def running_budget(t: Tables) -> DataFrame:
    return integrity.running_budget(t.orders, "o_custkey", "o_orderkey", "o_totalprice", 1_000_000).select("o_orderkey", "spent", "affordable")


def _draw(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


@query(f"WITH k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_draw(3, 'doc_id')}, doc_id) AS r FROM documents) SELECT lang, doc_id FROM k WHERE r <= 5")
def stratified_sample(t: Tables) -> DataFrame:
    return generate.sample_per_group(t.documents.select("lang", "doc_id"), "lang", "doc_id", 5, 3)


@query(f"WITH b AS (SELECT lang, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY {_draw(4, 'doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) SELECT lang, doc_id, n_chars, before FROM b WHERE before < 20000")
def budget_draw(t: Tables) -> DataFrame:
    return generate.budget_draw(t.documents.select("lang", "doc_id", "n_chars"), "doc_id", "n_chars", 20_000, 4, ["lang"])


@query("SELECT p_partkey, ('0x' || substr(sha256(p_brand || ':1:' || p_size), 1, 16))::UBIGINT::VARCHAR AS seed FROM part")
def derived_seeds(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", generate.derive_seed(F.col("p_brand"), F.lit(1), F.col("p_size")).alias("seed"))


GEN = "('0x' || substr(md5('2:' || p_partkey || ':' || attempt || ':{name}'), 1, 8))::BIGINT"


@query(
    f"""WITH t AS (SELECT p_partkey, p_partkey % 2 AS odd, attempt, 1 + {GEN.format(name="x")} % 20 AS x, [2, 3, 5][{GEN.format(name="y")} % 3 + 1] AS y FROM part, (SELECT unnest(range(0, 40)) AS attempt)),
 f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY attempt) AS n FROM t WHERE x % 2 = odd AND x % y = 0 AND x > y)
 SELECT p_partkey, attempt::INT AS attempt, x, y, CASE WHEN (x + 1 > 10) = (x > 10) AND (x - 1 > 10) = (x > 10) THEN true ELSE false END AS stable FROM f WHERE n = 1"""
)
def sampled_variables(t: Tables) -> DataFrame:
    items = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("want"))
    out = generate.sample_for_target(items, "p_partkey", "want", {"x": ("range", 1, 20), "y": (2, 3, 5)}, ["x % y == 0", "x > y"], "'even' if x % 2 == 0 else 'odd'", 40, 2)
    return out.withColumn("stable", generate.stable_nearby("'big' if x > 10 else 'small'", {"x": F.col("x")}, ["x"]))


@query("WITH g AS (SELECT n_nationkey, n_regionkey, ntile(3) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS grp, n_name FROM nation) SELECT n_regionkey, grp::INT AS \"group\", string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM g GROUP BY 1, 2")
def contiguous_groups(t: Tables) -> DataFrame:
    out = generate.partition_entries(t.nation, "n_nationkey", "n_name", 3, ["n_regionkey"])
    return out.select("n_regionkey", "group", F.array_join("names", "|").alias("names"))


@query(f"WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT count(*) AS n, {r('min(n)')} AS least, {r('quantile_cont(n, 0.5)')} AS median, {r('avg(n)')} AS mean, {r('max(n)')} AS most FROM c")
def conversation_lengths(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy("conv_id").agg(F.count("*").cast("double").alias("n"))
    return turns.agg(F.count("*").alias("n"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"))


@query("WITH a AS (SELECT conv_id, list(length(text) ORDER BY turn, text) AS sizes FROM conversations GROUP BY 1) SELECT conv_id, sizes = list_sort(sizes) AS climbs FROM a")
def sizes_climb(t: Tables) -> DataFrame:
    sizes = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.length(s["text"])).alias("sizes"))
    return sizes.select("conv_id", (F.array_sort("sizes") == F.col("sizes")).alias("climbs"))


@query("SELECT n_name, CASE n_regionkey % 3 WHEN 0 THEN ['a', 'b', 'c', n_name, 'k', 'l'] WHEN 1 THEN [n_name, 'k', 'l', 'a', 'b', 'c'] ELSE [n_name, 'a', 'b', 'c', 'k', 'l'] END AS facts FROM nation")
def arranged_facts(t: Tables) -> DataFrame:
    position = F.when(F.col("n_regionkey") % 3 == 0, "early").when(F.col("n_regionkey") % 3 == 1, "late").otherwise("middle")
    return t.nation.select("n_name", generate.arrange(F.array(F.col("n_name"), F.lit("k"), F.lit("l")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), position).alias("facts"))


@query(f"SELECT o_custkey, count(*) AS n, {_draw(8, 'o_custkey')} % 100 AS bucket FROM orders GROUP BY 1")
def hash_draws(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("bucket", draw(8, F.col("o_custkey")) % 100)
