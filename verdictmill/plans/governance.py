"""Provenance of runs, registers, claims, bibliographies, routing, casefiles, reports and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, prompts, text
from ..functions import rates as forms
from ..operators import calibration, casefiles, conversations, corpus, documents, generate, inference, integrity, items, movement, provenance, rates, reports, routing
from .analysis import GRID_SQL, event_grid
from .proxies import DOCS_SQL, LINES_SQL, doc_verdicts, line_verdicts
from .registry import Tables, query, r
from .screening import BATTERY_SQL, turns

s = lambda c: F.col(c).cast("string")

# --- runs: a document is a README, its name and lines follow from its id and digest

RUNS_SQL = """rn AS (SELECT doc_id, 'results/' || source || '/' || name AS path, name, CASE WHEN doc_id % 13 <> 0 THEN text || chr(10) || CASE WHEN doc_id % 7 <> 0 THEN '**Answer key:** `keys/' || lang || '.yaml` at v' || doc_id % 3 || ' of it' || chr(10) ELSE '' END
   || CASE WHEN doc_id % 5 <> 0 THEN 'Prediction: see notebook/p-' || doc_id % 20 || '.md' || chr(10) ELSE '' END || 'Outcome: notebook/o-' || doc_id % 11 || '.md' || chr(10) END AS readme, doc_id % 4 AS version
  FROM (SELECT *, '2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '-' || substr(md5(doc_id::VARCHAR), 1, CASE WHEN doc_id % 9 = 0 THEN 6 ELSE 7 END) || '-run' AS name FROM documents)),
 nt AS (SELECT 'notebook/p-' || k || '.md' AS path, CASE WHEN k % 3 > 0 THEN 'c' || k END AS first_commit FROM (SELECT unnest(range(0, 16)) AS k) UNION ALL SELECT 'notebook/o-' || k || '.md', 'c' || k FROM (SELECT unnest(range(0, 9)) AS k))"""


def _runs(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    day, sha = F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.substr(F.md5(i.cast("string")), F.lit(1), F.when(i % 9 == 0, 6).otherwise(7))
    name = F.concat(F.lit("2026-01-"), day, F.lit("-"), sha, F.lit("-run"))
    key = F.when(i % 7 != 0, F.concat(F.lit("**Answer key:** `keys/"), F.col("lang"), F.lit(".yaml` at v"), (i % 3).cast("string"), F.lit(" of it\n"))).otherwise("")
    guess = F.when(i % 5 != 0, F.concat(F.lit("Prediction: see notebook/p-"), (i % 20).cast("string"), F.lit(".md\n"))).otherwise("")
    readme = F.when(i % 13 != 0, F.concat(F.col("text"), F.lit("\n"), key, guess, F.lit("Outcome: notebook/o-"), (i % 11).cast("string"), F.lit(".md\n")))
    return t.documents.select("doc_id", F.concat(F.lit("results/"), F.col("source"), F.lit("/"), name).alias("path"), name.alias("name"), readme.alias("readme"), F.array((i % 4).cast("int")).alias("versions"))


def _notes(t: Tables) -> DataFrame:
    k = F.col("id")
    p = t.spark.range(16).select(F.concat(F.lit("notebook/p-"), k.cast("string"), F.lit(".md")).alias("path"), F.when(k % 3 > 0, F.concat(F.lit("c"), k.cast("string"))).alias("first_commit"))
    return p.unionByName(t.spark.range(9).select(F.concat(F.lit("notebook/o-"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("c"), k.cast("string")).alias("first_commit")))


def _ancestry(t: Tables) -> DataFrame:
    sha = F.substr(F.md5(s("doc_id")), F.lit(1), F.lit(7))
    return t.documents.filter("doc_id % 2 = 0").select(F.concat(F.lit("c"), (F.col("doc_id") % 20).cast("string")).alias("older"), sha.alias("younger"))


ISSUES_SQL = f"""WITH {RUNS_SQL}, x AS (SELECT *, readme IS NOT NULL AS has FROM rn), pr AS (SELECT x.*, nt.path AS note, nt.first_commit FROM x LEFT JOIN nt ON nt.path = 'notebook/p-' || doc_id % 20 || '.md' WHERE has AND doc_id % 5 <> 0),
 iss AS (SELECT path AS key, 'name' AS message FROM x WHERE doc_id % 9 = 0 UNION ALL SELECT path, 'no README' FROM x WHERE NOT has UNION ALL SELECT path, 'no answer key' FROM x WHERE has AND doc_id % 7 = 0
 UNION ALL SELECT path, 'records of another version' FROM x WHERE has AND doc_id % 7 <> 0 AND doc_id % 4 <> doc_id % 3 UNION ALL SELECT path, 'no prediction' FROM x WHERE has AND doc_id % 5 = 0
 UNION ALL SELECT path, 'prediction does not exist' FROM pr WHERE note IS NULL UNION ALL SELECT path, 'dead link notebook/p-' || doc_id % 20 || '.md' FROM pr WHERE note IS NULL
 UNION ALL SELECT path, 'dead link notebook/o-' || doc_id % 11 || '.md' FROM x WHERE has AND doc_id % 11 >= 9 UNION ALL SELECT path, 'prediction is not committed' FROM pr WHERE note IS NOT NULL AND first_commit IS NULL AND doc_id % 9 <> 0
 UNION ALL SELECT path, 'prediction does not predate the run' FROM pr WHERE first_commit IS NOT NULL AND doc_id % 9 <> 0 AND doc_id % 2 <> 0)"""


@query(ISSUES_SQL + " SELECT key, message FROM iss")
def run_issues(t: Tables) -> DataFrame:
    return provenance.run_issues(_runs(t), _notes(t), _ancestry(t))


@query(ISSUES_SQL + ", f AS (SELECT DISTINCT rn.name AS key FROM iss JOIN rn ON rn.path = iss.key), b AS (SELECT name AS key FROM rn WHERE doc_id % 6 = 1) SELECT coalesce(f.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'issue' WHEN f.key IS NULL THEN 'stale' ELSE 'deferred' END AS state FROM f FULL OUTER JOIN b ON f.key = b.key")
def provenance_states(t: Tables) -> DataFrame:
    runs = _runs(t)
    return provenance.provenance(runs, provenance.run_issues(runs, _notes(t), _ancestry(t)), runs.filter("doc_id % 6 = 1").select(F.col("name").alias("key")))


@query(f"WITH {RUNS_SQL} SELECT path, CASE WHEN readme IS NOT NULL AND doc_id % 7 <> 0 THEN doc_id % 3 END::INT AS version, CASE WHEN readme IS NOT NULL AND doc_id % 5 <> 0 THEN 'notebook/p-' || doc_id % 20 || '.md' ELSE '' END AS predictions, CASE WHEN readme IS NOT NULL THEN 'notebook/o-' || doc_id % 11 || '.md' ELSE '' END AS outcomes FROM rn")
def run_index(t: Tables) -> DataFrame:
    return provenance.run_index(_runs(t)).select("path", "version", F.array_join("predictions", " ").alias("predictions"), F.array_join("outcomes", " ").alias("outcomes"))


@query(f"WITH {RUNS_SQL}, k AS (SELECT 'notebook/p-' || doc_id % 20 || '.md' AS note, path FROM rn WHERE readme IS NOT NULL AND doc_id % 5 <> 0 UNION ALL SELECT 'notebook/o-' || doc_id % 11 || '.md', path FROM rn WHERE readme IS NOT NULL) SELECT note, count(DISTINCT path) AS n, min(path) AS first FROM k GROUP BY 1")
def note_index(t: Tables) -> DataFrame:
    return provenance.note_index(_runs(t)).select("note", F.size("runs").cast("long").alias("n"), F.element_at("runs", 1).alias("first"))


LOG_SQL = "CASE WHEN event_id % 17 = 0 THEN '{broken' WHEN event_id % 5 = 0 THEN '{\"a\": 1}' WHEN event_id % 7 = 0 THEN '{\"set_version\": \"2\"}' WHEN event_id % 3 = 0 THEN '[1]' ELSE '{\"set_version\": ' || user_id % 4 || '}' END"


@query(f"WITH l AS (SELECT event_type AS path, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 OR event_id % 3 = 0 THEN NULL ELSE user_id % 4 END AS v FROM events) SELECT path, array_to_string(list_sort(list_distinct(list(v))), ',') AS versions FROM l GROUP BY 1")
def record_versions(t: Tables) -> DataFrame:
    e = F.col("event_id")
    line = F.when(e % 17 == 0, "{broken").when(e % 5 == 0, '{"a": 1}').when(e % 7 == 0, '{"set_version": "2"}').when(e % 3 == 0, "[1]").otherwise(F.concat(F.lit('{"set_version": '), (F.col("user_id") % 4).cast("string"), F.lit("}")))
    return provenance.record_versions(t.events.select(F.col("event_type").alias("path"), line.alias("value"))).select("path", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions"))


@query("WITH c AS (SELECT c_custkey % 9 + 4 AS v, c_mktsegment AS d FROM customer WHERE c_custkey % 9 + 4 <> 7) SELECT v::VARCHAR AS key, 'no such decision' AS message FROM c WHERE d NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT k::VARCHAR, 'no line accounts for it' FROM (SELECT unnest(range(2, 12)) AS k) WHERE k NOT IN (SELECT v FROM c) UNION ALL SELECT v::VARCHAR, 'ahead of the corpus' FROM c WHERE v > 11")
def correction_findings(t: Tables) -> DataFrame:
    rows = t.customer.select((F.col("c_custkey") % 9 + 4).cast("int").alias("to_version"), F.col("c_mktsegment").alias("decision")).filter("to_version <> 7")
    headings = t.customer.filter("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_mktsegment").alias("heading"))
    return provenance.correction_findings(rows, headings, 11)


REGISTER_SQL = """g AS (SELECT DISTINCT o_custkey AS sha FROM orders WHERE o_orderstatus = 'P'), e AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN [] WHEN c_custkey % 3 = 1 THEN [c_custkey] ELSE [c_custkey, c_custkey + 1] END AS commits, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE 'why' END AS body FROM customer),
 n AS (SELECT DISTINCT unnest(commits) AS sha FROM e), b AS (SELECT s_suppkey AS sha FROM supplier)"""


@query(f"WITH {REGISTER_SQL}, nn AS (SELECT unnest(commits) AS sha FROM e) SELECT c_name AS key, 'names no commit' AS message FROM e WHERE len(commits) = 0 UNION ALL SELECT c_name, 'has no body' FROM e WHERE trim(body) = '' UNION ALL SELECT sha::VARCHAR, 'is no governed commit' FROM nn WHERE sha NOT IN (SELECT sha FROM g) UNION ALL SELECT sha::VARCHAR, 'has no entry' FROM g WHERE sha NOT IN (SELECT sha FROM n) AND sha NOT IN (SELECT sha FROM b) UNION ALL SELECT sha::VARCHAR, 'is baselined and not governed' FROM b WHERE sha NOT IN (SELECT sha FROM g) UNION ALL SELECT sha::VARCHAR, 'is baselined and explained' FROM b WHERE sha IN (SELECT sha FROM n)")
def decision_findings(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    commits = F.when(k % 3 == 0, F.array().cast("array<bigint>")).when(k % 3 == 1, F.array(k)).otherwise(F.array(k, k + 1))
    entries = t.customer.select(F.lit("2026-01-01").alias("date"), F.col("c_name").alias("title"), F.when(k % 10 == 0, " ").otherwise("why").alias("body"), commits.alias("commits"))
    return provenance.decision_findings(entries, t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sha")), t.supplier.select(F.col("s_suppkey").alias("key")))


#: Files are order priorities and segments; a few rows in a thousand break a rule.
CHECK_SQL = """ck AS (SELECT 'run-' || substr(o_orderpriority, 1, 1) AS file, o_custkey AS c, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE 1 END WHEN '4' THEN 1 + o_orderkey % 2 ELSE 3 END AS v, NULL AS kind, NULL AS src, o_custkey % 2 = 0 AS lab FROM orders
 UNION ALL SELECT 'rescored-v2-run-1', c_custkey, 2, 'rescore', 'run-1', c_custkey % 3 = 0 FROM customer UNION ALL SELECT 'rescored-v9-none', c_custkey, 9, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 'rescore' END, 'run-0', c_custkey % 3 = 0 FROM customer)"""


def _checkpoints(t: Tables) -> tuple[DataFrame, DataFrame]:
    p, k = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey")
    v = F.when(p == "1", 1).when(p == "2", 2).when((p == "3") & (k % 1000 == 0), F.lit(None)).when(p == "3", 1).when(p == "4", 1 + k % 2).otherwise(3)
    null = F.lit(None).cast("string")
    runs = t.orders.select(F.concat(F.lit("run-"), p).alias("file"), F.col("o_custkey").alias("case"), v.cast("int").alias("set_version"), null.alias("record_kind"), null.alias("rescored_from"), (F.col("o_custkey") % 2 == 0).alias("should_fire"))
    third = (F.col("c_custkey") % 3 == 0).alias("should_fire")
    one = t.customer.select(F.lit("rescored-v2-run-1").alias("file"), F.col("c_custkey").alias("case"), F.lit(2).alias("set_version"), F.lit("rescore").alias("record_kind"), F.lit("run-1").alias("rescored_from"), third)
    two = t.customer.select(F.lit("rescored-v9-none").alias("file"), F.col("c_custkey").alias("case"), F.lit(9).alias("set_version"), F.when(F.col("c_custkey") % 50 != 0, "rescore").alias("record_kind"), F.lit("run-0").alias("rescored_from"), third)
    keys = t.customer.select(F.lit(2).alias("version"), F.col("c_custkey").alias("case"), (F.col("c_custkey") % 3 == 0).alias("label"))
    return runs.unionByName(one).unionByName(two), keys


@query(
    f"""WITH {CHECK_SQL}, f AS (SELECT file, count(*) FILTER (WHERE v IS NULL) AS gaps, count(DISTINCT v) AS vs, max(v) AS v, count(*) FILTER (WHERE kind = 'rescore') AS again, count(*) AS n, starts_with(file, 'rescored-') AS bridge, max(src) AS src FROM ck GROUP BY 1),
 ru AS (SELECT * FROM f WHERE NOT bridge AND gaps = 0 AND vs = 1), cs AS (SELECT DISTINCT ck.file, ck.c, ck.v FROM ck JOIN ru USING (file))
 SELECT file AS key, 'rows without a version' AS message FROM f WHERE gaps > 0 UNION ALL SELECT file, 'several versions' FROM f WHERE vs > 1 UNION ALL SELECT file, 'a re-scored file with other rows' FROM f WHERE bridge AND again < n
 UNION ALL SELECT file, 're-scored from no run' FROM f WHERE bridge AND vs = 1 AND src NOT IN (SELECT file FROM ru)
 UNION ALL SELECT DISTINCT a.file || ' ' || b.file, 'no bridge between' FROM cs a JOIN cs b ON a.c = b.c AND a.file < b.file AND a.v <> b.v WHERE NOT EXISTS (SELECT 1 FROM f WHERE bridge AND vs = 1 AND ((src = a.file AND v = b.v) OR (src = b.file AND v = a.v)))"""
)
def checkpoint_findings(t: Tables) -> DataFrame:
    return provenance.checkpoint_findings(*_checkpoints(t))


@query("SELECT o_orderpriority AS file, count(*) AS n, sum(version)::BIGINT AS versions, sum(lab::INT)::BIGINT AS labels FROM (SELECT o_orderpriority, CASE WHEN substr(o_orderpriority, 1, 1) < '4' THEN 1 ELSE 3 END AS version, o_custkey % 2 = 0 AS lab FROM orders UNION ALL SELECT 'rescored-v3-' || o_orderpriority, 3, o_custkey % 3 = 0 FROM orders WHERE substr(o_orderpriority, 1, 1) < '4') GROUP BY 1")
def reconciled(t: Tables) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    rows = t.orders.select(F.col("o_orderpriority").alias("file"), F.col("o_custkey").alias("case"), F.when(p >= "4", 3).alias("set_version"), F.lit(None).cast("string").alias("record_kind"), F.lit(None).cast("string").alias("rescored_from"), (F.col("o_custkey") % 2 == 0).alias("should_fire"))
    declared = t.orders.select(F.col("o_orderpriority").alias("file"), F.lit(1).alias("version")).distinct()
    keys = t.customer.select(F.lit(3).alias("version"), F.col("c_custkey").alias("case"), (F.col("c_custkey") % 3 == 0).alias("label"))
    stamped, bridges = provenance.reconcile(rows, declared, keys)
    return stamped.unionByName(bridges).groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("set_version").cast("long")).alias("versions"), F.sum(F.col("should_fire").cast("long")).alias("labels"))


def _tree_sql(levels: int) -> str:
    """Nodes by the places of their items, each level from the one below."""
    up = [f"n{k + 1} AS (SELECT i // {provenance.FANOUT} AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, sum(n) AS n FROM n{k} GROUP BY i // {provenance.FANOUT})" for k in range(levels)]
    return f"n0 AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, d) - 1 AS i, d, 1 AS n FROM d), {', '.join(up)} SELECT sha256(string_agg(d, '' ORDER BY i)) AS fingerprint, sum(n)::BIGINT AS n FROM n{levels}"


@query(f"WITH d AS (SELECT doc_id, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(text, ''), coalesce(lang, ''))) AS d FROM documents), {_tree_sql(provenance.LEVELS)}")
def corpus_fingerprint(t: Tables) -> DataFrame:
    return provenance.corpus_fingerprint(t.documents, "doc_id", "doc_id", "text", "lang")


@query("SELECT source || '/' || doc_id AS path, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha256 FROM documents")
def manifest(t: Tables) -> DataFrame:
    return provenance.render_manifest(t.documents.select(F.concat_ws("/", "source", s("doc_id")).alias("path"), F.encode("text", "utf-8").alias("content")))


FLOORS = (("src1", 60.0, 50.0, 0), ("rc", 30.0, 20.0, 1), ("src1/1", 90.0, 10.0, 2), ("c2/", 40.0, 45.0, 3))
FLOORS_SQL = f"fl AS (SELECT * FROM (VALUES {', '.join(map(str, FLOORS))}) x(pattern, line, branch, pos)), fi AS (SELECT source || '/' || doc_id AS path, n_chars % 97 AS cl, n_chars % 31 AS ml, n_chars % 13 AS cb, n_chars % 29 AS nb FROM documents)"


@query(
    f"""WITH {FLOORS_SQL}, m AS (SELECT path, cl, ml, cb, nb, arg_max(struct_pack(pattern := pattern, line := line, branch := branch), (length(pattern), pos)) AS f FROM fi JOIN fl ON contains(path, pattern) GROUP BY ALL),
 v AS (SELECT path, f.pattern AS pattern, 'line' AS kind, CASE WHEN cl + ml = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * cl / (cl + ml) END AS percent, f.line AS floor FROM m UNION ALL SELECT path, f.pattern, 'branch', CASE WHEN nb = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * cb / nb END, f.branch FROM m)
 SELECT path, pattern, kind, {r("percent")} AS percent, {r("floor")} AS floor FROM v WHERE percent + 1e-9 < floor"""
)
def floor_violations(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    files = t.documents.select(F.concat_ws("/", "source", s("doc_id")).alias("path"), (n % 97).alias("covered_lines"), (n % 31).alias("missing_lines"), (n % 13).alias("covered_branches"), (n % 29).alias("num_branches"))
    floors = t.spark.createDataFrame(FLOORS, "pattern string, line double, branch double, at int")
    return provenance.floor_violations(files, floors)


@query("WITH p AS (SELECT o_orderpriority AS arena, list_distinct(list(c_mktsegment)) AS models FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 470000 AND o_orderpriority <> '5-LOW' GROUP BY 1), q AS (SELECT DISTINCT o_orderpriority AS arena, c_mktsegment AS model FROM orders JOIN customer ON o_custkey = c_custkey) SELECT q.arena, model FROM q LEFT JOIN p ON p.arena = q.arena WHERE NOT coalesce(list_contains(models, model), false)")
def refused_models(t: Tables) -> DataFrame:
    both = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    policies = both.filter("o_totalprice > 470000 and o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("arena")).agg(F.collect_set("c_mktsegment").alias("models"))
    return provenance.allowed_models(both.select(F.col("o_orderpriority").alias("arena"), F.col("c_mktsegment").alias("model")).distinct(), policies)


# --- texts that cite, claim and depend

BIB_SQL = "bb AS (SELECT p_partkey, p_partkey % 3 AS k, p_partkey % 10 AS d, p_name FROM part)"


def _bib(t: Tables) -> DataFrame:
    k, d = F.col("p_partkey") % 3, (F.col("p_partkey") % 10).cast("string")
    quote = F.concat(F.lit("  quote = {"), F.col("p_name"), F.when(k == 0, " 5% of\n  {it and 7%} all").when(k == 1, r" 5\% of").otherwise(""), F.lit("},\n"))
    entry = F.concat(F.lit("% 1111.11111\n@misc{a,\n  eprint = {2401.0000"), d, F.lit("},\n"), quote, F.when(k == 2, "  quotes = {x},\n").otherwise(""), F.lit("  Quote_Body = {y}\n}\n@misc{b,\n  note = {3%}\n}\n"))
    return t.part.select(F.col("p_partkey").alias("path"), entry.alias("text"))


@query(f"WITH {BIB_SQL} SELECT p_partkey AS path, '2401.0000' || d AS arxiv, 'quote' AS name, unnest([4, 5])::INT AS line FROM bb WHERE k = 0 UNION ALL SELECT p_partkey, '-', 'note', CASE k WHEN 0 THEN 9 WHEN 1 THEN 8 ELSE 9 END FROM bb")
def bare_percents(t: Tables) -> DataFrame:
    return documents.bare_percents(_bib(t))


@query(f"WITH {BIB_SQL} SELECT p_partkey AS path, '2401.0000' || d AS arxiv, 'quotes' AS name, 5 AS line FROM bb WHERE k = 2")
def unknown_quote_fields(t: Tables) -> DataFrame:
    return documents.unknown_quote_fields(_bib(t))


@query("WITH c AS (SELECT c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown paper' WHEN c_custkey % 4 = 1 AND c_custkey % 3 = 0 THEN 'number without a quote' END AS message, c_custkey FROM customer) SELECT c_custkey AS path, '2401.0000' || c_custkey % 4 AS arxiv, message FROM c WHERE message IS NOT NULL")
def uncited_numbers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    told = F.concat(F.when(k % 3 == 0, "It is 40%\nof all, says ").otherwise("In 40 of "), F.lit("2401.0000"), (k % 4).cast("string"), F.lit(".\n\n- Some 7 % here\n# 9 %\n"))
    bib = documents.bib_entries(t.region.limit(1).select(F.lit("@misc{a,\n eprint = {2401.00001}\n}\n@misc{b,\n quote = {2401.00002}\n}\n%@x\n@misc{c,\n quote_body = {x}, eprint={2401.00003}\n}\n").alias("text")))
    return documents.uncited_numbers(t.customer.select(k.alias("path"), told.alias("text")), bib).select(F.col("path").cast("long").alias("path"), "arxiv", "message")


@query("SELECT p_partkey AS path, 6 + p_partkey % 2 AS n_blocks, (14 + p_partkey % 2)::INT AS last_line FROM part")
def markdown_blocks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    doc = F.concat(F.lit("# "), F.col("p_name"), F.lit("\nOne line\nand the next of "), F.col("p_type"), F.lit("\n\n- item\n  goes on\n1. first\n2. no item of its own\n```\n# "), F.col("p_brand"), F.lit("\n\n- x\n```\n"), F.when(k % 2 == 1, "***\n").otherwise(""), F.lit("> quoted end"))
    cut = documents.markdown_blocks(t.part.select(k.alias("path"), doc.alias("text")))
    return cut.groupBy(F.col("path").cast("long").alias("path")).agg(F.count("*").alias("n_blocks"), F.max("line").alias("last_line"))


@query("SELECT lower(replace(p_brand, '#', '-')) AS claim_id, count(DISTINCT p_type) AS n, min(p_type) AS first FROM part WHERE p_size % 3 < 2 GROUP BY 1")
def published_ids(t: Tables) -> DataFrame:
    name = F.lower(F.translate("p_brand", "#", "-"))
    call = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(' claim("'), name, F.lit('") '))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" shown( '"), name, F.lit("' ) "))).otherwise(F.concat(F.lit(" reclaim('"), name, F.lit("')")))
    docs = t.part.groupBy(F.col("p_type").alias("path")).agg(F.concat_ws("\n", F.collect_list(F.concat("p_name", call))).alias("text"))
    return documents.published_ids(docs).select("claim_id", F.size("documents").cast("long").alias("n"), F.element_at("documents", 1).alias("first"))


@query("WITH h AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))) AS h FROM pages), f AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 3) SELECT page_id AS path, h AS depends_on FROM h WHERE h IN (SELECT h FROM f) AND NOT ends_with(h, '.')")
def dependencies(t: Tables) -> DataFrame:
    docs = t.pages.select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    named = docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("f"))
    files = named.groupBy("f").agg(F.count("*").alias("n")).filter("n > 3").select(F.col("f").alias("path"))
    return documents.dependencies(docs, files, 'href="/([^"]*)"', not_mechanisms=(".",))


# --- battery: what its checks could have shown, and the matched statistics

VALUED_SQL = BATTERY_SQL[: BATTERY_SQL.index(" vals AS (SELECT view")].rstrip().rstrip(",")
MATCHED_SQL = f"""{VALUED_SQL}, nb AS (SELECT *, row_number() OVER () AS i, count(*) FILTER (WHERE should_fire) OVER w AS p, count(*) OVER w AS c FROM lf WINDOW w AS (PARTITION BY view, feature, triple)),
 sc AS (SELECT a.view, a.feature, a.triple, a.i, a.should_fire, (sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END)::DOUBLE - 0.5) / (max(a.c) - 1) AS s FROM nb a JOIN nb b ON a.view = b.view AND a.feature = b.feature AND a.triple = b.triple WHERE a.p = 1 AND a.c > 1 GROUP BY ALL),
 gr AS (SELECT view, feature, triple, max(s) FILTER (WHERE should_fire) AS observed, min(s) AS lo, max(s) AS hi, avg((s - 0.5) ** 2) AS e2, avg((s - 0.5) ** 4) AS e4 FROM sc GROUP BY ALL),
 ma AS (SELECT view, feature, avg(observed) AS m, sqrt(sum(e2)) / count(*) AS se, avg(lo) AS mlow, avg(hi) AS mhigh, sum((observed - 0.5) ** 2) - sum(e2) AS excess, sum(e4 - e2 ** 2) AS var FROM gr GROUP BY ALL)"""


@query(f"{MATCHED_SQL} SELECT view, feature, {r('m')} AS matched_auc, {r('CASE WHEN se > 0 THEN abs(m - 0.5) / se ELSE 0.0 END')} AS z, coalesce(CASE WHEN se > 0 THEN abs(m - 0.5) / se ELSE 0.0 END > 3, false) AS matched_leaks, coalesce(CASE WHEN var > 1e-12 THEN excess / sqrt(var) ELSE 0.0 END > 3, false) AS cancels FROM ma")
def matched_battery(t: Tables) -> DataFrame:
    return corpus.battery(turns(t)).select("view", "feature", "matched_auc", "z", "matched_leaks", "cancels")


REACH_SQL = f"""{MATCHED_SQL}, per AS (SELECT view, feature, triple, min(value) AS v, min(value) = max(value) AS still, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM lf GROUP BY ALL),
 tt AS (SELECT view, feature, sum(p) * sum(q) AS total, coalesce(sum(p) FILTER (WHERE still) * sum(q) FILTER (WHERE still), 0) AS pairs FROM per GROUP BY ALL),
 fx AS (SELECT a.view, a.feature, sum(a.p * b.q * CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END)::DOUBLE AS fixed FROM (SELECT view, feature, v, sum(p) AS p FROM per WHERE still GROUP BY ALL) a JOIN (SELECT view, feature, v, sum(q) AS q FROM per WHERE still GROUP BY ALL) b USING (view, feature) GROUP BY ALL),
 re AS (SELECT view, feature, coalesce(fixed, 0.0) / total AS low, (coalesce(fixed, 0.0) + total - pairs) / total AS high, coalesce(se, 0.0) AS se, coalesce(mlow, 0.5) AS mlow, coalesce(mhigh, 0.5) AS mhigh FROM tt LEFT JOIN fx USING (view, feature) LEFT JOIN ma USING (view, feature)),
 rc AS (SELECT *, low >= 0.4 AND high <= 0.6 AND (se = 0 OR greatest(abs(mlow - 0.5), abs(mhigh - 0.5)) <= 3 * se) AS inert FROM re)"""


@query(f"{REACH_SQL} SELECT view, feature, {r('low')} AS low, {r('high')} AS high, {r('se')} AS null_se, inert FROM rc")
def battery_reach(t: Tables) -> DataFrame:
    return corpus.reach(corpus.viewed(turns(t)), list(text.FEATURES), ["view"]).select("view", "feature", "low", "high", "null_se", "inert")


@query(f"{REACH_SQL} SELECT 'inert:' || feature AS key, string_agg(printf('%s could only reach [%.3f, %.3f]', view, low, high), '; ' ORDER BY view) AS message FROM rc GROUP BY feature HAVING bool_and(inert)")
def inert_findings(t: Tables) -> DataFrame:
    return corpus.inert_findings(corpus.reach(corpus.viewed(turns(t)), list(text.FEATURES), ["view"]))


BY_BAND_SQL = f"""{VALUED_SQL}, bv AS (SELECT CASE triple % 3 WHEN 0 THEN 's' WHEN 1 THEN 'm' ELSE 'l' END AS band, * FROM lf),
 vals AS (SELECT band, view, feature, value, count(*) FILTER (WHERE should_fire) AS p, count(*) FILTER (WHERE NOT should_fire) AS q FROM bv GROUP BY ALL),
 be AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY band, view, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vals)"""


@query(f"{BY_BAND_SQL} SELECT band, view, feature, {r('CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (below + q * 0.5::DOUBLE)) / (sum(p) * sum(q)) ELSE 0.5 END')} AS auc FROM be GROUP BY ALL")
def battery_by_band(t: Tables) -> DataFrame:
    from ..operators.ranks import auc, long_form

    banded = turns(t).withColumn("band", F.when(F.col("triple") % 3 == 0, "s").when(F.col("triple") % 3 == 1, "m").otherwise("l"))
    long = long_form(corpus.viewed(banded), list(text.FEATURES), "band", "view", "should_fire")
    return auc(long, "value", "should_fire", ["band", "view", "feature"]).select("band", "view", "feature", "auc")


# --- routing

CASES_OFFER = "ro AS (SELECT p_partkey AS id, [p_brand, p_type] AS routes, p_size > 25 AS pos FROM part), offer AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_type FROM part WHERE p_size > 45 UNION SELECT DISTINCT c_mktsegment FROM customer)"


def _routed(t: Tables) -> tuple[DataFrame, DataFrame]:
    cases = t.part.select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("routes"), (F.col("p_size") > 25).alias("should_fire"))
    offered = t.part.filter("p_size % 2 = 0").select(F.col("p_brand").alias("name")).union(t.part.filter("p_size > 45").select("p_type")).union(t.customer.select("c_mktsegment")).distinct()
    return cases, offered


@query(f"WITH {CASES_OFFER}, x AS (SELECT id, unnest(routes) AS n FROM ro WHERE id % 5 = 0 UNION ALL SELECT id, 'odd' || id % 3 FROM ro WHERE id % 5 <> 0) SELECT id::VARCHAR AS key, 'no such procedure: ' || n AS message FROM x WHERE n NOT IN (SELECT name FROM offer)")
def route_findings(t: Tables) -> DataFrame:
    cases, offered = _routed(t)
    odd = F.when(F.col("id") % 5 == 0, F.col("routes")).otherwise(F.array(F.concat(F.lit("odd"), (F.col("id") % 3).cast("string"))))
    return routing.route_findings(cases.withColumn("routes", odd), offered)


@query(f"WITH {CASES_OFFER} SELECT name FROM offer WHERE name NOT IN (SELECT unnest(routes) FROM ro WHERE pos)")
def unreachable_procedures(t: Tables) -> DataFrame:
    return routing.unreachable_procedures(*_routed(t))


@query("SELECT p_type, bool_and(p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')) AS by_name FROM part WHERE p_size < 8 GROUP BY 1")
def routing_by_name(t: Tables) -> DataFrame:
    names = t.part.filter("p_size < 8").groupBy("p_type").agg(F.collect_set("p_brand").alias("offered"))
    return names.select("p_type", routing.by_name(F.col("offered"), F.array(*[F.lit(f"Brand#{k}") for k in range(1, 6)])).alias("by_name"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Use for ' || p_name || '. It routes ' || p_type || '. Do not use for ' || p_brand || '.' WHEN 1 THEN 'Use for ' || p_name || '. It routes ' || p_type || '.' WHEN 2 THEN 'Use for ' || p_name || '.' WHEN 3 THEN 'It routes ' || p_type || '. Do not use for ' || p_brand || '.' ELSE 'Named. It routes ' || p_type || '. Do not use for ' || p_brand || '.' END AS told FROM part")
def description_variants(t: Tables) -> DataFrame:
    body = F.concat(F.lit("Use for  "), F.col("p_name"), F.lit(".\nIt routes "), F.col("p_type"), F.lit(". Do not use for "), F.col("p_brand"), F.lit("."))
    variant = F.element_at(F.array(*map(F.lit, ("full", "no-exclusions", "opener-only", "no-opener", "named"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", routing.description_variant(body, variant, ".", "Do not use for", {"named": "Named."}).alias("told"))


@query("SELECT n_regionkey AS \"group\", string_agg(n_name, '-' ORDER BY n_nationkey) AS name, string_agg('to ' || n_nationkey, '; ' ORDER BY n_nationkey) AS product FROM nation GROUP BY 1")
def grouped_entries(t: Tables) -> DataFrame:
    groups = t.nation.groupBy(F.col("n_regionkey").alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return routing.grouped_entries(groups, t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("to "), s("n_nationkey")).alias("product")))


# --- rates, gates, reports

KIND_SQL = f"{DOCS_SQL}, ki AS (SELECT kind, doc_id, avg(fired::INT) AS p FROM docv WHERE NOT should_fire AND kind IS NOT NULL GROUP BY ALL HAVING count(fired) > 0), kr AS (SELECT kind, count(*) AS n, avg(p) AS f FROM ki GROUP BY 1)"
Z = forms.z_value()
WILSON_SQL = f"kw AS (SELECT *, greatest(0, (f + {Z!r}::DOUBLE ** 2 / (2 * n) - {Z!r}::DOUBLE * sqrt(f * (1 - f) / n + {Z!r}::DOUBLE ** 2 / (4 * n * n))) / (1 + {Z!r}::DOUBLE ** 2 / n)) AS lo, least(1, (f + {Z!r}::DOUBLE ** 2 / (2 * n) + {Z!r}::DOUBLE * sqrt(f * (1 - f) / n + {Z!r}::DOUBLE ** 2 / (4 * n * n))) / (1 + {Z!r}::DOUBLE ** 2 / n)) AS hi FROM kr)"


@query(f"WITH {KIND_SQL}, {WILSON_SQL} SELECT a.kind, b.kind AS other FROM kw a JOIN kw b ON a.kind <> b.kind WHERE b.f < a.lo OR b.f > a.hi")
def separated_kinds(t: Tables) -> DataFrame:
    return rates.separated(rates.fpr_by_kind(doc_verdicts(t)))


@query(f"WITH {KIND_SQL}, {WILSON_SQL} SELECT kind, format('{{:<16}}{{:>6}}', kind, n) || printf('%6.1f%%', round(f * 100, 1)) || '  [' || printf('%6.1f%%', round(lo * 100, 1)) || ',' || printf('%6.1f%%', round(hi * 100, 1)) || ']' AS line FROM kw")
def kind_report(t: Tables) -> DataFrame:
    return reports.kind_lines(rates.fpr_by_kind(doc_verdicts(t)))


@query(f"SELECT event_type AS verdict, {r('avg(value) FILTER (WHERE event_id % 3 <> 0)')} AS confidence, count(*) FILTER (WHERE event_id % 3 <> 0) AS n FROM events GROUP BY 1")
def mean_confidences(t: Tables) -> DataFrame:
    return rates.mean_confidence(t.events.select(F.col("event_type").alias("verdict"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("confidence")))


@query(f"WITH {DOCS_SQL} SELECT band, count(*) FILTER (WHERE fired IS NULL) AS lost, count(*) AS n FROM docv GROUP BY 1")
def losses_by_band(t: Tables) -> DataFrame:
    return rates.losses(doc_verdicts(t), "band")


GATE_SQL = "ga AS (SELECT l_returnflag AS template_id, l_linenumber - 1 AS n_distractors, CASE WHEN l_linenumber > 1 THEN CASE l_suppkey % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END END AS position, CASE WHEN l_quantity < 49 THEN (l_discount < 0.08)::INT ELSE 0 END AS ok FROM lineitem)"


def _gate(t: Tables) -> DataFrame:
    position = F.when(F.col("l_suppkey") % 3 == 0, "early").when(F.col("l_suppkey") % 3 == 1, "middle").otherwise("late")
    return t.lineitem.select(F.col("l_returnflag").alias("template_id"), (F.col("l_linenumber") - 1).alias("n_distractors"), position.alias("position"), F.when(F.col("l_quantity") < 49, F.col("l_discount") < 0.08).alias("correct"))


def _gate_part(scope: str, name: str, group: str, passes: str = "NULL::BOOLEAN", where: str = "true") -> str:
    return f"SELECT '{scope}' AS scope, {name} AS name, {r('avg(ok) FILTER (WHERE n_distractors = 0)')} AS clean, {r('avg(ok) FILTER (WHERE n_distractors > 0)')} AS loaded, count(*) AS n, {passes} AS passes FROM ga WHERE {where} {group}"


@query(f"WITH {GATE_SQL} " + " UNION ALL ".join([_gate_part("template", "template_id", "GROUP BY template_id", "coalesce(avg(ok) FILTER (WHERE n_distractors = 0) >= 0.95, true)"), _gate_part("distractors", "n_distractors::VARCHAR", "GROUP BY n_distractors"), _gate_part("position", "position", "GROUP BY position", where="position IS NOT NULL"), _gate_part("all", "NULL::VARCHAR", "", "avg(ok) FILTER (WHERE n_distractors > 0) BETWEEN 0.35 AND 0.75")]))
def calibration_gate(t: Tables) -> DataFrame:
    return rates.calibration_gate(_gate(t))


@query(f"WITH {GATE_SQL}, p AS (SELECT template_id, avg(ok) AS a FROM ga GROUP BY 1) SELECT count(*) AS n_templates, {r('stddev_samp(a)')} AS spread FROM p")
def template_spread(t: Tables) -> DataFrame:
    return rates.template_spread(_gate(t))


@query(f"WITH {DOCS_SQL}, f AS (SELECT round((n_chars % 101) / 100.0, 2)::DOUBLE AS f, should_fire::INT::DOUBLE AS o, fired, n_chars FROM docv), g AS (SELECT * FROM f WHERE fired IS NOT NULL AND n_chars % 10 <> 3) SELECT (SELECT count(*) FROM g) AS n, (SELECT count(*) FROM f) AS n_all, {r('avg((f - o) ** 2)')} AS brier FROM g")
def forecast_report(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    rows = doc_verdicts(t).select(F.when(n % 10 != 3, F.round((n % 101) / 100, 2)).alias("p_fire"), "fired", "should_fire")
    return calibration.calibration_report(rows).select("n", "n_all", "brier")


@query(f"WITH {LINES_SQL}, x AS (SELECT procedure, l_orderkey AS id, routes[1] AS accepted, coalesce(routes[1] = procedure, false)::INT AS hit FROM linev WHERE len(routes) > 0), i AS (SELECT accepted AS target, id, avg(hit) AS rate, sum(hit) AS hits, count(*) AS n, count(procedure) AS answered FROM x GROUP BY 1, 2), g AS (SELECT target, count(*) AS items, sum(n)::BIGINT AS recs, avg(rate) AS a, sum(hits) / sum(n) AS b, CASE WHEN sum(answered) > 0 THEN sum(hits) / sum(answered) ELSE 0.0 END AS c FROM i GROUP BY 1) SELECT target, printf('%-10s %6d %5d ', target, items, recs) || printf('%7.3f', a) || ' ' || printf('%7.3f', b) || ' ' || printf('%7.3f', c) AS line FROM g")
def routing_report_lines(t: Tables) -> DataFrame:
    return reports.routing_lines(rates.routing_by_procedure(line_verdicts(t), "first"))


@query(f"WITH {GRID_SQL}, p AS (SELECT item, avg(correct) AS p FROM grid GROUP BY 1) SELECT 0 AS at, printf('items scored          %d', count(*)) AS line FROM p UNION ALL SELECT 1, printf('median difficulty     %.3f', quantile_cont(p, 0.5)) FROM p")
def item_report(t: Tables) -> DataFrame:
    return reports.item_lines(items.item_analysis(event_grid(t))).filter("at < 2")


@query(f"WITH {LINES_SQL}, p AS (SELECT l_orderkey, avg((fired = should_fire)::INT) AS p, bool_or(should_fire) AS label, count(*) AS n FROM linev WHERE fired IS NOT NULL GROUP BY 1) SELECT l_orderkey AS item, label, {r('p')} AS p, n FROM p WHERE p = 0 OR p = 1")
def broken_item_list(t: Tables) -> DataFrame:
    return items.broken_item_list(items.respondent_grid(line_verdicts(t).withColumn("arm", F.lit("a")))).withColumnRenamed("case", "item")


@query(f"WITH a AS (SELECT o_orderkey AS k, avg((l_quantity > 25)::INT) AS a, avg((l_discount > 0.05)::INT) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), f AS (SELECT avg(a) AS a, avg(b) AS b, count(*) AS n, count(*) FILTER (WHERE a > b) AS wa, count(*) FILTER (WHERE b > a) AS wb FROM a) SELECT 0 AS at, printf('%-24s accuracy %.4f', 'full', a) AS line FROM f UNION ALL SELECT 1, printf('%-24s accuracy %.4f', 'bare', b) FROM f UNION ALL SELECT 2, printf('%d of %d item(s) differ -- %d favour full, %d favour bare', wa + wb, n, wa, wb) FROM f")
def comparison_report(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("case")).agg(F.avg((F.col("l_quantity") > 25).cast("int")).alias("full"), F.avg((F.col("l_discount") > 0.05).cast("int")).alias("bare"))
    return reports.comparison_lines(rows, "full", "bare", inference.wilcoxon(rows, "full", "bare")).filter("at < 3")


# --- conversations and trees

INST_SQL = "CASE WHEN p_partkey % 3 = 0 THEN 'math' WHEN p_partkey % 3 = 1 THEN 'database' ELSE 'actions' END"


def _tasks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    task = F.when(k % 3 == 0, "math").when(k % 3 == 1, "database").otherwise("actions")
    payload = (
        F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit(" "), F.col("p_name"), F.lit("?\n")).alias("question"))))
        .when(k % 3 == 1, F.to_json(F.struct(F.col("p_type").alias("fully_specified_question"), F.concat(F.lit(" "), F.col("p_brand")).alias("schema_sql"))))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("content"))).alias("fully_specified_question"), F.array(F.struct(F.col("p_size").alias("size"))).alias("function"))))
    )
    return t.part.select(F.col("p_partkey").alias("task_id"), task.alias("task"), payload.alias("payload"))


@query("SELECT p_partkey AS task_id, CASE p_partkey % 3 WHEN 0 THEN p_name || '?' WHEN 1 THEN p_type ELSE p_name END AS instruction FROM part")
def full_instructions(t: Tables) -> DataFrame:
    return conversations.full_instruction(_tasks(t)).select("task_id", "instruction")


@query("SELECT p_partkey AS task_id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'You are writing SQL against this database:' || chr(10) || chr(10) || p_brand ELSE 'The following functions are available to you:' || chr(10) || chr(10) || '[{\"size\":' || p_size || '}]' END AS context FROM part")
def task_contexts(t: Tables) -> DataFrame:
    return conversations.task_context(_tasks(t)).select("task_id", "context")


@query("SELECT conv_id AS conversation_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS response FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user') > 0")
def final_responses(t: Tables) -> DataFrame:
    nodes = t.conversations.select(F.col("conv_id").alias("conversation_id"), F.col("role").alias("node_name"), F.col("turn").alias("at"), F.col("text").alias("response"))
    has = nodes.filter("node_name = 'user'").select("conversation_id").distinct()
    return conversations.final_responses(nodes.join(has, "conversation_id", "left_semi"), "user")


@query("WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN substr(text, 1, 40) END AS rep FROM conversations) SELECT conv_id, string_agg('## Report from n' || turn || chr(10) || chr(10) || coalesce(rep, '[no report was returned by this sub-agent]'), chr(10) || chr(10) ORDER BY turn, rep) AS told FROM x GROUP BY 1")
def rendered_reports(t: Tables) -> DataFrame:
    own = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.substring("text", 1, 40)).alias("rep"))
    trees = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("x"))
    names, told = F.transform("x", lambda x: F.concat(F.lit("n"), x["turn"].cast("string"))), F.transform("x", lambda x: x["rep"])
    return trees.select("conv_id", conversations.render_reports(names, told).alias("told"))


@query("SELECT l_orderkey AS conversation_id, CASE WHEN l_linenumber = 1 THEN 'a' ELSE 'n' || l_linenumber END AS node_name, CASE WHEN l_linenumber <> 1 THEN max(l_returnflag || l_partkey) END AS report FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY l_orderkey, l_linenumber")
def pinned_dispatches(t: Tables) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "a").otherwise(F.concat(F.lit("n"), s("l_linenumber")))
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("conversation_id"), name.alias("node_name")).agg(F.max(F.concat("l_returnflag", s("l_partkey"))).alias("report"))
    whole = nodes.join(nodes.filter("node_name = 'a'").select("conversation_id"), "conversation_id", "left_semi")
    return conversations.pinned_dispatches(whole, whole.filter("node_name <> 'a'"), "a")


INSTR_SQL = "ir AS (SELECT o_custkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'sharded' END AS cond, [o_orderkey % 7, o_orderkey % 5 + 3] AS sizes, o_orderkey % 900 = 0 AS err FROM orders)"


@query(f"WITH {INSTR_SQL} SELECT (SELECT count(*) FROM ir) AS records, (SELECT count(*) FROM ir WHERE cond = 'sharded') AS sharded, (SELECT count(*) FROM ir WHERE cond = 'sharded' AND sizes[1] > sizes[2]) AS not_climbing, (SELECT count(*) FROM ir WHERE err) AS errors, (SELECT count(*) FROM (SELECT task_id FROM ir GROUP BY 1 HAVING count(DISTINCT cond) = 2)) AS pairs, ((SELECT count(*) FROM ir WHERE cond = 'sharded' AND sizes[1] > sizes[2]) > 0)::INT + ((SELECT count(*) FROM ir WHERE err) > 5)::INT AS failed")
def instrument_checks(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(F.col("o_custkey").alias("task_id"), F.when(k % 3 == 0, "full").otherwise("sharded").alias("condition"), F.array(k % 7, k % 5 + 3).alias("prompt_tokens_by_turn"), F.when(k % 900 == 0, "x").alias("error"))
    return conversations.instrument_checks(rows)


@query("WITH x AS (SELECT p_size % 4 AS a, p_size % 3 AS b FROM part) SELECT count(*) AS n, count(*) FILTER (WHERE a < 3) AS full_queries, count(*) FILTER (WHERE b < 2) AS sharded_queries, count(*) FILTER (WHERE a < 2) AS full_equal, count(*) FILTER (WHERE b = 0) AS sharded_equal, count(*) FILTER (WHERE a < 2 AND b = 0) AS both_equal FROM x")
def database_report(t: Tables) -> DataFrame:
    a, b, n = F.col("p_size") % 4, F.col("p_size") % 3, F.col("p_name")
    right = F.concat(F.lit("SELECT  x\nFROM t WHERE n = `"), n, F.lit("`"))
    full = F.when(a == 0, F.concat(right, F.lit("; done"))).when(a == 1, F.concat(F.lit("```sql\n"), right, F.lit("\n```"))).when(a == 2, "select x from t").otherwise("no query")
    sharded = F.when(b == 0, F.upper(right)).when(b == 1, F.concat(F.lit("select a.x from t where n = "), n)).otherwise("?")
    return conversations.database_report(t.part.select(F.concat(F.lit("select x from t where n = '"), n, F.lit("';")).alias("ref"), full.alias("full"), sharded.alias("sharded")), "ref")


@query(f"WITH x AS (SELECT p_size % 4 AS a, p_size % 3 AS b FROM part) SELECT count(*) AS n, count(*) FILTER (WHERE a < 2) AS full_matched, count(*) FILTER (WHERE a = 2) AS full_wrong, count(*) FILTER (WHERE a = 3) AS full_unreadable, count(*) FILTER (WHERE b = 0) AS sharded_matched, count(*) FILTER (WHERE b = 1) AS sharded_wrong, count(*) FILTER (WHERE b = 2) AS sharded_unreadable, {r('avg(CASE WHEN a < 3 THEN 1.0 ELSE 0.0 END)')} AS full_naming, {r('avg(CASE WHEN b = 0 THEN 1.0 WHEN b = 1 THEN 0.5 ELSE 0.0 END)')} AS sharded_naming FROM x")
def actions_report(t: Tables) -> DataFrame:
    a, b, n = F.col("p_size") % 4, F.col("p_size") % 3, F.col("p_name")
    one = lambda name, arg: F.concat(F.lit(f'{{"name": "{name}", "arguments": {{"n": "'), arg, F.lit('"}}'))
    calls = lambda *x: F.concat(F.lit("So ["), F.concat_ws(", ", *x), F.lit("]"))
    full = F.when(a == 0, calls(one("find", n), one("drop", n))).when(a == 1, calls(one("drop", n), one("find", F.upper(n)))).when(a == 2, calls(one("find", n), one("drop", F.lit("q")))).otherwise("nothing")
    sharded = F.when(b == 0, calls(one("find", F.concat(n, F.lit(" "))), one("drop", n))).when(b == 1, calls(one("find", n))).otherwise("none")
    key = F.concat(F.lit('[{"find": {"n": ["'), n, F.lit('"]}}, {"drop": {"n": ["zz", "'), n, F.lit('"]}}]'))
    return conversations.actions_report(t.part.select(key.alias("key"), full.alias("full"), sharded.alias("sharded")), "key")


@query("WITH a AS (SELECT unnest(['full', 'bare', 'none']) AS arm, unnest([0, 1, 2]) AS arm_at) SELECT c_custkey, arm, arm_at::INT AS arm_at FROM customer, a")
def items_by_arms(t: Tables) -> DataFrame:
    return conversations.items_by_arms(t.customer.select("c_custkey"), ("full", "bare", "none"), "c_custkey")


# --- generation and casefiles

@query("WITH RECURSIVE d AS (SELECT lang, list(source || ' ' || doc_id ORDER BY doc_id) AS pad FROM documents WHERE doc_id % 7 = 0 GROUP BY 1), c AS (SELECT lang, pad, ['core one of ' || lang, 'core two'] AS core FROM d), z AS (SELECT *, (list_sum(list_transform(pad, lambda x: length(x) + 1)) + list_sum(list_transform(core, lambda x: length(x) + 1)))::DOUBLE AS total FROM c), tg AS (SELECT *, 0.3::DOUBLE * total + 0.3::DOUBLE * total * 0.25::DOUBLE AS t1, 0.3::DOUBLE * total + 0.3::DOUBLE * total * 0.75::DOUBLE AS t2 FROM z), cu AS (SELECT *, list_transform(range(1, len(pad) + 1), lambda k: list_sum(list_transform(pad[1:k], lambda x: length(x) + 1))) AS run FROM tg), n1 AS (SELECT *, len(list_filter(run, lambda u: u <= t1)) AS n1 FROM cu), n2 AS (SELECT *, greatest(n1, len(list_filter(run, lambda u: u + length(core[1]) + 1 <= t2))) AS n2 FROM n1) SELECT lang, array_to_string(pad[1:n1] || core[1:1] || pad[n1 + 1:n2] || core[2:2] || pad[n2 + 1:], '|') AS woven FROM n2")
def woven_padding(t: Tables) -> DataFrame:
    pad = t.documents.filter("doc_id % 7 = 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "source"))), lambda x: F.concat_ws(" ", x["source"], x["doc_id"].cast("string"))).alias("pad"))
    core = F.array(F.concat(F.lit("core one of "), F.col("lang")), F.lit("core two"))
    return pad.select("lang", F.array_join(generate.weave(core, F.col("pad")), "|").alias("woven"))


@query("SELECT c_custkey, c_nationkey % 3 > 0 AS inert, c_nationkey % 3 > 0 AND c_custkey % 4 = 3 AS accepted FROM customer")
def audited_distractors(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    votes = F.when(k == 0, F.array().cast("array<boolean>")).when(k == 1, F.array(F.lit(True))).when(k == 2, F.array(F.lit(True), F.lit(None).cast("boolean"))).otherwise(F.array(F.lit(True), F.lit(True)))
    shared = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return generate.audited(t.customer.select("c_custkey", shared.alias("shared"), votes.alias("votes"))).select("c_custkey", "inert", "accepted")


@query(f"SELECT count(*) AS considered, count(*) FILTER (WHERE c_nationkey % 3 > 0 AND c_custkey % 4 = 3) AS accepted, count(*) FILTER (WHERE NOT (c_nationkey % 3 > 0 AND c_custkey % 4 = 3)) AS refused, {r('avg((c_nationkey % 3 > 0 AND c_custkey % 4 = 3)::INT)')} AS rate FROM customer")
def audit_summary(t: Tables) -> DataFrame:
    return generate.audit_summary(audited_distractors(t))


FILES_SQL = """cf AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'none' WHEN 5 THEN '7' ELSE (c_custkey % 6 % 4)::VARCHAR END AS ord, c_custkey % 5 AS a, c_custkey % 4 AS b, c_custkey % 3 AS c, c_custkey % 7 AS d FROM customer)"""


def _casefiles(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    a, b, c, d = (k % n for n in (5, 4, 3, 7))
    action = lambda i, status, kind, licence: F.struct(F.lit(i).alias("id"), status.alias("status"), kind.alias("failure_kind"), F.array(licence).alias("licensed_by"))
    text_ = lambda x: F.lit(x).cast("string")
    actions = F.array(
        action("A1", F.when(a == 0, "maybe").otherwise("required"), text_(None), text_("C1")), action("A2", text_("prohibited"), F.when(b != 0, "unjustified"), F.when(c == 0, "C1").otherwise("C2")),
        action("A3", text_("prohibited"), F.when(d < 4, "trap").otherwise("other"), F.when(d == 1, "C9").otherwise("C2")),
    )
    conditions = F.array(F.struct(F.lit("C1").alias("id"), F.when(a == 1, "D9").otherwise("D1").alias("source"), F.lit(True).alias("governs")), F.struct(F.lit("C2").alias("id"), F.lit("D1").alias("source"), F.lit(False).alias("governs")))
    order = F.when(k % 6 == 0, "none").when(k % 6 == 5, "7").otherwise((k % 6 % 4).cast("string"))
    return t.customer.select(
        s("c_custkey").alias("case_id"), order.alias("trap_order"), F.array(F.lit("D1")).alias("documents"), conditions.alias("conditions"), actions.alias("actions"), F.when(d == 2, "huge").otherwise("high").alias("exposure_band"),
        F.when(d == 3, "high").otherwise("low").alias("first_order_band"), (c == 1).alias("pivot_present"), F.when(d != 5, F.array(F.lit("date"))).otherwise(F.array().cast("array<string>")).alias("pivot_accepts"),
    )


@query(
    f"""WITH {FILES_SQL}, trap AS (SELECT *, d < 4 AS trap, b <> 0 AS unj FROM cf), m AS (
 SELECT k, 'unknown trap order' AS message FROM trap WHERE ord NOT IN ('none', '1', '2', '3') UNION ALL SELECT k, 'no required action' FROM trap WHERE a = 0 UNION ALL SELECT k, 'no unjustified action' FROM trap WHERE NOT unj
 UNION ALL SELECT k, 'unknown exposure band' FROM trap WHERE d = 2 UNION ALL SELECT k, 'the wrong answer is the right one' FROM trap WHERE d = 3 UNION ALL SELECT k, 'a control with a trap' FROM trap WHERE ord = 'none' AND trap UNION ALL SELECT k, 'no trap' FROM trap WHERE ord <> 'none' AND NOT trap
 UNION ALL SELECT k, 'a pivot without phrasings' FROM trap WHERE c = 1 AND d = 5 UNION ALL SELECT k, 'unknown status of A1' FROM trap WHERE a = 0 UNION ALL SELECT k, 'no failure kind of A2' FROM trap WHERE NOT unj UNION ALL SELECT k, 'a governing condition licenses A2' FROM trap WHERE unj AND c = 0
 UNION ALL SELECT k, 'unknown document of C1' FROM trap WHERE a = 1 UNION ALL SELECT k, 'unknown licence of A3' FROM trap WHERE d = 1) SELECT k::VARCHAR AS key, message FROM m"""
)
def casefile_findings(t: Tables) -> DataFrame:
    return casefiles.validate(_casefiles(t))


SCORED_SQL = "cs AS (SELECT (o_orderkey % 4)::VARCHAR AS ord, o_totalprice > 200000 AS adm, o_custkey % 3 = 0 AS trap, (o_orderkey % 7) / 6.0::DOUBLE AS graded, o_custkey % 2 = 0 AS was FROM orders)"


def _scored(t: Tables) -> DataFrame:
    order = F.when(F.col("o_orderkey") % 4 == 0, "none").otherwise((F.col("o_orderkey") % 4).cast("string"))
    return t.orders.select(s("o_orderkey").alias("case_id"), order.alias("trap_order"), (F.col("o_totalprice") > 200000).alias("admissible"), (F.col("o_custkey") % 3 == 0).alias("trap_hit"), ((F.col("o_orderkey") % 7) / 6.0).alias("graded"), (F.col("o_custkey") % 2 == 0).alias("was"))


_AGG = f"count(*) AS n, {r('avg(adm::INT)')} AS admissible, {r('avg(trap::INT)')} AS trap_rate, {r('avg(graded)')} AS graded"


@query(f"WITH {SCORED_SQL} SELECT 'order ' || CASE ord WHEN '0' THEN 'none' ELSE ord END AS scope, {_AGG}, NULL::BOOLEAN AS passes FROM cs GROUP BY ord UNION ALL SELECT 'all', {_AGG}, avg(adm::INT) < 0.9 FROM cs UNION ALL SELECT 'deep', {_AGG}, coalesce(avg(trap::INT), 0) > 0 FROM cs WHERE ord IN ('2', '3')")
def casefile_report(t: Tables) -> DataFrame:
    return casefiles.report(_scored(t))


@query(f"WITH {SCORED_SQL} SELECT count(*) AS n, {r('avg(was::INT)')} AS was, {r('avg(adm::INT)')} AS now, count(*) FILTER (WHERE NOT was AND adm) AS to_ok, count(*) FILTER (WHERE was AND NOT adm) AS to_fail, count(DISTINCT round(graded, 3)) AS graded_values FROM cs")
def rescore_report(t: Tables) -> DataFrame:
    return casefiles.rescore_report(_scored(t))


# --- ledgers, labels, keys

LEDGER_SQL = "le AS (SELECT user_id % 200 AS c, event_type AS judge, arg_max(CASE WHEN value > 30 THEN NULL ELSE value > 10 END, event_id) AS last, arg_max(value <= 30, event_id) AS reads FROM events GROUP BY 1, 2)"


def _ledger(t: Tables) -> DataFrame:
    return t.events.select((F.col("user_id") % 200).alias("case"), F.col("event_type").alias("judge"), F.col("event_id").alias("line_no"), F.when(F.col("value") <= 30, F.col("value") > 10).alias("adjudicated"))


@query(f"WITH {LEDGER_SQL} SELECT c AS \"case\", string_agg(judge, ' ' ORDER BY judge) AS judges FROM le WHERE reads GROUP BY 1")
def panels(t: Tables) -> DataFrame:
    return integrity.panels(_ledger(t)).select("case", F.array_join("judges", " ").alias("judges"))


@query(f"WITH {LEDGER_SQL} SELECT c AS \"case\" FROM le WHERE reads GROUP BY 1 HAVING count(*) >= 3")
def adjudicated_cases(t: Tables) -> DataFrame:
    return integrity.adjudicated_cases(_ledger(t))


@query("SELECT DISTINCT l_orderkey AS \"case\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_linenumber % 2 = 0) <> (o_custkey % 2 = 0) OR l_returnflag <> o_orderstatus")
def stale_labels(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("case"), (F.col("l_linenumber") % 2 == 0).alias("should_fire"), F.col("l_returnflag").alias("route"))
    key = t.orders.select(F.col("o_orderkey").alias("case"), (F.col("o_custkey") % 2 == 0).alias("new_label"), F.col("o_orderstatus").alias("new_route"))
    return integrity.stale_labels(rows, key)


TOKEN_SQL = r"list_distinct(regexp_extract_all(text, '(?:§|\bsection |\bclause )\s*\d+(?:\.\d+)*') || regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b') || regexp_extract_all(text, '\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December)(?: \d{4})?\b') || regexp_extract_all(text, '\b[A-Z]\w+ (?:Ltd|Limited|Inc|LLC|plc|GmbH)\b') || list_filter(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda n: length(replace(string_split(n, '.')[1], ',', '')) >= 3))"


@query(f"SELECT doc_id, len({TOKEN_SQL})::INT AS n_tokens, array_to_string(list_sort({TOKEN_SQL}), '|') AS tokens FROM documents")
def load_bearing_tokens(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", text.load_bearing_tokens(F.col("text")).alias("k"))
    return found.select("doc_id", F.size("k").alias("n_tokens"), F.array_join("k", "|").alias("tokens"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'composed' END AS vote FROM documents")
def last_votes(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("VERDICT: unsure\n"), F.col("text"), F.lit("\n Verdict : "), F.when(F.col("doc_id") % 2 == 0, "Real").otherwise("COMPOSED"), F.lit(" it is\n"))
    return t.documents.select("doc_id", parsing.last_line_vote(reply).alias("vote"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'infrastructure' WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'format' ELSE 'wrong_answer' END AS cause FROM part")
def zero_causes(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return t.part.select("p_partkey", parsing.zero_cause(n % 5 == 0, n % 2 != 0, n % 3 == 0).alias("cause"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size >= 40) AS closes, count(*) FILTER (WHERE p_size + 5 < 40) AS survives FROM part GROUP BY 1")
def interval_states(t: Tables) -> DataFrame:
    state = forms.interval_state(F.col("p_size"), F.col("p_size") + 5, 40)
    return t.part.groupBy("p_brand").agg(F.count_if(state == "closes").alias("closes"), F.count_if(state == "survives").alias("survives"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' END AS before, CASE WHEN doc_id % 2 = 0 THEN 'c d' END AS after FROM documents")
def shared_scopes(t: Tables) -> DataFrame:
    body = F.concat(F.lit("a <<"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, ">> c d ").otherwise("> c"))
    return t.documents.select("doc_id", prompts.shared_scope(body, "<<", ">>").alias("x")).select("doc_id", "x.before", "x.after")


J_SQL = "ev AS (SELECT o_custkey AS id, o_orderstatus AS st, avg(o_totalprice) AS b, max(o_totalprice) AS g, min(o_totalprice) AS m FROM orders GROUP BY 1, 2), jj AS (SELECT st, avg((abs(g - b) / b > 0.3)::INT) AS se, 1 - avg((abs(m - b) / b > 0.5)::INT) AS sp FROM ev GROUP BY 1)"


@query(f"WITH {J_SQL}, d AS (SELECT st, se + sp - 1 AS j, se, sp FROM jj) SELECT st, {r('j')} AS j, j >= 0.1 AS kill, printf('J = %.3f [%.3f, %.3f], min(sensitivity, specificity) = %.3f', j, j - 0.1, j + 0.1, least(se, sp)) || ': ' || CASE WHEN j < 0.1 THEN 'the venue survives' WHEN least(se, sp) < 0.5 THEN 'killed, but not both arms are adequate' ELSE 'the venue closes' END AS disposition FROM d")
def dispositions(t: Tables) -> DataFrame:
    e = t.orders.groupBy("o_custkey", F.col("o_orderstatus").alias("st")).agg(F.avg("o_totalprice").alias("b"), F.max("o_totalprice").alias("g"), F.min("o_totalprice").alias("m"))
    move = lambda c, x: F.avg((F.abs(F.col(c) - F.col("b")) / F.col("b") > x).cast("int"))
    rows = e.groupBy("st").agg(move("g", 0.3).alias("sensitivity"), (1 - move("m", 0.5)).alias("specificity")).withColumn("j", F.col("sensitivity") + F.col("specificity") - 1).withColumns({"low": F.col("j") - 0.1, "high": F.col("j") + 0.1})
    return movement.disposition(rows, 0.1, 0.5).select("st", "j", "kill", "disposition")


@query(f"{MATCHED_SQL}, k AS (SELECT view, feature, m, CASE WHEN se > 0 THEN abs(m - 0.5) / se ELSE 0.0 END AS z, CASE WHEN var > 1e-12 THEN excess / sqrt(var) ELSE 0.0 END AS d FROM ma) SELECT CASE WHEN z > 3 THEN 'matched' ELSE 'cancel' END || ':' || view || ':' || feature AS key, printf('matched %.3f, %.2f standard errors from chance', m, z) AS message FROM k WHERE z > 3 OR d > 3")
def matched_findings(t: Tables) -> DataFrame:
    return corpus.matched_findings(corpus.battery(turns(t)))


@query("SELECT 0.0 AS residual")
def identity_residual(t: Tables) -> DataFrame:
    from .proxies import forecasts

    return calibration.identity_residual(calibration.checked(forecasts(t)))
