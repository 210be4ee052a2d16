"""Reading and writing records as JSON lines: explicit schemas, refusals, torn tails, comments, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.guards import require

#: Shapes of the records that the operators read; all columns may be null but the keys.
VERDICT = (
    "`case` string, repeat int, fired boolean, procedure string, covers boolean, set_version int, model string, backend string, contract string, skill_version string, in_situ boolean, "
    "p_fire double, should_fire boolean, route string, routes array<string>, band string, triple string, domain string, stakes string, ask string, kind string, raw string"
)
RUN = (
    "item_id string, template_id string, arm string, model string, n_distractors int, position string, expected string, parsed string, parse_status string, correct boolean, zero_cause string, cost_usd double, prompt_tokens int, output_tokens int, duration_ms long, response string"
)
SHARDED = (
    "task_id string, task string, condition string, model string, n_turns int, final_response string, turn_responses array<string>, prompt_tokens_by_turn array<int>, output_tokens_by_turn array<int>, cost_usd double, duration_ms long, conversation_id string, schema_version int, error string, final_turn string, system_prompt string"
)
NODE = (
    "conversation_id string, node_name string, node_id string, parent_node_id string, operation string, model string, prompt string, response string, report_seen_by_parent string, prompt_tokens int, output_tokens int, cost_usd double, duration_ms long, schema_version int, attributes map<string,string>"
)
LEDGER = "`case` string, judge int, adjudicated boolean, label boolean, band string, triple string, kind string, model string, raw string"
EVENT = "triplet_id string, repeat int, q_base double, q_governing double, q_matched double"
CORRECTION = "kind string, to_version int, date string, reason string, decision string, item string, old_label boolean, new_label boolean, adjudicator string"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any line that does not parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_readable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that do not parse are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("_ok", F.col("_bad").isNull()).filter("_ok").drop("_bad", "_ok")


def completed_keys(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    return read_readable(spark, path, schema).select(*keys).distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the non-blank lines; files are read whole, for their order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).filter(F.trim("line") != "")


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with their line_no; the last line of a file may be torn and is left out, a torn one before it is refused."""
    lines = numbered_lines(spark, path)
    parsed = lines.select("path", "line_no", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("line").isNotNull().alias("ok"), F.max("line_no").over(W.partitionBy("path")).alias("end"))
    require(parsed, torn_line_within_a_file=~F.col("ok") & (F.col("line_no") < F.col("end")))
    return parsed.filter("ok").select("path", "line_no", "r.*")


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_corrections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of a register of JSON lines with ``#`` comments."""
    lines = numbered_lines(spark, path).filter(~F.trim("line").startswith("#"))
    parsed = lines.select("line_no", F.from_json("line", CORRECTION).alias("r"), F.try_parse_json("line").isNotNull().alias("ok"))
    why = F.when(~F.col("ok"), "not JSON").when(F.col("r.kind").isNull() | ~F.col("r.kind").isin("moved", "none", "rebuilt", "extended"), "unknown kind").when(F.col("r.to_version").isNull(), "no version").when(~F.coalesce(F.col("r.date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "bad date")
    told = parsed.withColumn("message", why)
    return told.filter("message is null").select("line_no", "r.*"), told.filter("message is not null").select(F.col("line_no").cast("string").alias("key"), "message")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of a line list; what follows ``#`` is a comment."""
    return spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("key")).filter("key <> ''").distinct()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, task, shards, payload) of a JSON array; a shard may be a string or an object with a ``shard`` text."""
    return corpus_rows(spark.read.text(path, wholetext=True))


def corpus_rows(arrays: DataFrame) -> DataFrame:
    """The same of JSON arrays (value)."""
    whole = arrays.select(F.explode(F.expr("cast(parse_json(value) as array<variant>)")).alias("v"))
    shard = lambda s: F.coalesce(F.try_variant_get(s, "$.shard", "string"), F.try_variant_get(s, "$", "string"))
    return whole.select(F.variant_get("v", "$.task_id", "string").alias("task_id"), F.variant_get("v", "$.task", "string").alias("task"), F.transform(F.variant_get("v", "$.shards", "array<variant>"), shard).alias("shards"), F.to_json("v").alias("payload"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_file(spark: SparkSession, path: str, length: int, sha256: str) -> DataFrame:
    return require(file_digests(spark, path), file_differs_from_lock=(F.col("length") != length) | (F.col("sha256") != sha256))
