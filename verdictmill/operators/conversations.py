"""Sharded conversations and call trees: shapes, plans, budgets, comparability, pairs of conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import called_names, match_calls
from ..functions.parsing import first_select, normalise_sql
from .guards import require


def shard_turns(n_turns: Column, final_turn: Column) -> Column:
    """Turns without the closing one."""
    return n_turns - F.when(final_turn.isNotNull(), 1).otherwise(0)


def climbs(sizes: Column) -> Column:
    """The array never falls."""
    return F.array_sort(sizes) == sizes


def shard_summary(instructions: DataFrame) -> DataFrame:
    n = F.size("shards").cast("double")
    return instructions.agg(F.count("*").alias("n"), F.count_distinct("task").alias("n_tasks"), F.min(n).alias("least"), F.percentile(n, 0.5).alias("median"), F.avg(n).alias("mean"), F.max(n).alias("most"))


def plan_run(instructions: DataFrame, pairable: Sequence[str], repeats: int = 1, final_turn: bool = False) -> DataFrame:
    """Per task whether it is planned, its instructions, and the calls they take."""
    calls = (F.size("shards") + int(final_turn)) * repeats
    planned = F.col("task").isin(*pairable)
    return instructions.groupBy("task", planned.alias("planned")).agg(F.count("*").alias("n"), F.sum(F.when(planned, calls).otherwise(0)).alias("calls"))


def responses_comparable(records: DataFrame) -> DataFrame:
    """One row: the reason against comparing final responses, null if there is none."""
    open_ = (F.col("condition") == "sharded") & (F.col("n_turns") > 1) & F.col("final_turn").isNull()
    return records.agg(F.count_if(open_).alias("n")).select(F.when(F.col("n") > 0, F.format_string("%d sharded conversations have no closing turn", "n")).alias("reason"))


def condition_pairs(records: DataFrame, key: str, condition: str, value: str, left: str = "full", right: str = "sharded") -> DataFrame:
    """(key, left value, right value) of the keys that have both conditions; one aggregate, no self-join."""
    at = lambda c, name: F.max(F.when(F.col(condition) == c, F.struct(F.col(value).alias("v")))).alias(name)
    both = records.groupBy(key).agg(at(left, "a"), at(right, "b")).filter("a is not null and b is not null")
    return both.select(key, F.col("a.v").alias(left), F.col("b.v").alias(right))


def concordance(pairs: DataFrame, gold: Column, left: Column, right: Column, tolerance: float = 1e-6) -> DataFrame:
    """How the two conditions agree with the gold value: both, either, neither, unreadable."""
    hit = lambda c: F.coalesce(F.abs(c - gold) <= tolerance, F.lit(False))
    a, b = hit(left), hit(right)
    unread = left.isNull() | right.isNull()
    return pairs.agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"), F.count_if(unread).alias("unreadable"))


def tree_budget(nodes: DataFrame) -> DataFrame:
    """Cost, tokens and duration per node name, and of all (node_name null), in one pass."""
    return nodes.rollup("node_name").agg(F.count("*").alias("nodes"), F.count_distinct("conversation_id").alias("trees"), F.sum("cost_usd").alias("cost_usd"), F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms")).withColumn("usd_per_tree", F.try_divide("cost_usd", "trees"))


def was_transformed(report: Column, response: Column) -> Column:
    return report.isNotNull() & (report != response)


def pinned_reports(nodes: DataFrame, root: str) -> DataFrame:
    """Per tree the reports its parent saw, by node."""
    seen = nodes.filter((F.col("node_name") != root) & F.col("report_seen_by_parent").isNotNull())
    return seen.groupBy("conversation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_name", "report_seen_by_parent")))).alias("reports"))


def call_cost(prompt_chars: Column, per_token: float = 2.5e-6, least: float = 0.005) -> Column:
    """A quarter of a token per character, and a floor."""
    return F.greatest(prompt_chars / 4 * per_token, F.lit(least))


def run_cost(items: Column, arms: Column, usd_per_item: Column, repeats: int = 2) -> Column:
    return items * arms * repeats * usd_per_item


# The field of a family that holds the whole instruction, and the one that holds its standing context (None: it needs none).
INSTRUCTION_FIELD = {"actions": "fully_specified_question", "database": "fully_specified_question", "math": "question"}
CONTEXT_FIELD = {"actions": "function", "database": "schema_sql", "math": None}
PREAMBLE = {"actions": "The following functions are available to you:", "database": "You are writing SQL against this database:"}


def full_instruction(tasks: DataFrame) -> DataFrame:
    """Adds ``instruction`` to rows (task_id, task, payload as JSON): the text of the family's field, or of its only message. Another family, and an empty one, is refused."""
    v = F.parse_json("payload")
    made = F.lit(None).cast("string")
    for task, field in INSTRUCTION_FIELD.items():
        one = F.try_variant_get(v, f"$.{field}", "array<variant>")
        nested = F.when(F.size(one) == 1, F.coalesce(F.try_variant_get(one[0], "$.content", "string"), F.try_variant_get(one[0], "$[0].content", "string")))
        plain = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
        made = F.when(F.col("task") == task, F.coalesce(plain, nested)).otherwise(made)
    out = tasks.withColumn("instruction", F.regexp_replace(made, r"^\s+|\s+$", ""))
    require(out, no_such_family=~F.col("task").isin(*INSTRUCTION_FIELD), no_instruction=F.col("task").isin(*INSTRUCTION_FIELD) & (F.coalesce("instruction", F.lit("")) == ""))
    return out


def task_context(tasks: DataFrame) -> DataFrame:
    """Adds ``context``: the preamble and the family's field (as JSON if it is no text), empty for a family that needs none. A missing one is refused."""
    v = F.parse_json("payload")
    made = F.when(F.col("task").isin(*[t for t, f in CONTEXT_FIELD.items() if f is None]), F.lit(""))
    for task, field in CONTEXT_FIELD.items():
        if field:
            at = F.try_variant_get(v, f"$.{field}", "variant")
            body = F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, f"$.{field}", "string")).otherwise(F.to_json(at))
            trimmed = F.nullif(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(""))
            made = made.when(F.col("task") == task, F.concat(F.lit(PREAMBLE[task] + "\n\n"), trimmed))
    out = tasks.withColumn("context", made)
    require(out, no_such_family=~F.col("task").isin(*CONTEXT_FIELD), no_context=F.col("task").isin(*CONTEXT_FIELD) & F.col("context").isNull())
    return out


def final_responses(nodes: DataFrame, root: str = "orchestrator", order: str = "at") -> DataFrame:
    """(conversation_id, response): what the root said first in each tree; a tree without a root is refused."""
    said = nodes.groupBy("conversation_id").agg(F.min_by(F.when(F.col("node_name") == root, F.struct("response")), F.when(F.col("node_name") == root, F.col(order))).alias("r"))
    require(said, tree_without_a_root=F.col("r").isNull())
    return said.select("conversation_id", "r.response")


#: Fixed value: what stands for a report that was left out.
ABLATED = "[no report was returned by this sub-agent]"


def render_reports(names: Column, reports: Column, ablated: str = ABLATED) -> Column:
    """The reports under a heading each; an ablated one (null) keeps its heading. Arrays of different lengths are refused: they are put together by place."""
    blocks = F.transform(F.arrays_zip(names.alias("n"), reports.alias("r")), lambda x: F.concat(F.lit("## Report from "), x["n"], F.lit("\n\n"), F.coalesce(x["r"], F.lit(ablated))))
    return F.when(F.size(names) == F.size(reports), F.array_join(blocks, "\n\n")).otherwise(F.raise_error(F.lit("as many reports as dispatches are needed")))


def pinned_dispatches(dispatches: DataFrame, pinned: DataFrame, ablate: str) -> DataFrame:
    """(conversation_id, node_name, report) of a fan-out (conversation_id, node_name) in which one node reports nothing and all others what is pinned (conversation_id, node_name, report).

    A tree without that node, and another node without a pinned report, is refused.
    """
    gone = F.col("node_name") == ablate
    require(dispatches.groupBy("conversation_id").agg(F.bool_or(gone).alias("has")), tree_without_the_node=~F.col("has"))
    both = dispatches.select("conversation_id", "node_name").join(pinned.select("conversation_id", "node_name", "report"), ["conversation_id", "node_name"], "left")
    require(both, unpinned_node=~gone & F.col("report").isNull())
    return both.withColumn("report", F.when(~gone, F.col("report")))


def instrument_checks(records: DataFrame, full: str = "full", sharded: str = "sharded", most_errors: int = 5) -> DataFrame:
    """One row over records (task_id, condition, prompt_tokens_by_turn, error): counts, complete pairs, and how many of the checks fail."""
    has = lambda c: F.bool_or(F.col("condition") == c)
    pairs = records.groupBy("task_id").agg(has(full).alias("a"), has(sharded).alias("b")).agg(F.count_if(F.col("a") & F.col("b")).alias("pairs"))
    falls = (F.col("condition") == sharded) & ~climbs(F.col("prompt_tokens_by_turn"))
    counts = records.agg(F.count("*").alias("records"), F.count_if(F.col("condition") == sharded).alias("sharded"), F.count_if(falls).alias("not_climbing"), F.count("error").alias("errors"))
    failed = (F.col("not_climbing") > 0).cast("int") + (F.col("errors") > most_errors).cast("int")
    return counts.join(pairs).withColumn("failed", failed)


def database_report(pairs: DataFrame, reference: str, left: str = "full", right: str = "sharded") -> DataFrame:
    """One row: replies with a query, and those whose query is the reference's after normalising, by condition and of both."""
    wanted = normalise_sql(F.col(reference))
    said = {c: normalise_sql(first_select(F.col(c))) for c in (left, right)}
    hit = {c: F.coalesce(q == wanted, F.lit(False)) for c, q in said.items()}
    return pairs.agg(F.count("*").alias("n"), *[F.count(said[c]).alias(f"{c}_queries") for c in said], *[F.count_if(hit[c]).alias(f"{c}_equal") for c in said], F.count_if(hit[left] & hit[right]).alias("both_equal"))


def actions_report(pairs: DataFrame, key: str, left: str = "full", right: str = "sharded") -> DataFrame:
    """One row: per condition the outcomes of matching calls, and the share of the key's functions that the reply names."""
    def named(reply: Column) -> Column:
        names = called_names(F.col("key"))
        return F.size(F.filter(names, lambda n: F.contains(reply, n))) / F.size(names)

    # A row per pair and condition, so that each reply is matched once.
    sides = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("reply"), F.col(key).alias("key")) for c in (left, right)])
    said = pairs.select(F.explode(sides).alias("x")).select("x.*")
    told = said.select("c", F.explode(F.array(match_calls(F.col("reply"), F.col("key")))).alias("told"), F.when(F.col("key").isNotNull(), named(F.col("reply"))).alias("named"))
    at = lambda c: F.col("c") == c
    counts = lambda c: [F.count_if(at(c) & (F.col("told") == o)).alias(f"{c}_{o}") for o in ("matched", "wrong", "unreadable")]
    share = lambda c: F.avg(F.when(at(c), F.col("named"))).alias(f"{c}_naming")
    return told.agg(F.count_if(at(left)).alias("n"), *counts(left), share(left), *counts(right), share(right))


def items_by_arms(items: DataFrame, arms: tuple[str, ...], order: str) -> DataFrame:
    """(items..., arm, arm_at): every item under every arm, item by item; the arms are few and travel with the plan."""
    return items.select("*", F.posexplode(F.array(*map(F.lit, arms))).alias("arm_at", "arm")).orderBy(order, "arm_at")
