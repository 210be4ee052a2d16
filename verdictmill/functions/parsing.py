"""Replies as text: verdicts in JSON, answer lines, numbers, queries. All as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import casefold, let

#: A flat JSON object; the first one counts.
FLAT_OBJECT = r"\{[^{}]*\}"
#: An answer line (what is told may stand on the next line), its decoration, a number.
ANSWER_LINE = r"(?imd)^[\s>*\-]*(?:\*\*|__|`)?\s*ANSWER\s*(?:\*\*|__|`)?\s*:\s*(.+?)\s*$"
NUMBER = r"-?\$?\d[\d,]*(?:\.\d+)?"


def _of(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def decision(text: Column, allowed: Sequence[str]) -> Column:
    """Struct (fired, procedure, p_fire) of the first flat object; all null if it is no JSON or ``fire`` no boolean."""
    found = F.try_parse_json(F.nullif(F.regexp_extract(text, FLAT_OBJECT, 0), F.lit("")))
    is_a = lambda path, kinds: F.schema_of_variant(F.try_variant_get(found, path, "variant")).isin(*kinds)
    fired = F.when(is_a("$.fire", ["BOOLEAN"]), _of(found, "$.fire", "boolean"))
    named = F.coalesce(_of(found, "$.procedure", "string"), _of(found, "$.tool", "string"))
    p = _of(found, "$.p_fire", "double")
    text_p = F.schema_of_variant(F.try_variant_get(found, "$.p_fire", "variant")) == "STRING"
    return F.struct(
        fired.alias("fired"),
        F.when(fired.isNotNull() & named.isin(*allowed), named).alias("procedure"),
        F.when(fired.isNotNull() & ~F.coalesce(text_p, F.lit(False)) & p.between(0.0, 1.0), p).alias("p_fire"),
    )


def balanced_objects(text: Column) -> Column:
    """Array of (first, last, depth) of the balanced ``{...}`` of a text, by their first character (from 0); depth 1 is outermost.

    One pass over the characters with a stack: within an object, quotes begin and end strings, in which braces mean nothing and a backslash guards the
    next character. Outside of all objects a quote is prose.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("quoted"), F.lit(False).alias("guarded"), F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<first:int,last:int,depth:int>>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        inside = F.size(s["open"]) > 0
        opens, closes = (c == "{") & ~s["quoted"], (c == "}") & ~s["quoted"] & inside
        quoted = F.when((c == '"') & inside & ~s["guarded"], ~s["quoted"]).otherwise(s["quoted"])
        open_ = F.when(opens, F.concat(s["open"], F.array(s["at"]))).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        whole = F.struct(F.element_at(s["open"], -1).alias("first"), s["at"].alias("last"), F.size(s["open"]).alias("depth"))
        found = F.when(closes, F.concat(s["found"], F.array(whole))).otherwise(s["found"])
        return F.struct((s["at"] + 1).alias("at"), quoted.alias("quoted"), (s["quoted"] & ~s["guarded"] & (c == "\\")).alias("guarded"), open_.alias("open"), found.alias("found"))

    return F.array_sort(F.aggregate(F.split(text, ""), start, step)["found"])


def json_candidates(text: Column, nested: bool = False) -> Column:
    """Array of what in a reply may be its JSON object, widest first: the whole, from the first brace to the last, then the flat objects in order.

    With ``nested`` the other balanced objects follow, outermost first: they find a verdict that holds an object and has braces in the prose beside it.
    """
    return let(F.regexp_replace(text, r"^\s+|\s+$", ""), lambda bare: _candidates(bare, nested))


def _candidates(bare: Column, nested: bool) -> Column:
    first, last = F.locate("{", bare), F.length(bare) - F.locate("}", F.reverse(bare)) + 1
    slice_ = F.when((first > 0) & F.contains(bare, F.lit("}")) & (first < last), F.substr(bare, first, last - first + 1))
    parts = [F.array(bare, slice_), F.regexp_extract_all(bare, F.lit(FLAT_OBJECT), F.lit(0))]
    if nested:
        balanced = F.array_sort(F.transform(balanced_objects(bare), lambda o: F.struct(o["depth"], o["first"], o["last"])))
        parts.append(F.transform(balanced, lambda o: F.substr(bare, o["first"] + 1, o["last"] - o["first"] + 1)))
    return F.array_compact(F.concat(*parts))


def first_object(text: Column, accept: Callable[[Column], Column], nested: bool = False) -> Column:
    """The first candidate, as a variant, that is a JSON object which ``accept`` takes."""
    # The parser stops behind the first value: an object has to be the whole candidate.
    whole = lambda c: c.startswith("{") & c.endswith("}") & (c.rlike(f"^{FLAT_OBJECT}$") | F.exists(balanced_objects(c), lambda o: (o["first"] == 0) & (o["last"] == F.length(c) - 1)))
    objects = F.transform(F.filter(json_candidates(text, nested), whole), lambda c: F.try_parse_json(c))
    return F.get(F.filter(objects, lambda v: F.coalesce(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT") & accept(v), F.lit(False))), F.lit(0))


def boolean_decision(text: Column, field: str = "decision", nested: bool = False) -> Column:
    """The boolean ``field`` of the first candidate that has one; a text or a number is none."""
    is_boolean = lambda v: F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")) == "BOOLEAN"
    return let(first_object(text, is_boolean, nested), lambda v: F.try_variant_get(v, f"$.{field}", "boolean"))


def judged(text: Column, verdicts: Sequence[str], nested: bool = False) -> Column:
    """Struct (verdict, confidence) of the first candidate whose ``verdict`` is one of ``verdicts``; the confidence is null unless a number in [0, 1]."""

    def told(found: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(found, "$.confidence", "variant"))
        number = F.when(~kind.isin("STRING", "BOOLEAN"), F.try_variant_get(found, "$.confidence", "double"))
        return F.struct(F.try_variant_get(found, "$.verdict", "string").alias("verdict"), F.when(number.between(0.0, 1.0), number).alias("confidence"))

    return let(first_object(text, lambda v: F.try_variant_get(v, "$.verdict", "string").isin(*verdicts), nested), told)


def normalise(text: Column) -> Column:
    """Without decoration; runs of white space, underscores and hyphens as a space; case folded."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\s*_`\"'\[]+", ""), r"[\s*_`\"'\].,;:!]+$", "")
    return casefold(F.trim(F.regexp_replace(bare, r"[\s_\-]+", " ")))


def parse_answer(text: Column, options: Column) -> Column:
    """Struct (status, value, raw) of the last answer line against an array of options."""
    raw = F.try_element_at(F.regexp_extract_all(text, F.lit(ANSWER_LINE), F.lit(1)), F.lit(-1))
    hits = F.filter(options, lambda o: normalise(o) == normalise(raw))
    status = F.when(raw.isNull(), "no_answer_line").when(F.size(hits) == 1, "parsed").when(F.size(hits) > 1, "ambiguous").otherwise("unlisted_option")
    return F.struct(status.alias("status"), F.when(F.size(hits) == 1, hits[0]).alias("value"), raw.alias("raw"))


def zero_cause(correct: Column, parsed: Column, infrastructure_error: Column) -> Column:
    return F.when(infrastructure_error, "infrastructure").when(correct, F.lit(None)).when(~parsed, "format").otherwise("wrong_answer")


def parse_number(text: Column) -> Column:
    """A number without its commas and dollar signs; white space within is none of it."""
    return F.regexp_replace(text, "[,$]", "").try_cast("double")


def last_number(text: Column) -> Column:
    return parse_number(F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1)))


def gold_answer(text: Column) -> Column:
    return parse_number(F.nullif(F.regexp_extract(text, r"####\s*(-?[\d,]+(?:\.\d+)?)", 1), F.lit("")))


def normalise_sql(query: Column) -> Column:
    """White space, case and kinds of quotes alone: double quotes and back-ticks are single quotes; closing semicolons go."""
    flat = F.rtrim(F.trim(F.regexp_replace(query, r"\s+", " ")), F.lit(";"))
    return F.translate(F.lower(flat), '"`', "''")


def first_select(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?is)(\bselect\b.+?\bfrom\b.*?)(?:;|\n```|\z)", 1)), F.lit(""))


def last_line_vote(text: Column, label: str = "VERDICT") -> Column:
    """What follows the last line that begins with the label; null without one."""
    return F.lower(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?im)^\s*{label}\s*:\s*(\w+)"), F.lit(1)), F.lit(-1)))


def markers(text: Column, wanted: Column) -> Column:
    """Struct (found, missing, verbatim): which markers a text holds, and whether it holds all."""
    found = F.filter(wanted, lambda m: F.contains(text, m))
    return F.struct(found.alias("found"), F.array_except(wanted, found).alias("missing"), (F.size(found) == F.size(wanted)).alias("verbatim"))


def confidence(value: Column) -> Column:
    """A number in [0, 1], else null; booleans are no numbers."""
    number = F.try_variant_get(F.try_parse_json(value), "$", "double")
    plain = ~F.lower(F.trim(value)).isin("true", "false") & ~value.startswith('"')
    return F.when(plain & number.between(0.0, 1.0), number)


def scored_items(replies: DataFrame, reply: str, options: str, answer: str, infrastructure_error: Column | None = None) -> DataFrame:
    """Adds status, value, is_correct and zero_cause to replies with options (array) and the answer."""
    parsed = replies.withColumn("_a", parse_answer(F.col(reply), F.col(options)))
    ok = (F.col("_a.status") == "parsed") & (F.col("_a.value") == F.col(answer))
    right = F.coalesce(ok, F.lit(False))
    cause = zero_cause(right, F.col("_a.status") == "parsed", F.coalesce(infrastructure_error, F.lit(False)) if infrastructure_error is not None else F.lit(False))
    return parsed.select(*replies.columns, F.col("_a.status").alias("status"), F.col("_a.value").alias("value"), right.alias("is_correct"), cause.alias("zero_cause"))


def score_summary(scored: DataFrame, *by: str) -> DataFrame:
    """(by, total, correct, parse_failures, accuracy) of scored items."""
    out = scored.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.count_if(F.col("status") != "parsed").alias("parse_failures"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))
