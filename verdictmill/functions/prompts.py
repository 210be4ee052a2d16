"""Taking prompts apart and putting them together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.corpus import common_prefix


def extract_delta(base: Column, variant: Column) -> Column:
    """What a variant inserts into its base: between the common beginning and the common end, to whole lines, without a bullet."""
    head = common_prefix(base, variant)
    room = F.least(F.length(base), F.length(variant)) - head
    tail = F.least(room, common_prefix(F.reverse(base), F.reverse(variant)))
    end = F.length(variant) - tail
    inner = F.substr(variant, head + 1, end - head)
    before = F.substr(variant, end, F.lit(1))
    feed = F.length(inner) - F.locate("\n", F.reverse(inner)) + 1
    snapped = F.when((tail > 0) & (end > head) & (before != "\n") & F.contains(inner, F.lit("\n")), F.substr(inner, F.lit(1), feed)).otherwise(inner)
    return F.trim(F.regexp_replace(F.regexp_replace(snapped, r"^\s+|\s+$", ""), r"^[-*]\s*", ""))


def insert_at(text: Column, marks: Column, shares: tuple[float, ...]) -> Column:
    """The text with each mark on a line of its own at its share of the text's length, the shares ascending."""
    n = F.length(text)
    cuts = [F.floor(n * s).cast("int") for s in shares]
    parts, at = [], F.lit(0)
    for k, cut in enumerate(cuts):
        parts += [F.substr(text, at + 1, cut - at), F.lit("\n"), marks[k], F.lit("\n")]
        at = cut
    return F.concat(*parts, F.substr(text, at + 1, n - at))


def shared_scope(description: Column, start: str, end: str) -> Column:
    """Struct (before, after) of a description cut at two markers; null where one is missing."""
    a, b = F.locate(start, description), F.locate(end, description)
    ok = (a > 0) & (b > a)
    return F.when(ok, F.struct(F.trim(F.substr(description, F.lit(1), a - 1)).alias("before"), F.trim(F.substr(description, b + len(end))).alias("after")))


def grouping_problems(groups: Column, names: Column) -> Column:
    """What keeps an array of arrays from being a partition of the names."""
    flat = F.flatten(groups)
    return F.array_compact(
        F.array(
            F.when(F.exists(groups, lambda g: F.size(g) == 0), "empty group"), F.when(F.size(F.array_except(flat, names)) > 0, "unknown name"),
            F.when(F.size(F.array_distinct(flat)) < F.size(flat), "duplicate name"), F.when(F.size(F.array_except(names, flat)) > 0, "missing name"),
        )
    )


def tokens_held(tokens: Column, text: Column) -> Column:
    """The tokens that a text holds: padding must hold none of those that decide."""
    return F.array_sort(F.filter(tokens, lambda k: F.contains(text, k)))
