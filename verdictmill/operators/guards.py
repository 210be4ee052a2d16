"""Refusals: conditions under which a result would be wrong. They are counted before a result is given.

``issues`` functions return rows (key, message) and stay lazy; ``require`` evaluates one small aggregate and raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """The input does not allow the result that was asked for."""


def require(df: DataFrame, **conditions: Column) -> DataFrame:
    """Raises if any row meets a condition, given by its message's name; all are counted in one pass."""
    row = df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()]).first()
    broken = {name: row[name] for name in conditions if row[name]}
    if broken:
        raise Refused(", ".join(f"{name.replace('_', ' ')}: {n} rows" for name, n in broken.items()))
    return df


def one_value_per(df: DataFrame, key: str, value: str) -> DataFrame:
    """Raises if a key has several values (a null beside a value counts)."""
    several = df.groupBy(key).agg(F.count_distinct(value).alias("n"), F.max(F.col(value).isNull()).alias("gap")).filter("n > 1 or (n = 1 and gap)")
    return require(several, **{f"{key}_with_several_{value}": F.lit(True)}) and df


def _distinct_with_null(column: Column) -> list[Column]:
    return [F.array_sort(F.collect_set(column)), F.coalesce(F.bool_or(column.isNull()), F.lit(False))]


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: for each guard the reason against comparing two arms, null if there is none.

    Versions default to 1 and must be one; venues (``in_situ``, default false) must be one; models and skill versions
    must be one or all unknown, and unknown beside a name is refused.
    """
    both = a.select("set_version", "in_situ", "model", "skill_version").unionByName(b.select("set_version", "in_situ", "model", "skill_version"))
    named = lambda c: _distinct_with_null(F.col(c).cast("string"))
    (models, no_model), (skills, no_skill) = named("model"), named("skill_version")
    facts = both.agg(
        F.array_sort(F.collect_set(F.coalesce("set_version", F.lit(1)))).alias("versions"),
        F.array_sort(F.collect_set(F.coalesce("in_situ", F.lit(False)))).alias("venues"),
        models.alias("models"), no_model.alias("no_model"), skills.alias("skills"), no_skill.alias("no_skill"),
    )
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    mixed = lambda c, gap: F.when(F.size(c) > 1, listed(F.col(c))).when((F.size(c) == 1) & F.col(gap), F.concat(listed(F.col(c)), F.lit(",unknown")))
    return facts.select(
        F.when(F.size("versions") > 1, listed(F.col("versions"))).alias("versions_differ"),
        F.when(F.size("venues") > 1, listed(F.col("venues"))).alias("venues_differ"),
        mixed("models", "no_model").alias("models_differ"),
        mixed("skills", "no_skill").alias("skills_differ"),
    )


def outside_vocabulary(df: DataFrame, key: str, **vocabularies: tuple[str, ...]) -> DataFrame:
    """Issues (key, message) for non-null values outside their vocabulary."""
    found = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), F.concat(F.lit(f"{c}: "), F.col(c))) for c, allowed in vocabularies.items()]
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*found))).alias("message"))


def union_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
