"""Routes of an answer key against what a router offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_findings(cases: DataFrame, offered: DataFrame) -> DataFrame:
    """(key, message): routes of cases (id, routes) that the router (name) does not offer. Without a router there is nothing to check against."""
    routes = cases.select(F.col("id").cast("string").alias("key"), F.explode("routes").alias("name"))
    names = offered.select("name").distinct()
    some = names.agg((F.count("*") > 0).alias("_some"))
    lost = routes.join(names, "name", "left_anti").join(F.broadcast(some)).filter("_some")
    return lost.select("key", F.concat(F.lit("no such procedure: "), F.col("name")).alias("message"))


def unreachable_procedures(cases: DataFrame, offered: DataFrame) -> DataFrame:
    """(name): procedures on offer that are the right answer of no positive case, so that they can only ever count as wrong."""
    labelled = cases.filter("should_fire").select(F.explode("routes").alias("name"))
    return offered.select("name").distinct().join(labelled.distinct(), "name", "left_anti")


def by_name(offered: Column, procedures: Column) -> Column:
    """Whether exact names can be told right: all that is offered are procedures."""
    return F.size(F.array_except(offered, procedures)) == 0


def description_variant(description: Column, variant: Column, opener_end: str, exclusions_start: str, authored: dict[str, str]) -> Column:
    """A description without its named parts: full, no-exclusions, opener-only, no-opener, or with an authored opener. Null where a marker is missing; an unknown variant is refused.

    The opener ends with ``opener_end``, the exclusions begin with ``exclusions_start``.
    """
    flat = F.trim(F.regexp_replace(description, r"\s+", " "))
    a, b = F.locate(opener_end, flat), F.locate(exclusions_start, flat)
    opener = F.substr(flat, F.lit(1), a + len(opener_end) - 1)
    middle, exclusions = F.trim(F.substr(flat, a + len(opener_end), b - a - len(opener_end))), F.substr(flat, b)
    told = F.when(variant == "no-exclusions", F.concat_ws(" ", opener, middle)).when(variant == "opener-only", opener).when(variant == "no-opener", F.concat_ws(" ", middle, exclusions))
    for name, text in authored.items():
        told = told.when(variant == name, F.concat_ws(" ", F.lit(text), middle, exclusions))
    known = variant.isin("no-exclusions", "opener-only", "no-opener", *authored)
    refused = F.raise_error(F.concat(F.lit("unknown variant "), variant))
    return F.when(variant == "full", flat).when(~known, refused.cast("string")).when((a > 0) & (b > a), F.trim(told))


def grouped_entries(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(group, name, product): groups (group, names array) of the router's entries (name, product) as one entry each, in the order of the group.

    An empty group, an unknown, repeated or missing name is refused.
    """
    from .guards import require

    require(groups, empty_group=F.size("names") == 0)
    members = groups.select("group", F.posexplode("names").alias("at", "member"))
    require(members.groupBy("member").agg(F.count("*").alias("n")), repeated_name=F.col("n") > 1)
    both = members.join(entries.select(F.col("name").alias("member"), "product", F.lit(True).alias("_known")), "member", "full_outer")
    require(both, unknown_name=F.col("_known").isNull(), missing_name=F.col("group").isNull())
    row = F.array_sort(F.collect_list(F.struct("at", "member", "product")))
    return both.groupBy("group").agg(row.alias("m")).select("group", F.array_join(F.transform("m", lambda s: s["member"]), "-").alias("name"), F.array_join(F.transform("m", lambda s: s["product"]), "; ").alias("product"))
