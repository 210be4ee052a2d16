"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

The mix holds ``volume`` times the corpus. Sources share it by weight, none above ``most`` times its own size.
Blocks of ``block`` words go to the sources by highest quotients target / (2k + 1), then, by the same rule, to
the shards of a source. A shard's documents stand in seeded order and its words are cut into blocks; its quota
takes the first blocks, starting over when all are taken.

Only tables of sources and shards are ranked as a whole; documents are ordered within shards of about
``shard_rows``, so a source with a third of all rows is just many shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, md5_part

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 16
#: A word with the white space before it, so that a part of a text keeps its lines.
SPACED_WORD = rf"[\x20\x09-\x0D]*{WORD}"
SHARD_ROWS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(entries: DataFrame, group: list[str], order: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the entries of a group share its ``seats`` by highest quotients votes / (2k + 1).

    Up to the divisor V / (seats - n/2) every quotient wins, below V / (seats + n/2) none does; so only at most
    2n quotients of n entries are ranked, however many seats there are. Ties go to the smaller ``order``.
    """
    all_of = W.partitionBy(*group)
    sure = F.when((F.col("_votes") > 0) & (F.col(seats) > F.col("_n") / 2), F.floor(F.col(votes) * (F.col(seats) - F.col("_n") / 2) / F.col("_votes") + 0.5)).otherwise(F.lit(0)).cast("long")
    most = F.when(F.col("_votes") > 0, F.floor(F.col(votes) * (F.col(seats) + F.col("_n") / 2) / F.col("_votes") + 0.5) + 1).otherwise(F.lit(0)).cast("long")
    ready = entries.withColumns({"_votes": F.sum(votes).over(all_of).cast("double"), "_n": F.count("*").over(all_of)})
    ready = ready.withColumns({"_sure": sure, "_most": most}).withColumn("_left", F.col(seats) - F.sum("_sure").over(all_of))
    # One row for each quotient in question, and one (k null) that keeps the entry.
    asked = F.when(F.col("_most") > F.col("_sure"), F.sequence("_sure", F.col("_most") - 1)).otherwise(F.array().cast("array<bigint>"))
    ranked = ready.withColumn("_k", F.explode(F.concat(F.array(F.lit(None).cast("long")), asked))).withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), F.col(order)))
    won = ranked.withColumn("_won", (F.col("_k").isNotNull() & (place <= F.col("_left"))).cast("long"))
    plain = entries.columns
    return won.groupBy(*plain).agg((F.max("_sure") + F.sum("_won")).alias("quota"))


def source_targets(sources: DataFrame, volume: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``no`` (from 1, by code point, null last), ``weight``, ``target`` and ``blocks``'s total words.

    Targets fill up by weight: in the order of cap / weight, a source is at its cap if the words still to share
    give it more; the others share the rest by weight.
    """
    one = W.partitionBy(F.lit(0))
    no = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last()))
    out = sources.withColumn("no", no).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.col("no") - 1, F.lit(len(WEIGHTS))).cast("int") + 1))
    out = out.withColumns({"_cap": F.col("source_size") * F.lit(most), "_total": F.sum("source_size").over(one) * F.lit(volume)})
    before = one.orderBy(F.col("_cap") / F.col("weight"), "no").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("_capped", F.col("_cap") * weights <= F.col("weight") * left)
    capped = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(one), F.lit(0.0))
    free = F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(one)
    return out.withColumns({"_rest": F.col("_total") - capped, "_free": free}).withColumn(
        "target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("weight") * F.col("_rest") / F.col("_free"))
    )


def _row_key(id_col: Column, source: Column, text: Column) -> Column:
    """A 128-bit key, never null, that tells rows apart by id, source and text; rows that share it can stand for each other."""
    marked = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return F.md5(F.concat_ws("|", F.md5(marked(id_col)), F.md5(marked(source)), F.md5(text)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", volume: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: int = 42) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, passes, rest.

    A document is taken ``passes`` times as a whole and then with its first ``rest`` words. A null text has size
    0 and is never taken; null sources form one source, the last; repeated rows are documents of their own,
    ordered by id and then by source and text; an empty table gives an empty result. Further columns are not read.
    """
    return _plan(docs, id_col, text_col, source_col, volume, most, block, shard_rows, seed).drop("_key")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, volume: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: int = 42) -> DataFrame:
    """``mix`` with the key of each row beside it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    row_key = _row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("_key")
    base = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row_key))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sources, volume, most).withColumns({"_all": F.floor(F.col("_total") / block + 0.5).cast("long"), "one": F.lit(0), "shards": F.ceil(F.col("_rows") / shard_rows).cast("long")})
    slim = targets.select("one", "no", "source", "source_size", "target", "shards", "_all")
    quotas = scratch.keep(apportion(slim, ["one"], "no", "target", "_all").drop("one", "_all"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.col("_key")))
    by_source = F.broadcast(quotas) if quotas.count() <= 10_000 else quotas  # a row each, well under 1 MB
    placed = base.alias("b").join(by_source.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source"))).select("b.*", "q.no", F.pmod(md5_part(key, 1, 8), F.col("q.shards")).alias("shard"), F.substring(F.md5(key), 9, 24).alias("_order"))
    placed = scratch.keep(placed)
    shards = placed.groupBy("no", "shard").agg(F.sum("size").alias("words"))
    shards = apportion(shards.join(quotas.select("no", "source_size", "target", F.col("quota").alias("seats")), "no"), ["no"], "shard", "words", "seats")
    before = F.coalesce(F.sum("size").over(W.partitionBy("no", "shard").orderBy("_order", "id", "_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = placed.withColumn("_before", before).join(shards.select("no", "shard", "words", "source_size", "target", (F.col("quota") * block).alias("_take")), ["no", "shard"])
    passes = F.when(F.col("words") > 0, F.floor(F.col("_take") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("passes", F.least(passes, F.lit(int(most))))
    rest = F.when(F.col("passes") >= int(most), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("_take") - F.col("passes") * F.col("words") - F.col("_before")))).cast("long")
    out = out.withColumn("rest", rest)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("rest")).alias("taken"), "passes", "rest", "_key")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents, the columns of ``docs``: a row per copy, so a text that ``mix`` takes twice has two rows, and one that it takes in part a row of its first words.

    Rows that repeat an id are documents of their own, with a null id too: each gives the copies of its own text; those that repeat id, source and text
    share what the mix takes of them. A null or empty text has no words and goes. Where ``docs`` has ``n_chars``, it is that of the copy; other
    columns pass unread, whatever their names. An empty table gives an empty one.
    """
    plan = _plan(docs, id_col, text_col, source_col, **how).filter("taken > 0")
    key, passes, rests, size, rest, copy = fresh("key", "passes", "rests", "size", "rest", "copy")
    # Rows of one key stand next to each other in one shard: all are taken equally often as a whole, and the rest fills them in turn.
    plan = plan.groupBy(F.col("_key").alias(key)).agg(F.max("passes").alias(passes), F.sum("rest").alias(rests), F.max("size").alias(size))
    text = F.col(text_col)
    joined = docs.withColumn(key, _row_key(F.col(id_col), F.col(source_col), text)).join(plan, key)
    before = F.row_number().over(W.partitionBy(key).orderBy(F.lit(0))) - 1
    filled = joined.withColumn(rest, F.greatest(F.lit(0), F.least(F.col(size), F.col(rests) - before * F.col(size))))
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED_WORD), 0), 1, F.col(rest).cast("int")), "")
    part = F.when(F.col(rest) == F.col(size), text).when(F.col(rest) > 0, words)
    copies = F.concat(F.array_repeat(text, F.col(passes).cast("int")), F.array_compact(F.array(part)))
    taken = filled.withColumn(copy, F.explode(copies)).withColumn(text_col, F.col(copy))
    if "n_chars" in docs.columns:
        taken = taken.withColumn("n_chars", F.length(text_col).cast("long"))
    return taken.select(*docs.columns)
