"""Exact deduplication through a minimal perfect hash over the historical distinct digests.

The corpus comes in two batches: *history* and *new*. History's distinct digests are dealt to shards by their
first bits; each shard gets a minimal perfect hash whose slots hold the full 32-byte digest, the locator of
the winner (the smallest id with that text, and the hash of its row) and a count. A new digest looks its slot up and compares all bytes: equal, it
is a repeat of history, whose winner is the slot's and whose rows are added to the slot's count; otherwise it is no member and stands by itself.

Both sides are reduced to one row per digest before they meet, so a text that holds a third of all rows
costs one slot and one lookup. Shards have about ``shard_keys`` keys at any size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, fresh, row_hash, without_rows

#: Average keys of a shard.
SHARD_KEYS = 1024
#: Bits a key gets at each level of the hash.
GAMMA = 2.0


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256)


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _words(digests: pd.Series) -> np.ndarray:
    """Hex digests as rows of four 64-bit words."""
    return np.frombuffer(bytes.fromhex("".join(digests)), dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = (words[:, 1] + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= (x >> np.uint64(29)) ^ words[:, 2]
    x *= np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


def build_levels(words: np.ndarray) -> list[np.ndarray]:
    """Bit arrays: a key's level is the first whose bit only that key takes; distinct keys end apart."""
    levels: list[np.ndarray] = []
    left = np.arange(len(words))
    while len(left):
        bits = max(8, math.ceil(GAMMA * len(left)))
        at = _place(words[left], len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slot_of(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key, -1 if no level has its bit. A nonmember may get a slot: compare its bytes."""
    out = np.full(len(words), -1, dtype=np.int64)
    before, left = 0, np.arange(len(words))
    for k, bits in enumerate(levels):
        at = _place(words[left], k, len(bits))
        hit = bits[at]
        out[left[hit]] = before + np.cumsum(bits)[at[hit]] - 1
        before, left = before + int(bits.sum()), left[~hit]
    return out


INDEX = "shard int, level_bits array<int>, levels binary, slots binary, winners binary, hashes binary, counts binary"
NO_ID = 2**63 - 1


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """One row per shard from (digest, keep_id, keep_hash, n): the levels, and by slot the full digest, the winner's locator and the count."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _words(pdf["digest"])
        levels = build_levels(words)
        order = np.argsort(slot_of(words, levels))
        by_slot = lambda c: [pdf[c].to_numpy(np.int64)[order].tobytes()]
        return pd.DataFrame(
            {
                "shard": [int(pdf["shard"].iloc[0])],
                "level_bits": [[len(x) for x in levels]],
                "levels": [b"".join(np.packbits(x).tobytes() for x in levels)],
                "slots": [words[order].tobytes()],
                "winners": by_slot("keep_id"),
                "hashes": by_slot("keep_hash"),
                "counts": by_slot("n"),
            }
        )

    return distinct.select(_shard(F.col("digest"), shards).alias("shard"), "digest", "keep_id", "keep_hash", "n").groupBy("shard").applyInPandas(build, INDEX)


def _levels(packed: bytes, sizes: list[int]) -> Iterator[np.ndarray]:
    at = 0
    for bits in sizes:
        n = (bits + 7) // 8
        yield np.unpackbits(np.frombuffer(packed, np.uint8, n, at), count=bits).astype(bool)
        at += n


def members(words: np.ndarray, shard: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each key in a shard, and whether the slot holds all its bytes."""
    at = slot_of(words, list(_levels(shard["levels"], list(shard["level_bits"]))))
    slots = np.frombuffer(shard["slots"], dtype="<u8").reshape(-1, 4)
    return at, (at >= 0) & (slots[np.maximum(at, 0)] == words).all(axis=1)


VERDICTS = "digest string, keep_id long, keep_hash long, n long, known boolean"


def settle(distinct: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, keep_hash, n, known) of history's digests, from their slots with the repeats among the new ones counted, and of the new digests that are no members."""

    def probe(keys: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        parts, fresh = [], keys
        if len(shard):
            row = shard.iloc[0]
            numbers = {c: np.frombuffer(row[of], dtype=np.int64) for c, of in (("keep_id", "winners"), ("keep_hash", "hashes"), ("n", "counts"))}
            if len(keys):
                at, member = members(_words(keys["digest"]), row)
                numbers["n"] = numbers["n"] + np.bincount(at[member], keys["n"].to_numpy()[member], len(numbers["n"])).astype(np.int64)
                fresh = keys[~member]
            names = [row["slots"][k : k + 32].hex() for k in range(0, len(row["slots"]), 32)]
            parts.append(pd.DataFrame({"digest": names, **numbers, "known": True}))
        parts.append(fresh[["digest", "keep_id", "keep_hash", "n"]].assign(known=False))
        return pd.concat(parts) if len(parts) > 1 and len(parts[1]) else parts[0]

    keyed = distinct.select(_shard(F.col("digest"), shards).alias("shard"), "digest", "keep_id", "keep_hash", "n")
    return keyed.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(probe, VERDICTS)


def _verdicts(docs: DataFrame, id_col: str, text_col: str, shard_keys: int, scratch: Scratch) -> DataFrame:
    """(id, hash, digest, keep_id, keep_hash, n, known) of each row; NO_ID stands for a null keep_id."""
    rows = scratch.keep(docs.select(F.col(id_col).cast("long").alias("id"), row_hash(text_col).alias("hash"), text_digest(F.col(text_col)).alias("digest")))
    low, high, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
    middle = low + (high - low) // 2 if low is not None else 0
    number = F.coalesce(F.col("id"), F.lit(NO_ID))
    once = rows.groupBy("digest", (number <= middle).alias("old")).agg(F.min(F.struct(number.alias("id"), "hash")).alias("keep"), F.count("*").alias("n"))
    once = scratch.keep(once.select("digest", "old", F.col("keep.id").alias("keep_id"), F.col("keep.hash").alias("keep_hash"), "n"))
    shards = max(1, math.ceil(n / 2 / shard_keys))
    index = scratch.keep(build_index(once.filter("old"), shards))
    verdicts = scratch.keep(settle(once.filter("not old"), index, shards))
    return rows.join(verdicts, "digest")  # both sides as tables: the join may split a digest with very many rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, known (its text is in history).

    History is the half of the id range with the smaller ids, so its winners are the overall winners. A null
    or empty text is the empty text. Rows that repeat an id are one document and share its verdict. A row
    whose id is null never wins over one with an id; texts that only such rows have keep them. An empty table
    gives an empty result; further columns are not read.
    """
    out = _verdicts(docs, id_col, text_col, shard_keys, Scratch(docs.sparkSession, "exact-dedup"))
    keep = F.when(F.col("keep_id") < NO_ID, F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"), "known"
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row of each text, with all its columns: that of the smallest id, a null id last.

    Rows that repeat an id with different texts are told apart; of rows that repeat id and text, one stays. Null and empty texts
    are equal. An empty table gives an empty one; further columns pass unread.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    found = _verdicts(docs, id_col, text_col, shard_keys, scratch)
    stays = (F.coalesce(F.col("id"), F.lit(NO_ID)) == F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))
    judged = scratch.keep(found.select("id", "hash", "n", stays.alias("stays")))
    left = without_rows(docs, judged.filter("not stays").select("id", "hash"), id_col, row_hash(text_col), scratch)
    twice = scratch.keep(judged.filter("stays and n > 1").groupBy("id", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("id", "hash"))
    if not twice.limit(1).count():
        return left
    other, code = fresh("id", "hash")
    several = left.join(twice.toDF(other, code), F.col(id_col).cast("long").eqNullSafe(F.col(other)) & (row_hash(text_col) == F.col(code)), "left_semi")
    one = several.groupBy(F.col(id_col).alias("_id"), row_hash(text_col).alias("_hash")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return without_rows(left, twice, id_col, row_hash(text_col), scratch).unionByName(one.select("_row.*"))
