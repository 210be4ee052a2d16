"""MinHash near-deduplication with min-max hashing, every link confirmed on the full shingle sets.

Each permutation is evaluated once and gives two signature values, its minimum and its maximum; bands are made
of either. Documents with the same shingle set become one class at once. Within a bucket, the members are
compared with the one of the smallest id (never all with all); where a bucket then still holds several components, its
members outside the largest one are compared with all members of other components. So every pair that shares a
bucket is either compared or already in one component, and a group of thousands of copies costs a star.

At 85 of 100, a pair shares none of 44 bands of 8 values with probability (1 - 0.85^8)^44, under one in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, only, row_hash, slices, without_rows
from .shingles import U, mix, shingle_sets

WORDS = 5
SIMILAR = 85  # of 100
BANDS = 44
ROWS = 8
SEED = 7
BITS = 2048

SIGNATURES = "id long, hash long, n_shingles long, k1 long, k2 long, bands array<long>"


class MinMax:
    """Banded min-max signatures: ``bands * rows / 2`` permutations, half the bands of minima, half of maxima."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.times = (rng.integers(0, 2**31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.plus = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.weights = rng.integers(0, 2**63, rows, dtype=U) * U(2) + U(1)
        self.salts = rng.integers(0, 2**63, bands, dtype=U)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minima, then the maxima, over all shingles; each permutation is evaluated once per shingle."""
        x = (shingles >> U(32)).astype(np.uint32)
        low, high = np.full(len(self.times), 2**32 - 1, np.uint32), np.zeros(len(self.times), np.uint32)
        for at in range(0, len(x), 256):
            values = x[at : at + 256, None] * self.times + self.plus
            np.minimum(low, values.min(axis=0), out=low)
            np.maximum(high, values.max(axis=0), out=high)
        return np.concatenate([low, high])

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Bucket keys, a row of ``bands`` for each signature."""
        parts = mix(signatures.reshape(len(signatures), self.bands, self.rows).astype(U))
        return mix((parts * self.weights).sum(axis=2, dtype=U) + self.salts).view(np.int64)


def signatures(docs: DataFrame, words: int, scheme: MinMax) -> DataFrame:
    """Per document (id, hash, text): the size of its shingle set, two keys of the whole set, and its bucket keys."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            n, k1, k2, sigs = [], [], [], []
            for s in shingle_sets(pdf["text"], words):
                n.append(len(s))
                k1.append(mix(s + U(1)).sum(dtype=U))
                k2.append(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                sigs.append(scheme.signature(s))
            keys = scheme.keys(np.array(sigs))
            yield pd.DataFrame({"id": pdf["id"], "hash": pdf["hash"], "n_shingles": n, "k1": np.array(k1, U).view(np.int64), "k2": np.array(k2, U).view(np.int64), "bands": [k if m else k[:0] for k, m in zip(keys, n, strict=True)]})

    return docs.mapInPandas(sign, SIGNATURES)


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit words, one set for each shingle: two maps differ in no more bits than their sets in shingles."""
    flags = np.zeros(BITS, bool)
    flags[(shingles & U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.int64)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            sets = list(shingle_sets(pdf["text"], words))
            yield pd.DataFrame({"id": pdf["id"], "shingles": [s.view(np.int64) for s in sets], "bits": [bit_map(s) for s in sets]})

    return docs.mapInPandas(fill, "id long, shingles array<long>, bits array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similar * union."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    na, nb = F.size("sa"), F.size("sb")
    both = F.size(F.array_intersect("sa", "sb"))
    near = two.filter(100 * F.least(na, nb) >= similar * F.greatest(na, nb))
    return near.withColumn("_both", both).filter(100 * F.col("_both") >= similar * (na + nb - F.col("_both"))).select("a", "b").distinct()


def hopeful(members: DataFrame, sets: DataFrame, similar: int, scratch: Scratch) -> DataFrame:
    """The members (key, id, component) that can be near one of their bucket, with n, others and bits.

    ``others`` is how many of the n shingles some other member (of any bucket) has too; a link can share no more. So
    a copy with edits of its own falls out by itself, without a comparison with each of its thousands of siblings.
    """
    ids = members.select("id").distinct()
    own = sets.join(ids, "id", "left_semi")
    once = own.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
    alone = once.groupBy("id").agg(F.count("*").alias("alone"))
    counts = own.select("id", F.size("shingles").alias("n"), "bits").distinct().join(alone, "id", "left").select("id", "n", "bits", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("others"))
    counted = scratch.keep(members.join(counts, "id"))
    least = counted.groupBy("key").agg(F.min("n").alias("least"))
    near = F.greatest(F.col("least"), F.col("others"))  # the union of a link has n and what the other adds
    return counted.join(scratch.keep(least), "key").filter(100 * F.col("others") >= similar * (F.col("n") + near - F.col("others"))).drop("least")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that links reach, by neighbours' labels and pointer jumping."""
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = scratch.keep(lower.join(to, "label").select("id", "old", F.least("label", "further").alias("label")))
        moved = new.filter("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            scratch.drop(both)
            return labels.select("id", F.col("label").alias("component"))


def further_texts(signed: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, hash, node) of the texts of an id after its first (by hash): they are documents of their own, and get numbers above all ids. None if no id has several."""
    ids = signed.filter("id is not null")
    twice = scratch.keep(ids.groupBy("id").agg(F.min("hash").alias("first"), F.max("hash").alias("_last")).filter("first < _last").drop("_last"))
    if not twice.limit(1).count():
        return None
    parts = 1024
    own = ids.join(twice, "id").filter("hash <> first").select("id", "hash").distinct().withColumn("_part", F.pmod("hash", F.lit(parts)))
    number = F.row_number().over(W.partitionBy("_part").orderBy("id", "hash"))
    return scratch.keep(own.select("id", "hash", (F.lit(ids.agg(F.max("id")).first()[0]) + (number - 1) * parts + F.col("_part") + 1).alias("node")))


def _numbered(df: DataFrame, more: DataFrame | None) -> DataFrame:
    """``df`` with the number of its document in ``node``."""
    return df.withColumn("node", F.col("id")) if more is None else df.join(more, ["id", "hash"], "left").withColumn("node", F.coalesce("node", "id"))


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, similar: int, scheme: MinMax, scratch: Scratch) -> DataFrame:
    """(id, hash, n_shingles, component_id, kept) of each row."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(text_col).alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by_id = scratch.keep(signatures(base, words, scheme))
    further = further_texts(by_id, scratch)
    rows = _numbered(by_id.drop("bands"), further)
    signed = _numbered(by_id, further).drop("id").withColumnRenamed("node", "id")
    base = _numbered(base, further).select(F.col("node").alias("id"), "text")
    named = signed.filter("n_shingles > 0 and id is not null")
    classes = scratch.keep(named.groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep")))
    heads = named.join(classes.select(F.col("rep").alias("id"), "k1", "k2", "n_shingles"), ["id", "k1", "k2", "n_shingles"], "left_semi")
    dealt = scratch.keep(heads.select("id", F.explode("bands").alias("key")))
    stars = dealt.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).filter("pivot < _last").drop("_last")
    shared = scratch.keep(dealt.join(stars, "key"))
    scratch.drop(dealt)
    pairs = scratch.keep(shared.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    sets = scratch.keep(full_sets(only(base, shared.select("id"), "id", scratch), words))
    links = scratch.keep(confirm(pairs, sets, similar))
    found = components(links, scratch)

    labelled = shared.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high").select("key")
    mixed = scratch.keep(mixed)  # as tables, here and below: the joins may then split a bucket with very many members
    open_ = scratch.keep(labelled.join(mixed, "key", "left_semi"))
    scratch.drop(shared)
    open_ = scratch.keep(hopeful(open_, sets, similar, scratch))
    largest = open_.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
    outside = open_.join(scratch.keep(largest), "key").filter("component <> main").select("key", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("others").alias("ox"), F.col("bits").alias("bx"))
    most = F.least("others", "ox")  # shingles that the two can share
    differ = F.aggregate(F.zip_with("bits", "bx", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    can = (100 * most >= similar * (F.col("n") + F.col("nx") - most)) & ((100 + similar) * differ <= (100 - similar) * (F.col("n") + F.col("nx")))
    across = outside.join(open_, "key").filter((F.col("component") != F.col("cx")) & can).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
    more = scratch.keep(confirm(across.join(pairs, ["a", "b"], "left_anti"), sets, similar))
    if more.limit(1).count():
        found = components(links.unionByName(more), scratch)
    scratch.drop(sets, open_)

    rep = F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("node"))
    out = rows.join(classes, ["k1", "k2", "n_shingles"], "left").select("id", "hash", "node", "n_shingles", rep.alias("rep")).join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNotNull(), F.coalesce("component", "rep")))
    kept = F.col("node").eqNullSafe(F.col("component_id"))
    if further is not None:  # a component of further texts alone has the id of its first
        out = out.join(further.select(F.col("node").alias("component_id"), F.col("id").alias("_of")), "component_id", "left")
        return out.select("id", "hash", "n_shingles", F.coalesce("_of", "component_id").alias("component_id"), kept.alias("kept"))
    return out.select("id", "hash", "n_shingles", "component_id", kept.alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A null or empty text, or one of white space alone, has no shingles and stays alone. Repeated rows of an id and a text
    are one document; further texts of an id are documents of their own, which come after all ids where one of a group is kept. Rows without an id
    are kept, with a null component. An empty table gives an empty result; further columns are not read.
    """
    return _judged(docs, id_col, text_col, words, similar, MinMax(bands, rows, seed), Scratch(docs.sparkSession, "near-dedup")).drop("hash").withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """The documents that stay, one of each group, with all their columns; what ``near_dedup`` says of odd rows holds."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    judged = _judged(docs, id_col, text_col, words, similar, MinMax(bands, rows, seed), scratch)
    return without_rows(docs, judged.filter("not kept").select("id", "hash"), id_col, row_hash(text_col), scratch)
