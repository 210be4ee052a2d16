"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Candidates are sorted along a Hilbert curve and written as Parquet blocks, each with its ids, labels, vectors and a zone map: the least and
greatest value of every dimension. Interval arithmetic on a zone map bounds the inner products that an anchor can have with any row of the block; a
block is read for an anchor only if those bounds meet one of the anchor's score windows.

Windows are searched twice. First in the few block groups of highest bounds, which gives each window a k-th best score; then, with that
as the window's lower end, in whatever groups and blocks the bounds still let through. Positives are the first rows in the window of
all scores among rows of the anchor's label; each positive then opens a window for negatives of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import finite, matrix, per_dimension

BLOCK, ANCHOR_BLOCK = 1024, 256
#: Groups of neighbouring blocks, and parts of the sort, at most: every task that asks gets a zone map of each group.
GROUPS, PARTS = 1024, 1024
#: Groups that are searched first for each window.
TRIED = 4
#: Dimensions of the curve (those that vary most), and bits of each.
CURVE, BITS = 64, 4
#: Components of this size or more take no part: with them, scores of 128 dimensions could leave the range of a long.
LIMIT = 2.0**20
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
ASKED = "id long, key long, label long, x array<int>, tags array<int>, lows array<long>, highs array<long>"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of grid cells (rows x dimensions, each below 2**bits) on the Hilbert curve, as bytes that sort alike."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:  # from the coarsest cube down: reflect or turn what lies within
        for i in range(len(x)):
            inside = (x[i] & q) > 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inside, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turned ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turned
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bit planes, coarsest first
    return [r.tobytes() for r in np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)]


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product of each anchor with any vector inside each box."""
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they hold every sum, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def candidate_blocks(rows: DataFrame, scratch: Scratch, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """(group, ids, labels, rows, low, high): blocks of neighbours on the curve; equal vectors are kept apart by id, so a hot one fills many blocks."""
    stats, n = per_dimension(rows), rows.count()
    spread = (stats["q"].astype(float) - stats["s"].astype(float) ** 2 / stats["n"]).to_numpy()
    dims = np.argsort(-spread, kind="stable")[:CURVE]
    low, width = stats["lo"].to_numpy(np.int64)[dims], (stats["hi"] - stats["lo"]).to_numpy(np.int64)[dims] + 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(curve=hilbert_keys(((matrix(pdf["x"])[:, dims] - low) << BITS) // width, BITS))

    per = max(1, math.ceil(n / block / groups))  # blocks of a group

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, no, waiting = TaskContext.get().partitionId(), 0, []

        def full(pdf: pd.DataFrame) -> pd.DataFrame:
            x = matrix(pdf["x"], np.int32)
            zone = [x.min(0).astype(np.int64).tobytes()], [x.max(0).astype(np.int64).tobytes()]
            return pd.DataFrame({"group": [part * 2**32 + no // per], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "rows": [x.tobytes()], "low": zone[0], "high": zone[1]})

        for pdf in batches:
            waiting = pd.concat([*waiting, pdf]) if len(waiting) else pdf
            while len(waiting) >= block:
                yield full(waiting.iloc[:block])
                waiting, no = waiting.iloc[block:], no + 1
        if len(waiting):
            yield full(waiting)

    placed = scratch.keep(rows.mapInPandas(place, "id long, label long, x array<int>, curve binary"))
    parts = min(PARTS, max(1, math.ceil(n / block / 4)))
    ordered = placed.repartitionByRange(parts, "curve", "id").sortWithinPartitions("curve", "id").drop("curve")
    return scratch.keep(ordered.mapInPandas(pack, "group long, ids binary, labels binary, rows binary, low binary, high binary"))


class Blocks:
    """The candidate blocks, and the zone maps of their groups: at most ``GROUPS`` and ``PARTS`` of them together."""

    def __init__(self, table: DataFrame, dim: int):
        def hull(pdf: pd.DataFrame) -> pd.DataFrame:
            box = lambda c: np.stack([np.frombuffer(x, np.int64) for x in pdf[c]])
            return pd.DataFrame({"group": pdf["group"].iloc[:1], "low": [box("low").min(0).tobytes()], "high": [box("high").max(0).tobytes()]})

        zones = table.select("group", "low", "high").groupBy("group").applyInPandas(hull, "group long, low binary, high binary").orderBy("group").toPandas()
        box = lambda c: np.stack([np.frombuffer(x, np.int64) for x in zones[c]]).astype(np.float64)
        self.table, self.dim, self.group, self.low, self.high = table, dim, zones["group"].to_numpy(np.int64), box("low"), box("high")


def search(asked: DataFrame, blocks: Blocks, k: int, same: bool, tried: int | None = None) -> DataFrame:
    """(id, key, tag, rank, found, score): the first ``k`` rows in each window of each anchor, of its own label or of any other.

    ``tried``: look only into that many groups of highest bounds for each anchor.
    """
    group, low, high, dim = blocks.group, blocks.low, blocks.high, blocks.dim

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ANCHOR_BLOCK):
                part = pdf.iloc[at : at + ANCHOR_BLOCK]
                x, keys = matrix(part["x"], np.int32), part[["id", "key", "label"]].to_numpy(np.int64)
                least, most = score_bounds(x, low, high)
                of = np.repeat(np.arange(len(part)), part["tags"].map(len))
                tags, lows, highs = (np.concatenate([np.asarray(v, np.int64) for v in part[c]]) for c in ("tags", "lows", "highs"))
                meets = (most[of] >= lows[:, None]) & (least[of] <= highs[:, None])  # windows x groups
                wanted = np.zeros(most.shape, bool)
                np.logical_or.at(wanted, of, meets)
                if tried and tried < len(group):
                    best = np.where(wanted, most, -np.inf)
                    wanted &= best >= np.partition(best, -tried, axis=1)[:, [-tried]]
                for g in np.flatnonzero(wanted.any(0)):
                    who = np.flatnonzero(wanted[:, g])
                    mine = wanted[of, g]
                    yield pd.DataFrame(
                        {"group": [group[g]], "keys": [keys[who].tobytes()], "vectors": [x[who].tobytes()], "of": [np.searchsorted(who, of[mine]).tobytes()], "windows": [np.stack([tags, lows, highs], 1)[mine].tobytes()]}
                    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if (out := _first_in_block(row, dim, k, same)) is not None:
                    yield out

    met = asked.mapInPandas(ask, "group long, keys binary, vectors binary, of binary, windows binary").join(blocks.table, "group")
    found = met.mapInPandas(score, "id long, key long, tag int, found long, score long")
    rank = F.row_number().over(W.partitionBy("id", "key", "tag").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _first_in_block(row: tuple, dim: int, k: int, same: bool) -> pd.DataFrame | None:
    """The first ``k`` rows of one block in each of a batch of windows that the block's own zone map lets through."""
    keys = np.frombuffer(row.keys, np.int64).reshape(-1, 3)
    vectors = np.frombuffer(row.vectors, np.int32).reshape(-1, dim)
    of, windows = np.frombuffer(row.of, np.int64), np.frombuffer(row.windows, np.int64).reshape(-1, 3)
    least, most = score_bounds(vectors, np.frombuffer(row.low, np.int64).astype(np.float64)[None], np.frombuffer(row.high, np.int64).astype(np.float64)[None])
    open_ = np.flatnonzero((most[of, 0] >= windows[:, 1]) & (least[of, 0] <= windows[:, 2]))
    if not len(open_):
        return None
    ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
    who, at = np.unique(of[open_], return_inverse=True)
    scores = products(vectors[who], np.frombuffer(row.rows, np.int32).reshape(-1, dim))
    picked, chosen = [], []
    for i, anchor in enumerate(who):
        own, _, label = keys[anchor]
        fits = np.flatnonzero(((labels == label) == same) & (ids != own))
        s = scores[i, fits]
        order = np.lexsort((ids[fits], -s))
        falling = -s[order]
        for w in open_[at == i]:
            first, end = np.searchsorted(falling, -windows[w, 2]), np.searchsorted(falling, -windows[w, 1], side="right")
            take = order[first : min(end, first + k)]
            picked += [w] * len(take)
            chosen.append((fits[take], s[take]))
    if not picked:
        return None
    places, got = (np.concatenate(c) for c in zip(*chosen, strict=True))
    return pd.DataFrame({"id": keys[of[picked], 0], "key": keys[of[picked], 1], "tag": windows[picked, 0].astype(np.int32), "found": ids[places], "score": got})


def first_in_windows(asked: DataFrame, blocks: Blocks, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """``search`` in a few groups, then in all with each window's lower end raised to its k-th best score so far."""
    asked = scratch.keep(asked)
    floor = search(asked, blocks, k, same, TRIED).filter(F.col("rank") == k).groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("floors"))
    raised = asked.join(scratch.keep(floor), ["id", "key"], "left").withColumn("lows", F.expr("transform(lows, (low, i) -> greatest(low, floors[tags[i]]))"))
    return scratch.keep(search(raised.drop("floors"), blocks, k, same))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``. An anchor's positives are its first other rows of the same label by inner product of
    x = floor(256 c), ties by smaller id; each gives its first negatives: rows of another label whose score is at most the positive's and at least ``share``
    of it. ``label``: an SQL expression of the row.

    Rows with a null id, label, vector or component, or a non-finite component, take no part, nor those that ``vectors.finite`` tells. Rows that
    repeat id, label and vector are one; an anchor's own id is never its candidate; rows of one id with different vectors
    are anchors of their own. A positive below 0 has no negatives (the window is empty), nor has one whose window holds none. An empty table gives an
    empty result; further columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    good = finite(vectors, vector_col, LIMIT, id=f"cast(`{id_col}` as long)", label=f"cast({label} as long)")
    rows = scratch.keep(good.filter("id is not null and label is not null").select("id", "label", F.col("x").cast("array<int>").alias("x")).distinct())
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    blocks = Blocks(candidate_blocks(rows, scratch), len(first["x"]))
    anchors = rows.filter(F.col("id") % every == 0).withColumn("key", F.xxhash64("label", "x"))
    shape = [F.col(c.split()[0]) for c in ASKED.split(", ")]
    everything = F.array(F.lit(0)).alias("tags"), F.array(F.lit(-(2**62))).cast("array<long>").alias("lows"), F.array(F.lit(2**62)).cast("array<long>").alias("highs")
    chosen = first_in_windows(anchors.select("*", *everything).select(shape), blocks, positives, True, scratch)
    part, whole = share
    # The least whole score with part * positive <= whole * score.
    low = F.expr(f"({part} * score + {whole - 1} - pmod({part} * score + {whole - 1}, {whole})) div {whole}")
    windows = chosen.withColumn("low", low).groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "score"))).alias("w"))
    split = F.col("w.rank").alias("tags"), F.col("w.low").alias("lows"), F.col("w.score").alias("highs")
    mined = first_in_windows(anchors.join(windows, ["id", "key"]).select("id", "key", "label", "x", *split).select(shape), blocks, negatives, False, scratch)
    kept = chosen.select("id", "key", F.col("rank").alias("tag"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(kept, ["id", "key", "tag"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
