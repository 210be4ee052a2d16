"""Best-fit packing of documents into sequences, with certified bin counts and repacking of the rest.

Documents are tokenized once, in tasks; what travels on are pieces of a few dozen bytes. Pieces are dealt to
partitions of about ``group_rows`` and each is packed by best-fit decreasing. A lower bound by dual feasible
functions certifies a partition whose number of bins it equals. Partitions with a gap give up the documents of
their incompletely filled bins, these documents are exchanged (dealt anew) and packed again; a round counts only if it
saves sequences. No piece is dropped and none is split further.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .tokenization import default_path, tokenizer

SEQUENCE = 2048
GROUP_ROWS = 2048
ROUNDS = 2
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``most`` ids but the first, which may be shorter."""
    first = n % most or min(n, most)
    return [(0, first), *((at, most) for at in range(first, n, most))]


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A null text is empty; an empty one is the end id alone."""
    path = path or default_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for pdf in slices(batches, 1024):
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(bpe.encode(text), np.uint32(END_ID)).astype("<u4")
                rows += [(doc_id, k, start, length, zlib.crc32(ids[start : start + length])) for k, (start, length) in enumerate(cut(len(ids), most))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(encode, PIECES)


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each length, by best-fit decreasing, and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (room, bin), ascending; only bins with room
    left: list[int] = []
    for i in order:
        n = int(lengths[i])
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            k = room.pop(at)[1]
        else:
            k = len(left)
            left.append(most)
        rest = left[k] - n
        left[k], bins[i] = rest, k
        if rest:
            bisect.insort(room, (rest, k))
    return bins, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, most: int) -> int:
    """The largest bound of three families of dual feasible functions: the plain volume, u(k) and the threshold function.

    f is dual feasible if sizes that fit one bin map to values of at most 1 in sum; so sum(f) bins are needed at least.
    """
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // most)
    for k in range(1, 21):  # u(k): x itself where (k+1)x is whole, else floor((k+1)x)/k
        whole = (k + 1) * x % most == 0
        scaled = np.where(whole, x * k, (k + 1) * x // most * most)  # k * most times the value
        best = max(best, -(-int(scaled.sum()) // (k * most)))
    sizes, counts = np.unique(x, return_counts=True)
    above, volume = np.cumsum(counts[::-1])[::-1], np.cumsum((sizes * counts)[::-1])[::-1]
    for e in sizes[sizes <= most // 2]:  # threshold e: 1 above most - e, 0 below e, x between
        big, low = np.searchsorted(sizes, most - e, side="right"), np.searchsorted(sizes, e)
        ones, total_low = (int(above[big]), int(volume[big])) if big < len(sizes) else (0, 0)
        best = max(best, ones + -(-(int(volume[low]) - total_low) // most))
    return best


PACKED = PIECES + ", bin long, offset long, room long, bins long, bound long"


def pack_groups(pieces: DataFrame, groups: int, salt: int, most: int) -> DataFrame:
    """Deals pieces to ``groups`` partitions; adds bin (unique in all), offset, room, and the partition's bins and bound."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["group"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, left = best_fit(lengths, most)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        firsts = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(firsts, ends - lengths[order], 0))
        offset = np.empty(len(pdf), np.int64)
        offset[order] = ends - lengths[order] - base
        return pdf.drop(columns="group").assign(bin=(salt << 56) + (group << 24) + bins, offset=offset, room=left[bins], bins=len(left), bound=lower_bound(lengths, most))

    # By content too: rows without an id, and those that repeat one, do not all meet in one partition.
    group = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "start", "length", "ids_crc32"), F.lit(groups)).alias("group")
    return pieces.select(group, "doc_id", "piece", "start", "length", "ids_crc32").groupBy("group").applyInPandas(pack, PACKED)


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    ``certified`` says that the partition that packed the piece last uses as few bins as any packing of it can.
    Repeated rows are documents of their own; a null id stays null; an empty table gives an empty result; further
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(tokenized_pieces(docs, id_col, text_col, most, path))
    deal = lambda n: max(1, math.ceil(n / group_rows))
    done = scratch.keep(pack_groups(pieces, deal(pieces.count()), 0, most))
    scratch.drop(pieces)
    settled: list[DataFrame] = []
    for salt in range(1, rounds + 1):
        loose = done.filter((F.col("bins") > F.col("bound")) & (F.col("room") > 0))
        n, used = loose.agg(F.count("*"), F.count_distinct("bin")).first()
        if not n:
            break
        again = scratch.keep(pack_groups(loose, deal(n), salt, most))
        if again.agg(F.count_distinct("bin")).first()[0] >= used:
            break
        settled.append(done.filter(~((F.col("bins") > F.col("bound")) & (F.col("room") > 0))))
        done = again
    for part in settled:
        done = done.unionByName(part)
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified"))
