"""What the training-data operators share: table access and scratch tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table  # noqa: F401

#: The white space of the contracts: a space and the control characters from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, on one machine alone: a cluster has to name its shared folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="verdictmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut the lineage and survive the loss of any executor.

    ``keep`` writes and rereads; ``drop`` removes what later steps no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._where: dict[int, str] = {}
        self._count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._where[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := self._where.pop(id(df), None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def md5_part(text: Column, first: int, digits: int) -> Column:
    """A number of ``digits`` (at most 15) hexadecimal digits of an MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


#: Ids that are broadcast at most: 8 bytes each. More are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def fresh(*names: str) -> list[str]:
    """Column names that no table has: rows pass joins with whatever columns they have."""
    return [f"_{n}_{uuid.uuid4().hex}" for n in names]


def only(docs: DataFrame, wanted: DataFrame, id_col: str, scratch: Scratch) -> DataFrame:
    """The documents whose id is among those of ``wanted`` (its one column); a few are broadcast, so that texts stay where they are."""
    [other] = fresh("id")
    table = scratch.keep(wanted.toDF(other).distinct())
    return docs.join(_few(table), F.col(id_col) == F.col(other), "left_semi")


def row_hash(*columns: str) -> Column:
    """Beside its id, what tells a row apart from others of the same id, or without one."""
    return F.xxhash64(*columns)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, hash_: Column, scratch: Scratch) -> DataFrame:
    """The documents without those of ``gone`` (id, hash): other texts of the same id stay, and null ids are equal to each other."""
    other, code = fresh("id", "hash")
    table = scratch.keep(gone.toDF(other, code).distinct())
    return docs.join(_few(table), F.col(id_col).cast("long").eqNullSafe(F.col(other)) & (hash_ == F.col(code)), "left_anti")


def slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The rows of a task in small frames: what is made of a frame is passed on before the next, so batches of long texts need little memory."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows].reset_index(drop=True)
