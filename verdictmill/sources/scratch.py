"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder, on one machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    where = where or tempfile.mkdtemp(prefix="verdictmill-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Written:
    """A table that grows by parts under one path: it cuts the lineage, and reading it is one scan however many parts it has."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, shared_path(spark, name), None

    def add(self, rows: DataFrame) -> int:
        """Appends rows and returns how many they were."""
        part = f"{self.path}/part={uuid.uuid4().hex[:12]}"
        rows.write.parquet(part)
        self.schema = self.schema or rows.schema
        self.last = self.spark.read.schema(rows.schema).parquet(part)
        return self.last.count()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")


def written(rows: DataFrame, name: str = "kept") -> DataFrame:
    """The rows, computed once, written and read again: for what several parts of a plan use."""
    table = Written(rows.sparkSession, name)
    table.schema = rows.schema
    rows.write.parquet(f"{table.path}/part=0")
    return table.read()
