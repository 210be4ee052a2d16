"""The tables of a folder, and Python workers that can import this package from where it lies."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    known = spark.sparkContext.environment
    if HOME not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, known.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{folder}/{name}.parquet")
