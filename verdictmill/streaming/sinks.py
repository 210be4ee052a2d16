"""Sinks and state for runs that are broken off and taken up again: appends that happen once, and stamps that a run has to keep."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import require
from ..sources.scratch import shared_path


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were committed; what a broken-off attempt left is not among them."""
    at, fs = _files(spark, path)
    if not fs.exists(at) or not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def append_once(rows: DataFrame, path: str, keys: list[str], batch: str) -> bool:
    """Appends the rows whose ``keys`` the table at ``path`` does not have, as one transaction; false if the batch was committed before.

    A batch is written aside and then renamed to its place, which either happens or does not: an attempt that is killed leaves nothing that
    is read, and a batch that is repeated finds its place taken. Of rows that repeat a key in a batch one is written. One writer at a time.
    """
    spark = rows.sparkSession
    place, fs = _files(spark, f"{path}/batch={batch}")
    if fs.exists(place):
        return False
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    new = rows.dropDuplicates(keys).join(read_appended(spark, path, schema).select(*keys), keys, "left_anti").select(*rows.columns)
    aside = f"{path}/_aside/{uuid.uuid4().hex}"
    new.write.parquet(aside)
    return _commit(spark, aside, f"{path}/batch={batch}")


def _commit(spark: SparkSession, aside: str, place: str) -> bool:
    (source, fs), (target, _) = _files(spark, aside), _files(spark, place)
    return bool(fs.rename(source, target))


def append_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Runs a stream of records into the table over all that is there; the trigger's number is the batch, so one that is repeated after a failure is one."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: append_once(rows, path, keys, str(n)) and None).start().awaitTermination()


STATE = "stamp string, first string"


def stamp_stream(stream: DataFrame, run: str, order: str, stamps: list[str]) -> DataFrame:
    """(run, stamp, begun, rows): per run and trigger the stamps that came, beside the one that the run began with, which is kept as state.

    A stamp is the digest of the ``stamps`` (versions, fingerprints) of a row; that of the least ``order`` in a run's first trigger is the one it began with.
    """
    told = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stamps]), 256)
    slim = stream.select(F.col(run).cast("string").alias("run"), F.format_string("%020d", F.col(order).cast("long")).alias("order"), told.alias("stamp"))

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        first = None
        for pdf in parts:
            for stamp, n in pdf["stamp"].value_counts().items():
                counts[stamp] = counts.get(stamp, 0) + int(n)
            least = min(zip(pdf["order"], pdf["stamp"], strict=True))
            first = min(first, least) if first else least
        if not state.exists and first:
            state.update((first[1], first[0]))
        begun = state.get[0] if state.exists else first[1]
        yield pd.DataFrame({"run": [key[0]] * len(counts), "stamp": list(counts), "begun": begun, "rows": list(counts.values())})

    return slim.groupBy("run").applyInPandasWithState(keep, "run string, stamp string, begun string, rows long", STATE, "append", "NoTimeout")


def resume(stream: DataFrame, run: str, order: str, stamps: list[str], checkpoint: str | None = None) -> DataFrame:
    """(run, begun, rows, refused) over all that is there, and all that earlier calls with the same ``checkpoint`` saw: a run that goes on under another stamp is refused."""
    spark = stream.sparkSession
    root = checkpoint or shared_path(spark, "stamps")

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    stamp_stream(stream, run, order, stamps).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(write).start().awaitTermination()
    seen = spark.read.schema("run string, stamp string, begun string, rows long").parquet(f"{root}/out/*")
    return seen.groupBy("run").agg(F.first("begun").alias("begun"), F.sum("rows").alias("rows"), F.bool_or(F.col("stamp") != F.col("begun")).alias("refused"))


def require_resumable(runs: DataFrame) -> DataFrame:
    return require(runs, run_resumed_under_another_stamp=F.col("refused"))
