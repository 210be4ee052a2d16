"""Append-only logs as streams: last write wins per key, and scorecards that grow with the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.integrity import last_write_wins
from ..sources.scratch import shared_path


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregated stream over all that is there, and returns the last state of each key.

    Each trigger appends the keys it has changed with its number; so the sink is a plain table and a trigger that is
    repeated after a failure writes the same rows again under the same number.
    """
    spark = stream.sparkSession
    root = shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(write).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    return last_write_wins(spark.read.schema(schema).parquet(f"{root}/out/*"), keys, "_batch").select(*stream.columns)


def stream_last_write_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The streaming form of the batch operator: a stateful aggregate keyed by what is written again."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return run_available(last, keys).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def stream_counts(rows: DataFrame, time: str, window: str, by: str, late: str = "1 hour") -> DataFrame:
    """Counts per window and value; the watermark bounds the state."""
    counted = rows.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))
    flat = counted.select(F.col("window.start").alias("start"), by, "n")
    return run_available(flat, ["start", by])
