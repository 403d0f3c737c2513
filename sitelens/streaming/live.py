"""An extension: new images as a stream. The batch operators have no counterpart of this.

Event time is the capture time of the file name. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import names


def stream_index(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of an image index as they arrive, with capture time and setup."""
    raw = spark.readStream.schema(schema).parquet(folder)
    name = names.file_name(F.col("path"))
    return raw.withColumns({"captured_at": names.captured_at(name).cast("timestamp"), "setup": names.setup_of(name)})


def unique_images(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(["path"])


def hourly_counts(stream: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """``hour``, ``setup``, ``n``, ``best``: images and best score of each hour and setup. ``late`` None: the stream has its watermark."""
    timed = stream.withWatermark("captured_at", late) if late else stream
    return timed.groupBy(F.window("captured_at", "1 hour"), "setup").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).select(F.col("window.start").alias("hour"), "setup", "n", "best")


def sessions(stream: DataFrame, gap: str = "3 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a setup's images, a gap apart."""
    return stream.withWatermark("captured_at", late).groupBy(F.session_window("captured_at", gap), "setup").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "setup", "n")
