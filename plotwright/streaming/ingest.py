"""Streams: an upload folder into records, duplicates by content hash, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_copies(rows: DataFrame, at: str, text: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose text hash was not seen within the watermark."""
    return rows.withColumn("sha256", F.sha2(F.col(text), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["sha256"])


def volume(rows: DataFrame, at: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rows per tumbling window, late ones within the delay."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, width)).agg(F.count("*").alias("c")).select(F.col("window.start").alias("start"), "c")


def sessions(rows: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Rows per session of a key, a session ending after a gap."""
    return rows.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("c")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "c")
