"""Structured Streaming extensions: statistics that grow as records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mutation_counts(stream: DataFrame, late: str = "30 days", width: str = "1 day") -> DataFrame:
    """Mutations per loading day and (a, pos, d); rows later than ``late`` are dropped by the watermark.

    stream: loaded_at, a, pos, d, mut_id. Repeated mut_ids within the watermark count once.
    """
    s = stream.select(F.col("loaded_at").cast("timestamp").alias("at"), "mut_id", F.upper(F.trim("a")).alias("a"), "pos", F.upper(F.trim("d")).alias("d"))
    s = s.withWatermark("at", late).dropDuplicatesWithinWatermark(["mut_id"])
    return s.groupBy(F.window("at", width), "a", "pos", "d").agg(F.count(F.lit(1)).alias("n"))


def event_windows(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Number and summed value of events per window and type."""
    s = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return s.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(stream: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of users: windows that close after a gap."""
    s = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return s.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
