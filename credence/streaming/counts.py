"""Contingency tables of streams: the same aggregations as for tables, kept up incrementally by Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, names: Sequence[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(begin, names..., n) for each window; rows later than the watermark allows are left out, and windows are final once it has passed them."""
    at = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return at.groupBy(F.window(time, window).alias("w"), *names).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), *names, "n")


def running_counts(stream: DataFrame, names: Sequence[str]) -> DataFrame:
    """(names..., n) so far; the state holds one row for each combination. Any score or fit by counts takes it as `joint`."""
    return stream.groupBy(*names).agg(F.count("*").alias("n"))
