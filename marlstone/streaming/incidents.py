"""Incidents as a stream: the first of each kind in a window of event time, and counts by code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduped(incidents: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One incident of each kind while the watermark remembers it; state is bounded by the watermark."""
    return incidents.withWatermark("t", delay).dropDuplicatesWithinWatermark(["code", "where", "detail"])


def counts(incidents: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Incidents by code in tumbling or sliding windows; late ones count until the watermark passes."""
    window = F.window("t", width, slide) if slide else F.window("t", width)
    return incidents.withWatermark("t", delay).groupBy(window, "code").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "code", "n")
