"""Sessions of a live point stream, with watermarks: the streaming form of gap sessions and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import seconds_between
from driftline.operators.sessionize import GLH_GAP_S


def session_summaries(points: DataFrame, gap_seconds: int = GLH_GAP_S, lateness: str = "1 hour") -> DataFrame:
    """One row for each closed session of a volunteer: points, first and last time, extent.

    Points at most ``gap_seconds`` apart share a session, as in the batch form; the end is the last point, not
    the end of the window. Works on batch frames too.
    """
    if points.isStreaming:
        points = points.withWatermark("timestamp", lateness)
    window = F.session_window("timestamp", f"{gap_seconds} seconds")
    out = points.groupBy("volunteer", window).agg(F.count(F.lit(1)).alias("n_points"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    return out.withColumn("duration_s", seconds_between(F.col("end_time"), F.col("start_time"))).drop("session_window")


def qc_points(points: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Stateless flags and the removal of repeated (volunteer, time) within the watermark."""
    from driftline.operators.cleaning import filter_accuracy, tag_in_study_area

    if points.isStreaming:
        points = points.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["volunteer", "timestamp"])
    else:
        points = points.dropDuplicates(["volunteer", "timestamp"])
    return filter_accuracy(tag_in_study_area(points)).where("qc_accuracy_pass")
