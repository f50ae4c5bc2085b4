"""Sessions of point streams: gaps, segments, ordinals and summaries, all by windows over one user's stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import seconds_between

GLH_GAP_S = 600
#: Windows over streams hold so many seconds.
DAY_S = 86_400


def keys(df: DataFrame, *names: str) -> list[str]:
    """Those of the names that the frame has, after volunteer."""
    return [c for c in ("volunteer", *names) if c in df.columns]


def order(df: DataFrame, *columns: str) -> list[Column]:
    """Order by columns, then by the input ordinal ``ord`` where there is one; nulls last."""
    return [F.col(c).asc_nulls_last() for c in (*columns, "ord") if c in df.columns]


def _point_ids(df: DataFrame, session: str, time_col: str) -> DataFrame:
    return df.withColumn("point_id", (F.row_number().over(Window.partitionBy(*keys(df, session)).orderBy(*order(df, time_col))) - 1).cast("long"))


def _carried(df: DataFrame, days: DataFrame, by: list[str], *values: str) -> DataFrame:
    """Join values of a table of days (by, _day) to the rows of the days; null is a day."""
    own = days.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_day").alias("_d"), *values)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(own, reduce(lambda x, y: x & y, same, F.col("_day").eqNullSafe(F.col("_d"))), "left").drop("_d", *[f"_by_{c}" for c in by])


def sessionise_raw_signals(df: DataFrame, gap_seconds: float = GLH_GAP_S, time_col: str = "timestamp") -> DataFrame:
    """Add session_id and point_id: a session starts after a gap of more than ``gap_seconds``; points without time are sessions of their own, last.

    Windows run over a user's day, so a long stream is many tasks. One table of days says what the days before hold: the last
    time, whether the first point of a day starts a session, and how many sessions came before. It is made from the rows of the same
    shuffle, so a stream is read and shuffled once.
    """
    by, within = keys(df), order(df, time_col)
    df = df.withColumn("_day", F.floor(F.unix_micros(time_col) / (DAY_S * 1_000_000)).cast("long"))
    day = Window.partitionBy(*by, "_day").orderBy(*within)
    inside = F.coalesce(seconds_between(F.col(time_col), F.lag(time_col).over(day)) > gap_seconds, F.lit(True))
    df = df.withColumn("_new", F.when(F.row_number().over(day) > 1, inside.cast("int")).otherwise(0))  # the first point of a day: by the table of days
    df = df.withColumn("_own", F.sum("_new").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    days = df.groupBy(*by, "_day").agg(F.min(time_col).alias("_start"), F.max(time_col).alias("_end"), F.sum("_new").alias("_n"))
    line = Window.partitionBy(*by).orderBy(F.col("_day").asc_nulls_last())
    days = days.withColumn("_first", F.coalesce(seconds_between(F.col("_start"), F.lag("_end").over(line)) > gap_seconds, F.lit(True)).cast("int"))
    days = days.withColumn("_base", F.sum(F.col("_n") + F.col("_first")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    out = _carried(df, days.select(*by, "_day", "_base"), by, "_base").withColumn("session_id", F.col("_base") + F.col("_own") - 1)
    return _point_ids(out.drop("_day", "_new", "_own", "_base"), "session_id", time_col)


def sessionise_track_segments(df: DataFrame, max_gap_seconds: float | None = None, base_session_id: int = 0, files: str = "source_file") -> DataFrame:
    """Add session_id and point_id to track points: a session for each segment, cut at gaps within it if asked for.

    Ids go on over the files of a volunteer, in order of their names (of their paths, where names are equal). Windows run over a segment's day; a table of segments and days, one
    row for each, carries sessions on by prefix sums, so one volunteer is many tasks.
    """
    df = df.where("timestamp is not null and lat is not null and lon is not null")
    by, within = keys(df), order(df, "timestamp")
    segment = [c for c in (files, "source_path", "trk_idx", "seg_idx") if c in df.columns]
    df = df.withColumn("_day", F.floor(F.unix_micros("timestamp") / (DAY_S * 1_000_000)).cast("long"))
    part = Window.partitionBy(*by, *segment, "_day").orderBy(*within)
    gap = lambda a, b: F.lit(False) if max_gap_seconds is None else F.coalesce(seconds_between(a, b) > max_gap_seconds, F.lit(False))
    df = df.withColumn("_new", gap(F.col("timestamp"), F.lag("timestamp").over(part)).cast("int"))
    df = df.withColumn("_own", F.sum("_new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    parts = df.groupBy(*by, *segment, "_day").agg(F.min("timestamp").alias("_start"), F.max("timestamp").alias("_end"), F.sum("_new").alias("_n"))
    before = F.lag("_end").over(Window.partitionBy(*by, *segment).orderBy("_day"))
    parts = parts.withColumn("_first", F.when(before.isNull(), F.lit(1)).otherwise(gap(F.col("_start"), before).cast("int")))
    line = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_last() for c in segment], "_day").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_base", F.sum(F.col("_n") + F.col("_first")).over(line) - F.col("_n"))
    out = _carried(df, parts.select(*by, *segment, "_day", "_base"), [*by, *segment], "_base")
    out = out.withColumn("session_id", F.col("_base") + F.col("_own") - 1 + base_session_id)
    return _point_ids(out.drop("_day", "_new", "_own", "_base"), "session_id", "timestamp")


def sessionise_timeline_paths(df: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """Each segment is a session; point_id by time."""
    if "segment_id" not in df.columns:
        raise KeyError("segment_id")
    return _point_ids(df.withColumn("session_id", F.col("segment_id")), "session_id", time_col)


def sessionise_visits_or_activities(df: DataFrame) -> DataFrame:
    """As paths; the time is the timestamp, else the start."""
    return sessionise_timeline_paths(df, "timestamp" if "timestamp" in df.columns else "start_time")


def summarise_sessions(df: DataFrame, session_col: str = "session_id", time_col: str = "timestamp", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each session (and each value of ``by``): points, times, extent in degrees and, where present, on the grid."""
    span = [f(c).alias(f"{c}_{n}") for c in ("lat", "lon", "east", "north") if c in df.columns for f, n in ((F.min, "min"), (F.max, "max"))]
    key = keys(df, *by, session_col)
    out = df.groupBy(*key).agg(F.count("*").alias("n_points"), F.min(time_col).alias("start_time"), F.max(time_col).alias("end_time"), *span)
    extent = [c for c in out.columns if c.endswith(("_min", "_max"))]
    return out.withColumn("duration_s", seconds_between(F.col("end_time"), F.col("start_time"))).select(*key, "n_points", "start_time", "end_time", "duration_s", *extent)


def session_summary(df: DataFrame) -> DataFrame:
    """Of track points: also the first file and the mean rate, null where a session has no duration."""
    out = df.groupBy(*keys(df, "session_id")).agg(
        *([F.min_by("source_file", F.struct("timestamp", "point_id")).alias("source_file")] if "source_file" in df.columns else []),
        F.count("*").alias("n_points"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        *(f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))),
    )
    out = out.withColumn("duration_s", seconds_between(F.col("end_time"), F.col("start_time")))
    return out.withColumn("mean_rate_hz", F.try_divide(F.col("n_points") - 1, F.col("duration_s")))
