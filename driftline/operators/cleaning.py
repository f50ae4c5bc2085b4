"""Quality flags of point streams, and the cleaning pipelines made of them.

A flag never drops a row; ``apply_qc`` does. All windows share the partitioning by session, so a pipeline
shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.projection import grid_distance
from driftline.functions.scalars import seconds_between

from .sessionize import keys, order

# Defaults: fixed values.
STUDY_AREA = {"lat_min": 55.80, "lat_max": 56.05, "lon_min": -3.40, "lon_max": -3.00}
MAX_ACCURACY_M, ACCURACY_SENTINEL, MAX_SPEED_KMH = 50.0, 100.0, 200.0
MIN_SESSION_POINTS, MIN_SESSION_S = 5, 60.0
#: Flags that drop a row when they fail, in the order in which reasons are named.
DROP_FLAGS = ("qc_accuracy_pass", "qc_speed_pass", "qc_dedup_keep", "qc_session_pass")


def tag_in_study_area(df: DataFrame, bbox: dict[str, float] = STUDY_AREA, lat_col: str = "lat", lon_col: str = "lon", out_col: str = "qc_in_study_area") -> DataFrame:
    """Whether a point lies in the box, edges included; false without coordinates."""
    inside = F.col(lat_col).between(bbox["lat_min"], bbox["lat_max"]) & F.col(lon_col).between(bbox["lon_min"], bbox["lon_max"])
    return df.withColumn(out_col, F.coalesce(inside, F.lit(False)))


def filter_accuracy(df: DataFrame, max_accuracy_m: float = MAX_ACCURACY_M, sentinel: float = ACCURACY_SENTINEL, treat_sentinel_as_unknown: bool = True) -> DataFrame:
    """Unknown accuracy passes: null, and the sentinel unless told otherwise."""
    if "accuracy_m" not in df.columns:
        return df.withColumn("qc_accuracy_pass", F.lit(True))
    a = F.col("accuracy_m")
    ok = a.isNull() | (a <= max_accuracy_m)
    return df.withColumn("qc_accuracy_pass", ok | (a == sentinel) if treat_sentinel_as_unknown else ok)


def filter_speed(df: DataFrame, max_speed_kmh: float = MAX_SPEED_KMH, session_col: str = "session_id", time_col: str = "timestamp") -> DataFrame:
    """Speed from the point before in its session; unknown speed passes."""
    window = Window.partitionBy(*keys(df, session_col)).orderBy(*(order(df) or order(df, time_col)))
    before = lambda c: F.lag(c).over(window)
    dt = seconds_between(F.col(time_col), before(time_col))
    speed = F.when(dt > 0, grid_distance(F.col("east"), F.col("north"), before("east"), before("north")) / dt * 3.6)
    return df.withColumn("implied_speed_kmh", speed).withColumn("qc_speed_pass", F.col("implied_speed_kmh").isNull() | (F.col("implied_speed_kmh") <= max_speed_kmh))


def dedupe_timestamps(df: DataFrame, session_col: str = "session_id", time_col: str = "timestamp") -> DataFrame:
    """The first point of each time in a session is kept; missing times are equal."""
    window = Window.partitionBy(*keys(df, session_col), time_col).orderBy(*(order(df) or [F.lit(1)]))
    return df.withColumn("qc_dedup_keep", F.row_number().over(window) == 1)


def filter_short_sessions(df: DataFrame, min_points: int = MIN_SESSION_POINTS, min_duration_s: float = MIN_SESSION_S, session_col: str = "session_id", time_col: str = "timestamp") -> DataFrame:
    """A session passes with enough points and enough time; a point without session fails."""
    if session_col not in df.columns:
        return df.withColumn("qc_session_pass", F.lit(True))
    window = Window.partitionBy(*keys(df, session_col))
    span = seconds_between(F.max(time_col).over(window), F.min(time_col).over(window))
    ok = F.col(session_col).isNotNull() & (F.count(F.lit(1)).over(window) >= min_points) & (span >= min_duration_s)
    return df.withColumn("qc_session_pass", F.coalesce(ok, F.lit(False)))


def apply_qc(df: DataFrame, drop_flags: tuple[str, ...] = DROP_FLAGS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped); dropped rows have drop_reason: their failing flags, joined by commas."""
    flags = [f for f in drop_flags if f in df.columns]
    passed: Column = F.lit(True)
    for f in flags:
        passed = passed & F.coalesce(F.col(f), F.lit(False))
    reason = F.concat_ws(",", *[F.when(~F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags])
    return df.where(passed), df.where(~passed).withColumn("drop_reason", reason)


def audit(flagged: DataFrame, accuracy: bool = True) -> DataFrame:
    """One row of counts of a flagged frame, from one pass."""
    failed = lambda f: F.count_if(~F.col(f))
    passed = F.lit(True)
    for f in DROP_FLAGS:
        if f in flagged.columns:
            passed = passed & F.col(f)
    counts = {"input_rows": F.count(F.lit(1)), "in_study_area": F.count_if("qc_in_study_area"), "out_of_study_area": failed("qc_in_study_area")}
    if accuracy:
        counts["accuracy_fail"] = failed("qc_accuracy_pass")
    counts |= {"speed_fail": failed("qc_speed_pass"), "dedup_drop": failed("qc_dedup_keep"), "short_session_drop": failed("qc_session_pass"), "kept_rows": F.count_if(passed), "dropped_rows": F.count_if(~passed)}
    return flagged.agg(*[v.alias(k) for k, v in counts.items()])


def flag_glh(df: DataFrame, bbox: dict[str, float] = STUDY_AREA, max_accuracy_m: float | None = MAX_ACCURACY_M, max_speed_kmh: float = MAX_SPEED_KMH, min_session_points: int = MIN_SESSION_POINTS, min_session_duration_s: float = MIN_SESSION_S) -> DataFrame:
    """All flags. max_accuracy_m None: every accuracy passes."""
    df = tag_in_study_area(df, bbox)
    df = df.withColumn("qc_accuracy_pass", F.lit(True)) if max_accuracy_m is None else filter_accuracy(df, max_accuracy_m)
    return filter_short_sessions(dedupe_timestamps(filter_speed(df, max_speed_kmh)), min_session_points, min_session_duration_s)


def clean_glh(df: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(kept rows with their flags, audit) of raw fixes."""
    flagged = flag_glh(df, **limits)
    return apply_qc(flagged)[0], audit(flagged)


def clean_glh_timeline_paths(df: DataFrame, min_session_points: int = 1, min_session_duration_s: float = 0.0, **limits) -> tuple[DataFrame, DataFrame]:
    """Paths have no accuracy and may be single points."""
    flagged = flag_glh(df, max_accuracy_m=None, min_session_points=min_session_points, min_session_duration_s=min_session_duration_s, **limits)
    return apply_qc(flagged)[0], audit(flagged, accuracy=False)


def clean_gpx(df: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """As raw fixes, without accuracy."""
    flagged = flag_glh(df, **{"max_accuracy_m": None, **limits}).drop("qc_accuracy_pass")
    return apply_qc(flagged)[0], audit(flagged, accuracy=False)
