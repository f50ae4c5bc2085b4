"""Truth for observed points: overlapping sessions, as-of interpolation, matching and deviation statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.projection import grid_distance
from driftline.functions.scalars import seconds_between
from driftline.schemas import MATCHED
from driftline.tables import cut

from .quantiles import percentiles, with_groups
from .sessionize import summarise_sessions

MAX_BRACKET_GAP_S = 60.0
#: Sessions meet in buckets of so many seconds, so that overlap is found by an equi-join.
OVERLAP_BUCKET_S = 86_400
#: As-of windows hold so many seconds of a stream.
ASOF_BUCKET_S = 86_400
_POSITION = ("lat", "lon", "east", "north")


def with_volunteer(df: DataFrame) -> DataFrame:
    return df if "volunteer" in df.columns else df.withColumn("volunteer", F.lit(None).cast("string"))


def _buckets(width: int) -> Column:
    at = lambda c: F.floor(F.unix_micros(c) / (width * 1_000_000)).cast("long")
    return F.explode(F.sequence(at(F.col("start_time")), at(F.col("end_time"))))


def find_overlapping_sessions(gpx_summary: DataFrame, glh_summary: DataFrame, bucket_s: int = OVERLAP_BUCKET_S) -> DataFrame:
    """Pairs of sessions of one volunteer that overlap for more than no time; of each layer, if the observed sessions have one (glh_layer).

    Each session stands in every bucket of time that it touches; a pair is taken in the bucket where its
    overlap starts, so it comes once without a distinct.
    """
    layer = [c for c in ("glh_layer",) if c in glh_summary.columns]
    side = lambda df, p, *more: with_volunteer(df).where("start_time is not null").select("volunteer", *more, F.col("session_id").alias(f"{p}_session_id"), F.col("start_time").alias(f"{p}_start"), F.col("end_time").alias(f"{p}_end"), _buckets(bucket_s).alias("_bucket"))
    g, h = side(gpx_summary, "gpx"), side(glh_summary, "glh", *layer).withColumnsRenamed({"volunteer": "_v", "_bucket": "_b"})
    pairs = g.join(h, (F.col("_bucket") == F.col("_b")) & F.col("volunteer").eqNullSafe(F.col("_v")) & (F.col("gpx_start") < F.col("glh_end")) & (F.col("glh_start") < F.col("gpx_end")))
    start, end = F.greatest("gpx_start", "glh_start"), F.least("gpx_end", "glh_end")
    pairs = pairs.withColumns({"overlap_start": start, "overlap_end": end}).withColumn("overlap_s", seconds_between(F.col("overlap_end"), F.col("overlap_start")))
    first = F.col("_bucket") == F.floor(F.unix_micros("overlap_start") / (bucket_s * 1_000_000)).cast("long")
    return pairs.where(first & (F.col("overlap_s") > 0)).select("volunteer", *layer, "gpx_session_id", "glh_session_id", "overlap_start", "overlap_end", "overlap_s")


def _edges(truth: DataFrame, by: list[str]) -> DataFrame:
    """For each bucket of time: the last truth point before it and the first one after it.

    One row for each bucket between the first and the last truth point of a key, so a target in a bucket
    without truth finds its neighbours by an equi-join too.
    """
    key = F.struct("_at", "_ord")
    days = truth.groupBy(*by, "_bucket").agg(F.min_by("_truth", key).alias("_first"), F.max_by("_truth", key).alias("_last"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    days = days.withColumns({"_next": F.lead("_bucket").over(w), "_after": F.lead("_first").over(w), "_prior": F.lag("_last").over(w)})
    filled = days.withColumn("_b", F.explode(F.sequence("_bucket", F.coalesce(F.col("_next") - 1, "_bucket"))))
    before = F.when(F.col("_b") == F.col("_bucket"), F.col("_prior")).otherwise(F.col("_last"))
    return filled.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_b", before.alias("_before"), "_after")


def interpolate_asof(truth: DataFrame, targets: DataFrame, by: list[str], time_col: str = "timestamp", bucket_s: int = ASOF_BUCKET_S) -> DataFrame:
    """Truth at the times of the targets: between the last point at or before and the first one after.

    Both streams meet in windows over a key and a bucket of time, truth before target at equal times; what lies
    before and after a bucket comes from a table of its edges, so a long stream of one key is many tasks. Both
    windows run over preceding rows, which Spark carries along; the position is linear in time. Adds gpx_lat,
    gpx_lon, gpx_east, gpx_north, bracket_dt_prev_s, bracket_dt_next_s, bracket_total_s and in_bracket; all
    null (false) where a target is not between two truth points.
    """
    names = [c for c in targets.columns if c not in (*by, time_col)]
    point = F.struct(F.col(time_col).alias("t"), *[F.col(c) for c in _POSITION])
    ordinal = F.col("ord") if "ord" in truth.columns else F.lit(0).cast("long")
    bucket = F.floor(F.unix_micros(time_col) / (bucket_s * 1_000_000)).cast("long").alias("_bucket")
    t = truth.select(*by, F.col(time_col).alias("_at"), bucket, F.lit(0).alias("_kind"), ordinal.alias("_ord"), point.alias("_truth"))
    q = targets.select(*by, F.col(time_col).alias("_at"), bucket, F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_ord"), F.struct(*names).alias("_row"))
    both = t.unionByName(q, allowMissingColumns=True)
    keys = Window.partitionBy(*by, "_bucket")
    rising, falling = keys.orderBy("_at", "_kind", "_ord"), keys.orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_ord"))
    both = both.withColumns({
        "_left": F.last("_truth", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0)),
        "_right": F.last("_truth", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1)),
    }).where("_kind = 1")
    edges = _edges(t.where("_at is not null"), by)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    both = both.join(edges, reduce(lambda x, y: x & y, same, F.col("_bucket") == F.col("_b")), "left")
    both = both.withColumns({"_left": F.coalesce("_left", "_before"), "_right": F.coalesce("_right", "_after")}).withColumnRenamed("_at", time_col)
    left, right = F.col("_left"), F.col("_right")
    ok = left.isNotNull() & right.isNotNull()
    both = both.withColumns({"in_bracket": ok, "bracket_dt_prev_s": F.when(ok, seconds_between(F.col(time_col), left["t"])), "bracket_dt_next_s": F.when(ok, seconds_between(right["t"], F.col(time_col)))})
    both = both.withColumn("bracket_total_s", F.col("bracket_dt_prev_s") + F.col("bracket_dt_next_s"))
    both = both.withColumn("_w", F.when(F.col("bracket_total_s") > 0, F.col("bracket_dt_prev_s") / F.col("bracket_total_s")).otherwise(F.lit(0.0)))
    out = {f"gpx_{c}": F.when(ok, left[c] + F.col("_w") * (right[c] - left[c])) for c in _POSITION}
    return both.withColumns(out).select(*by, time_col, *[F.col("_row")[c].alias(c) for c in names], *out, "bracket_dt_prev_s", "bracket_dt_next_s", "bracket_total_s", "in_bracket")


def match_layers(gpx: DataFrame, glh: DataFrame, max_bracket_gap_s: float = MAX_BRACKET_GAP_S) -> DataFrame:
    """The 21-column table of observed points with their truth, for all layers (column glh_layer) in one pass.

    A point in several pairs keeps the pairing with the smallest GPX session, matched or not. Truth points are
    not copied for each pair or layer: the window runs over a GPX session and all points that overlap it. Both
    sides are written once to the shared folder, so what made them runs once however often they are read here.
    """
    gpx, glh = with_volunteer(gpx), with_volunteer(glh)
    optional = {"glh_accuracy_m": ("accuracy_m", "double"), "glh_source": ("source", "string"), "glh_speed_mps": ("speed_mps", "double")}
    at = ["session_id", "timestamp", *_POSITION]
    ordinal = lambda df: (F.col("ord") if "ord" in df.columns else F.lit(0)).cast("long")
    gpx = cut(gpx.select("volunteer", *at, ordinal(gpx).alias("ord")), "truth")
    glh = cut(glh.select("volunteer", "glh_layer", *at, ordinal(glh).alias("_glh_ord"), *[(F.col(c) if c in glh.columns else F.lit(None)).cast(t).alias(n) for n, (c, t) in optional.items()]), "observed")
    pairs = find_overlapping_sessions(summarise_sessions(gpx), summarise_sessions(glh, by=("glh_layer",))).withColumnsRenamed({"volunteer": "_v", "glh_layer": "_layer"})
    same = F.col("volunteer").eqNullSafe(F.col("_v")) & F.col("glh_layer").eqNullSafe(F.col("_layer")) & (F.col("session_id") == F.col("glh_session_id"))
    inside = glh.join(pairs, same & F.col("timestamp").between(F.col("overlap_start"), F.col("overlap_end")))
    targets = inside.select("volunteer", "gpx_session_id", "timestamp", "glh_layer", "glh_session_id", *[F.col(c).alias(f"glh_{c}") for c in _POSITION], *optional, "_glh_ord")
    joined = interpolate_asof(gpx.withColumnRenamed("session_id", "gpx_session_id"), targets, ["volunteer", "gpx_session_id"])
    matched = F.coalesce(F.col("in_bracket") & (F.col("bracket_total_s") <= max_bracket_gap_s), F.lit(False))
    joined = joined.withColumn("matched", matched)
    joined = joined.withColumns({f"gpx_{c}": F.when(F.col("matched"), F.col(f"gpx_{c}")) for c in _POSITION})
    joined = joined.withColumn("deviation_m", grid_distance(F.col("glh_east"), F.col("glh_north"), F.col("gpx_east"), F.col("gpx_north")))
    first = Window.partitionBy("volunteer", "glh_layer", "timestamp", "glh_session_id").orderBy("gpx_session_id", "_glh_ord")
    kept = joined.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select([F.col(f.name).cast(f.dataType) for f in MATCHED])


def match_streams(gpx: DataFrame, glh: DataFrame, glh_layer: str, max_bracket_gap_s: float = MAX_BRACKET_GAP_S) -> DataFrame:
    """``match_layers`` for one layer, named ``glh_layer``."""
    return match_layers(gpx, glh.withColumn("glh_layer", F.lit(glh_layer)), max_bracket_gap_s)


def match_volunteer(gpx: DataFrame, layers: dict[str, DataFrame], max_bracket_gap_s: float = MAX_BRACKET_GAP_S) -> DataFrame:
    """All layers of observed points, matched in one pass."""
    found = [df.withColumn("glh_layer", F.lit(name)) for name, df in layers.items() if df is not None]
    if not found:
        return gpx.sparkSession.createDataFrame([], MATCHED)
    return match_layers(gpx, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), max_bracket_gap_s)


def deviation_summary(matched: DataFrame) -> DataFrame:
    """Deviation statistics for each volunteer and layer (null is a group); percentiles are exact, by ranks, whatever the size of a group."""
    dev = F.when(F.col("matched"), F.col("deviation_m"))
    matched = cut(matched.select("volunteer", "glh_layer", "matched", "deviation_m"), "deviations")
    ranks = percentiles(matched, ["volunteer", "glh_layer"], {"median_m": (dev, 0.5), "p90_m": (dev, 0.9), "p95_m": (dev, 0.95), "p99_m": (dev, 0.99)})
    out = matched.groupBy("volunteer", "glh_layer").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("matched").alias("n_matched"), F.avg(dev).alias("mean_m"), F.max(dev).alias("max_m"))
    out = with_groups(out, ranks, ["volunteer", "glh_layer"]).withColumn("match_rate", F.col("n_matched") / F.col("n_total"))
    return out.select("volunteer", "glh_layer", "n_total", "n_matched", "match_rate", "mean_m", "median_m", "p90_m", "p95_m", "p99_m", "max_m")
