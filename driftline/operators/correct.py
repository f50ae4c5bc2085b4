"""Correctors and their statistics: nearest network wins, model-weighted snap, classifier-chosen snap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.projection import grid_distance, to_wgs84
from driftline.functions.scalars import clip, column_or
from driftline.tables import cut

from .features import Networks, add_map_context_features
from .quantiles import percentiles, with_groups
from .spatial import MAX_SNAP_M

_CONTEXT = ("nearest_car_distance_m", "nearest_ped_distance_m", "nearest_car_east", "nearest_car_north", "nearest_ped_east", "nearest_ped_north")


def against_truth(df: DataFrame, east: str, north: str, deviation: str, **improvements: str) -> DataFrame:
    """Add the distance to the truth and how much smaller it is than other deviations; null where a column is missing."""
    if {"gpx_east", "gpx_north"} <= set(df.columns):
        df = df.withColumn(deviation, grid_distance(F.col(east), F.col(north), F.col("gpx_east"), F.col("gpx_north")))
    else:
        df = df.withColumn(deviation, F.lit(None).cast("double"))
    return df.withColumns({name: column_or(df, other) - F.col(deviation) for name, other in improvements.items()})


def apply_rule_based_correction(df: DataFrame, networks: Networks | None = None, max_snap_m: float = MAX_SNAP_M, project_root: str | None = None) -> DataFrame:
    """Snap to the nearer network, to the carriageway on ties; null where there is neither.

    Where map context is missing it is worked out from ``networks`` or, without these, from those under ``project_root``.
    """
    if not set(_CONTEXT) <= set(df.columns):
        if networks is None and project_root is None:
            raise KeyError("map context is missing: give networks or project_root")
        if networks is None:
            from driftline.sources.networks import load_all_networks  # which needs the operators

            networks = load_all_networks(df.sparkSession, project_root)
        df = add_map_context_features(df, networks, max_snap_m=max_snap_m)
    car, ped = F.col("nearest_car_distance_m"), F.col("nearest_ped_distance_m")
    car_wins = car.isNotNull() & (ped.isNull() | (car <= ped))
    pick = lambda a, b: F.when(car_wins, a).when(ped.isNotNull(), b)
    df = df.withColumns({
        "corrected_glh_east": pick(F.col("nearest_car_east"), F.col("nearest_ped_east")),
        "corrected_glh_north": pick(F.col("nearest_car_north"), F.col("nearest_ped_north")),
        "corrected_glh_network_kind": pick(F.lit("carriageway"), F.lit("pedestrian")),
        "corrected_snap_distance_m": pick(car, ped),
    })
    df = to_wgs84(df, "corrected_glh_east", "corrected_glh_north", "corrected_glh_lat", "corrected_glh_lon")
    return against_truth(df, "corrected_glh_east", "corrected_glh_north", "corrected_deviation_m", improvement_m="deviation_m")


def _has_snap() -> Column:
    return F.col("corrected_glh_east").isNotNull() & F.col("corrected_glh_north").isNotNull() & F.col("corrected_snap_distance_m").isNotNull()


def hybrid_correction(df: DataFrame, predicted: str = "predicted_deviation_m", alpha_floor: float = 0.0, alpha_ceil: float = 1.0) -> DataFrame:
    """Move towards the snap by predicted / (predicted + snap distance); stay where there is no snap."""
    p, snap = F.col(predicted), F.col("corrected_snap_distance_m")
    alpha = F.when(_has_snap() & p.isNotNull(), F.try_divide(p, p + snap)).otherwise(F.lit(0.0))
    df = df.withColumn("hybrid_alpha", clip(alpha, alpha_floor, alpha_ceil))
    toward = lambda a: F.when(_has_snap(), F.col(f"glh_{a}") + F.col("hybrid_alpha") * (F.col(f"corrected_glh_{a}") - F.col(f"glh_{a}"))).otherwise(F.col(f"glh_{a}"))
    df = df.withColumns({"pred_glh_east": toward("east"), "pred_glh_north": toward("north")})
    df = to_wgs84(df, "pred_glh_east", "pred_glh_north", "pred_glh_lat", "pred_glh_lon")
    return against_truth(df, "pred_glh_east", "pred_glh_north", "pred_deviation_m", improvement_vs_raw_m="deviation_m", improvement_vs_stage2_m="corrected_deviation_m")


def classifier_correction(df: DataFrame, probability: str = "snap_helps_prob", threshold: float = 0.5) -> DataFrame:
    """Take the snap where there is one and its probability to help reaches the threshold."""
    df = df.withColumn("snap_helps_decision", F.coalesce(_has_snap() & (F.col(probability) >= threshold), F.lit(False)))
    pick = lambda a: F.when(F.col("snap_helps_decision"), F.col(f"corrected_glh_{a}")).otherwise(F.col(f"glh_{a}"))
    df = df.withColumns({"clf_glh_east": pick("east"), "clf_glh_north": pick("north")})
    df = to_wgs84(df, "clf_glh_east", "clf_glh_north", "clf_glh_lat", "clf_glh_lon")
    return against_truth(df, "clf_glh_east", "clf_glh_north", "clf_deviation_m", clf_improvement_vs_raw_m="deviation_m", clf_improvement_vs_stage2_m="corrected_deviation_m")


def correction_summary(df: DataFrame) -> DataFrame:
    """Before and after for each volunteer and layer (null is a group); medians and percentiles are exact, by ranks."""
    by = ["volunteer", "glh_layer"]
    matched = F.coalesce(F.col("matched"), F.lit(False))
    fixed = matched & F.col("corrected_deviation_m").isNotNull()
    df = cut(df.select(*by, matched.alias("matched"), fixed.alias("fixed"), F.when(matched, F.col("deviation_m")).alias("raw"), F.when(fixed, F.col("corrected_deviation_m")).alias("cor"), F.when(fixed, F.col("improvement_m")).alias("gain")), "corrections")
    raw, cor, gain = F.col("raw"), F.col("cor"), F.col("gain")
    ranks = percentiles(df, by, {"raw_median_m": (raw, 0.5), "raw_p95_m": (raw, 0.95), "cor_median_m": (cor, 0.5), "cor_p95_m": (cor, 0.95), "improvement_median_m": (gain, 0.5)})
    out = df.groupBy(*by).agg(
        F.count_if("matched").alias("n_matched"), F.count_if("fixed").alias("n_correctable"), F.avg(raw).alias("raw_mean_m"), F.avg(cor).alias("cor_mean_m"), F.avg(gain).alias("improvement_mean_m"),
        (100.0 * F.try_divide(F.count_if(gain > 0), F.count(gain))).alias("pct_improved"),
    )
    out = with_groups(out, ranks, by).withColumn("snap_rate", F.try_divide(F.col("n_correctable"), F.col("n_matched")))
    return out.select(*by, "n_matched", "n_correctable", "snap_rate", "raw_median_m", "raw_mean_m", "raw_p95_m", "cor_median_m", "cor_mean_m", "cor_p95_m", "improvement_median_m", "improvement_mean_m", "pct_improved")
