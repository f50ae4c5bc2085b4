"""Registered queries: each runs an operator over whole tables. Doubles are rounded, times are microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import projection as P
from driftline.functions import scalars as S
from driftline.operators import cleaning, correct, features, hmm, matching, models, sessionize, spatial
from driftline.sources import glh as glh_source
from driftline.sources import gpx as gpx_source
from driftline.sources import networks as network_source
from driftline.streaming import sessions as streaming
from driftline.tables import cut

from . import fixtures as fx

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


def r6(*names: str):
    """Seconds, exact to the microsecond."""
    return [F.round(n, 6).alias(n) for n in names]


def us(name: str, out: str | None = None):
    return F.unix_micros(name).alias(out or f"{name}_us")


def glh(spark: SparkSession, d: str, volunteers: int = 2, gap: float = fx.GAP_S) -> DataFrame:
    return sessionize.sessionise_raw_signals(fx.tracks(spark, d, volunteers).where("kind = 'GLH'"), gap)


def gpx(spark: SparkSession, d: str, volunteers: int = 2, gap: float = fx.GAP_S) -> DataFrame:
    return sessionize.sessionise_raw_signals(fx.tracks(spark, d, volunteers).where("kind = 'GPX'"), gap)


def flagship(spark: SparkSession, d: str, volunteers: int = 1, gap: float = 21600, bracket: float = 7200, min_points: int = 2, speed: float = 200.0) -> DataFrame:
    """Sessionise, clean, match and summarise."""
    kept, _ = cleaning.clean_glh(glh(spark, d, volunteers, gap), max_accuracy_m=500.0, max_speed_kmh=speed, min_session_points=min_points)
    truth, _ = cleaning.clean_gpx(gpx(spark, d, volunteers, gap), max_speed_kmh=speed, min_session_points=min_points)
    return matching.deviation_summary(matching.match_layers(truth, kept, bracket))


# --- sessions


@query
def sessionise_gap(spark, d):
    return glh(spark, d).select("ord", "volunteer", "session_id", "point_id")


@query
def trkseg_sessions(spark, d):
    t = fx.tracks(spark, d).where("kind = 'GPX'").withColumns({"trk_idx": F.col("user_id") % 3, "seg_idx": F.lit(0)})
    return sessionize.sessionise_track_segments(t, max_gap_seconds=fx.GAP_S).select("ord", "session_id", "point_id")


@query
def path_sessions(spark, d):
    t = fx.tracks(spark, d).where("glh_layer = 'timeline_paths'").withColumn("segment_id", F.col("user_id"))
    return sessionize.sessionise_timeline_paths(t).select("ord", "session_id", "point_id")


@query
def visit_sessions(spark, d):
    t = fx.tracks(spark, d).where("kind = 'GLH'").withColumn("segment_id", F.col("user_id") % 10).withColumnRenamed("timestamp", "start_time")
    return sessionize.sessionise_visits_or_activities(t).select("ord", "session_id", "point_id")


@query
def session_extent(spark, d):
    s = sessionize.summarise_sessions(glh(spark, d))
    extent = [c for c in s.columns if c.endswith(("_min", "_max"))]
    return s.select("volunteer", "session_id", "n_points", us("start_time"), us("end_time"), *r6("duration_s"), *r4(*extent))


@query
def session_rate(spark, d):
    s = sessionize.session_summary(gpx(spark, d).withColumn("source_file", F.concat(F.lit("f"), F.col("volunteer"))))
    return s.select("volunteer", "session_id", "source_file", "n_points", *r6("duration_s"), F.round("mean_rate_hz", 6).alias("mean_rate_hz"))


@query
def session_window_summary(spark, d):
    s = streaming.session_summaries(fx.tracks(spark, d).where("kind = 'GLH'"), fx.GAP_S)
    return s.select("volunteer", "n_points", us("start_time"), us("end_time"), *r6("duration_s"), *r4("lat_min", "lat_max", "lon_min", "lon_max"))


# --- cleaning


@query
def qc_bbox(spark, d):
    return cleaning.tag_in_study_area(fx.tracks(spark, d)).select("ord", "qc_in_study_area")


@query
def qc_accuracy(spark, d):
    return cleaning.filter_accuracy(fx.tracks(spark, d)).select("ord", "qc_accuracy_pass")


@query
def qc_speed(spark, d):
    return cleaning.filter_speed(glh(spark, d), max_speed_kmh=0.5).select("ord", *r4("implied_speed_kmh"), "qc_speed_pass")


@query
def qc_dedup(spark, d):
    hourly = fx.tracks(spark, d).withColumns({"timestamp": F.date_trunc("hour", "timestamp"), "session_id": F.lit(0)})
    return cleaning.dedupe_timestamps(hourly).select("ord", "qc_dedup_keep")


@query
def qc_short(spark, d):
    return cleaning.filter_short_sessions(glh(spark, d)).select("ord", "qc_session_pass")


def _cleaned(spark, d):
    return cleaning.flag_glh(glh(spark, d), max_speed_kmh=0.5, min_session_points=3)


@query
def clean_kept(spark, d):
    return cleaning.apply_qc(_cleaned(spark, d))[0].select("ord", "volunteer", "session_id")


@query
def clean_dropped_reasons(spark, d):
    return cleaning.apply_qc(_cleaned(spark, d))[1].select("ord", "drop_reason")


@query
def clean_audit(spark, d):
    return cleaning.clean_glh(glh(spark, d), max_speed_kmh=0.5, min_session_points=3)[1]


@query
def clean_paths_audit(spark, d):
    return cleaning.clean_glh_timeline_paths(glh(spark, d).where("glh_layer = 'timeline_paths'"), max_speed_kmh=0.5)[1]


@query
def clean_gpx_audit(spark, d):
    return cleaning.clean_gpx(gpx(spark, d), max_speed_kmh=1.0)[1]


# --- matching


_BRACKET = ("bracket_dt_prev_s", "bracket_dt_next_s", "bracket_total_s")


@query
def overlap_pairs(spark, d):
    pairs = matching.find_overlapping_sessions(sessionize.summarise_sessions(gpx(spark, d)), sessionize.summarise_sessions(glh(spark, d)))
    return pairs.select("volunteer", "gpx_session_id", "glh_session_id", us("overlap_start"), us("overlap_end"), *r6("overlap_s"))


@query
def interpolate_asof(spark, d):
    truth, targets = fx.tracks(spark, d).where("kind = 'GPX'"), fx.tracks(spark, d).where("kind = 'GLH'").select("volunteer", "timestamp", F.col("ord").alias("target"))
    found = matching.interpolate_asof(truth, targets, ["volunteer"])
    return found.select("target", "in_bracket", *r4("gpx_lat", "gpx_lon", "gpx_east", "gpx_north"), *r6(*_BRACKET))


_MATCHED = ("glh_east", "glh_north", "gpx_lat", "gpx_lon", "gpx_east", "gpx_north", "deviation_m")


def _matched(spark, d, volunteers=2):
    return matching.match_layers(gpx(spark, d, volunteers), glh(spark, d, volunteers), fx.BRACKET_S)


@query
def match_streams(spark, d):
    m = matching.match_streams(gpx(spark, d), glh(spark, d), "all", fx.BRACKET_S)
    return m.select("volunteer", "glh_layer", "glh_session_id", "gpx_session_id", us("timestamp"), "glh_source", *r4("glh_accuracy_m", *_MATCHED), *r6(*_BRACKET), "matched")


@query
def match_layers(spark, d):
    return _matched(spark, d).select("volunteer", "glh_layer", "glh_session_id", "gpx_session_id", us("timestamp"), *r4("deviation_m"), "matched")


@query
def deviation_summary(spark, d):
    s = matching.deviation_summary(_matched(spark, d))
    return s.select("volunteer", "glh_layer", "n_total", "n_matched", *r4("match_rate", "mean_m", "median_m", "p90_m", "p95_m", "p99_m", "max_m"))


# --- scalars and projection


@query
def bng_forward(spark, d):
    p = P.to_bng(fx.tracks(spark, d).select("ord", "lat", "lon"))
    return p.select("ord", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


@query
def bng_roundtrip(spark, d):
    p = P.to_wgs84(P.to_bng(fx.tracks(spark, d).select("ord", "lat", "lon")), lat="lat2", lon="lon2")
    return p.select("ord", F.round("lat2", 6).alias("lat"), F.round("lon2", 6).alias("lon"))


@query
def bng_distance(spark, d):
    t = fx.tracks(spark, d)
    return t.select("ord", F.round(P.grid_distance(F.col("east"), F.col("north"), F.lit(325500.0), F.lit(673500.0)), 4).alias("distance_m"))


@query
def parse_latlng(spark, d):
    e, lat, lon = F.col("ord"), F.col("lat").cast("string"), F.col("lon").cast("string")
    forms = F.when(e % 5 == 0, F.concat(lat, F.lit("°, "), lon, F.lit("°"))).when(e % 5 == 1, F.concat(F.lit("geo:"), lat, F.lit(","), lon)).when(e % 5 == 2, F.concat(F.lit(" "), lat, F.lit(" , "), lon)).when(e % 5 == 3, F.concat(lat, F.lit("e0,"), lon)).otherwise(F.lit(".5,1"))
    t = fx.tracks(spark, d).withColumn("value", forms)
    a, b = S.latlng_text(F.col("value"))
    return t.select("ord", a.alias("lat"), b.alias("lon"))


@query
def safe_float(spark, d):
    text = F.when(F.col("ord") % 3 == 0, F.lit("n/a")).when(F.col("ord") % 3 == 1, F.col("speed_mps").cast("string"))
    return fx.tracks(spark, d).select("ord", F.round(S.safe_float(text), 6).alias("value"))


@query
def offset_time(spark, d):
    minutes = F.when(F.col("ord") % 4 == 0, F.lit("bad")).otherwise((F.col("ord") % 90).cast("string"))
    t = fx.tracks(spark, d).withColumn("at", S.offset_time(F.col("timestamp"), minutes))
    return t.select("ord", us("at"))


@query
def osm_classify(spark, d):
    classes = F.array(*map(F.lit, ("Motorway", " residential ", "footway", "cycleway", "construction", "track_grade3", "steps", "proposed")))
    t = fx.tracks(spark, d).withColumn("fclass", F.get(classes, (F.col("ord") % 9).cast("int")))
    return t.select("ord", network_source.classify_osm(F.col("fclass")).alias("network_kind"))


@query
def union_dedupe_network(spark, d):
    s = fx.table(spark, d, "supplier")
    by = F.struct(F.lit("supplier").alias("file"), F.lit(0).cast("long").alias("split"), F.col("s_suppkey").cast("long").alias("row")).alias("record")
    a = s.select((F.col("s_suppkey") % 20).cast("string").alias("toid"), F.col("s_name").alias("road_name"), F.col("s_suppkey").cast("long").alias("k"), by)
    b = s.select(F.concat(F.lit("osm_"), (F.col("s_suppkey") % 7).cast("string")).alias("toid"), F.col("s_suppkey").cast("long").alias("k"), F.lit("x").alias("city"), by)
    c = s.select((F.col("s_suppkey") % 30).cast("string").alias("toid"), F.col("s_suppkey").cast("long").alias("k"), by)
    return network_source.combine([a, b, c]).select("toid", "road_name", "city", "k")


# --- spatial


def _points(spark, d):
    return fx.tracks(spark, d).where("kind = 'GLH'").select("ord", "volunteer", "glh_layer", "timestamp", "east", "north")


def _snap(spark, d, cap):
    s = spatial.snap_points_to_network(_points(spark, d), fx.network(spark, d), max_snap_m=cap, add_wgs84=False)
    return s.select("ord", *r4("snap_east", "snap_north", "snap_distance_m"), "snap_toid", "snap_network_kind", "snap_road_name")


@query
def snap_nearest(spark, d):
    return _snap(spark, d, 100.0)


@query
def snap_nearest_15m(spark, d):
    return _snap(spark, d, 15.0)


@query
def dist_to_network(spark, d):
    return spatial.distance_to_network(_points(spark, d), fx.network(spark, d)).select("ord", *r4("dist_to_network_m"))


@query
def candidates_topk(spark, d):
    c = spatial.find_candidates(_points(spark, d), fx.network(spark, d), k=3)
    one = c.select("ord", F.posexplode("candidates").alias("rank", "c"))
    return one.select("ord", "rank", F.col("c.edge_ord").alias("edge_ord"), F.round("c.d", 4).alias("d"), F.round("c.px", 4).alias("proj_east"), F.round("c.py", 4).alias("proj_north"))


@query
def inside_building(spark, d):
    return spatial.is_inside_building(_points(spark, d), fx.buildings(spark, d)).select("ord", "inside_building", "inside_building_osm_id")


@query
def nearest_building(spark, d):
    return spatial.nearest_building_distance(_points(spark, d), fx.buildings(spark, d), max_search_m=60.0).select("ord", *r4("nearest_building_m"))


@query
def building_density(spark, d):
    return spatial.building_density(_points(spark, d), fx.buildings(spark, d), radius_m=100.0).select("ord", "n_buildings_100m", *r4("building_area_100m_m2"))


@query
def building_features(spark, d):
    b = spatial.building_features(_points(spark, d), fx.buildings(spark, d))
    return b.select("ord", "inside_building", "n_buildings_50m", "n_buildings_100m", *r4("nearest_building_m", "building_area_50m_m2", "building_area_100m_m2"))


_CONTEXT = ("nearest_car_distance_m", "nearest_ped_distance_m", "dist_to_nearest_network_m", "bearing_to_nearest_car_sin", "bearing_to_nearest_car_cos", "bearing_to_nearest_ped_sin", "bearing_to_nearest_ped_cos")


@query
def bearing(spark, d):
    sin, cos = features.bearing(F.col("east"), F.col("north"), F.lit(325500.0), F.lit(673500.0))
    return fx.tracks(spark, d).select("ord", F.round(sin, 6).alias("sin"), F.round(cos, 6).alias("cos"))


@query
def map_features(spark, d):
    f = features.add_map_context_features(_points(spark, d), fx.networks(spark, d), max_snap_m=30.0)
    return f.select("ord", *r4(*_CONTEXT), "nearest_car_toid", "nearest_ped_toid")


# --- correctors


def _corrected(spark, d, volunteers=2):
    return correct.apply_rule_based_correction(cut(_matched(spark, d, volunteers), "matched"), fx.networks(spark, d), max_snap_m=15.0)


@query
def rule_correct(spark, d):
    c = _corrected(spark, d)
    return c.select("volunteer", "glh_layer", us("timestamp"), "corrected_glh_network_kind", *r4("corrected_glh_east", "corrected_glh_north", "corrected_snap_distance_m", "corrected_deviation_m", "improvement_m"))


@query
def correction_summary(spark, d):
    s = correct.correction_summary(_corrected(spark, d))
    return s.select("volunteer", "glh_layer", "n_matched", "n_correctable", *r4(*[c for c in s.columns if c.endswith(("_m", "rate", "improved"))]))


@query
def hybrid_alpha(spark, d):
    h = correct.hybrid_correction(_corrected(spark, d).withColumn("predicted_deviation_m", F.col("glh_accuracy_m") / 10))
    return h.select("volunteer", "glh_layer", us("timestamp"), *r4("hybrid_alpha", "pred_glh_east", "pred_glh_north", "pred_deviation_m", "improvement_vs_raw_m", "improvement_vs_stage2_m"))


@query
def classifier_decision(spark, d):
    c = correct.classifier_correction(_corrected(spark, d).withColumn("snap_helps_prob", F.col("glh_accuracy_m") / 100))
    return c.select("volunteer", "glh_layer", us("timestamp"), "snap_helps_decision", *r4("clf_glh_east", "clf_glh_north", "clf_deviation_m", "clf_improvement_vs_raw_m", "clf_improvement_vs_stage2_m"))


# --- models


@query
def log_target(spark, d):
    p, _, _ = models.prepare_features(_matched(spark, d))
    return p.select("volunteer", "glh_layer", us("timestamp"), F.round("y", 6).alias("y"))


@query
def one_hot(spark, d):
    p, _, _ = models.feature_table(_corrected(spark, d), {"glh_layer": ["raw_signals", "timeline_paths"], "glh_source": ["click", "view"]})
    names = ["glh_layer__raw_signals", "glh_layer__timeline_paths", "glh_source__click", "glh_source__view", "inside_building"]
    return p.select("volunteer", us("timestamp"), "glh_layer", *[F.col("f").getField(n).cast("long").alias(n) for n in names], F.round("f.corrected_snap_distance_m", 4).alias("corrected_snap_distance_m"))


@query
def snap_helped_label(spark, d):
    p, _, _ = models.prepare_classifier_features(_corrected(spark, d))
    return p.select("volunteer", "glh_layer", us("timestamp"), F.col("y").cast("long").alias("snap_helped"))


@query
def feature_levels(spark, d):
    found = models.levels_of(_corrected(spark, d))
    return spark.createDataFrame([(c, i, v) for c, levels in found.items() for i, v in enumerate(levels)], "feature string, place long, level string")


@query
def hmm_match(spark, d):
    m = hmm.apply_hmm(cut(_matched(spark, d), "matched"), fx.network(spark, d))
    return m.select("volunteer", "glh_layer", "glh_session_id", us("timestamp"), *r4("hmm_pred_glh_east", "hmm_pred_glh_north", "hmm_perp_distance_m", "hmm_pred_deviation_m", "hmm_improvement_vs_raw_m"))


def _regressor(spark, d):
    data = cut(_corrected(spark, d), "corrected")  # levels, training and scoring read it
    prepared, names, levels = models.prepare_features(data)
    return models.train(prepared, names, levels), data


@query
def gbt_predict(spark, d):
    bundle, data = _regressor(spark, d)
    return models.apply_model(bundle, data).select("volunteer", "glh_layer", us("timestamp"), *r4("predicted_deviation_m", "hybrid_alpha", "pred_deviation_m"))


@query
def classifier_predict(spark, d):
    data = cut(_corrected(spark, d), "corrected")
    prepared, names, levels = models.prepare_classifier_features(data)
    bundle = models.train_classifier(prepared, names, levels)
    return models.apply_classifier_corrector(bundle, data).select("volunteer", "glh_layer", us("timestamp"), *r4("snap_helps_prob", "clf_deviation_m"), "snap_helps_decision")


@query
def feature_importance(spark, d):
    return models.feature_importance(_regressor(spark, d)[0], spark, top_n=None).select("rank", "feature", *r4("gain"))


@query
def leave_one_out(spark, d):
    """Cross-validation by volunteer, of eight."""
    scored, _ = models.leave_one_out(cut(_corrected(spark, d, 8), "corrected"))
    return models.calibration(cut(scored, "scored")).select("fold", "n_test", "n_train", *r4("r_log"))


# --- exports


@query
def glh_raw_signals(spark, d):
    p, _, _ = glh_source.parse_raw_signals(fx.exports(spark, d))
    return p.select("volunteer", us("timestamp"), "lat", "lon", *r4("accuracy_m"), "source")


@query
def glh_activity_records(spark, d):
    _, a, _ = glh_source.parse_raw_signals(fx.exports(spark, d))
    return a.select("volunteer", us("timestamp"), "top_activity", *r4("confidence"), "n_candidates")


@query
def glh_wifi_scans(spark, d):
    _, _, w = glh_source.parse_raw_signals(fx.exports(spark, d))
    return w.select("volunteer", us("timestamp"), "n_access_points")


@query
def glh_timeline_paths(spark, d):
    p, _, _, _ = glh_source.parse_segments(fx.exports(spark, d))
    return p.select("volunteer", "segment_id", us("timestamp"), "lat", "lon")


@query
def glh_visits(spark, d):
    _, v, _, _ = glh_source.parse_segments(fx.exports(spark, d))
    return v.select("volunteer", "segment_id", us("start_time"), "lat", "lon", "place_id")


@query
def glh_activities(spark, d):
    _, _, a, _ = glh_source.parse_segments(fx.exports(spark, d))
    return a.select("volunteer", "segment_id", "endpoint", us("timestamp"), "lat", "lon", "mode", *r4("distance_m"))


def _parsed(found: glh_source.Export) -> DataFrame:
    """All layers of exports in one shape."""
    doc = F.regexp_extract("volunteer", "folder=(.*)", 1).alias("doc")
    layers = {"raw_signals": found.raw_signals, "activity_records": found.activity_records, "wifi_scans": found.wifi_scans, "timeline_paths": found.timeline_paths, "visits": found.visits, "activities": found.activities, "other_segments": found.other_segments}
    out = None
    for name, df in layers.items():
        have = lambda c, kind, df=df: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
        at = have("timestamp", "timestamp") if "timestamp" in df.columns else have("start_time", "timestamp")
        own = df.select(doc, F.lit(name).alias("layer"), have("segment_id", "long").alias("segment_id"), have("endpoint", "string").alias("endpoint"), F.unix_micros(at).alias("at_us"), have("lat", "double").alias("lat"), have("lon", "double").alias("lon"))
        out = own if out is None else out.unionByName(own)
    return out


@query
def glh_parse_a(spark, d):
    """Export files of the first family, written from the events, read in byte ranges."""
    return _parsed(glh_source.parse_glh(spark, f"{fx.export_files(spark, d, 'A')}/*"))


@query
def glh_parse_b(spark, d):
    return _parsed(glh_source.parse_glh(spark, f"{fx.export_files(spark, d, 'B')}/*"))


@query
def gpx_parse(spark, d):
    p = gpx_source.parse_gpx(spark, f"{fx.track_files(spark, d)}/*", max_gap_seconds=fx.GAP_S)
    return p.select("point_id", us("timestamp"), "lat", "lon", *r4("elevation_m"), "trk_idx", "seg_idx")


@query
def load_layers(spark, d):
    """A layer written from the customers, loaded as paths."""
    n = network_source.load_path_link(spark, fx.project(spark, d, network_source.PATH_LINK_FILE))
    points = F.flatten("parts")
    return n.select("toid", "road_name", "network_kind", F.size("parts").alias("n_parts"), F.size(points).alias("n_points"), F.get(points, F.lit(0))["x"].alias("x"), F.element_at(points, -1)["y"].alias("y"))
