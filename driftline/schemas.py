"""Column names and types of every layer; readers and operators return exactly these."""

from pyspark.sql import types as T

_D, _L, _S, _TS, _B = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW_SIGNALS = _schema(timestamp=_TS, lat=_D, lon=_D, accuracy_m=_D, altitude_m=_D, speed_mps=_D, source=_S)
ACTIVITY_RECORDS = _schema(timestamp=_TS, top_activity=_S, confidence=_D, n_candidates=_L)
WIFI_SCANS = _schema(timestamp=_TS, n_access_points=_L)
TIMELINE_PATHS = _schema(segment_id=_L, timestamp=_TS, lat=_D, lon=_D, segment_start=_S, segment_end=_S)
VISITS = _schema(segment_id=_L, start_time=_TS, end_time=_TS, lat=_D, lon=_D, place_id=_S, semantic_type=_S, probability=_S, hierarchy_level=_S)
ACTIVITIES = _schema(segment_id=_L, endpoint=_S, timestamp=_TS, lat=_D, lon=_D, mode=_S, mode_probability=_S, distance_m=_D, activity_probability=_D)
OTHER_SEGMENTS = _schema(segment_id=_L, start_time=_TS, end_time=_TS, keys=T.ArrayType(_S))
GPX_POINTS = _schema(source_file=_S, session_id=_L, point_id=_L, timestamp=_TS, lat=_D, lon=_D, elevation_m=_D, trk_idx=_L, seg_idx=_L)
MATCHED = _schema(
    volunteer=_S, glh_layer=_S, glh_session_id=_L, gpx_session_id=_L, timestamp=_TS,
    glh_lat=_D, glh_lon=_D, glh_east=_D, glh_north=_D, glh_accuracy_m=_D, glh_source=_S, glh_speed_mps=_D,
    gpx_lat=_D, gpx_lon=_D, gpx_east=_D, gpx_north=_D,
    bracket_dt_prev_s=_D, bracket_dt_next_s=_D, bracket_total_s=_D, deviation_m=_D, matched=_B,
)
#: Lines or rings of a geometry: arrays of points.
PARTS = T.ArrayType(T.ArrayType(_schema(x=_D, y=_D)))
