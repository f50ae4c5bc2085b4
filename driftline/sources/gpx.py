"""GPX tracks through Spark's XML source: a row for each track point, with sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import to_utc
from driftline.operators.sessionize import sessionise_track_segments
from driftline.schemas import GPX_POINTS

_POINT = "_lat string, _lon string, ele string, time string"
_SCHEMA = f"trk array<struct<trkseg: array<struct<trkpt: array<struct<{_POINT.replace(' string', ': string')}>>>>>>"


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, source_path, trk_idx, seg_idx, timestamp, lat, lon, elevation_m of all points, in file order by ``ord``."""
    files = spark.read.schema(_SCHEMA).format("xml").option("rowTag", "gpx").load(path)
    files = files.withColumn("source_path", F.input_file_name()).withColumn("source_file", F.url_decode(F.element_at(F.split("source_path", "/"), -1)))
    tracks = files.select("source_file", "source_path", F.posexplode("trk").alias("trk_idx", "t"))
    segments = tracks.select("source_file", "source_path", "trk_idx", F.posexplode("t.trkseg").alias("seg_idx", "s"))
    points = segments.select("source_file", "source_path", "trk_idx", "seg_idx", F.posexplode("s.trkpt").alias("ord", "p"))
    number = lambda c: F.col(c).try_cast("double")
    return points.select("source_file", "source_path", F.col("trk_idx").cast("long"), F.col("seg_idx").cast("long"), F.col("ord").cast("long"), to_utc(F.col("p.time")).alias("timestamp"), number("p._lat").alias("lat"), number("p._lon").alias("lon"), number("p.ele").alias("elevation_m"))


def parse_gpx(spark: SparkSession, path: str | list[str], max_gap_seconds: float | None = None, volunteer: str | None = None, base_session_id: int = 0) -> DataFrame:
    """Track points with session_id (going on over files, in order of name) and point_id; points without time or place go."""
    points = read_points(spark, path)
    if volunteer is not None:
        points = points.withColumn("volunteer", F.lit(volunteer))
    done = sessionise_track_segments(points, max_gap_seconds, base_session_id)
    return done.select(*(["volunteer"] if volunteer is not None else []), *[F.col(f.name).cast(f.dataType) for f in GPX_POINTS])


def parse_volunteer_folder(spark: SparkSession, folder: str, max_gap_seconds: float | None = None, volunteer: str | None = None) -> DataFrame:
    """Every ``.gpx`` of a folder."""
    return parse_gpx(spark, f"{folder.rstrip('/')}/*.[gG][pP][xX]", max_gap_seconds, volunteer if volunteer is not None else folder.rstrip("/").rsplit("/", 1)[-1])
