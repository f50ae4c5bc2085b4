"""Tracks, networks, buildings and exports derived from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.features import Networks
from driftline.tables import new_path

#: Sessions of the derived tracks: gap and bracket that suit their density.
GAP_S, BRACKET_S = 3600, 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str, volunteers: int = 2) -> DataFrame:
    """One point for each event: position, accuracy and kind by its id, volunteer by its user."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = F.col("event_id")
    accuracy = F.when(e % 7 == 0, F.lit(100.0)).when(e % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(
        e.alias("ord"), (F.col("user_id") % volunteers).cast("string").alias("volunteer"),
        F.when(e % 5 == 0, "GLH").otherwise("GPX").alias("kind"), F.when(e % 10 == 0, "raw_signals").otherwise("timeline_paths").alias("glh_layer"),
        F.col("ts").cast("timestamp").alias("timestamp"), (F.lit(55.78) + (e * 37 % 300) / F.lit(1000.0)).alias("lat"), (F.lit(-3.45) + (e * 53 % 500) / F.lit(1000.0)).alias("lon"),
        accuracy.cast("double").alias("accuracy_m"), F.col("event_type").alias("source"), (F.col("value") / 10).alias("speed_mps"),
        (F.lit(325000.0) + e * 37 % 1000).alias("east"), (F.lit(673000.0) + e * 53 % 1000).alias("north"), F.col("user_id"),
    )


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street for each nation: a line to the north."""
    k = F.col("n_nationkey").cast("long")
    x = F.lit(325000.0) + 40 * k
    point = lambda y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    return table(spark, sf_dir, "nation").select(k.alias("edge_ord"), F.concat(F.lit("t"), k.cast("string")).alias("toid"), F.when(k % 2 == 0, "carriageway").otherwise("pedestrian").alias("network_kind"), F.col("n_name").alias("road_name"), F.array(F.array(point(673000.0), point(674000.0))).alias("parts"))


def networks(spark: SparkSession, sf_dir: str) -> Networks:
    full = network(spark, sf_dir)
    return Networks(full.where("network_kind = 'carriageway'"), full.where("network_kind = 'pedestrian'"), full)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of 12 by 8 metres for each supplier."""
    k = F.col("s_suppkey").cast("long")
    x, y = F.lit(325000.0) + k * 37 % 1000, F.lit(673000.0) + k * 71 % 1000
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(point(0.0, 0.0), point(12.0, 0.0), point(12.0, 8.0), point(0.0, 8.0), point(0.0, 0.0))
    return table(spark, sf_dir, "supplier").select(k.alias("b_ord"), k.cast("string").alias("osm_id"), F.array(ring).alias("parts"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a signal (by id modulo 3: position, activity, wifi) and as a segment of an export, as JSON."""
    t = tracks(spark, sf_dir)
    e, when = F.col("ord"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = lambda c: F.concat(c.cast("string"), F.lit("°"))
    coord = F.concat(text(F.col("lat")), F.lit(", "), text(F.col("lon")))
    position = F.struct(coord.alias("LatLng"), when.alias("timestamp"), F.col("accuracy_m").alias("accuracyMeters"), F.col("source").alias("source"))
    kinds = F.array(F.struct(F.col("source").alias("type"), F.lit(0.5).alias("confidence")), F.struct(F.lit("STILL").alias("type"), ((e % 10) / 10.0).alias("confidence")))
    activity = F.struct(kinds.alias("probableActivities"), when.alias("timestamp"))
    wifi = F.struct(F.array_repeat(F.struct(F.lit(1).alias("mac")), (e % 4).cast("int")).alias("deliveredAccessPoints"), when.alias("timestamp"))
    signal = F.struct(F.when(e % 3 == 0, position).alias("position"), F.when(e % 3 == 1, activity).alias("activityRecord"), F.when(e % 3 == 2, wifi).alias("wifiScan"))
    path = F.struct(F.array(F.struct(coord.alias("point"), (e % 60).cast("string").alias("durationMinutesOffsetFromStartTime"))).alias("timelinePath"), when.alias("startTime"), when.alias("endTime"))
    visit = F.struct(F.struct(F.struct(F.struct(coord.alias("latLng")).alias("placeLocation"), F.concat(F.lit("p"), e.cast("string")).alias("placeID")).alias("topCandidate")).alias("visit"), when.alias("startTime"), when.alias("endTime"))
    moved = F.struct(F.struct(coord.alias("start"), coord.alias("end"), F.lit("WALKING").alias("activityType"), F.col("speed_mps").cast("string").alias("distanceMeters")).alias("activity"), when.alias("startTime"), when.alias("endTime"))
    segment = F.when(e % 3 == 0, F.to_json(path)).when(e % 3 == 1, F.to_json(visit)).otherwise(F.to_json(moved))
    return t.select("user_id", "ord", F.to_json(signal).alias("signal"), segment.alias("segment"))


def _document(rows: DataFrame, by: list[str], family: str = "A") -> DataFrame:
    """``by`` and a document (text) of the entries of each group, in order."""
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "signal", "segment"))).alias("rows"))
    joined = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), ",")
    list_ = F.concat(F.lit("["), joined("segment"), F.lit("]"))
    doc = list_ if family == "B" else F.concat(F.lit('{"rawSignals":['), joined("signal"), F.lit('],"semanticSegments":'), list_, F.lit("}"))
    return groups.select(*by, doc.alias("doc"))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export documents, one for each user."""
    docs = _document(entries(spark, sf_dir), ["user_id"])
    return docs.select(F.col("user_id").cast("string").alias("volunteer"), F.lit("export.json").alias("source_file"), F.parse_json("doc").alias("doc"))


#: Events of a file: each volunteer of eight has one file for so many event ids.
FILE_EVENTS = 4000


def _files(rows: DataFrame, name: str) -> str:
    """A file for each row (folder, value) in the shared folder."""
    path = new_path(rows.sparkSession, name)
    rows.select("value", "folder").repartition("folder").write.partitionBy("folder").text(path)
    return path


def _folder() -> tuple:
    return (F.concat_ws("_", (F.col("user_id") % 8).cast("string"), F.floor(F.col("ord") / FILE_EVENTS).cast("string"))).alias("folder")


def export_files(spark: SparkSession, sf_dir: str, family: str) -> str:
    """Where export files of bounded size are written: folder=<volunteer>_<part>."""
    rows = entries(spark, sf_dir).select(_folder(), "ord", "signal", "segment")
    return _files(_document(rows, ["folder"], family).withColumnRenamed("doc", "value"), f"exports-{family}")


def track_files(spark: SparkSession, sf_dir: str) -> str:
    """GPX files: one track of two segments (even and odd ids), every 9th point without time and every 5th without height."""
    t, e = tracks(spark, sf_dir), F.col("ord")
    text = lambda name, value, there: F.when(there, F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))).otherwise(F.lit(""))
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    point = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('">'), text("ele", F.col("speed_mps").cast("string"), e % 5 != 0), text("time", at, e % 9 != 0), F.lit("</trkpt>"))
    rows = t.select(_folder(), (e % 2).alias("seg"), F.struct("ord", point.alias("p")).alias("x"))
    segments = rows.groupBy("folder", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "").alias("points"))
    own = segments.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("seg", "points"))).alias("s"))
    body = F.array_join(F.transform("s", lambda s: F.concat(F.lit("<trkseg>"), s["points"], F.lit("</trkseg>"))), "")
    return _files(own.select("folder", F.concat(F.lit('<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk>'), body, F.lit("</trk></gpx>")).alias("value")), "tracks")


def project(spark: SparkSession, sf_dir: str, file: str) -> str:
    """A project folder whose layer ``file`` (CSV with WKT) has a bent path of two parts for each customer."""
    root, k = new_path(spark, "project"), F.col("c_custkey").cast("long")
    at = lambda dx, dy: F.concat_ws(" ", (325000 + k % 997 + dx).cast("string"), (673000 + k * 7 % 991 + dy).cast("string"))
    wkt = F.concat(F.lit("MULTILINESTRING (("), F.concat_ws(", ", at(0, 0), at(5, 0), at(5, 12)), F.lit("), ("), F.concat_ws(", ", at(20, 0), at(20, 9)), F.lit("))"))
    rows = table(spark, sf_dir, "customer").select(k.alias("identifier"), F.col("c_name").alias("pathname"), wkt.alias("wkt"))
    rows.write.option("header", True).csv(f"{root}/map/{file}.csv")
    return root
