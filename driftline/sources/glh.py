"""Location-history exports (JSON of either family) as tables.

Files are read in byte ranges: ``json_elements`` finds the signals and segments of a file, whatever its size, by many tasks, and writes them
once; each becomes a VARIANT, written by its kind, and every layer is a projection of those of its kind. Documents that are VARIANTs already (``read_exports``, one row
each) go through the same projections. segment_id is the place of a segment in its file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline import schemas
from driftline.functions.scalars import add_latlng, first_truthy, offset_time, safe_float, to_utc
from driftline.tables import cut

from .json_elements import read_elements


@dataclass
class Export:
    """The layers of a set of files, lazily."""

    family: DataFrame
    raw_signals: DataFrame
    activity_records: DataFrame
    wifi_scans: DataFrame
    timeline_paths: DataFrame
    visits: DataFrame
    activities: DataFrame
    other_segments: DataFrame


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _there(v: Column, path: str) -> Column:
    """Whether a key is present, null or not."""
    return _at(v, path).isNotNull()


def _text(v: Column, path: str) -> Column:
    return _at(v, path, "string")


def _items(df: DataFrame, source: Column, name: str) -> DataFrame:
    """A row for each element of a VARIANT array: ``<name>`` and ``<name>_pos``."""
    spark = df.sparkSession
    kept = df.withColumn("_src", source).where("_src is not null")
    each = kept.lateralJoin(spark.tvf.variant_explode(F.col("_src").outer()))
    return each.withColumnsRenamed({"value": name, "pos": f"{name}_pos"}).drop("_src", "key")


def detect_family(v: Column) -> Column:
    """'A' for an object with segments or signals, 'B' for a list; anything else is an error."""
    shape = F.schema_of_variant(v)
    is_object = shape.startswith("OBJECT")
    return F.when(shape.startswith("ARRAY"), F.lit("B")).when(is_object & (_there(v, "$.rawSignals") | _there(v, "$.semanticSegments")), F.lit("A")).otherwise(F.raise_error(F.concat(F.lit("not a location-history export: "), shape)).cast("string"))


def read_exports(spark: SparkSession, path: str | list[str], volunteer: str | None = None) -> DataFrame:
    """source_file, volunteer and the document as VARIANT, one row for each file."""
    files = spark.read.option("wholetext", True).text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    who = F.lit(volunteer) if volunteer is not None else F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return files.select(who.cast("string").alias("volunteer"), F.url_decode(name).alias("source_file"), F.parse_json("value").alias("doc"))


def _finish(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select("volunteer", "source_file", *[F.col(f.name).cast(f.dataType) for f in schema])


def parse_raw_signals(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions, activity records and wifi scans; an entry is the first of these that it holds. A list has none."""
    signals = F.when(F.schema_of_variant("doc").startswith("OBJECT"), _at(F.col("doc"), "$.rawSignals"))
    return signal_layers(_items(docs, signals, "e"))


def _bodies(e: Column) -> list[Column]:
    return [_at(e, f"$.{k}") for k in ("position", "activityRecord", "wifiScan")]


def signal_kind(e: Column) -> Column:
    """p, a or w; null for none."""
    position, activity, wifi = _bodies(e)
    return F.when(position.isNotNull(), F.lit("p")).when(activity.isNotNull(), F.lit("a")).when(wifi.isNotNull(), F.lit("w"))


def segment_kind(s: Column) -> Column:
    return F.when(_there(s, "$.timelinePath"), F.lit("path")).when(_there(s, "$.visit"), F.lit("visit")).when(_there(s, "$.activity"), F.lit("activity")).otherwise(F.lit("other"))


def signal_layers(entry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The layers of entries (volunteer, source_file, e; kind, if it is known)."""
    e = F.col("e")
    entry = entry.withColumns({"kind": F.col("kind") if "kind" in entry.columns else signal_kind(e), "body": F.coalesce(*_bodies(e))})
    b = F.col("body")
    points = add_latlng(entry.where("kind = 'p'"), first_truthy(_at(b, "$.LatLng"), _at(b, "$.latLng")), required=True)
    number = lambda k: safe_float(_text(b, f"$.{k}"))
    points = points.withColumns({
        "timestamp": to_utc(_text(b, "$.timestamp")), "accuracy_m": number("accuracyMeters"), "altitude_m": number("altitudeMeters"),
        "speed_mps": number("speedMetersPerSecond"), "source": F.when(_there(b, "$.source"), _text(b, "$.source")).otherwise(F.lit("UNKNOWN")),
    })
    probable = _at(b, "$.probableActivities", "array<variant>")
    ranked = F.transform(probable, lambda x, i: F.struct((-F.coalesce(_at(x, "$.confidence", "double"), F.lit(0.0))).alias("less"), i.alias("i"), _text(x, "$.type").alias("type"), _at(x, "$.confidence", "double").alias("confidence")))
    records = entry.where("kind = 'a'").withColumns({"timestamp": to_utc(_text(b, "$.timestamp")), "top": F.array_min(ranked), "n_candidates": F.coalesce(F.size(F.when(probable.isNotNull(), probable)), F.lit(0))})
    records = records.withColumns({"top_activity": F.col("top.type"), "confidence": F.col("top.confidence")})
    delivered, others = (_at(b, f"$.{k}", "array<variant>") for k in ("deliveredAccessPoints", "accessPoints"))
    count = F.when(F.size(delivered) > 0, F.size(delivered)).when(others.isNotNull(), F.size(others)).otherwise(F.lit(0))
    scans = entry.where("kind = 'w'").withColumns({"timestamp": to_utc(_text(b, "$.timestamp")), "n_access_points": count})
    return _finish(points, schemas.RAW_SIGNALS), _finish(records, schemas.ACTIVITY_RECORDS), _finish(scans, schemas.WIFI_SCANS)


def parse_segments(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Timeline paths, visits, activity endpoints and other segments; a segment is the first of these that it holds."""
    doc = F.col("doc")
    segments = F.when(F.schema_of_variant(doc).startswith("ARRAY"), doc).otherwise(_at(doc, "$.semanticSegments"))
    return segment_layers(_items(docs, segments, "s"))


def segment_layers(seg: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The layers of segments (volunteer, source_file, s, s_pos; kind, if it is known)."""
    s = F.col("s")
    seg = seg.withColumns({"kind": F.col("kind") if "kind" in seg.columns else segment_kind(s), "segment_id": F.col("s_pos").cast("long"), "start": _text(s, "$.startTime"), "end": _text(s, "$.endTime")})
    seg = seg.withColumns({"start_time": to_utc(F.col("start")), "end_time": to_utc(F.col("end"))})

    path = _items(seg.where("kind = 'path'"), _at(s, "$.timelinePath"), "p")
    p = F.col("p")
    path = add_latlng(path, first_truthy(_at(p, "$.point"), _at(p, "$.latLng")), required=True)
    offset = "$.durationMinutesOffsetFromStartTime"
    when = F.when(F.coalesce(_text(p, "$.time"), F.lit("")) != "", to_utc(_text(p, "$.time"))).when(_there(p, offset), offset_time(F.col("start_time"), _text(p, offset))).otherwise(F.col("start_time"))
    paths = path.withColumns({"timestamp": when, "segment_start": F.col("start"), "segment_end": F.col("end")})

    top = lambda k: _text(s, f"$.visit.topCandidate.{k}")
    visits = add_latlng(seg.where("kind = 'visit'"), _at(s, "$.visit.topCandidate.placeLocation"), required=True).withColumns({
        "place_id": F.coalesce(F.nullif(top("placeID"), F.lit("")), top("placeId")), "semantic_type": top("semanticType"),
        "probability": top("probability"), "hierarchy_level": _text(s, "$.visit.hierarchyLevel"),
    })

    ends = seg.where("kind = 'activity'").withColumn("x", F.explode(F.array(
        F.struct(F.lit("start").alias("endpoint"), _at(s, "$.activity.start").alias("place"), F.col("start_time").alias("at")),
        F.struct(F.lit("end").alias("endpoint"), _at(s, "$.activity.end").alias("place"), F.col("end_time").alias("at")),
    )))
    activities = add_latlng(ends, F.col("x.place"), required=True).withColumns({
        "endpoint": F.col("x.endpoint"), "timestamp": F.col("x.at"),
        "mode": F.coalesce(F.nullif(_text(s, "$.activity.topCandidate.type"), F.lit("")), _text(s, "$.activity.activityType")),
        "mode_probability": _text(s, "$.activity.topCandidate.probability"), "distance_m": safe_float(_text(s, "$.activity.distanceMeters")),
        "activity_probability": safe_float(_text(s, "$.activity.probability")),
    })

    others = seg.where("kind = 'other'").withColumn("keys", F.sort_array(F.json_object_keys(F.to_json(s))))
    return _finish(paths, schemas.TIMELINE_PATHS), _finish(visits, schemas.VISITS), _finish(activities, schemas.ACTIVITIES), _finish(others, schemas.OTHER_SEGMENTS)


def parse_glh(spark: SparkSession, path: str | list[str], volunteer: str | None = None) -> Export:
    """All layers of one or many export files; a file that is neither family, or ends early, is an error."""
    elements, files = read_elements(spark, path)
    in_path = lambda i: F.url_decode(F.element_at(F.split(F.col("file"), "/"), i))
    who = [(F.lit(volunteer) if volunteer is not None else in_path(-2)).cast("string").alias("volunteer"), in_path(-1).alias("source_file")]
    family = F.when(F.col("root") == "[", "B").when((F.col("root") == "{") & F.arrays_overlap("keys", F.array(F.lit("rawSignals"), F.lit("semanticSegments"))), "A")
    files = cut(files.select(*who, family.alias("family"), (F.col("final") <= 0).alias("complete")), "export-files")
    if bad := files.where("family is null or not complete").first():
        raise ValueError(f"not a location-history export{'' if bad['complete'] else ', or one that ends early'}: {bad['source_file']}")
    elements = elements.where(F.col("key").isin("rawSignals", "semanticSegments", "")).select(*who, "key", "pos", F.parse_json("text").alias("v"))
    v = F.col("v")
    kind = F.when(F.col("key") == "rawSignals", signal_kind(v)).otherwise(segment_kind(v))
    elements = cut(elements.select("volunteer", "source_file", "pos", "v", kind.alias("kind")), "export-elements", "kind")  # each layer reads its own
    signals = elements.where(F.col("kind").isin("p", "a", "w")).select("volunteer", "source_file", "kind", v.alias("e"))
    segments = elements.where(F.col("kind").isin("path", "visit", "activity", "other")).select("volunteer", "source_file", "kind", v.alias("s"), F.col("pos").alias("s_pos"))
    return Export(files.select("volunteer", "source_file", "family"), *signal_layers(signals), *segment_layers(segments))


def parse_volunteer_folder(spark: SparkSession, folder: str, volunteer: str | None = None) -> Export | None:
    """The largest ``.json`` of a folder (the first by name on ties); None if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{folder.rstrip('/')}/*").where(F.lower("path").endswith(".json"))
    best = files.select("path", "length").orderBy(F.desc("length"), "path").first()
    return parse_glh(spark, best["path"], volunteer if volunteer is not None else folder.rstrip("/").rsplit("/", 1)[-1]) if best else None
