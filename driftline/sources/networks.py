"""Road, path and building layers: readers, attribute maps, combined networks and their parquet caches.

A layer is a table with ``parts``: its lines or rings as arrays of points on the grid. Layers come as parquet
(with ``parts``), as WKT or GeoJSON text, or as shapefiles. ``record`` is the place of a feature in its layer (file, offset of
the split, row), which orders features alike however files are split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from driftline.functions.geometry import reproject
from driftline.operators.features import Networks

from .shapefile import read_shapefile

# File names and attribute maps of the layers: fixed values.
ROAD_LINK_FILE, CONNECTING_LINK_FILE, PATH_LINK_FILE, STREET_FILE = "main_ExportFeature1", "main_connectinglink1", "main_pathlink1", "main_Street"
ROAD_LINK = {"TOID": "toid", "roadname": "road_name", "roadname_l": "road_name_alt", "roadclassi": "road_class", "formofway": "form_of_way", "averagewid": "average_width_m", "minimumwid": "minimum_width_m", "cyclefacil": "cycle_facility", "wholelink": "whole_link", "roadstruct": "road_structure"}
CONNECTING_LINK = {"TOID": "toid", "pathnode": "path_node", "connecting": "connecting"}
PATH_LINK = {"identifier": "toid", "pathname": "road_name", "length": "length_m", "cyclefacil": "cycle_facility", "wholelink": "whole_link"}
STREET = {"USRN": "usrn", "name": "street_name", "streettype": "street_type", "town": "town", "administra": "administrative_area", "locality": "locality", "descriptor": "descriptor", "roadclassi": "road_classification"}
OSM_ROAD = {"name": "road_name", "fclass": "road_class", "ref": "road_ref", "oneway": "osm_oneway", "maxspeed": "osm_maxspeed", "bridge": "osm_bridge", "tunnel": "osm_tunnel"}
BUILDING = ("osm_id", "code", "fclass", "name", "type")
OSM_ROAD_FILES = {"Glasgow_streets": "Glasgow", "manchester_gis_osm_roads_free_1": "Manchester", "London_gis_osm_roads_free_1": "London", "lancashire_gis_osm_roads_free_1": "Lancashire", "Cumbria_gis_osm_roads_free_1": "Cumbria"}
BUILDING_FILES = {"buildings": "Edinburgh", "Glasgow_buildings": "Glasgow", "manchester_gis_osm_buildings_a_free_1": "Manchester", "London_gis_osm_buildings_a_free_1": "London", "lancashire_gis_osm_buildings_a_free_1": "Lancashire", "Cumbria_gis_osm_buildings_a_free_1": "Cumbria"}
CARRIAGEWAY_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service", "track", "track_grade1", "track_grade2", "track_grade3", "track_grade4", "track_grade5", "road")
PEDESTRIAN_CLASSES = ("footway", "pedestrian", "path", "bridleway", "cycleway", "steps", "corridor")


def classify_osm(fclass: Column) -> Column:
    """osm_carriageway, osm_pedestrian or osm_other (null too)."""
    c = F.lower(F.trim(fclass))
    return F.when(c.isin(*CARRIAGEWAY_CLASSES), F.lit("osm_carriageway")).when(c.isin(*PEDESTRIAN_CLASSES), F.lit("osm_pedestrian")).otherwise(F.lit("osm_other"))


def parts_of_wkt(wkt: Column) -> Column:
    """Points of a (MULTI)LINESTRING or (MULTI)POLYGON text."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda t: F.struct(F.split(F.trim(t), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(t), r"\s+")[1].cast("double").alias("y"))
    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


def parts_of_geojson(geometry: Column) -> Column:
    """Points of a GeoJSON geometry text of the same kinds."""
    kind = F.get_json_object(geometry, "$.type")
    at = lambda shape: F.from_json(F.get_json_object(geometry, "$.coordinates"), shape)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line, lines, many = at("array<array<double>>"), at("array<array<array<double>>>"), at("array<array<array<array<double>>>>")
    ring = lambda r: F.transform(r, point)
    return F.when(kind == "LineString", F.transform(F.array(line), ring)).when(kind.isin("MultiLineString", "Polygon"), F.transform(lines, ring)).when(kind == "MultiPolygon", F.transform(F.flatten(many), ring))


def read_features(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A layer of ``<root>/map`` with its attributes, ``parts`` and ``crs`` (null: unknown); None if it is not there.

    Looked for as parquet, as GeoJSON sequence, as CSV with a ``wkt`` column, and as shapefile.
    """
    base = f"{root.rstrip('/')}/map/{name}"
    for suffix, read in (
        (".parquet", lambda p: spark.read.parquet(p).withColumn("record", _record(F.col("_metadata.row_index")))),
        (".geojsonl", lambda p: _geojson(spark, p)),
        (".csv", lambda p: spark.read.option("header", True).csv(p).withColumns({"record": _record(), "parts": parts_of_wkt(F.col("wkt"))}).drop("wkt")),
        (".shp", lambda p: read_shapefile(spark, p.removesuffix(".shp"))),
    ):
        try:
            found = read(base + suffix)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        return found if "crs" in found.columns else found.withColumn("crs", F.lit(None).cast("string"))
    return None


def _record(row: Column | None = None) -> Column:
    """File, offset of the split and row: rows of a split come in order, so this is the order of the file however it is split."""
    at = F.lit(0).cast("long") if row is not None else F.col("_metadata.file_block_start")
    return F.struct(F.col("_metadata.file_path").alias("file"), at.alias("split"), (F.monotonically_increasing_id() if row is None else row).alias("row"))


def _geojson(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    names = sorted({k for r in lines.select(F.explode(F.json_object_keys(F.get_json_object("value", "$.properties"))).alias("k")).distinct().collect() for k in [r["k"]]})
    return lines.select(*[F.get_json_object("value", f"$.properties.{k}").alias(k) for k in names], _record().alias("record"), parts_of_geojson(F.get_json_object("value", "$.geometry")).alias("parts"))


def _on_grid(layer: DataFrame, default_crs: str) -> DataFrame:
    """Parts on the grid: what is in degrees (by its crs, else the default) is reprojected."""
    layer = layer.withColumn("_crs", F.coalesce("crs", F.lit(default_crs)))
    degrees = layer.where("_crs <> '27700'")
    return layer.where("_crs = '27700'").unionByName(reproject(degrees, "record")).drop("_crs", "crs")


def _kept(layer: DataFrame, keep: dict[str, str]) -> DataFrame:
    present = {s: d for s, d in keep.items() if s in layer.columns}
    return layer.select(*[F.col(s).cast("string").alias(d) for s, d in present.items()], "parts", "record")


def _load(spark: SparkSession, root: str, name: str, keep: dict[str, str], kind: str) -> DataFrame:
    layer = read_features(spark, root, name)
    if layer is None:
        raise FileNotFoundError(f"{root}/map/{name}")
    return _kept(_on_grid(layer, "27700"), keep).withColumn("network_kind", F.lit(kind))


def load_road_link(spark: SparkSession, root: str = ".") -> DataFrame:
    return _load(spark, root, ROAD_LINK_FILE, ROAD_LINK, "road_link")


def load_connecting_link(spark: SparkSession, root: str = ".") -> DataFrame:
    return _load(spark, root, CONNECTING_LINK_FILE, CONNECTING_LINK, "connecting_link")


def load_path_link(spark: SparkSession, root: str = ".") -> DataFrame:
    return _load(spark, root, PATH_LINK_FILE, PATH_LINK, "path_link")


def load_street(spark: SparkSession, root: str = ".") -> DataFrame:
    return _load(spark, root, STREET_FILE, STREET, "street")


def load_osm_roads_for_city(spark: SparkSession, root: str, name: str, city: str) -> DataFrame:
    """Roads of a city by kind; what is neither for vehicles nor for feet goes before anything else is done."""
    layer = read_features(spark, root, name)
    if layer is None:
        raise FileNotFoundError(f"{root}/map/{name}")
    fclass = F.col("fclass").cast("string") if "fclass" in layer.columns else F.lit(None).cast("string")
    layer = layer.withColumn("network_kind", classify_osm(fclass)).where("network_kind <> 'osm_other'")
    layer = _on_grid(layer, "4326")
    toid = [F.concat(F.lit("osm_"), F.col("osm_id").cast("string")).alias("toid")] if "osm_id" in layer.columns else []
    present = [F.col(s).cast("string").alias(d) for s, d in OSM_ROAD.items() if s in layer.columns]
    return layer.select(*toid, *present, "network_kind", F.lit(city).alias("city"), "parts", "record")


def _osm(spark: SparkSession, root: str, kind: str) -> list[DataFrame]:
    out = []
    for name, city in OSM_ROAD_FILES.items():
        try:
            out.append(load_osm_roads_for_city(spark, root, name, city).where(F.col("network_kind") == kind))
        except FileNotFoundError:
            continue
    return out


def combine(parts: list[DataFrame]) -> DataFrame:
    """Union in the given order, each part by its ``record``; of a toid the first is kept (missing toids are equal); edge_ord rises in that order."""
    ordered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)
    if "toid" in union.columns:
        first = Window.partitionBy("toid").orderBy("_part", "record")
        union = union.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return _numbered(union, "edge_ord")


def _numbered(union: DataFrame, name: str) -> DataFrame:
    """Numbers that rise with part and record (a distributed sort; they need not be dense)."""
    return union.orderBy("_part", "record").withColumn(name, F.monotonically_increasing_id()).drop("_part", "record")


def cached(spark: SparkSession, path: str | None, force_rebuild: bool, build) -> DataFrame:
    """A parquet cache: read if there, unless it is to be rebuilt."""
    if path is None:
        return build()
    if not force_rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _cache_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/outputs/cache/networks/{name}.parquet"


def load_carriageway_network(spark: SparkSession, root: str = ".", force_rebuild: bool = False) -> DataFrame:
    """Road and connecting links, and the carriageways of the cities that are there."""
    return cached(spark, _cache_path(root, "carriageway_network"), force_rebuild, lambda: combine([load_road_link(spark, root), load_connecting_link(spark, root), *_osm(spark, root, "osm_carriageway")]))


def load_pedestrian_network(spark: SparkSession, root: str = ".", force_rebuild: bool = False) -> DataFrame:
    return cached(spark, _cache_path(root, "pedestrian_network"), force_rebuild, lambda: combine([load_path_link(spark, root), *_osm(spark, root, "osm_pedestrian")]))


def load_full_network(spark: SparkSession, root: str = ".", force_rebuild: bool = False) -> DataFrame:
    """Both, not deduplicated across; carriageways come first."""
    def build() -> DataFrame:
        car, ped = load_carriageway_network(spark, root, force_rebuild), load_pedestrian_network(spark, root, force_rebuild)
        shifted = ped.withColumn("edge_ord", F.col("edge_ord") + F.lit(1 << 62))
        return car.unionByName(shifted, allowMissingColumns=True)

    return cached(spark, _cache_path(root, "full_network"), force_rebuild, build)


def load_streets(spark: SparkSession, root: str = ".", force_rebuild: bool = False) -> DataFrame:
    """Named streets, for labels only."""
    return cached(spark, _cache_path(root, "streets"), force_rebuild, lambda: load_street(spark, root).drop("record"))


def load_all_networks(spark: SparkSession, root: str = ".", force_rebuild: bool = False) -> Networks:
    return Networks(*[f(spark, root, force_rebuild) for f in (load_carriageway_network, load_pedestrian_network, load_full_network, load_streets)])


def load_buildings(spark: SparkSession, root: str = ".", cache_path: str | None = None, force_rebuild: bool = False) -> DataFrame:
    """Footprints of all cities that are there (an error if none is), with b_ord; nothing is deduplicated."""
    def build() -> DataFrame:
        found = []
        for name, city in BUILDING_FILES.items():
            layer = read_features(spark, root, name)
            if layer is not None:
                layer = _on_grid(layer, "4326")
                found.append(layer.select(*[F.col(c).cast("string").alias(c) for c in BUILDING if c in layer.columns], F.lit(city).alias("city"), "parts", "record", F.lit(len(found)).alias("_part")))
        if not found:
            raise FileNotFoundError(f"{root}/map: no building layer")
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        return _numbered(union, "b_ord")

    return cached(spark, cache_path, force_rebuild, build)
