"""Planar geometry as expressions on arrays of segments (x1, y1, x2, y2) and rings of points (x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .projection import to_bng


def segments_of(parts: Column) -> Column:
    """Lines or rings as one array of segments with their ordinal."""
    ring = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(F.get(p, i - 1)["x"].alias("x1"), F.get(p, i - 1)["y"].alias("y1"), F.get(p, i)["x"].alias("x2"), F.get(p, i)["y"].alias("y2")))
    flat = F.flatten(F.transform(F.filter(parts, lambda p: F.size(p) > 1), ring))
    return F.transform(flat, lambda s, i: F.struct(i.alias("seg"), s["x1"].alias("x1"), s["y1"].alias("y1"), s["x2"].alias("x2"), s["y2"].alias("y2")))


def nearest_on(segment: Column, x: Column, y: Column) -> Column:
    """Distance, ordinal and foot of the perpendicular (clamped to the ends) on one segment: a struct that sorts by distance."""
    dx, dy = segment["x2"] - segment["x1"], segment["y2"] - segment["y1"]
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - segment["x1"]) * dx + (y - segment["y1"]) * dy) / length2))).otherwise(F.lit(0.0))
    px, py = segment["x1"] + t * dx, segment["y1"] + t * dy
    return F.struct(F.hypot(x - px, y - py).alias("d"), segment["seg"].alias("seg"), px.alias("px"), py.alias("py"))


def nearest_point(segments: Column, x: Column, y: Column) -> Column:
    """The nearest point of a geometry: (d, seg, px, py); the first segment on ties."""
    return F.array_min(F.transform(segments, lambda s: nearest_on(s, x, y)))


def crosses(s: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point towards rising x crosses a segment."""
    return ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])


def crossings(segments: Column, x: Column, y: Column) -> Column:
    """How many segments a ray towards rising x crosses."""
    return F.size(F.filter(segments, lambda s: crosses(s, x, y)))


def polygon_distance(segments: Column, x: Column, y: Column) -> Column:
    """0 inside and on the boundary, else the distance to the nearest edge."""
    return F.when(crossings(segments, x, y) % 2 == 1, F.lit(0.0)).otherwise(nearest_point(segments, x, y)["d"])


def strictly_within(segments: Column, x: Column, y: Column) -> Column:
    """Inside, the boundary excluded."""
    return (crossings(segments, x, y) % 2 == 1) & (nearest_point(segments, x, y)["d"] > 0)


def area(segments: Column) -> Column:
    """Shoelace area; holes run against their shells."""
    return F.abs(F.aggregate(segments, F.lit(0.0), lambda total, s: total + (s["x1"] * s["y2"] - s["x2"] * s["y1"]) / 2))


def bounds(segments: Column) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax."""
    side = lambda pick, a, b: pick(F.transform(segments, lambda s: (F.least if pick is F.array_min else F.greatest)(s[a], s[b])))
    return {"xmin": side(F.array_min, "x1", "x2"), "ymin": side(F.array_min, "y1", "y2"), "xmax": side(F.array_max, "x1", "x2"), "ymax": side(F.array_max, "y1", "y2")}


def reproject(layer: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """Geometry from longitude and latitude (x, y) to the grid: points are taken apart, projected and put back in order."""
    flat = layer.select(key, F.posexplode(parts).alias("_i", "_line")).select(key, "_i", F.posexplode("_line").alias("_j", "_p"))
    flat = to_bng(flat.select(key, "_i", "_j", F.col("_p.y").alias("_lat"), F.col("_p.x").alias("_lon")), "_lat", "_lon", "_e", "_n")
    in_order = lambda a: F.transform(F.array_sort(a), lambda s: s["v"])
    lines = flat.groupBy(key, "_i").agg(in_order(F.collect_list(F.struct(F.col("_j").alias("o"), F.struct(F.col("_e").alias("x"), F.col("_n").alias("y")).alias("v")))).alias("_line"))
    shapes = lines.groupBy(key).agg(in_order(F.collect_list(F.struct(F.col("_i").alias("o"), F.col("_line").alias("v")))).alias("_parts"))
    return layer.join(shapes, key, "left").withColumn(parts, F.col("_parts")).drop("_parts")
