"""Joins of points with lines and polygons through a grid, as pairs of rows.

What is asked depends on the coordinates alone, so it is worked out once for each different pair of coordinates and joined
back to the points; a place that many points share is one row. Coordinates meet features by an equi-join on grid
cells. Nothing is gathered by cell: candidates are rows, bounded by the envelopes in the condition of the join, measured by
generated code and aggregated by coordinates, so a dense cell costs time in proportion and no memory.

The grid has cells of several sizes, and a feature lies in those that suit its own extent (nine cells at most, bar the
largest), so a long road or a large building is no flood of rows. Searches for the nearest feature go outwards in rings: where a
cell close by is known to hold a piece of a feature, only the inner ring is searched.

Points are read once for each table that is asked and once to join back: give a stored table (``tables.cut``) where they
are dear to make.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import area, bounds, crosses, nearest_on, segments_of
from driftline.functions.projection import to_wgs84

MAX_SNAP_M, MAX_SEARCH_M, BUILDING_SEARCH_M, HMM_RADIUS_M, HMM_K = 100.0, 500.0, 200.0, 100.0, 5
#: The inner ring as a share of the reach.
INNER = 0.2
#: Sizes of cells: the smallest is twice the reach, each next one four times as large.
SIZES, FACTOR = 5, 4
#: Cells are left this much wider than exact arithmetic needs, in metres.
SLACK = 1e-3
# Attribute columns of a snap, and where they come from in order of preference: fixed values.
ATTRIBUTES = {
    "toid": ("toid",),  # names are matched without case
    "network_kind": ("network_kind",),
    "road_name": ("road_name", "road_name_alt", "street_name", "pathname", "name"),
    "road_class": ("road_class", "road_classification", "roadclassi", "roadclas_1", "fclass"),
    "form_of_way": ("form_of_way", "formofway", "formofway_"),
    "city": ("city",),
}


def _cell(x: Column, size: Column | float) -> Column:
    return F.floor(x / size).cast("long")


def _pick(values: list[float], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), i + 1)


def coordinates(points: DataFrame, east: str, north: str) -> DataFrame:
    """The different coordinates (x, y) of the points; missing ones ask nothing."""
    x, y = F.col(east).cast("double"), F.col(north).cast("double")
    return points.select(x.alias("x"), y.alias("y")).where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).distinct()


def join_back(points: DataFrame, found: list[DataFrame], east: str, north: str) -> DataFrame:
    """Points with what was found for their coordinates, null where nothing was."""
    both = reduce(lambda a, b: a.join(b, ["x", "y"], "full"), found).withColumnsRenamed({"x": "_x", "y": "_y"})
    return points.join(both, (F.col(east) == F.col("_x")) & (F.col(north) == F.col("_y")), "left").drop("_x", "_y")


def _in_cells(items: DataFrame, radii: list[float]) -> DataFrame:
    """Items (with xmin..ymax) in the cells, of the size that suits their extent, where something within a ring's radius can lie."""
    rows = items.withColumn("ring", F.explode(F.array(*map(F.lit, range(len(radii))))))
    reach = _pick(radii, F.col("ring"))
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.least(F.lit(SIZES - 1), F.greatest(F.lit(0), F.ceil(F.log(float(FACTOR), F.greatest(extent, F.lit(1e-9)) / (2 * reach))).cast("int")))
    rows = rows.withColumn("level", level).withColumn("_size", 2 * reach * F.pow(F.lit(float(FACTOR)), F.col("level")))
    across = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo) - reach - SLACK, F.col("_size")), _cell(F.col(hi) + reach + SLACK, F.col("_size"))))
    return rows.withColumn("cx", across("xmin", "xmax")).withColumn("cy", across("ymin", "ymax")).drop("_size")


def _probes(at: DataFrame, radii: list[float]) -> DataFrame:
    """Coordinates (x, y, ring) as the cells they ask, one of each size; ``radius`` is their ring's."""
    rows = at.withColumn("radius", _pick(radii, F.col("ring"))).withColumn("level", F.explode(F.array(*map(F.lit, range(SIZES)))))
    size = 2 * F.col("radius") * F.pow(F.lit(float(FACTOR)), F.col("level"))
    return rows.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})


def _envelope_distance() -> Column:
    gap = lambda lo, hi, v: F.greatest(F.col(lo) - F.col(v), F.lit(0.0), F.col(v) - F.col(hi))
    return F.hypot(gap("xmin", "xmax", "x"), gap("ymin", "ymax", "y"))


def _meet(at: DataFrame, items: DataFrame, radii: list[float], outer: Column | None = None) -> DataFrame:
    """Pairs of coordinates and items whose envelope lies within the radius of the ring that is asked (for ring 0: that ``outer`` accepts)."""
    near = _envelope_distance() <= F.col("radius") + SLACK
    wanted = near if outer is None else F.when(F.col("ring") == 0, outer).otherwise(near)
    keys = ["ring", "level", "cx", "cy"]
    cells = _in_cells(items, radii).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    return _probes(at, radii).join(cells, same & wanted).drop(*keys, *[f"_{k}" for k in keys])


def _ringed(at: DataFrame, segments: DataFrame, reach: float) -> tuple[DataFrame, list[float]]:
    """Coordinates with the ring to search: 1, the inner one, where a cell next to theirs holds a point of a segment, which is then within it."""
    inner = reach * INNER
    size = inner / 2.83  # two cells away at most: inner is over the diagonal of two by two
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / (2 * size))).cast("int")
    along = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    spot = lambda a, b: _cell(F.col(a) + F.col("_i") / F.col("_n") * (F.col(b) - F.col(a)), size)
    held = along.select(spot("x1", "x2").alias("_cx"), spot("y1", "y2").alias("_cy")).distinct()
    beside = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    known = held.select(beside("_cx"), "_cy").select("_cx", beside("_cy")).distinct()
    rows = at.join(known, (_cell(F.col("x"), size) == F.col("_cx")) & (_cell(F.col("y"), size) == F.col("_cy")), "left")
    return rows.select("x", "y", F.when(F.col("_cx").isNotNull(), 1).otherwise(0).alias("ring")), [reach, inner]


# --- lines


def edges(network: DataFrame, attributes: bool = True) -> DataFrame:
    """A row for each segment of the network: edge_ord, attrs, s (the segment), its ends and envelope."""
    attrs, known = [], {c.lower() for c in network.columns}
    for name, sources in ATTRIBUTES.items() if attributes else ():
        have = [F.col(c) for c in sources if c in known]
        attrs.append((F.coalesce(*have) if have else F.lit(None)).cast("string").alias(name))
    segs = network.select("edge_ord", *([F.struct(*attrs).alias("attrs")] if attributes else []), F.explode(segments_of(F.col("parts"))).alias("s"))
    segs = segs.withColumns({c: F.col(f"s.{c}") for c in ("x1", "y1", "x2", "y2")})
    return segs.withColumns({"xmin": F.least("x1", "x2"), "xmax": F.greatest("x1", "x2"), "ymin": F.least("y1", "y2"), "ymax": F.greatest("y1", "y2")})


def snaps(at: DataFrame, network: DataFrame, cap: float) -> DataFrame:
    """x, y and best (d, edge_ord, seg, px, py, attrs): the nearest point of the network within ``cap``; the first edge on ties."""
    lines = edges(network)
    ringed, radii = _ringed(at, lines, cap)
    foot = nearest_on(F.col("s"), F.col("x"), F.col("y"))
    met = _meet(ringed, lines, radii).select("x", "y", "edge_ord", "attrs", foot.alias("f")).where(F.col("f.d") <= cap)
    return met.groupBy("x", "y").agg(F.min(F.struct("f.d", "edge_ord", "f.seg", "f.px", "f.py", "attrs")).alias("best"))


def snap_columns(best: Column, prefix: str, compat_attrs: bool = False) -> dict[str, Column]:
    named = "snap_" if compat_attrs else prefix
    return {f"{prefix}east": best["px"], f"{prefix}north": best["py"], f"{prefix}distance_m": best["d"], **{f"{named}{a}": best["attrs"][a] for a in ATTRIBUTES}}


def snap_points_to_network(points: DataFrame, network: DataFrame, east_col: str = "east", north_col: str = "north", max_snap_m: float = MAX_SNAP_M, prefix: str = "snap_", add_wgs84: bool = True, compat_attrs: bool = False) -> DataFrame:
    """Nearest edge within ``max_snap_m`` (the first by edge_ord on ties): snapped point, distance, attributes under the prefix.

    compat_attrs: attributes are named ``snap_*`` whatever the prefix, as an older interface has it.
    """
    best = snaps(coordinates(points, east_col, north_col), network, max_snap_m).withColumnRenamed("best", "_best")
    near = join_back(points, [best], east_col, north_col).withColumns(snap_columns(F.col("_best"), prefix, compat_attrs)).drop("_best")
    return to_wgs84(near, f"{prefix}east", f"{prefix}north", f"{prefix}lat", f"{prefix}lon") if add_wgs84 else near


def distance_to_network(points: DataFrame, network: DataFrame, east_col: str = "east", north_col: str = "north", max_search_m: float = MAX_SEARCH_M, out_col: str = "dist_to_network_m") -> DataFrame:
    """Distance to the nearest edge; null beyond ``max_search_m``."""
    lines = edges(network, attributes=False)
    ringed, radii = _ringed(coordinates(points, east_col, north_col), lines, max_search_m)
    d = nearest_on(F.col("s"), F.col("x"), F.col("y"))["d"]
    least = _meet(ringed, lines, radii).select("x", "y", d.alias("d")).where(F.col("d") <= max_search_m).groupBy("x", "y").agg(F.min("d").alias(out_col))
    return join_back(points.drop(out_col), [least], east_col, north_col)


def find_candidates(points: DataFrame, network: DataFrame, east_col: str = "east", north_col: str = "north", max_radius_m: float = HMM_RADIUS_M, k: int = HMM_K) -> DataFrame:
    """Add candidates: the k nearest edges within the radius as an array of (d, edge_ord, px, py); empty without any."""
    at = coordinates(points, east_col, north_col).withColumn("ring", F.lit(0))
    foot = nearest_on(F.col("s"), F.col("x"), F.col("y"))
    met = _meet(at, edges(network, attributes=False), [max_radius_m]).select("x", "y", "edge_ord", foot.alias("f")).where(F.col("f.d") <= max_radius_m)
    each = met.groupBy("x", "y", "edge_ord").agg(F.min("f").alias("f"))
    order = Window.partitionBy("x", "y").orderBy("f.d", "edge_ord")
    top = each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    own = top.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("f.d", "edge_ord", "f.px", "f.py"))).alias("candidates"))
    none = F.array().cast("array<struct<d:double,edge_ord:bigint,px:double,py:double>>")
    return join_back(points, [own], east_col, north_col).withColumn("candidates", F.coalesce("candidates", none))


# --- polygons


def polygons(buildings: DataFrame) -> DataFrame:
    """b_ord, osm_id, area, envelope and segs of every building that has an outline."""
    layer = buildings.withColumn("segs", segments_of(F.col("parts"))).where(F.size("segs") > 0)
    return layer.withColumns(bounds(F.col("segs"))).select("b_ord", F.col("osm_id").cast("string").alias("osm_id"), area(F.col("segs")).alias("area"), "xmin", "ymin", "xmax", "ymax", "segs")


def _measured(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """For each pair of coordinates and building: d (to the outline) and odd (inside or on the boundary); pairs with null segs are not measured."""
    x, y, s = F.col("x"), F.col("y"), F.col("s")
    rows = pairs.select("x", "y", *keys, F.explode_outer("segs").alias("s"))
    rows = rows.select("x", "y", *keys, nearest_on(s, x, y)["d"].alias("d"), crosses(s, x, y).cast("int").alias("c"))
    return rows.groupBy("x", "y", *keys).agg(F.min("d").alias("d"), F.sum("c").alias("c")).withColumn("odd", F.coalesce(F.col("c") % 2 == 1, F.lit(False))).drop("c")


def nearest_at(at: DataFrame, layer: DataFrame, reach: float) -> DataFrame:
    """x, y, nearest_building_m: among buildings whose envelope meets the box of ``reach`` around the point; 0 inside."""
    outline = layer.select(F.explode("segs").alias("s")).select("s.x1", "s.y1", "s.x2", "s.y2")
    ringed, radii = _ringed(at, outline, reach)
    box = reduce(lambda a, b: a & b, [(F.col(f"{v}min") <= F.col(v) + reach) & (F.col(f"{v}max") >= F.col(v) - reach) for v in ("x", "y")])
    pairs = _meet(ringed, layer.select("b_ord", "xmin", "ymin", "xmax", "ymax", "segs"), radii, box)
    far = F.when(F.col("odd"), F.lit(0.0)).otherwise(F.col("d"))
    return _measured(pairs, ["b_ord"]).groupBy("x", "y").agg(F.min(far).alias("nearest_building_m"))


def around_at(at: DataFrame, layer: DataFrame, radii_m: tuple[float, ...], inside: bool) -> DataFrame:
    """x, y, the first building around the point (``first``) and number and area of buildings within each radius.

    An outline touches all sides of its envelope, so the envelope gives a least and a most for the distance; only buildings
    between them at some radius, or whose envelope holds the point, are measured.
    """
    reach = float(max((*radii_m, 1.0)))
    far = lambda v: F.greatest(F.abs(F.col(v) - F.col(f"{v}min")), F.abs(F.col(v) - F.col(f"{v}max")))
    near = lambda v: F.least(F.abs(F.col(v) - F.col(f"{v}min")), F.abs(F.col(v) - F.col(f"{v}max")))
    most = F.least(F.hypot(near("x"), far("y")), F.hypot(far("x"), near("y")))
    pairs = _meet(at.withColumn("ring", F.lit(0)), layer, [reach]).withColumns({"low": _envelope_distance(), "high": most})
    open_ = F.col("low") == 0 if inside else F.lit(False)
    for r in radii_m:
        open_ = open_ | ((F.col("low") <= r + SLACK) & (F.col("high") > r - SLACK))
    sure = F.lit(False) if not radii_m else F.col("high") <= max(radii_m)
    pairs = pairs.withColumn("segs", F.when(open_, F.col("segs"))).where(open_ | sure)
    each = _measured(pairs, ["b_ord", "osm_id", "area", "high"])
    d = F.when(F.col("odd"), F.lit(0.0)).otherwise(F.coalesce("d", "high"))
    out = [F.min(F.when(F.col("odd") & (F.col("d") > 0), F.struct("b_ord", "osm_id"))).alias("first")] if inside else []
    for r in radii_m:
        out += [F.count_if(d <= r).alias(f"n_buildings_{int(r)}m"), F.sum(F.when(d <= r, F.col("area"))).alias(f"building_area_{int(r)}m_m2")]
    return each.groupBy("x", "y").agg(*out)


def building_tables(at: DataFrame, buildings: DataFrame, radii_m: tuple[float, ...] = (50, 100), max_search_m: float = BUILDING_SEARCH_M, parts: tuple[str, ...] = ("inside", "nearest", "density")) -> tuple[list[DataFrame], dict[str, Column]]:
    """What is found for coordinates, and the feature columns made of it once it is joined back."""
    layer, found, out = polygons(buildings), [], {}
    radii = tuple(radii_m) if "density" in parts else ()
    if "inside" in parts or radii:
        found.append(around_at(at, layer, radii, "inside" in parts).withColumnRenamed("first", "_first"))
    if "inside" in parts:
        out |= {"inside_building": F.col("_first").isNotNull(), "inside_building_osm_id": F.col("_first.osm_id")}
    if "nearest" in parts:
        found.append(nearest_at(at, layer, float(max_search_m)))
    for r in radii:
        out |= {f"n_buildings_{int(r)}m": F.coalesce(f"n_buildings_{int(r)}m", F.lit(0)).cast("long"), f"building_area_{int(r)}m_m2": F.coalesce(f"building_area_{int(r)}m_m2", F.lit(0.0))}
    return found, out


def building_features(points: DataFrame, buildings: DataFrame, radii_m: tuple[float, ...] = (50, 100), east_col: str = "east", north_col: str = "north", max_search_m: float = BUILDING_SEARCH_M, parts: tuple[str, ...] = ("inside", "nearest", "density")) -> DataFrame:
    """Inside a building, distance to the nearest, number and area within each radius.

    Inside excludes the boundary; the nearest is among buildings whose envelope meets the box of
    ``max_search_m`` around the point, whatever its distance; radii count those at most that far. Without
    coordinates: false, null, 0 and 0.0.
    """
    found, out = building_tables(coordinates(points, east_col, north_col), buildings, radii_m, max_search_m, parts)
    return join_back(points, found, east_col, north_col).withColumns(out).drop("_first")


def is_inside_building(points: DataFrame, buildings: DataFrame, **where: str) -> DataFrame:
    return building_features(points, buildings, parts=("inside",), **where)


def nearest_building_distance(points: DataFrame, buildings: DataFrame, max_search_m: float = BUILDING_SEARCH_M, **where: str) -> DataFrame:
    return building_features(points, buildings, max_search_m=max_search_m, parts=("nearest",), **where)


def building_density(points: DataFrame, buildings: DataFrame, radius_m: float = 50.0, **where: str) -> DataFrame:
    return building_features(points, buildings, radii_m=(radius_m,), parts=("density",), **where)
