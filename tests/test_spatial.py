"""Joins with lines and polygons against plain loops: several parts, holes, ties, dense cells, large and tiny shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import spatial

PARTS = "array<array<struct<x:double,y:double>>>"


def to_segment(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)


def segments(parts):
    return [(p[i - 1], p[i]) for p in parts for i in range(1, len(p))]


def odd(x, y, parts):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in segments(parts)) % 2 == 1


def ring(x, y, w, h, turn=False):
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return corners[::-1] if turn else corners


def points_of(spark, rng, n, side):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, side, (n, 2)))]
    rows += [(n, None, 1.0), (n + 1, 5.0, None), (n + 2, float("nan"), 0.0), (n + 3, *rows[0][1:]), (n + 4, side * 50.0, 0.0)]  # missing, repeated and far off
    return rows, spark.createDataFrame(rows, "ord long, east double, north double")


@pytest.fixture(scope="module")
def town(spark):
    """Buildings of several parts and with courts, from a shed to a block of 900 metres."""
    rng = np.random.default_rng(11)
    shapes = []
    for x, y in rng.uniform(0, 1000, (60, 2)).round(1):
        w, h = rng.choice([2.0, 12.0, 40.0, 150.0], 2)
        parts = [ring(x, y, w, h)]
        if w > 10 and h > 10:
            parts.append(ring(x + w / 4, y + h / 4, w / 2, h / 2, turn=True))  # a court
        if rng.random() < 0.3:
            parts.append(ring(x + w + 30, y, 6.0, 6.0))  # a wing apart
        shapes.append(parts)
    shapes.append([ring(50.0, 60.0, 900.0, 700.0), ring(60.0, 70.0, 880.0, 680.0, turn=True)])
    frame = spark.createDataFrame([(i, str(i), [[{"x": float(a), "y": float(b)} for a, b in p] for p in s]) for i, s in enumerate(shapes)], f"b_ord long, osm_id string, parts {PARTS}")
    return shapes, frame


def test_buildings(spark, town):
    shapes, frame = town
    rows, points = points_of(spark, np.random.default_rng(3), 300, 1000)
    got = {r.ord: r for r in spatial.building_features(points, frame, radii_m=(50, 100), max_search_m=80.0).collect()}
    areas = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in segments(s)) / 2) for s in shapes]
    boxes = [(min(x for p in s for x, _ in p), min(y for p in s for _, y in p), max(x for p in s for x, _ in p), max(y for p in s for _, y in p)) for s in shapes]
    assert len(got) == len(rows)
    for i, x, y in rows:
        r = got[i]
        if x is None or y is None or x != x:
            assert (r.inside_building, r.nearest_building_m, r.n_buildings_50m, r.building_area_100m_m2) == (False, None, 0, 0.0)
            continue
        edge = [min(to_segment(x, y, a, b) for a, b in segments(s)) for s in shapes]
        far = [0.0 if odd(x, y, s) else d for s, d in zip(shapes, edge)]
        inside = [j for j, s in enumerate(shapes) if odd(x, y, s) and edge[j] > 0]
        near = [d for d, b in zip(far, boxes) if b[0] <= x + 80 and b[2] >= x - 80 and b[1] <= y + 80 and b[3] >= y - 80]
        assert r.inside_building == bool(inside) and r.inside_building_osm_id == (str(min(inside)) if inside else None)
        assert r.nearest_building_m == (pytest.approx(min(near), abs=1e-9) if near else None)
        for radius in (50, 100):
            held = [j for j, d in enumerate(far) if d <= radius]
            assert r[f"n_buildings_{radius}m"] == len(held)
            assert r[f"building_area_{radius}m_m2"] == pytest.approx(sum(areas[j] for j in held), rel=1e-12)


def test_one_part_at_a_time(spark, town):
    """The single questions agree with all of them at once."""
    _, frame = town
    _, points = points_of(spark, np.random.default_rng(4), 60, 1000)
    whole = {r.ord: r for r in spatial.building_features(points, frame, radii_m=(50,)).collect()}
    for one, names in ((spatial.is_inside_building, ["inside_building", "inside_building_osm_id"]), (spatial.nearest_building_distance, ["nearest_building_m"]), (spatial.building_density, ["n_buildings_50m", "building_area_50m_m2"])):
        for r in one(points, frame).collect():
            assert [r[n] for n in names] == [whole[r.ord][n] for n in names]


def roads(spark, lines):
    return spark.createDataFrame([(i, f"t{i}", [[{"x": float(a), "y": float(b)} for a, b in p] for p in parts]) for i, parts in enumerate(lines)], f"edge_ord long, toid string, parts {PARTS}")


def test_roads(spark):
    rng = np.random.default_rng(7)
    lines = [[np.cumsum(np.vstack([rng.uniform(0, 2000, 2), rng.normal(0, 40, (6, 2))]), axis=0).tolist()] for _ in range(40)]
    lines += [[[(-5000.0, -4000.0), (9000.0, 7000.0)]], [[(10.0, 10.0), (10.0, 10.0)], [(900.0, 900.0), (905.0, 900.0)]]]  # a long one; one of two parts, of which one is a point
    lines.append(lines[0])  # the same once more: ties go to the first
    network = roads(spark, lines)
    rows, points = points_of(spark, rng, 200, 2000)
    snapped = {r.ord: r for r in spatial.snap_points_to_network(points, network, add_wgs84=False).collect()}
    near = {r.ord: r.dist_to_network_m for r in spatial.distance_to_network(points, network, max_search_m=60.0).collect()}
    top = {r.ord: [(c.edge_ord, c.d) for c in r.candidates] for r in spatial.find_candidates(points, network, max_radius_m=150.0, k=4).collect()}
    for i, x, y in rows:
        if x is None or y is None or x != x:
            assert snapped[i].snap_distance_m is None and near[i] is None and top[i] == []
            continue
        far = [min(to_segment(x, y, a, b) for a, b in segments(parts)) for parts in lines]
        best = min(range(len(far)), key=lambda j: (far[j], j))
        if far[best] <= 100:
            assert snapped[i].snap_toid == f"t{best}" and snapped[i].snap_distance_m == pytest.approx(far[best], abs=1e-9)
            assert math.hypot(snapped[i].snap_east - x, snapped[i].snap_north - y) == pytest.approx(far[best], abs=1e-6)
        else:
            assert snapped[i].snap_distance_m is None and snapped[i].snap_toid is None
        assert near[i] == (pytest.approx(far[best], abs=1e-9) if far[best] <= 60 else None)
        expected = sorted((j for j in range(len(far)) if far[j] <= 150), key=lambda j: (far[j], j))[:4]
        assert [e for e, _ in top[i]] == expected and [d for _, d in top[i]] == pytest.approx([far[j] for j in expected], abs=1e-9)


def test_dense_cell(spark):
    """10,000 edges and a crowd at one spot in one cell: rows stay small, nothing is gathered by cell."""
    n = 10_000
    x = 500.0 + F.col("id") % 100 / 100.0
    y = 500.0 + F.floor(F.col("id") / 100) / 100.0
    point = lambda dx: F.struct((x + dx).alias("x"), y.cast("double").alias("y"))
    network = spark.range(n).select(F.col("id").alias("edge_ord"), F.col("id").cast("string").alias("toid"), F.array(F.array(point(0.0), point(0.004))).alias("parts"))
    points = spark.range(400).select(F.col("id").alias("ord"), F.when(F.col("id") < 300, 500.5).otherwise(500.0 + F.col("id") / 400.0).alias("east"), F.when(F.col("id") < 300, 500.5).otherwise(500.25).alias("north"))
    found = spatial.snap_points_to_network(points, network, add_wgs84=False)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.ord: r for r in found.collect()}
    assert len(rows) == 400 and all(rows[i].snap_toid == "5050" and rows[i].snap_distance_m == 0.0 for i in range(300))
    for i in range(300, 400):
        px = 500.0 + i / 400.0
        best = min(to_segment(px, 500.25, (500.0 + j / 100.0, 500.25), (500.004 + j / 100.0, 500.25)) for j in range(100))
        assert rows[i].snap_distance_m == pytest.approx(best, abs=1e-9)
