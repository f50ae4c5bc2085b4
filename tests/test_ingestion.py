"""Files of every kind that is read, with results worked out by hand."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from driftline.operators import correct, models, spatial
from driftline.sources import glh, gpx, networks


def url(path):
    return "file://" + str(path)


# --- exports

SIGNALS = [
    {"position": {"LatLng": "55.9486°, -3.1999°", "accuracyMeters": 12, "altitudeMeters": 80.5, "source": "WIFI", "timestamp": "2024-01-01T10:00:00.000+00:00", "speedMetersPerSecond": 1.5}},
    {"position": {"latLng": {"latitudeE7": 559486000, "longitudeE7": -31999000}, "timestamp": "2024-01-01T11:00:00.000+01:00"}},
    {"position": {"LatLng": {"latLng": "geo:55.9,-3.1"}, "timestamp": "bad"}},
    {"position": {"LatLng": "nowhere", "timestamp": "2024-01-01T10:00:00Z"}},
    {"activityRecord": {"probableActivities": [{"type": "STILL", "confidence": 0.2}, {"type": "WALKING", "confidence": 0.7}], "timestamp": "2024-01-01T10:00:05Z"}},
    {"wifiScan": {"accessPoints": [{"mac": 1}, {"mac": 2}], "timestamp": "2024-01-01T10:00:06Z"}},
]
SEGMENTS = [
    {"startTime": "2024-01-01T10:00:00Z", "endTime": "2024-01-01T12:00:00Z", "timelinePath": [{"point": "geo:55.1,-3.1", "durationMinutesOffsetFromStartTime": "15"}, {"point": "55.2°, -3.2°", "time": "2024-01-01T10:30:00Z"}, {"point": "bad"}]},
    {"startTime": "2024-01-01T12:00:00Z", "endTime": "2024-01-01T13:00:00Z", "visit": {"hierarchyLevel": 0, "topCandidate": {"placeID": "", "placeId": "P1", "semanticType": "Home", "probability": 0.9, "placeLocation": {"latLng": "55.3°, -3.3°"}}}},
    {"startTime": "2024-01-01T13:00:00Z", "endTime": "2024-01-01T14:00:00Z", "activity": {"start": {"latLng": "55.4°, -3.4°"}, "end": "geo:55.5,-3.5", "distanceMeters": "1200.5", "topCandidate": {"type": "WALKING", "probability": 0.8}}},
    {"startTime": "2024-01-01T14:00:00Z", "timelineMemory": {"x": 1}},
]


def test_export_of_an_object(spark, tmp_path):
    folder = tmp_path / "v1"
    folder.mkdir()
    (folder / "small.json").write_text("[]")
    (folder / "big.json").write_text(json.dumps({"rawSignals": SIGNALS, "semanticSegments": SEGMENTS}))
    found = glh.parse_volunteer_folder(spark, url(folder))
    assert [tuple(r) for r in found.family.collect()] == [("v1", "big.json", "A")]
    points = sorted(found.raw_signals.collect(), key=lambda r: (r.lat, str(r.timestamp)))
    assert [(r.lat, r.lon, r.accuracy_m, r.altitude_m, r.speed_mps, r.source) for r in points] == [(55.9, -3.1, None, None, None, "UNKNOWN"), (55.9486, -3.1999, 12.0, 80.5, 1.5, "WIFI"), (55.9486, -3.1999, None, None, None, "UNKNOWN")]
    assert points[0].timestamp is None and points[1].timestamp == points[2].timestamp  # one instant in two zones
    assert [(r.top_activity, r.confidence, r.n_candidates) for r in found.activity_records.collect()] == [("WALKING", 0.7, 2)]
    assert [r.n_access_points for r in found.wifi_scans.collect()] == [2]
    paths = sorted((r.segment_id, r.timestamp.strftime("%H:%M"), r.lat, r.lon) for r in found.timeline_paths.collect())
    assert paths == [(0, "10:15", 55.1, -3.1), (0, "10:30", 55.2, -3.2)]
    assert [(r.segment_id, r.place_id, r.semantic_type, r.lat) for r in found.visits.collect()] == [(1, "P1", "Home", 55.3)]
    assert sorted((r.endpoint, r.lat, r.mode, r.distance_m) for r in found.activities.collect()) == [("end", 55.5, "WALKING", 1200.5), ("start", 55.4, "WALKING", 1200.5)]
    assert [(r.segment_id, r.keys) for r in found.other_segments.collect()] == [(3, ["startTime", "timelineMemory"])]


def test_export_of_a_list(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(SEGMENTS))
    found = glh.parse_glh(spark, url(tmp_path / "list.json"), volunteer="me")
    assert found.family.first().family == "B" and found.raw_signals.count() == 0 and found.wifi_scans.count() == 0
    assert (found.timeline_paths.count(), found.visits.count(), found.activities.count(), found.other_segments.count()) == (2, 1, 2, 1)
    assert found.visits.first().volunteer == "me"


def test_neither(spark, tmp_path):
    (tmp_path / "other.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="not a location-history export"):
        glh.parse_glh(spark, url(tmp_path / "other.json")).visits.collect()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("x")
    assert glh.parse_volunteer_folder(spark, url(tmp_path / "none")) is None


def test_plans_stay_small(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(SEGMENTS))
    found = glh.parse_glh(spark, url(tmp_path / "list.json"))
    for layer in (found.raw_signals, found.timeline_paths, found.visits, found.activities):
        assert len(layer._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_a_layer_reads_its_own_elements_once(spark, tmp_path):
    """No layer parses JSON again or reads elements of another kind, and each works a coordinate out once."""
    (tmp_path / "one.json").write_text(json.dumps({"rawSignals": SIGNALS, "semanticSegments": SEGMENTS}))
    found = glh.parse_glh(spark, url(tmp_path / "one.json"))
    for name in ("raw_signals", "activity_records", "wifi_scans", "timeline_paths", "visits", "activities", "other_segments"):
        layer = getattr(found, name)
        plan = layer._jdf.queryExecution().optimizedPlan().toString()
        assert "parse_json" not in plan.lower() and "parsejson" not in plan.lower()
        assert plan.count("regexp_extract(") <= 4  # two, each named again in nullif
        assert {"p", "path"} <= {f.split("kind=")[1].split("/")[0] for f in layer.inputFiles()}  # one table, in parts by kind
        assert "kind" in layer._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


# --- tracks


def track(*segments):
    body = "".join("<trkseg>" + "".join(f'<trkpt lat="{lat}" lon="{lon}">{f"<ele>{ele}</ele>" if ele else ""}{f"<time>{t}</time>" if t else ""}</trkpt>' for lat, lon, ele, t in seg) + "</trkseg>" for seg in segments)
    return f'<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk>{body}</trk></gpx>'


def test_gpx(spark, tmp_path):
    at = "2024-01-01T10:{:02d}:00Z".format
    (tmp_path / "a.gpx").write_text(track([(55.0, -3.0, 10.5, at(1)), (55.1, -3.1, None, at(0)), (55.2, -3.2, None, None)], [(55.3, -3.3, None, at(2)), (55.4, -3.4, None, at(40))]))
    (tmp_path / "b.GPX").write_text(track([(56.0, -4.0, None, at(5))]))
    (tmp_path / "c.gpx").write_text(track([(56.0, -4.0, None, None)]))
    rows = sorted((r.source_file, r.session_id, r.point_id, r.lat, r.elevation_m, r.trk_idx, r.seg_idx) for r in gpx.parse_volunteer_folder(spark, url(tmp_path), volunteer="v").collect())
    assert rows == [("a.gpx", 0, 0, 55.1, None, 0, 0), ("a.gpx", 0, 1, 55.0, 10.5, 0, 0), ("a.gpx", 1, 0, 55.3, None, 0, 1), ("a.gpx", 1, 1, 55.4, None, 0, 1), ("b.GPX", 2, 0, 56.0, None, 0, 0)]
    apart = gpx.parse_gpx(spark, url(tmp_path / "a.gpx"), max_gap_seconds=600, base_session_id=7)
    assert sorted((r.session_id, r.lat) for r in apart.collect()) == [(7, 55.0), (7, 55.1), (8, 55.3), (9, 55.4)]
    assert gpx.parse_gpx(spark, url(tmp_path / "c.gpx")).count() == 0


# --- layers


def shapefile(base, kind, shapes, fields, rows, prj=None, index=False):
    """A shapefile written byte by byte: shapes are lists of parts, None for a null shape."""
    records, places = b"", b""
    for i, parts in enumerate(shapes, 1):
        if parts is None:
            body = struct.pack("<i", 0)
        else:
            points = [p for part in parts for p in part]
            starts, at = [], 0
            for part in parts:
                starts.append(at)
                at += len(part)
            body = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        places += struct.pack(">2i", 50 + len(records) // 2, len(body) // 2)
        records += struct.pack(">2i", i, len(body) // 2) + body
    base.parent.mkdir(parents=True, exist_ok=True)
    base.with_suffix(".shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(records) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + records)
    if index:
        base.with_suffix(".shx").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(places) // 2) + b"\0" * 72 + places)
    width = 1 + sum(n for _, n in fields)
    head = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    head += b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([n, 0]) + b"\0" * 14 for name, n in fields) + b"\r"
    base.with_suffix(".dbf").write_bytes(head + b"".join(b" " + b"".join(str(v).encode().ljust(n)[:n] for v, (_, n) in zip(row, fields)) for row in rows) + b"\x1a")
    if prj:
        base.with_suffix(".prj").write_text(prj)


def line(x, y, dx=0.0, dy=10.0):
    return [[(x, y), (x + dx, y + dy)]]


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    layers = root / "map"
    bent = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], [(100.0, 0.0), (100.0, 5.0)]]  # two parts, one of two segments
    shapefile(layers / networks.ROAD_LINK_FILE, 3, [bent, None, line(20.0, 0.0), line(30.0, 0.0)], [("TOID", 8), ("roadname", 10), ("formofway", 12)], [("r1", "High St", "Single"), ("r0", "gone", "x"), ("r2", "", "Single"), ("r2", "twice", "")], 'PROJCS["British_National_Grid"]')
    shapefile(layers / networks.CONNECTING_LINK_FILE, 3, [line(40.0, 0.0)], [("TOID", 8), ("pathnode", 8)], [("c1", "n")])
    (layers / (networks.PATH_LINK_FILE + ".csv")).write_text('identifier,pathname,wkt\np1,Alley,"LINESTRING (50 0, 50 10)"\np2,Lane,"MULTILINESTRING ((60 0, 60 10), (61 0, 61 10))"\n')
    (layers / (networks.STREET_FILE + ".csv")).write_text('USRN,name,wkt\n1,High Street,"LINESTRING (0 0, 0 10)"\n')
    roads = [("1", "residential", "LineString", [[-3.1999, 55.9486], [-3.1998, 55.9487]]), ("2", "footway", "MultiLineString", [[[-3.19, 55.94], [-3.18, 55.94]]]), ("3", "proposed", "LineString", [[0.0, 50.0], [0.1, 50.0]])]
    (layers / "Glasgow_streets.geojsonl").write_text("\n".join(json.dumps({"type": "Feature", "properties": {"osm_id": i, "fclass": c, "name": f"n{i}"}, "geometry": {"type": t, "coordinates": xy}}) for i, c, t, xy in roads))
    square = [[-3.2, 55.94], [-3.19, 55.94], [-3.19, 55.95], [-3.2, 55.95], [-3.2, 55.94]]
    (layers / "buildings.geojsonl").write_text(json.dumps({"properties": {"osm_id": "b1", "type": "house"}, "geometry": {"type": "Polygon", "coordinates": [square]}}))
    outer, hole = [(0.0, 0.0), (0.0, 20.0), (20.0, 20.0), (20.0, 0.0), (0.0, 0.0)], [(5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0), (5.0, 5.0)]
    shapefile(layers / "London_gis_osm_buildings_a_free_1", 5, [[outer, hole]], [("osm_id", 8), ("name", 8)], [("b2", "Ring")], 'PROJCS["British_National_Grid"]')
    return root


def test_shapefile_by_ranges(spark, tmp_path):
    """Several tasks read a layer with an index; the rows are those of one task without."""
    from driftline.sources.shapefile import read_shapefile

    shapes = [None if i % 7 == 3 else [[(float(i), 0.5), (i + 1.0, 2.0)] * (1 + i % 4)] + [[(0.0, float(i)), (1.0, 1.0)]] * (i % 3) for i in range(103)]
    rows = [(f"t{i}", "é" * (i % 5), "") for i in range(103)]
    fields = [("TOID", 8), ("name", 12), ("none", 4)]
    shapefile(tmp_path / "a", 3, shapes, fields, rows, index=True)
    shapefile(tmp_path / "b", 3, shapes, fields, rows)
    ranged, whole = read_shapefile(spark, url(tmp_path / "a"), records=26), read_shapefile(spark, url(tmp_path / "b"))
    assert ranged.rdd.getNumPartitions() == 4 and whole.rdd.getNumPartitions() == 1 and "Join" not in ranged._jdf.queryExecution().optimizedPlan().toString()
    plain = lambda df: sorted((r.record.row, r.TOID, r.name, r.none, str(r.parts)) for r in df.collect())
    assert plain(ranged) == plain(whole) and [r[1] for r in plain(ranged)] == [f"t{i}" for i in range(103) if i % 7 != 3]
    assert plain(ranged)[1][2] == "é" and plain(ranged)[0][2] is None
    shapefile(tmp_path / "c", 3, [], fields, [], index=True)
    assert read_shapefile(spark, url(tmp_path / "c")).count() == 0


def test_layers(spark, project):
    root = url(project)
    road = {r.toid: r for r in networks.load_road_link(spark, root).where("toid <> 'r2'").collect()}
    assert set(road) == {"r1"} and road["r1"].road_name == "High St" and road["r1"].network_kind == "road_link"
    assert [[(p.x, p.y) for p in part] for part in road["r1"].parts] == [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], [(100.0, 0.0), (100.0, 5.0)]]
    assert networks.load_connecting_link(spark, root).first().path_node == "n"
    paths = {r.toid: r for r in networks.load_path_link(spark, root).collect()}
    assert paths["p1"].road_name == "Alley" and [len(p) for p in paths["p2"].parts] == [2, 2]
    assert networks.load_street(spark, root).first().street_name == "High Street"
    osm = {r.toid: r for r in networks.load_osm_roads_for_city(spark, root, "Glasgow_streets", "Glasgow").collect()}
    assert {k: r.network_kind for k, r in osm.items()} == {"osm_1": "osm_carriageway", "osm_2": "osm_pedestrian"}
    assert (osm["osm_1"].parts[0][0].x, osm["osm_1"].parts[0][0].y) == pytest.approx((325163.837, 673490.648), abs=0.01)
    with pytest.raises(FileNotFoundError):
        networks.load_osm_roads_for_city(spark, root, "nowhere", "x")


def test_networks_and_caches(spark, project):
    root = url(project)
    every = networks.load_all_networks(spark, root)
    kinds = lambda df: sorted(r.toid for r in df.collect())
    assert kinds(every.carriageway) == ["c1", "osm_1", "r1", "r2"] and kinds(every.pedestrian) == ["osm_2", "p1", "p2"]
    assert kinds(every.full) == sorted(kinds(every.carriageway) + kinds(every.pedestrian))
    order = [r.toid for r in every.full.orderBy("edge_ord").collect()]
    assert order == ["r1", "r2", "c1", "osm_1", "p1", "p2", "osm_2"] and every.carriageway.where("toid = 'r2'").first().road_name is None  # the first of a toid
    (project / "map" / (networks.CONNECTING_LINK_FILE + ".shp")).rename(project / "map" / "away.shp")
    try:
        assert kinds(networks.load_carriageway_network(spark, root)) == kinds(every.carriageway)  # from the cache
        with pytest.raises(FileNotFoundError):
            networks.load_carriageway_network(spark, root, force_rebuild=True)
    finally:
        (project / "map" / "away.shp").rename(project / "map" / (networks.CONNECTING_LINK_FILE + ".shp"))
    points = spark.createDataFrame([(1, 12.0, 9.0), (2, 101.0, 3.0)], "ord long, glh_east double, glh_north double").withColumns({"gpx_east": F.lit(10.0), "gpx_north": F.lit(9.0), "deviation_m": F.lit(2.0)})
    fixed = {r.ord: r for r in correct.apply_rule_based_correction(points, project_root=root).collect()}
    assert (fixed[1].corrected_glh_east, fixed[1].corrected_glh_north, fixed[1].corrected_deviation_m) == (10.0, 9.0, 0.0)
    assert (fixed[2].corrected_glh_east, fixed[2].corrected_snap_distance_m) == (100.0, 1.0)  # the second part of a line


def test_buildings(spark, project):
    layer = networks.load_buildings(spark, url(project), cache_path=url(project / "cache" / "buildings.parquet"))
    rows = {r.osm_id: r for r in layer.collect()}
    assert {k: r.city for k, r in rows.items()} == {"b1": "Edinburgh", "b2": "London"} and rows["b2"].name == "Ring" and rows["b1"].type == "house"
    assert networks.load_buildings(spark, "file:///nowhere", cache_path=url(project / "cache" / "buildings.parquet")).count() == 2
    with pytest.raises(FileNotFoundError):
        networks.load_buildings(spark, "file:///nowhere")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 10.0, 10.0), (3, 25.0, 10.0)], "ord long, east double, north double")
    inside = {r.ord: r.inside_building for r in spatial.is_inside_building(points, layer.where("osm_id = 'b2'")).select("ord", "inside_building").collect()}
    assert inside == {1: True, 2: False, 3: False}  # the hole is outside


def test_raw_attribute_names(spark):
    parts = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 0D, 'y', 10D))) as parts"
    raw = spark.createDataFrame([(0, "t", "alley", "B", "dual")], "edge_ord long, TOID string, pathname string, roadclas_1 string, formofway string").selectExpr("*", parts)
    points = spark.createDataFrame([(1, 1.0, 5.0)], "ord long, east double, north double")
    found = spatial.snap_points_to_network(points, raw, add_wgs84=False).first()
    assert (found.snap_toid, found.snap_road_name, found.snap_road_class, found.snap_form_of_way) == ("t", "alley", "B", "dual")


# --- models


def test_bundles(spark, tmp_path):
    rows = [(float(i % 7), float(i % 5), float(i % 7) * 3 + 1, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "glh_accuracy_m double, corrected_snap_distance_m double, deviation_m double, odd int").withColumns({"matched": F.lit(True), "glh_layer": F.when(F.col("odd") == 1, "a").otherwise("b"), "corrected_deviation_m": F.col("deviation_m") - F.col("odd") * 2 + 1})
    prepared, names, levels = models.prepare_features(df)
    bundle = models.train(prepared, names, levels, trees=4)
    models.save_bundle(bundle, url(tmp_path / "own"))
    again = models.load_bundle(url(tmp_path / "own"))
    assert (again.feature_columns, again.categorical_levels) == (bundle.feature_columns, bundle.categorical_levels)
    scores = lambda b: [r.predicted_deviation_m for r in models.predict_deviation(b, df).collect()]
    one = scores(bundle)
    assert scores(again) == one and min(one) >= 0
    mean = [r.predicted_deviation_m for r in models.predict_ensemble([bundle, again], df).collect()]
    assert mean == pytest.approx(one)
    gains = models.feature_importance(bundle, spark, top_n=None).orderBy("rank").collect()
    assert [r.gain for r in gains] == sorted((r.gain for r in gains), reverse=True) and gains[0].feature == "glh_accuracy_m"
