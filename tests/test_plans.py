"""What plans read and shuffle: sessions and matching go over their input once."""

import re

from driftline.operators import matching, sessionize
from driftline.plans import fixtures as fx
from driftline.plans import queries

SF = "/root/testdata/sf0.001"


def counts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan parquet|Scan parquet", plan)), len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan)), len(re.findall("Window ", plan))


def test_sessions_read_twice_at_most(spark):
    scans, exchanges, _ = counts(queries.glh(spark, SF))
    assert scans <= 2 and exchanges <= 6


def test_match_in_one_pass(spark):
    g, h = queries.gpx(spark, SF), queries.glh(spark, SF)
    scans, exchanges, windows = counts(matching.match_layers(g, h, fx.BRACKET_S))
    assert scans <= 6 and exchanges <= 30 and windows <= 10


def test_layers_as_a_key(spark):
    """The same rows as one match for each layer."""
    g, h = queries.gpx(spark, SF), queries.glh(spark, SF)
    layers = {n: h.where(f"glh_layer = '{n}'") for n in ("raw_signals", "timeline_paths")}
    plain = lambda df: sorted(map(str, df.collect()))
    once = plain(matching.match_layers(g, h, fx.BRACKET_S))
    assert once == plain(matching.match_volunteer(g, layers, fx.BRACKET_S))
    assert once == sorted(r for n, df in layers.items() for r in plain(matching.match_streams(g, df, n, fx.BRACKET_S)))
    assert matching.match_volunteer(g, {}).count() == 0


def test_track_sessions_of_one_volunteer_over_many_parts(spark):
    """Segments and days of one volunteer, against a plain loop; windows never hold a volunteer's stream."""
    rows, k = [], 0
    from datetime import datetime, timedelta

    for f in ("b.gpx", "a.gpx"):
        for trk in (0, 1):
            for seg in (1, 0):
                for i in range(40):
                    k += 1
                    rows.append((k, "v", f, trk, seg, datetime(2024, 1, 1) + timedelta(seconds=(i * 7919 * (k % 5 + 1)) % 400_000), 55.9, -3.2))
    df = spark.createDataFrame(rows, "ord long, volunteer string, source_file string, trk_idx long, seg_idx long, timestamp timestamp, lat double, lon double").repartition(6)
    for gap in (None, 5000.0):
        got = {r.ord: (r.session_id, r.point_id) for r in sessionize.sessionise_track_segments(df, gap, base_session_id=10).collect()}
        session, before, point = 9, None, 0
        for r in sorted(rows, key=lambda r: (r[2], r[3], r[4], r[5], r[0])):
            new = before is None or before[2:5] != r[2:5] or (gap is not None and (r[5] - before[5]).total_seconds() > gap)
            session, point = (session + 1, 0) if new else (session, point + 1)
            before = r
            assert got[r[0]] == (session, point)
    plan = sessionize.sessionise_track_segments(df, 5000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert all("seg_idx" in w or "_day" in w for w in re.findall(r"Window \[lag[^\n]*", plan))
