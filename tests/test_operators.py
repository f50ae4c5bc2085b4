"""Boundaries that the tables do not reach."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import projection, scalars
from driftline.operators import cleaning, correct, hmm, matching, sessionize
from driftline.sources import glh

T0 = datetime(2024, 1, 1)


def stream(spark, seconds, **more):
    rows = [(i, "v", T0 + timedelta(seconds=s), 55.9, -3.2, 325000.0, 673000.0) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "ord long, volunteer string, timestamp timestamp, lat double, lon double, east double, north double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


def test_gap_is_strict(spark):
    rows = sessionize.sessionise_raw_signals(stream(spark, [0, 600, 1200.000001])).orderBy("ord").collect()
    assert [(r.session_id, r.point_id) for r in rows] == [(0, 0), (0, 1), (1, 0)]


def test_accuracy_boundaries(spark):
    df = spark.createDataFrame([(50.0,), (50.1,), (100.0,), (None,)], "accuracy_m double")
    assert [r.qc_accuracy_pass for r in cleaning.filter_accuracy(df).collect()] == [True, False, True, True]


def test_bracket_ends(spark):
    truth = stream(spark, [0, 60])
    found = matching.interpolate_asof(truth, stream(spark, [0, 30, 60]).select("volunteer", "timestamp", F.col("ord").alias("k")), ["volunteer"])
    assert [r.in_bracket for r in found.orderBy("k").collect()] == [True, True, False]


def test_single_point_sessions_never_pair(spark):
    one = sessionize.summarise_sessions(sessionize.sessionise_raw_signals(stream(spark, [30])))
    long = sessionize.summarise_sessions(sessionize.sessionise_raw_signals(stream(spark, [0, 60])))
    assert matching.find_overlapping_sessions(long, one).count() == 0
    assert matching.find_overlapping_sessions(long, long).count() == 1


def test_viterbi_gaps():
    here = [(1.0, 0.0, 0.0), (2.0, 5.0, 0.0)]
    steps = [here, here, here, [], here, here]
    chosen, _ = hmm.viterbi(steps, np.zeros((6, 2)))
    assert [i for i, c in enumerate(chosen) if c is not None] == [0, 1, 4, 5]
    assert hmm.viterbi([[], here], np.zeros((2, 2)))[0] == [None, None]
    whole, _ = hmm.viterbi(steps, np.zeros((6, 2)), mode="segmented")
    assert [i for i, c in enumerate(whole) if c is not None] == [0, 1, 2, 4, 5]


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(55.9486, -3.1999), (51.5, -0.12), (None, 1.0)], "lat double, lon double")
    rows = projection.to_wgs84(projection.to_bng(df), lat="lat2", lon="lon2").collect()
    assert (rows[0].east, rows[0].north) == pytest.approx((325163.837, 673490.648), abs=0.01)
    assert (rows[1].east, rows[1].north) == pytest.approx((530591.166, 179571.066), abs=0.01)
    assert all(abs(r.lat - r.lat2) < 5e-8 and abs(r.lon - r.lon2) < 1e-7 for r in rows[:2]) and rows[2].east is None


def test_coordinates(spark):
    df = spark.createDataFrame([(v,) for v in ("55.943, -3.207", "geo:55.9,-3.1", "55.9°, -3.2°", "1e3,2", ".5,1", "", None)], "v string")
    lat, lon = scalars.latlng_text(F.col("v"))
    assert [tuple(r) for r in df.select(lat, lon).collect()] == [(55.943, -3.207), (55.9, -3.1), (55.9, -3.2), *[(None, None)] * 4]


def test_hybrid_alpha(spark):
    row = (0.0, 0.0, 4.0, 0.0, 1.0, 3.0)
    df = spark.createDataFrame([row], "glh_east double, glh_north double, corrected_glh_east double, corrected_glh_north double, corrected_snap_distance_m double, predicted_deviation_m double")
    out = correct.hybrid_correction(df).first()
    assert (out.hybrid_alpha, out.pred_glh_east) == (0.75, 3.0)


def test_export_first_tie_wins(spark):
    doc = '{"rawSignals":[{"activityRecord":{"probableActivities":[{"type":"WALKING","confidence":0.7},{"type":"STILL","confidence":0.7}],"timestamp":"2024-01-01T00:00:00.000+00:00"}}]}'
    df = spark.createDataFrame([("v", "f", doc)], "volunteer string, source_file string, d string").withColumn("doc", F.parse_json("d")).drop("d")
    row = glh.parse_raw_signals(df)[1].first()
    assert (row.top_activity, row.n_candidates) == ("WALKING", 2)


def test_viterbi_finds_the_best_path():
    """Against every path of small sequences without gaps."""
    import itertools
    import math

    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        observed = rng.uniform(0, 60, (n, 2))
        steps = []
        for x, y in observed:
            spots = np.array([x, y]) + rng.uniform(-25, 25, (int(rng.integers(1, 4)), 2))
            steps.append([(math.dist((x, y), s), float(s[0]), float(s[1])) for s in spots])

        def score(path):
            total = sum(-(steps[t][i][0] ** 2) / (2 * hmm.SIGMA_Z**2) for t, i in enumerate(path))
            for t in range(1, n):
                a, b = steps[t - 1][path[t - 1]], steps[t][path[t]]
                total -= abs(math.dist(a[1:], b[1:]) - math.dist(observed[t - 1], observed[t])) / hmm.BETA
            return total

        best = max(itertools.product(*(range(len(s)) for s in steps)), key=score)
        for mode in ("parity", "segmented"):
            chosen, totals = hmm.viterbi(steps, observed, mode=mode)
            assert tuple(chosen) == best and totals[-1] == pytest.approx(score(best))


def plain_viterbi(candidates, observed, sigma_z=hmm.SIGMA_Z, beta=hmm.BETA):
    """One session, a step at a time, gaps by the rules of parity."""
    import math

    chosen, scores, back = [None] * len(candidates), [], []
    if not candidates or not candidates[0]:
        return chosen
    for t, own in enumerate(candidates):
        emit = [-(c[0] ** 2) / (2 * sigma_z**2) for c in own]
        if t and own and candidates[t - 1]:
            paths = [[scores[-1][i] - abs(math.dist(a[1:], b[1:]) - math.dist(observed[t], observed[t - 1])) / beta for i, a in enumerate(candidates[t - 1])] for b in own]
            back.append([max(range(len(p)), key=p.__getitem__) for p in paths])
            scores.append([max(p) + e for p, e in zip(paths, emit)])
        else:
            back.append([-1] * len(own))
            scores.append(emit)
    last = max(t for t, s in enumerate(scores) if s)
    k = chosen[last] = max(range(len(scores[last])), key=scores[last].__getitem__)
    for t in range(last, 0, -1):
        if not candidates[t]:
            k = -1
        elif back[t][k] < 0:
            k = 0
        else:
            k = chosen[t - 1] = back[t][k]
    return chosen


def test_many_sessions_at_once():
    """Batches of sessions of all lengths, with gaps, equal the recursion for each alone; in segmented mode each run alone."""
    rng = np.random.default_rng(12)
    sessions = []
    for n in (1, 2, 0, 7, 30, 3, 12, 1, 5):
        observed = rng.uniform(0, 60, (n, 2))
        sessions.append((observed, [[(float(np.hypot(*o)), *map(float, p + o)) for o in rng.uniform(-25, 25, (int(rng.integers(0, 4)), 2))] for p in observed]))
    bounds = np.cumsum([0] + [len(c) for _, c in sessions])
    counts = np.array([len(s) for _, c in sessions for s in c])
    flat = np.array([x for _, c in sessions for s in c for x in s]).reshape(-1, 3)
    observed = np.concatenate([o for o, _ in sessions])
    chosen, _ = hmm.solve(bounds, counts, flat, observed)
    whole, _ = hmm.solve(bounds, counts, flat, observed, mode="segmented")
    for (own, c), a, b in zip(sessions, bounds, bounds[1:]):
        assert [None if k < 0 else k for k in chosen[a:b]] == plain_viterbi(c, own)
        expected, t = [], 0
        while t < len(c):
            end = t
            while end < len(c) and c[end]:
                end += 1
            expected += plain_viterbi(c[t:end], own[t:end]) + [None] * (end < len(c))
            t = end + 1
        assert [None if k < 0 else k for k in whole[a:b]] == expected


def test_sessions_over_batches(spark):
    """A session that batches cut is solved whole."""
    parts = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 0D, 'y', 5000D)))"
    network = spark.sql(f"select 0L as edge_ord, 'a' as toid, {parts} as parts union all select 1L, 'b', transform({parts}, p -> transform(p, q -> named_struct('x', 14D, 'y', q.y)))")
    rows = [(s * 1000 + i, "v", s, T0 + timedelta(seconds=10 * i), 8.0 if i % 50 == 7 else 2.0, 10.0 * i) for s in (1, 2, 3, 4) for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, volunteer string, glh_session_id long, timestamp timestamp, glh_east double, glh_north double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = hmm.apply_hmm(df, network).select("ord", "hmm_pred_glh_east", "hmm_pred_glh_north").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows) and not [r for r in out if r.hmm_pred_glh_east != 0.0 or abs(r.hmm_pred_glh_north - 10.0 * (r.ord % 1000)) > 1e-9]


def test_hmm_on_two_streets(spark):
    """A walk along one street that once comes nearer to the other stays on its street."""
    parts = lambda x: f"array(array(named_struct('x', {x}D, 'y', 0D), named_struct('x', {x}D, 'y', 200D)))"
    network = spark.sql(f"select 0L as edge_ord, 'a' as toid, {parts(0.0)} as parts union all select 1L, 'b', {parts(14.0)}")
    rows = [(i, "v", 7, T0 + timedelta(seconds=10 * i), 8.0 if i == 3 else 2.0, 10.0 * i, 0.0, 10.0 * i) for i in range(7)]
    rows += [(9, "v", 8, T0, 2.0, 5.0, 0.0, 5.0), (10, None, 7, T0, 2.0, 5.0, 0.0, 5.0)]  # a session of one; no volunteer
    df = spark.createDataFrame(rows, "ord long, volunteer string, glh_session_id long, timestamp timestamp, glh_east double, glh_north double, gpx_east double, gpx_north double").withColumn("deviation_m", F.abs(F.col("glh_east")))
    out = {r.ord: r for r in hmm.apply_hmm(df, network).collect()}
    assert len(out) == 9 and all(out[i].hmm_pred_glh_east == 0.0 and out[i].hmm_pred_glh_north == 10.0 * i for i in range(7))
    assert out[3].hmm_perp_distance_m == 8.0 and out[3].hmm_pred_deviation_m == 0.0 and out[3].hmm_improvement_vs_raw_m == 8.0
    assert out[9].hmm_pred_glh_east is None and out[10].hmm_pred_glh_east is None


def test_streams_over_days(spark):
    """Sessions and as-of neighbours that lie days apart, against plain Python; a day is a window, so what is carried over counts."""
    rng = np.random.default_rng(8)
    seconds = sorted(int(s) for s in rng.choice(6 * 86_400, 300, replace=False) if not 90_000 < s < 260_000)
    seconds += [seconds[-1]] * 2  # ties, by ordinal
    df = stream(spark, seconds).repartition(7)
    got = [(r.ord, r.session_id, r.point_id) for r in sessionize.sessionise_raw_signals(df, 3000).orderBy("ord").collect()]
    expected, session, point = [], -1, 0
    for i, s in enumerate(seconds):
        new = i == 0 or s - seconds[i - 1] > 3000
        session, point = (session + 1, 0) if new else (session, point + 1)
        expected.append((i, session, point))
    assert got == expected
    late = spark.createDataFrame([(900, "v", None, 0.0, 0.0, 0.0, 0.0), (901, "v", None, 0.0, 0.0, 0.0, 0.0), (902, "w", T0, 0.0, 0.0, 0.0, 0.0)], df.schema)
    more = {r.ord: (r.session_id, r.point_id) for r in sessionize.sessionise_raw_signals(df.union(late), 3000).where("ord >= 900").collect()}
    assert more == {900: (session + 1, 0), 901: (session + 2, 0), 902: (0, 0)}  # without time: sessions of their own, last

    truth = df.withColumn("lat", F.unix_seconds("timestamp").cast("double"))
    asked = [int(s) for s in rng.choice(7 * 86_400, 200, replace=False)] + seconds[:5]
    targets = stream(spark, asked).select("volunteer", "timestamp", F.col("ord").alias("k"))
    found = {r.k: r for r in matching.interpolate_asof(truth, targets, ["volunteer"]).collect()}
    times = sorted(set(seconds))
    for k, s in enumerate(asked):
        before, after = [t for t in seconds if t <= s], [t for t in times if t > s]
        row = found[k]
        assert row.in_bracket == bool(before and after)
        if row.in_bracket:
            assert (row.bracket_dt_prev_s, row.bracket_dt_next_s) == (s - before[-1], after[0] - s)
