"""DuckDB SQL of the registered queries, written apart from the operators: plain joins and windows over the same tables."""

from __future__ import annotations


def _tracks(volunteers: int = 2) -> str:
    return f"""t as (select event_id as ord, cast(user_id % {volunteers} as varchar) as volunteer, user_id,
        case when event_id % 5 = 0 then 'GLH' else 'GPX' end as kind, case when event_id % 10 = 0 then 'raw_signals' else 'timeline_paths' end as glh_layer,
        epoch_us(ts) as us, 55.78::double + (event_id * 37 % 300) / 1000.0::double as lat, -3.45::double + (event_id * 53 % 500) / 1000.0::double as lon,
        case when event_id % 7 = 0 then 100.0::double when event_id % 11 = 0 then null else value end as accuracy_m, event_type as source, value / 10 as speed_mps,
        325000.0::double + event_id * 37 % 1000 as east, 673000.0::double + event_id * 53 % 1000 as north from events)"""


def _sessions(name: str, kind: str, gap: int = 3600) -> str:
    return f"""{name}_1 as (select *, lag(us) over (partition by volunteer order by us, ord) as prev from t where kind = '{kind}'),
        {name}_2 as (select *, cast(sum(case when prev is null or us - prev > {gap * 1_000_000} then 1 else 0 end) over (partition by volunteer order by us, ord rows unbounded preceding) - 1 as bigint) as session_id from {name}_1),
        {name} as (select *, row_number() over (partition by volunteer, session_id order by us, ord) - 1 as point_id from {name}_2)"""


GLH, GPX = _sessions("h", "GLH"), _sessions("g", "GPX")
BASE = f"with {_tracks()}"
STREAMS = f"{BASE}, {GLH}, {GPX}"


def _r(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def _bng(source: str) -> str:
    """g: ord, east and north of ``source`` (ord, lat, lon): geocentric coordinates, shift, Airy ellipsoid, transverse Mercator (the published series)."""
    rad, sec = "pi() / 180", "pi() / 648000"
    a, b, f0, n = "6377563.396::double", "6356256.909::double", "0.9996012717::double", "((6377563.396::double - 6356256.909) / (6377563.396::double + 6356256.909))"
    we2, ae2 = "(1 - power(6356752.314245179::double / 6378137, 2))", f"(1 - power({b} / {a}, 2))"
    return f"""g1 as (select ord, lat * {rad} as p, lon * {rad} as l, 6378137 / sqrt(1 - {we2} * power(sin(lat * {rad}), 2)) as v from {source}),
        g2 as (select ord, v * cos(p) * cos(l) as x, v * cos(p) * sin(l) as y, (1 - {we2}) * v * sin(p) as z from g1),
        g3 as (select ord, -446.448 + (1 + 20.4894e-6::double) * x + 0.8421 * {sec} * y - 0.2470 * {sec} * z as x, 125.157 - 0.8421 * {sec} * x + (1 + 20.4894e-6::double) * y + 0.1502 * {sec} * z as y,
            -542.060 + 0.2470 * {sec} * x - 0.1502 * {sec} * y + (1 + 20.4894e-6::double) * z as z from g2),
        g4 as (select *, sqrt(x * x + y * y) as r, atan2(z * {a}, sqrt(x * x + y * y) * {b}) as th from g3),
        g5 as (select ord, atan2(z + (power({a} / {b}, 2) - 1) * {b} * power(sin(th), 3), r - {ae2} * {a} * power(cos(th), 3)) as p, atan2(y, x) + 2 * {rad} as d from g4),
        g6 as (select *, sin(p) as sp, cos(p) as cp, power(tan(p), 2) as t2, {a} * {f0} / sqrt(1 - {ae2} * power(sin(p), 2)) as nu, {a} * {f0} * (1 - {ae2}) / power(1 - {ae2} * power(sin(p), 2), 1.5) as rho, p - 49 * {rad} as dp, p + 49 * {rad} as s from g5),
        g7 as (select *, nu / rho - 1 as h, {b} * {f0} * ((1 + {n} + 1.25 * power({n}, 2) + 1.25 * power({n}, 3)) * dp - (3 * {n} + 3 * power({n}, 2) + 2.625 * power({n}, 3)) * sin(dp) * cos(s)
            + 1.875 * (power({n}, 2) + power({n}, 3)) * sin(2 * dp) * cos(2 * s) - 35::double / 24 * power({n}, 3) * sin(3 * dp) * cos(3 * s)) as m from g6),
        g as (select ord, 400000 + nu * cp * d + nu / 6 * power(cp, 3) * (nu / rho - t2) * power(d, 3) + nu / 120 * power(cp, 5) * (5 - 18 * t2 + t2 * t2 + 14 * h - 58 * t2 * h) * power(d, 5) as east,
            m - 100000 + nu / 2 * sp * cp * d * d + nu / 24 * sp * power(cp, 3) * (5 - t2 + 9 * h) * power(d, 4) + nu / 720 * sp * power(cp, 5) * (61 - 58 * t2 + t2 * t2) * power(d, 6) as north from g7)"""


_BOXES = ", ".join(f"{f}({c}) as {c}_{f}" for c in ("lat", "lon", "east", "north") for f in ("min", "max"))
_BOX_NAMES = [f"{c}_{f}" for c in ("lat", "lon", "east", "north") for f in ("min", "max")]
_SUMMARY = f"select volunteer, session_id, count(*) as n_points, min(us) as start_time_us, max(us) as end_time_us, (max(us) - min(us)) / 1e6::double as duration_s, {_BOXES} from {{}} group by 1, 2"


def _flags(source: str, speed: float, points: int, seconds: float, accuracy: bool) -> str:
    """f: a stream with its flags."""
    passes = "coalesce(accuracy_m is null or accuracy_m <= 50 or accuracy_m = 100, false)" if accuracy else "true"
    return f"""f_1 as (select *, us - lag(us) over w as dt, sqrt(power(east - lag(east) over w, 2) + power(north - lag(north) over w, 2)) as moved from {source} window w as (partition by volunteer, session_id order by ord)),
        f_2 as (select *, case when dt > 0 then moved / (dt / 1e6::double) * 3.6 end as implied_speed_kmh from f_1),
        f as (select *, lat between 55.80 and 56.05 and lon between -3.40 and -3.00 as area_ok, {passes} as accuracy_ok, implied_speed_kmh is null or implied_speed_kmh <= {speed} as speed_ok,
              row_number() over (partition by volunteer, session_id, us order by ord) = 1 as dedup_ok,
              count(*) over (partition by volunteer, session_id) >= {points} and (max(us) over (partition by volunteer, session_id) - min(us) over (partition by volunteer, session_id)) / 1e6 >= {seconds} as session_ok from f_2)"""


_ALL_OK = "accuracy_ok and speed_ok and dedup_ok and session_ok"


def _audit(accuracy: bool) -> str:
    count = lambda name, what: f"count(*) filter (where {what}) as {name}"
    parts = ["count(*) as input_rows", count("in_study_area", "area_ok"), count("out_of_study_area", "not area_ok")]
    parts += [count("accuracy_fail", "not accuracy_ok")] if accuracy else []
    parts += [count("speed_fail", "not speed_ok"), count("dedup_drop", "not dedup_ok"), count("short_session_drop", "not session_ok"), count("kept_rows", _ALL_OK), count("dropped_rows", f"not ({_ALL_OK})")]
    return f"select {', '.join(parts)} from f"


_MATCHED_NAMES = ("gpx_lat", "gpx_lon", "gpx_east", "gpx_north")


def _layer(name: str, keep: str) -> str:
    """m_<name>: points of a layer with their truth."""
    lerp = ", ".join(f"case when ok then l_{c} + w * (r_{c} - l_{c}) end as gpx_{c}" for c in ("lat", "lon", "east", "north"))
    sides = ", ".join(f"{s}.{c} as {s}_{c}" for s in "lr" for c in ("us", "lat", "lon", "east", "north"))
    return f"""h_{name} as (select * from h where {keep}), hs_{name} as ({_SUMMARY.format(f"h_{name}")}),
        p_{name} as (select g.volunteer, g.session_id as gpx_session_id, h.session_id as glh_session_id, greatest(g.start_time_us, h.start_time_us) as low, least(g.end_time_us, h.end_time_us) as high
            from gs g join hs_{name} h on g.volunteer = h.volunteer and least(g.end_time_us, h.end_time_us) > greatest(g.start_time_us, h.start_time_us)),
        q_{name} as (select h.*, p.gpx_session_id from h_{name} h join p_{name} p on h.volunteer = p.volunteer and h.session_id = p.glh_session_id and h.us between p.low and p.high),
        b_{name} as (select q.volunteer, q.session_id as glh_session_id, q.gpx_session_id, q.us, q.ord, q.lat as glh_lat, q.lon as glh_lon, q.east as glh_east, q.north as glh_north, q.accuracy_m as glh_accuracy_m, q.source as glh_source, q.speed_mps as glh_speed_mps, {sides}
            from q_{name} q asof left join g l on q.volunteer = l.volunteer and q.gpx_session_id = l.session_id and q.us >= l.us asof left join g r on q.volunteer = r.volunteer and q.gpx_session_id = r.session_id and q.us < r.us),
        w_{name} as (select *, case when l_us is not null and r_us is not null then (us - l_us) / 1e6::double end as bracket_dt_prev_s, case when l_us is not null and r_us is not null then (r_us - us) / 1e6::double end as bracket_dt_next_s from b_{name}),
        x_{name} as (select *, bracket_dt_prev_s + bracket_dt_next_s as bracket_total_s, coalesce(bracket_dt_prev_s + bracket_dt_next_s <= 900, false) as ok, bracket_dt_prev_s / (bracket_dt_prev_s + bracket_dt_next_s) as w from w_{name}),
        y_{name} as (select *, {lerp}, row_number() over (partition by volunteer, us, glh_session_id order by gpx_session_id, ord) as n from x_{name}),
        m_{name} as (select *, '{name}' as glh_layer, ok as matched, sqrt(power(glh_east - gpx_east, 2) + power(glh_north - gpx_north, 2)) as deviation_m from y_{name} where n = 1)"""


_GS = f"gs as ({_SUMMARY.format('g')})"
ALL_LAYERS = f"{STREAMS}, {_GS}, {_layer('all', 'true')}"
MATCHED = f"""{STREAMS}, {_GS}, {_layer("raw_signals", "glh_layer = 'raw_signals'")}, {_layer("timeline_paths", "glh_layer = 'timeline_paths'")},
    m as (select * from m_raw_signals union all select * from m_timeline_paths)"""

_NET = "net as (select n_nationkey::bigint as k, 325000.0::double + 40 * n_nationkey as x, n_name as road_name, case when n_nationkey % 2 = 0 then 'carriageway' else 'pedestrian' end as network_kind from nation)"


def _near(name: str, points: str, east: str, cap: float, which: str = "true", key: str = "ord") -> str:
    """name: edges within cap of each point, by nearness (rn). Streets run north along the whole extent."""
    return f"{name} as (select p.{key}, net.*, abs(p.{east} - net.x) as d, row_number() over (partition by p.{key} order by abs(p.{east} - net.x), net.k) as rn from {points} p join net on abs(p.{east} - net.x) <= {cap} and {which})"


CORRECTED = f"""{MATCHED}, {_NET}, {_near("car", "m", "glh_east", 15, "net.k % 2 = 0", "us")}, {_near("ped", "m", "glh_east", 15, "net.k % 2 = 1", "us")},
    c_1 as (select m.*, car.d as car_d, ped.d as ped_d, case when car.d is not null and (ped.d is null or car.d <= ped.d) then car.x else ped.x end as corrected_glh_east,
            case when car.d is not null and (ped.d is null or car.d <= ped.d) then 'carriageway' when ped.d is not null then 'pedestrian' end as corrected_glh_network_kind,
            case when car.d is not null and (ped.d is null or car.d <= ped.d) then car.d else ped.d end as corrected_snap_distance_m
            from m left join car on m.us = car.us and car.rn = 1 left join ped on m.us = ped.us and ped.rn = 1),
    c_2 as (select *, case when corrected_glh_east is not null then glh_north end as corrected_glh_north from c_1),
    c_3 as (select *, sqrt(power(corrected_glh_east - gpx_east, 2) + power(corrected_glh_north - gpx_north, 2)) as corrected_deviation_m from c_2),
    c as (select *, deviation_m - corrected_deviation_m as improvement_m from c_3)"""

_BUILDINGS = "b as (select s_suppkey::bigint as k, 325000.0::double + s_suppkey * 37 % 1000 as x, 673000.0::double + s_suppkey * 71 % 1000 as y from supplier)"
_NEAR_B = f"""{BASE}, {_BUILDINGS}, p as (select * from t where kind = 'GLH'),
    d as (select p.ord, p.east, p.north, b.*, sqrt(power(greatest(x - east, 0, east - x - 12), 2) + power(greatest(y - north, 0, north - y - 8), 2)) as d from p cross join b)"""
_INSIDE = "east > x and east < x + 12 and north > y and north < y + 8"


def _box(r: int) -> str:
    return f"x <= east + {r} and x + 12 >= east - {r} and y <= north + {r} and y + 8 >= north - {r}"


def _density(r: int) -> str:
    return f"count(*) filter (where d <= {r}) as n_buildings_{r}m, round(96.0::double * count(*) filter (where d <= {r}), 4) as building_area_{r}m_m2"


_SNAP = f"""{BASE}, {_NET}, p as (select * from t where kind = 'GLH'), {{}}
    select p.ord, round(n.x, 4) as snap_east, round(case when n.x is not null then p.north end, 4) as snap_north, round(n.d, 4) as snap_distance_m, 't' || n.k as snap_toid, n.network_kind as snap_network_kind, n.road_name as snap_road_name
    from p left join n on p.ord = n.ord and n.rn = 1"""
_EXPORT = f"{BASE}, e as (select *, cast(user_id as varchar) as who, row_number() over (partition by user_id order by ord) - 1 as segment_id from t)"
_DOCS = f"{BASE}, e as (select *, (user_id % 8) || '_' || (ord // 4000) as doc, row_number() over (partition by user_id % 8, ord // 4000 order by ord) - 1 as place from t)"
_SEGMENTS = """select doc, 'timeline_paths' as layer, place as segment_id, null as endpoint, us + ord % 60 * 60000000 as at_us, lat, lon from e where ord % 3 = 0
        union all select doc, 'visits', place, null, us, lat, lon from e where ord % 3 = 1
        union all select doc, 'activities', place, endpoint, us, lat, lon from e cross join (values ('start'), ('end')) as ends(endpoint) where ord % 3 = 2"""
_POINT = "volunteer, glh_layer, us as timestamp_us"
_CARRIAGEWAY = ("motorway", "residential", "track_grade3")
_PEDESTRIAN = ("footway", "cycleway", "steps")
_SAMPLE_CLASSES = "['Motorway', ' residential ', 'footway', 'cycleway', 'construction', 'track_grade3', 'steps', 'proposed', null]"
_QUANTILES = ", ".join(f"round(quantile_cont(case when matched then deviation_m end, {q}), 4) as {n}_m" for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))

ORACLE_SQL = {
    "sessionise_gap": f"{BASE}, {GLH} select ord, volunteer, session_id, point_id from h",
    "trkseg_sessions": f"""{BASE}, a as (select *, user_id % 3 as trk, lag(us) over w as prev, lag(user_id % 3) over w as was from t where kind = 'GPX' window w as (partition by volunteer order by user_id % 3, us, ord)),
        s as (select *, cast(sum(case when prev is null or was <> trk or us - prev > 3600000000 then 1 else 0 end) over (partition by volunteer order by trk, us, ord rows unbounded preceding) - 1 as bigint) as session_id from a)
        select ord, session_id, row_number() over (partition by volunteer, session_id order by us, ord) - 1 as point_id from s""",
    "path_sessions": f"{BASE} select ord, user_id as session_id, row_number() over (partition by volunteer, user_id order by us, ord) - 1 as point_id from t where glh_layer = 'timeline_paths'",
    "visit_sessions": f"{BASE} select ord, user_id % 10 as session_id, row_number() over (partition by volunteer, user_id % 10 order by us, ord) - 1 as point_id from t where kind = 'GLH'",
    "session_extent": f"{BASE}, {GLH}, s as ({_SUMMARY.format('h')}) select volunteer, session_id, n_points, start_time_us, end_time_us, {_r('duration_s', digits=6)}, {_r(*_BOX_NAMES)} from s",
    "session_rate": f"{BASE}, {GPX}, s as ({_SUMMARY.format('g')}) select volunteer, session_id, 'f' || volunteer as source_file, n_points, {_r('duration_s', digits=6)}, round((n_points - 1) / nullif(duration_s, 0), 6) as mean_rate_hz from s",
    "session_window_summary": f"{BASE}, {GLH}, s as ({_SUMMARY.format('h')}) select volunteer, n_points, start_time_us, end_time_us, {_r('duration_s', digits=6)}, {_r(*_BOX_NAMES[:4])} from s",
    "qc_bbox": f"{BASE} select ord, lat between 55.80 and 56.05 and lon between -3.40 and -3.00 as qc_in_study_area from t",
    "qc_accuracy": f"{BASE} select ord, accuracy_m is null or accuracy_m = 100 or accuracy_m <= 50 as qc_accuracy_pass from t",
    "qc_speed": f"{BASE}, {GLH}, {_flags('h', 0.5, 5, 60, True)} select ord, {_r('implied_speed_kmh')}, speed_ok as qc_speed_pass from f",
    "qc_dedup": f"{BASE} select ord, row_number() over (partition by volunteer, us // 3600000000 order by ord) = 1 as qc_dedup_keep from t",
    "qc_short": f"{BASE}, {GLH}, {_flags('h', 0.5, 5, 60, True)} select ord, session_ok as qc_session_pass from f",
    "clean_kept": f"{BASE}, {GLH}, {_flags('h', 0.5, 3, 60, True)} select ord, volunteer, session_id from f where {_ALL_OK}",
    "clean_dropped_reasons": f"""{BASE}, {GLH}, {_flags("h", 0.5, 3, 60, True)} select ord, concat_ws(',', case when not accuracy_ok then 'qc_accuracy_pass' end, case when not speed_ok then 'qc_speed_pass' end,
        case when not dedup_ok then 'qc_dedup_keep' end, case when not session_ok then 'qc_session_pass' end) as drop_reason from f where not ({_ALL_OK})""",
    "clean_audit": f"{BASE}, {GLH}, {_flags('h', 0.5, 3, 60, True)} {_audit(True)}",
    "clean_paths_audit": f"{BASE}, {GLH}, hp as (select * from h where glh_layer = 'timeline_paths'), {_flags('hp', 0.5, 1, 0, False)} {_audit(False)}",
    "clean_gpx_audit": f"{BASE}, {GPX}, {_flags('g', 1.0, 5, 60, False)} {_audit(False)}",
    "overlap_pairs": f"{ALL_LAYERS} select volunteer, gpx_session_id, glh_session_id, low as overlap_start_us, high as overlap_end_us, round((high - low) / 1e6::double, 6) as overlap_s from p_all",
    "interpolate_asof": f"""{BASE}, g as (select * from t where kind = 'GPX'), q as (select * from t where kind = 'GLH'),
        b as (select q.ord as target, q.us, l.us as l_us, r.us as r_us, {", ".join(f"{s}.{c} as {s}_{c}" for s in "lr" for c in ("lat", "lon", "east", "north"))}
              from q asof left join g l on q.volunteer = l.volunteer and q.us >= l.us asof left join g r on q.volunteer = r.volunteer and q.us < r.us),
        x as (select *, l_us is not null and r_us is not null as ok, (us - l_us) / 1e6::double as p, (r_us - us) / 1e6::double as n from b)
        select target, ok as in_bracket, {", ".join(f"round(case when ok then l_{c} + p / (p + n) * (r_{c} - l_{c}) end, 4) as gpx_{c}" for c in ("lat", "lon", "east", "north"))},
               round(case when ok then p end, 6) as bracket_dt_prev_s, round(case when ok then n end, 6) as bracket_dt_next_s, round(case when ok then p + n end, 6) as bracket_total_s from x""",
    "match_streams": f"{ALL_LAYERS} select volunteer, glh_layer, glh_session_id, gpx_session_id, us as timestamp_us, glh_source, {_r('glh_accuracy_m', 'glh_east', 'glh_north', *_MATCHED_NAMES, 'deviation_m')}, {_r('bracket_dt_prev_s', 'bracket_dt_next_s', 'bracket_total_s', digits=6)}, matched from m_all",
    "match_layers": f"{MATCHED} select volunteer, glh_layer, glh_session_id, gpx_session_id, us as timestamp_us, {_r('deviation_m')}, matched from m",
    "deviation_summary": f"""{MATCHED} select volunteer, glh_layer, count(*) as n_total, count(*) filter (where matched) as n_matched, round(count(*) filter (where matched) / count(*), 4) as match_rate,
        round(avg(case when matched then deviation_m end), 4) as mean_m, {_QUANTILES}, round(max(case when matched then deviation_m end), 4) as max_m from m group by 1, 2""",
    # there and back is the identity to the sixth decimal
    "bng_forward": f"{BASE}, {_bng('t')} select ord, round(east, 3) as east, round(north, 3) as north from g",
    "bng_roundtrip": f"{BASE} select ord, round(lat, 6) as lat, round(lon, 6) as lon from t",
    "bng_distance": f"{BASE} select ord, round(sqrt(power(east - 325500, 2) + power(north - 673500, 2)), 4) as distance_m from t",
    "parse_latlng": f"{BASE} select ord, case when ord % 5 in (0, 1, 2) then lat end as lat, case when ord % 5 in (0, 1, 2) then lon end as lon from t",
    "safe_float": f"{BASE} select ord, case when ord % 3 = 1 then round(speed_mps, 6) end as value from t",
    "offset_time": f"{BASE} select ord, case when ord % 4 <> 0 then us + ord % 90 * 60000000 end as at_us from t",
    "osm_classify": f"""{BASE}, k as (select ord, lower(trim({_SAMPLE_CLASSES}[ord % 9 + 1])) as c from t)
        select ord, case when c in {_CARRIAGEWAY} then 'osm_carriageway' when c in {_PEDESTRIAN} then 'osm_pedestrian' else 'osm_other' end as network_kind from k""",
    "union_dedupe_network": """with u as (select 0 as part, cast(s_suppkey % 20 as varchar) as toid, s_name as road_name, null as city, s_suppkey::bigint as k from supplier
        union all select 1, 'osm_' || s_suppkey % 7, null, 'x', s_suppkey from supplier union all select 2, cast(s_suppkey % 30 as varchar), null, null, s_suppkey from supplier),
        r as (select *, row_number() over (partition by toid order by part, k) as n from u) select toid, road_name, city, k from r where n = 1""",
    "snap_nearest": _SNAP.format(_near("n", "p", "east", 100)),
    "snap_nearest_15m": _SNAP.format(_near("n", "p", "east", 15)),
    "dist_to_network": f"{BASE}, {_NET} select ord, round(min(abs(east - x)), 4) as dist_to_network_m from t cross join net where kind = 'GLH' group by ord",
    "candidates_topk": f"{BASE}, {_NET}, p as (select * from t where kind = 'GLH'), {_near('n', 'p', 'east', 100)} select p.ord, (n.rn - 1)::int as rank, n.k as edge_ord, round(n.d, 4) as d, round(n.x, 4) as proj_east, round(p.north, 4) as proj_north from p join n on p.ord = n.ord where n.rn <= 3",
    "inside_building": f"{_NEAR_B} select ord, bool_or({_INSIDE}) as inside_building, cast(min(k) filter (where {_INSIDE}) as varchar) as inside_building_osm_id from d group by ord",
    "nearest_building": f"{_NEAR_B} select ord, round(min(d) filter (where {_box(60)}), 4) as nearest_building_m from d group by ord",
    "building_density": f"{_NEAR_B} select ord, {_density(100)} from d group by ord",
    "building_features": f"{_NEAR_B} select ord, bool_or({_INSIDE}) as inside_building, round(min(d) filter (where {_box(200)}), 4) as nearest_building_m, {_density(50)}, {_density(100)} from d group by ord",
    "bearing": f"{BASE} select ord, round(sin(atan2(325500 - east, 673500 - north)), 6) as sin, round(cos(atan2(325500 - east, 673500 - north)), 6) as cos from t",
    "map_features": f"""{BASE}, {_NET}, p as (select * from t where kind = 'GLH'), {_near("car", "p", "east", 30, "net.k % 2 = 0")}, {_near("ped", "p", "east", 30, "net.k % 2 = 1")}
        select p.ord, round(car.d, 4) as nearest_car_distance_m, round(ped.d, 4) as nearest_ped_distance_m, round(least(car.d, ped.d), 4) as dist_to_nearest_network_m,
               {", ".join(f"round({f}(atan2({k}.x - p.east, case when {k}.x is not null then 0 end)), 4) as bearing_to_nearest_{k}_{f}" for k in ("car", "ped") for f in ("sin", "cos"))}, 't' || car.k as nearest_car_toid, 't' || ped.k as nearest_ped_toid
        from p left join car on p.ord = car.ord and car.rn = 1 left join ped on p.ord = ped.ord and ped.rn = 1""",
    "rule_correct": f"{CORRECTED} select {_POINT}, corrected_glh_network_kind, {_r('corrected_glh_east', 'corrected_glh_north', 'corrected_snap_distance_m', 'corrected_deviation_m', 'improvement_m')} from c",
    "correction_summary": f"""{CORRECTED}, x as (select *, case when matched then deviation_m end as raw, case when matched then corrected_deviation_m end as cor, case when matched and corrected_deviation_m is not null then improvement_m end as gain from c)
        select volunteer, glh_layer, count(*) filter (where matched) as n_matched, count(cor) as n_correctable, round(count(cor) / nullif(count(*) filter (where matched), 0), 4) as snap_rate,
        {", ".join(f"round(quantile_cont({c}, 0.5), 4) as {c}_median_m, round(avg({c}), 4) as {c}_mean_m, round(quantile_cont({c}, 0.95), 4) as {c}_p95_m" for c in ("raw", "cor"))},
        round(quantile_cont(gain, 0.5), 4) as improvement_median_m, round(avg(gain), 4) as improvement_mean_m, round(100.0::double * count(*) filter (where gain > 0) / nullif(count(gain), 0), 4) as pct_improved from x group by 1, 2""",
    "hybrid_alpha": f"""{CORRECTED}, a as (select *, glh_accuracy_m / 10 as p, corrected_glh_east is not null as snap from c),
        x as (select *, case when snap and p is not null then least(greatest(p / nullif(p + corrected_snap_distance_m, 0), 0), 1) else 0.0::double end as alpha from a),
        y as (select *, case when snap then glh_east + alpha * (corrected_glh_east - glh_east) else glh_east end as pe, case when snap then glh_north + alpha * (corrected_glh_north - glh_north) else glh_north end as pn from x),
        z as (select *, sqrt(power(pe - gpx_east, 2) + power(pn - gpx_north, 2)) as dev from y)
        select {_POINT}, round(alpha, 4) as hybrid_alpha, round(pe, 4) as pred_glh_east, round(pn, 4) as pred_glh_north, round(dev, 4) as pred_deviation_m, round(deviation_m - dev, 4) as improvement_vs_raw_m, round(corrected_deviation_m - dev, 4) as improvement_vs_stage2_m from z""",
    "classifier_decision": f"""{CORRECTED}, x as (select *, coalesce(corrected_glh_east is not null and glh_accuracy_m / 100 >= 0.5, false) as take from c),
        y as (select *, case when take then corrected_glh_east else glh_east end as pe, case when take then corrected_glh_north else glh_north end as pn from x),
        z as (select *, sqrt(power(pe - gpx_east, 2) + power(pn - gpx_north, 2)) as dev from y)
        select {_POINT}, take as snap_helps_decision, round(pe, 4) as clf_glh_east, round(pn, 4) as clf_glh_north, round(dev, 4) as clf_deviation_m, round(deviation_m - dev, 4) as clf_improvement_vs_raw_m, round(corrected_deviation_m - dev, 4) as clf_improvement_vs_stage2_m from z""",
    # every point has a street within 100 m here, so no chain is broken; sums in the order of the operator's
    "hmm_match": f"""{MATCHED.replace("with ", "with recursive ", 1)}, {_NET}, {_near("n", "m", "glh_east", 100, key="us")},
        vo as (select volunteer, glh_session_id, us, list({{'d': d, 'x': x}} order by rn) as c from n join m using (us) where n.rn <= 5 group by all),
        vs as (select *, row_number() over w as t, count(*) over (partition by volunteer, glh_session_id) as steps, glh_east - lag(glh_east) over w as de, glh_north - lag(glh_north) over w as dn,
              673000 + (glh_north - 673000) * 1000 / 1000000 * 1000 as y from m join vo using (volunteer, glh_session_id, us) window w as (partition by volunteer, glh_session_id order by us)),
        vf as (select volunteer, glh_session_id, t, c, y, list_transform(c, lambda a: -(a.d * a.d) / 200) as score, list_transform(c, lambda a: 0::bigint) as back from vs where t = 1
              union all
              select volunteer, glh_session_id, t, c, y, list_transform(p, lambda a: a.best) as score, list_transform(p, lambda a: a.i) as back from (
                select *, list_transform(q, lambda a: {{'best': list_max(a.path) - a.d * a.d / 200, 'i': list_position(a.path, list_max(a.path))::bigint}}) as p from (
                  select s.volunteer, s.glh_session_id, s.t, s.c, s.y, list_transform(s.c, lambda b: {{'d': b.d, 'path': list_transform(range(1, len(f.c) + 1), lambda i:
                    f.score[i] - abs(sqrt((f.c[i].x - b.x) * (f.c[i].x - b.x) + (f.y - s.y) * (f.y - s.y)) - sqrt(s.de * s.de + s.dn * s.dn)) / 50)}}) as q
                  from vf f join vs s on f.volunteer = s.volunteer and f.glh_session_id = s.glh_session_id and s.t = f.t + 1))),
        vr as (select f.volunteer, f.glh_session_id, f.t, list_position(score, list_max(score))::bigint as k from vf f join vs s using (volunteer, glh_session_id, t) where s.t = s.steps and s.steps > 1
              union all
              select f.volunteer, f.glh_session_id, r.t - 1, f.back[r.k] from vr r join vf f on f.volunteer = r.volunteer and f.glh_session_id = r.glh_session_id and f.t = r.t where r.t > 1),
        vh as (select s.*, s.c[r.k] as e from vs s left join vr r using (volunteer, glh_session_id, t)),
        vv as (select *, sqrt(power(e.x - gpx_east, 2) + power(case when e is not null then glh_north end - gpx_north, 2)) as dev from vh)
        select {_POINT.replace("glh_layer", "glh_layer, glh_session_id")}, round(e.x, 4) as hmm_pred_glh_east, round(case when e is not null then glh_north end, 4) as hmm_pred_glh_north, round(e.d, 4) as hmm_perp_distance_m,
               round(dev, 4) as hmm_pred_deviation_m, round(deviation_m - dev, 4) as hmm_improvement_vs_raw_m from vv""",
    "log_target": f"{MATCHED} select {_POINT}, round(ln(1 + deviation_m), 6) as y from m where matched",
    "one_hot": f"""{CORRECTED} select volunteer, us as timestamp_us, glh_layer, (glh_layer = 'raw_signals')::bigint as glh_layer__raw_signals, (glh_layer = 'timeline_paths')::bigint as glh_layer__timeline_paths,
        coalesce(glh_source = 'click', false)::bigint as glh_source__click, coalesce(glh_source = 'view', false)::bigint as glh_source__view, 0::bigint as inside_building, {_r("corrected_snap_distance_m")} from c""",
    "feature_levels": f"""{CORRECTED}, l as (select distinct 'glh_source' as feature, glh_source as level from c union select distinct 'glh_layer', glh_layer from c union select distinct 'corrected_glh_network_kind', corrected_glh_network_kind from c)
        select feature, row_number() over (partition by feature order by level) - 1 as place, level from l where level is not null""",
    "snap_helped_label": f"{CORRECTED} select {_POINT}, (corrected_deviation_m < deviation_m)::bigint as snap_helped from c where matched and corrected_deviation_m < deviation_m is not null",
    "glh_raw_signals": f"{_EXPORT} select who as volunteer, us as timestamp_us, lat, lon, {_r('accuracy_m')}, source from e where ord % 3 = 0",
    "glh_activity_records": f"{_EXPORT} select who as volunteer, us as timestamp_us, case when ord % 10 > 5 then 'STILL' else source end as top_activity, round(greatest(0.5::double, ord % 10 / 10), 4) as confidence, 2::bigint as n_candidates from e where ord % 3 = 1",
    "glh_wifi_scans": f"{_EXPORT} select who as volunteer, us as timestamp_us, ord % 4 as n_access_points from e where ord % 3 = 2",
    "glh_timeline_paths": f"{_EXPORT} select who as volunteer, segment_id, us + ord % 60 * 60000000 as timestamp_us, lat, lon from e where ord % 3 = 0",
    "glh_visits": f"{_EXPORT} select who as volunteer, segment_id, us as start_time_us, lat, lon, 'p' || ord as place_id from e where ord % 3 = 1",
    "glh_activities": f"{_EXPORT} select who as volunteer, segment_id, endpoint, us as timestamp_us, lat, lon, 'WALKING' as mode, round(speed_mps, 4) as distance_m from e cross join (values ('start'), ('end')) as ends(endpoint) where ord % 3 = 2",
    "glh_parse_a": f"""{_DOCS} {_SEGMENTS} union all select doc, 'raw_signals', null, null, us, lat, lon from e where ord % 3 = 0
        union all select doc, case when ord % 3 = 1 then 'activity_records' else 'wifi_scans' end, null, null, us, null, null from e where ord % 3 <> 0""",
    "glh_parse_b": f"{_DOCS} {_SEGMENTS}",
    "gpx_parse": f"""{_DOCS}, p as (select *, ord % 2 as seg_idx, lag(us) over (partition by doc, ord % 2 order by us, ord) as prev from e where ord % 9 <> 0),
        s as (select *, sum(case when us - prev > 3600000000 then 1 else 0 end) over (partition by doc, seg_idx order by us, ord rows unbounded preceding) as part from p)
        select row_number() over (partition by doc, seg_idx, part order by us, ord) - 1 as point_id, us as timestamp_us, lat, lon, case when ord % 5 <> 0 then round(speed_mps, 4) end as elevation_m, 0::bigint as trk_idx, seg_idx from s""",
    "load_layers": "select c_custkey::varchar as toid, c_name as road_name, 'path_link' as network_kind, 2 as n_parts, 5 as n_points, (325000 + c_custkey % 997)::double as x, (673000 + c_custkey * 7 % 991 + 9)::double as y from customer",
}
