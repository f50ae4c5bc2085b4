"""WGS84 to British National Grid and back, as column arithmetic.

Latitude and longitude become geocentric coordinates, a seven-parameter Helmert shift leads to the Airy 1830
ellipsoid, and a transverse Mercator projection to grid metres. Each stage is a set of columns, so that no
expression is repeated and all of it is generated code. The shift is accurate to a few metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published constants of the two ellipsoids, the shift and the grid: fixed values.
WGS84_A, WGS84_B = 6378137.0, 6356752.314245179
AIRY_A, AIRY_B = 6377563.396, 6356256.909
SHIFT_X, SHIFT_Y, SHIFT_Z = -446.448, 125.157, -542.060
TURN_X, TURN_Y, TURN_Z = (math.radians(s / 3600) for s in (-0.1502, -0.2470, -0.8421))
SCALE = 1 + 20.4894e-6
F0, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
_N = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)


def _e2(a: float, b: float) -> float:
    return 1 - (b / a) ** 2


def _stages(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({f"_p_{k}": v for k, v in stage.items()})
    return df


def _c(name: str) -> Column:
    return F.col(f"_p_{name}")


def _geocentric(df: DataFrame, lat: Column, lon: Column, a: float, b: float) -> DataFrame:
    """lat and lon in radians to x, y, z."""
    e2 = _e2(a, b)
    return _stages(
        df,
        {"sl": F.sin(lat), "cl": F.cos(lat), "so": F.sin(lon), "co": F.cos(lon)},
        {"nu": a / F.sqrt(1 - e2 * _c("sl") * _c("sl"))},
        {"x": _c("nu") * _c("cl") * _c("co"), "y": _c("nu") * _c("cl") * _c("so"), "z": (1 - e2) * _c("nu") * _c("sl")},
    )


def _geodetic(df: DataFrame, a: float, b: float) -> DataFrame:
    """x, y, z to phi and lam in radians."""
    e2, ep2 = _e2(a, b), (a / b) ** 2 - 1
    return _stages(
        df,
        {"r": F.hypot(_c("x"), _c("y"))},
        {"th": F.atan2(_c("z") * a, _c("r") * b)},
        {"st": F.sin(_c("th")), "ct": F.cos(_c("th"))},
        {"phi": F.atan2(_c("z") + ep2 * b * _c("st") * _c("st") * _c("st"), _c("r") - e2 * a * _c("ct") * _c("ct") * _c("ct")), "lam": F.atan2(_c("y"), _c("x"))},
    )


def _arc(phi: Column) -> Column:
    """Meridian arc from the origin."""
    n = _N
    d, s = phi - LAT0, phi + LAT0
    return AIRY_B * F0 * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
        - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s)
        - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )


def _radii(df: DataFrame, phi: Column) -> DataFrame:
    e2 = _e2(AIRY_A, AIRY_B)
    return _stages(
        df,
        {"sp": F.sin(phi), "cp": F.cos(phi), "tp": F.tan(phi)},
        {"w": 1 - e2 * _c("sp") * _c("sp"), "t2": _c("tp") * _c("tp")},
        {"nu": AIRY_A * F0 / F.sqrt(_c("w")), "rho": AIRY_A * F0 * (1 - e2) / (_c("w") * F.sqrt(_c("w")))},
        {"eta2": _c("nu") / _c("rho") - 1},
    )


def _clean(df: DataFrame, **out: Column) -> DataFrame:
    df = df.withColumns(out)
    return df.drop(*[c for c in df.columns if c.startswith("_p_")])


def to_bng(df: DataFrame, lat: str = "lat", lon: str = "lon", east: str = "east", north: str = "north") -> DataFrame:
    """Add grid coordinates; null where latitude or longitude is."""
    df = _geocentric(df, F.radians(F.col(lat)), F.radians(F.col(lon)), WGS84_A, WGS84_B)
    x, y, z = _c("x"), _c("y"), _c("z")
    df = _stages(df, {
        "x": SHIFT_X + SCALE * x - TURN_Z * y + TURN_Y * z,
        "y": SHIFT_Y + TURN_Z * x + SCALE * y - TURN_X * z,
        "z": SHIFT_Z - TURN_Y * x + TURN_X * y + SCALE * z,
    })
    df = _radii(_geodetic(df, AIRY_A, AIRY_B), _c("phi"))
    nu, rho, eta2, t2, sp, cp, d = (_c(k) for k in ("nu", "rho", "eta2", "t2", "sp", "cp", "d"))
    df = _stages(df, {"d": _c("lam") - LON0, "m": _arc(_c("phi"))}, {"d2": d * d, "c3": cp * cp * cp})
    d2, c3 = _c("d2"), _c("c3")
    n = _c("m") + N0 + nu / 2 * sp * cp * d2 + nu / 24 * sp * c3 * (5 - t2 + 9 * eta2) * d2 * d2 + nu / 720 * sp * c3 * cp * cp * (61 - 58 * t2 + t2 * t2) * d2 * d2 * d2
    e = E0 + nu * cp * d + nu / 6 * c3 * (nu / rho - t2) * d * d2 + nu / 120 * c3 * cp * cp * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * d * d2 * d2
    return _clean(df, **{east: e, north: n})


def to_wgs84(df: DataFrame, east: str = "east", north: str = "north", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add latitude and longitude; null where a grid coordinate is."""
    df = _stages(df, {"phi": (F.col(north) - N0) / (AIRY_A * F0) + LAT0})
    for _ in range(6):
        df = _stages(df, {"m": _arc(_c("phi"))}, {"phi": _c("phi") + (F.col(north) - N0 - _c("m")) / (AIRY_A * F0)})
    df = _radii(df, _c("phi"))
    nu, rho, eta2, t2, tp, cp = (_c(k) for k in ("nu", "rho", "eta2", "t2", "tp", "cp"))
    df = _stages(df, {"q": (F.col(east) - E0) / nu, "v": nu / rho}, {"q2": _c("q") * _c("q")})
    q, q2, v = _c("q"), _c("q2"), _c("v")
    phi = _c("phi") - tp * v / 2 * q2 + tp * v / 24 * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * q2 * q2 - tp * v / 720 * (61 + 90 * t2 + 45 * t2 * t2) * q2 * q2 * q2
    lam = LON0 + (q - (v + 2 * t2) / 6 * q * q2 + (5 + 28 * t2 + 24 * t2 * t2) / 120 * q * q2 * q2 - (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2) / 5040 * q * q2 * q2 * q2) / cp
    df = _stages(df, {"phi2": phi, "lam2": lam})
    df = _geocentric(df, _c("phi2"), _c("lam2"), AIRY_A, AIRY_B)
    df = _stages(df, {"x": (_c("x") - SHIFT_X) / SCALE, "y": (_c("y") - SHIFT_Y) / SCALE, "z": (_c("z") - SHIFT_Z) / SCALE})
    x, y, z = _c("x"), _c("y"), _c("z")
    df = _stages(df, {"x": x + TURN_Z * y - TURN_Y * z, "y": y - TURN_Z * x + TURN_X * z, "z": z + TURN_Y * x - TURN_X * y})
    df = _geodetic(df, WGS84_A, WGS84_B)
    return _clean(df, **{lat: F.degrees(_c("phi")), lon: F.degrees(_c("lam"))})


def grid_distance(e1: Column, n1: Column, e2: Column, n2: Column) -> Column:
    """Metres between two grid points; null if any part is."""
    return F.hypot(e1 - e2, n1 - n2)
