"""Map context of points: snaps to both networks, bearings and buildings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import MAX_SNAP_M, building_tables, coordinates, join_back, snap_columns, snaps


@dataclass
class Networks:
    """The combined networks of a region."""

    carriageway: DataFrame
    pedestrian: DataFrame
    full: DataFrame | None = None
    streets: DataFrame | None = None


def bearing(from_east: Column, from_north: Column, to_east: Column, to_north: Column) -> tuple[Column, Column]:
    """Sine and cosine of the direction, 0 to the north and rising to the east; no movement is north."""
    angle = F.atan2(to_east - from_east, to_north - from_north)
    return F.sin(angle), F.cos(angle)


def coordinate_columns(df: DataFrame) -> tuple[str, str]:
    for pair in (("glh_east", "glh_north"), ("east", "north")):
        if set(pair) <= set(df.columns):
            return pair
    raise KeyError("no grid coordinates: name east_col and north_col")


def add_map_context_features(df: DataFrame, networks: Networks, buildings: DataFrame | None = None, east_col: str | None = None, north_col: str | None = None, max_snap_m: float = MAX_SNAP_M, building_radii_m: tuple[float, ...] = (50, 100), compat_attrs: bool = False) -> DataFrame:
    """nearest_car_*, nearest_ped_*, dist_to_nearest_network_m, bearings and, with buildings, their features: all for the different coordinates, joined back once."""
    if east_col is None or north_col is None:
        east_col, north_col = coordinate_columns(df)
    at = coordinates(df, east_col, north_col)
    found, out = building_tables(at, buildings, building_radii_m) if buildings is not None else ([], {})
    for kind, network in (("car", networks.carriageway), ("ped", networks.pedestrian)):
        found.append(snaps(at, network, max_snap_m).withColumnRenamed("best", f"_{kind}"))
    df = join_back(df, found, east_col, north_col)
    for kind in ("car", "ped"):
        df = df.withColumns(snap_columns(F.col(f"_{kind}"), f"nearest_{kind}_", compat_attrs))
    out |= {"dist_to_nearest_network_m": F.least("nearest_car_distance_m", "nearest_ped_distance_m")}
    for kind in ("car", "ped"):
        sin, cos = bearing(F.col(east_col), F.col(north_col), F.col(f"nearest_{kind}_east"), F.col(f"nearest_{kind}_north"))
        out |= {f"bearing_to_nearest_{kind}_sin": sin, f"bearing_to_nearest_{kind}_cos": cos}
    return df.withColumns(out).drop("_car", "_ped", "_first")
