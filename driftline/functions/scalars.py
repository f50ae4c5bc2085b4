"""Scalar expressions: coordinates, times, guards. All are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# "55.9°, -3.2°", "geo:55.9,-3.2" or "55.9, -3.2"; no exponents, no bare fractions: a fixed format.
COORDINATE = r"^\s*(?:geo:)?([-+]?\d+(?:\.\d+)?)\s*°?\s*,\s*([-+]?\d+(?:\.\d+)?)\s*°?\s*$"


def latlng_text(value: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a coordinate string; null where it does not parse."""
    part = lambda i: F.nullif(F.regexp_extract(value, COORDINATE, i), F.lit("")).cast("double")
    return part(1), part(2)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once and written once in the plan, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_truthy(*values: Column) -> Column:
    """The first VARIANT that is neither absent, null, empty, zero nor false."""
    full = lambda v: ~F.is_variant_null(v) & ~F.try_variant_get(v, "$", "string").isin("", "0", "0.0", "false", "[]", "{}")
    return F.coalesce(*[let(value, lambda v: F.when(full(v), v)) for value in values])


def _coordinate(v: Column, deeper: int) -> Column:
    """Text of a coordinate: a string, E7 integers of an object, or what LatLng, latLng or latlng holds."""
    at = lambda k, kind: F.try_variant_get(v, f"$.{k}", kind)
    is_number = lambda k: F.regexp_like(F.schema_of_variant(at(k, "variant")), F.lit("^(BIGINT|DOUBLE|DECIMAL)"))
    e7 = [F.when(is_number(k), at(k, "double") / 1e7).cast("decimal(12,7)").cast("string") for k in ("latitudeE7", "longitudeE7")]
    shape = F.schema_of_variant(v)
    own = F.when(shape == "STRING", F.try_variant_get(v, "$", "string")).when(shape.startswith("OBJECT"), F.concat(e7[0], F.lit(","), e7[1]))
    if not deeper:
        return own
    return F.coalesce(own, let(first_truthy(*[at(k, "variant") for k in ("LatLng", "latLng", "latlng")]), lambda w: _coordinate(w, deeper - 1)))


def add_latlng(df: DataFrame, value: Column, required: bool = False) -> DataFrame:
    """Add lat and lon of a VARIANT: a string, E7 integers, or an object that holds one of these under LatLng, latLng or latlng.

    Objects are followed two levels down. Every level binds its value by ``let``, so the plan grows with the
    number of levels and not with its powers. ``required``: rows without one are left out, by a generator, as a condition
    would be worked out below the projection, and the coordinate twice.
    """
    pair = lambda t: F.struct(*[x.alias(n) for n, x in zip(("lat", "lon"), latlng_text(t), strict=True)])
    place = let(let(value, lambda v: _coordinate(v, 2)), pair)
    df = df.withColumn("_place", F.explode(F.filter(F.array(place), lambda p: p["lat"].isNotNull())) if required else place)
    return df.withColumns({"lat": F.col("_place.lat"), "lon": F.col("_place.lon")}).drop("_place")


def to_utc(value: Column) -> Column:
    """A timestamp, each value parsed on its own; null where it does not parse."""
    return F.try_to_timestamp(value)


def safe_float(value: Column) -> Column:
    return value.try_cast("double")


def offset_time(start: Column, minutes: Column) -> Column:
    """start + minutes (text or number); null where either is missing or bad."""
    return F.timestamp_micros(F.unix_micros(start) + F.round(safe_float(minutes) * 6e7).cast("long"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def no_nan(value: Column) -> Column:
    """Missing is null here, never NaN."""
    return F.when(~F.isnan(value), value)


def column_or(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """A column that may be absent."""
    return F.col(name) if name in df.columns else (F.lit(None).cast("double") if default is None else default)


def log_deviation(value: Column) -> Column:
    return F.log1p(value)


def from_log(value: Column) -> Column:
    """Back from log1p, never below 0."""
    return F.greatest(F.expm1(value), F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
