"""Distances, bearings, projections and coordinate conversions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres (or in the unit of ``radius``)."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(half), F.sqrt(F.lit(1.0) - half))


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    return haversine_m(lng1, lat1, lng2, lat2, EARTH_M / 1000.0)


def bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    dlng = F.radians(lng2) - F.radians(lng1)
    y = F.sin(dlng) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlng)
    return F.pmod(F.atan2(y, x) * F.lit(180.0 / math.pi) + 360.0, F.lit(360.0))


def turn_type(bearing_in: Column, bearing_out: Column) -> Column:
    """Turn class from two bearings."""
    raw = F.pmod(bearing_out - bearing_in + 360.0, F.lit(360.0))
    diff = F.when(raw > 180, raw - 360.0).otherwise(raw)
    size = F.abs(diff)
    side = F.when(diff > 0, "right").otherwise("left")
    return (
        F.when(size < 25, "straight")
        .when(size <= 100, side)
        .when(size < 170, F.concat(F.lit("hard-"), side))
        .otherwise("uturn")
    )


def project_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Nearest point of a segment: struct(x, y, t, d2), planar, t clamped to 0..1."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.nullif(length2, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(
        x.alias("x"), y.alias("y"), t.alias("t"), ((px - x) * (px - x) + (py - y) * (py - y)).alias("d2")
    )


def rational(value: Column) -> Column:
    """A num/den struct as a double; zero denominator gives 0."""
    return F.when(value["den"] == 0, F.lit(0.0)).otherwise(
        value["num"].cast("double") / F.nullif(value["den"].cast("double"), F.lit(0.0))
    )


def dms_to_decimal(dms: Column, ref: Column, digits: int | None = None) -> Column:
    """Degrees, minutes, seconds (array of num/den structs) to signed decimal degrees."""
    value = rational(F.get(dms, F.lit(0))) + rational(F.get(dms, F.lit(1))) / 60.0 + rational(F.get(dms, F.lit(2))) / 3600.0
    signed = F.when(ref.isin("S", "W"), -value).otherwise(value)
    return signed if digits is None else F.round(signed, digits)


def parse_linestring(geojson: Column) -> Column:
    """GeoJSON LineString text to array<struct<lng, lat>>; null when it does not parse."""
    coords = F.from_json(geojson, "struct<type:string,coordinates:array<array<double>>>")["coordinates"]
    return F.transform(
        coords, lambda c: F.struct(F.get(c, F.lit(0)).alias("lng"), F.get(c, F.lit(1)).alias("lat"))
    )


def first_coord(coords: Column) -> Column:
    return F.get(coords, F.lit(0))


def last_coord(coords: Column) -> Column:
    return F.try_element_at(coords, F.lit(-1))
