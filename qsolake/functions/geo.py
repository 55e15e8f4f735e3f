"""Maidenhead locators: cell centres and great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qsolake.functions.radio import let, trimmed

EARTH_KM = 6371.0088


def valid_grid(x: Column) -> Column:
    return F.upper(trimmed(x)).rlike("^[A-R]{2}[0-9]{2}([A-X]{2})?([0-9]{2})?$")


def _letter(grid: Column, at: int) -> Column:
    return (F.ascii(F.substring(grid, at, 1)) - 65).cast("double")


def _digit(grid: Column, at: int) -> Column:
    return F.substring(grid, at, 1).try_cast("double")


def grid_center(x: Column) -> Column:
    """struct(latitude, longitude) of the centre of the cell; null for an invalid locator."""
    return let(F.upper(trimmed(x)), lambda grid: F.when(valid_grid(grid), _center(grid)))


def _center(grid: Column) -> Column:
    n = F.length(grid)
    out = {}
    for name, step, origin, at in (("latitude", 1.0, 90.0, 2), ("longitude", 2.0, 180.0, 1)):
        value = _letter(grid, at) * (10 * step) - origin + _digit(grid, at + 2) * step
        small, least = step / 24, step / 24 / 10
        value = value + F.when(n >= 6, _letter(grid, at + 4) * small).otherwise(0.0)
        value = value + F.when(n >= 8, _digit(grid, at + 6) * least).otherwise(0.0)
        half = F.when(n >= 8, F.lit(least)).when(n >= 6, F.lit(small)).otherwise(F.lit(step)) / 2
        out[name] = value + half
    return F.struct(*[v.alias(k) for k, v in out.items()])


def distance_km(a: Column, b: Column) -> Column:
    """Haversine distance between two locators' centres; null if either is invalid."""
    return let(grid_center(a), lambda p: let(grid_center(b), lambda q: let(_haversine(p, q), _kilometres)))


def _kilometres(h: Column) -> Column:
    return EARTH_KM * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def _haversine(p: Column, q: Column) -> Column:
    lat1, lat2 = F.radians(p["latitude"]), F.radians(q["latitude"])
    dlat, dlon = lat2 - lat1, F.radians(q["longitude"] - p["longitude"])
    return F.pow(F.sin(dlat / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), 2)
