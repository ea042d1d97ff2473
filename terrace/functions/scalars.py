"""Column expressions; all of them stay inside whole-stage code generation and give null where a value is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = {"km": 6371.0, "mi": 3959.0}


def _nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def price_relative(p1: Column, p2: Column) -> Column:
    """Log price difference; null unless both prices are positive."""
    return F.when((p1 > 0) & (p2 > 0), F.ln(p2) - F.ln(p1))


def years_between(d1: Column, d2: Column) -> Column:
    return F.datediff(d2, d1) / 365.25


def cagr(p1: Column, p2: Column, years: Column) -> Column:
    """Signed compound annual growth; null for sales of one day."""
    return F.pow(p2 / _nonzero(p1), 1 / _nonzero(years)) - 1


def annual_appreciation(relative: Column, years: Column) -> Column:
    return relative / _nonzero(years)


def state(tract: Column) -> Column:
    return F.substring(tract, 1, 2)


def county(tract: Column) -> Column:
    return F.substring(tract, 3, 3)


def tract_number(tract: Column) -> Column:
    return F.substring(tract, 6, 6)


def is_tract(tract: Column) -> Column:
    return F.coalesce(tract.rlike("^[0-9]{11}$"), F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    """A proxy: different tracts of one county."""
    return (F.substring(a, 1, 5) == F.substring(b, 1, 5)) & (a != b)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km") -> Column:
    """Great-circle distance; the root is clamped, so antipodes and equal points are safe."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS[unit] * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
