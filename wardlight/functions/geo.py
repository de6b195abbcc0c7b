"""Distances and grids on the unit sphere, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed value: mean Earth radius in metres.
EARTH_RADIUS_M = 6371008.8


def unit_vector(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """Position on the unit sphere."""
    phi, lam = F.radians(lat), F.radians(lng)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord(radius_m: float) -> float:
    """Straight-line distance on the unit sphere for a distance along the surface."""
    return 2.0 * math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2.0)


def chord_sq(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared straight-line distance between two unit vectors."""
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2.0)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(h, F.lit(1.0))))) * (2.0 * EARTH_RADIUS_M)


def planar_dist_sq(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Squared equirectangular degrees, longitude scaled at the first point's latitude."""
    d_lat = lat1 - lat2
    d_lng = (lng1 - lng2) * F.cos(F.radians(lat1))
    return d_lat * d_lat + d_lng * d_lng


# The same formulas as SQL text over column names.  Operators with long conditions use
# these: one parsed expression instead of a Python call per arithmetic node.


def unit_vector_sql(lat: str, lng: str) -> tuple[str, str, str]:
    return (
        f"cos(radians({lat})) * cos(radians({lng}))",
        f"cos(radians({lat})) * sin(radians({lng}))",
        f"sin(radians({lat}))",
    )


def chord_sq_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    ends = zip(unit_vector_sql(lat1, lng1), unit_vector_sql(lat2, lng2))
    return " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in ends)


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    half_lat, half_lng = f"sin(radians({lat2} - {lat1}) / 2D)", f"sin(radians({lng2} - {lng1}) / 2D)"
    h = f"{half_lat} * {half_lat} + cos(radians({lat1})) * cos(radians({lat2})) * {half_lng} * {half_lng}"
    return f"{2.0 * EARTH_RADIUS_M!r}D * asin(sqrt(greatest(0D, least({h}, 1D))))"


def grid_cell(lat: Column, lng: Column, radius_m: float) -> tuple[Column, Column, Column]:
    """Integer cell of the unit-sphere grid whose edge is the chord of ``radius_m``."""
    edge = F.lit(chord(radius_m))
    return tuple(F.floor(v / edge).cast("long") for v in unit_vector(lat, lng))


def located(lat: str, lng: str) -> Column:
    """True if both coordinates are finite numbers (never null)."""

    def finite(name: str) -> Column:
        value = F.col(name).cast("double")
        return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

    return finite(lat) & finite(lng)
