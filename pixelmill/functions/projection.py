"""Universal Transverse Mercator on the WGS 84 ellipsoid as column algebra (G5): Krueger's series to the fourth order."""

from __future__ import annotations

from math import pi, sqrt
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid, and the scale and shift of the projection.
MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500_000.0, 10_000_000.0
GEOGRAPHIC = 4326
N = FLATTENING / (2 - FLATTENING)
#: Coefficients of the series, forward, inverse, and from the conformal to the geodetic latitude.
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
INVERSE = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)
RADIUS = SCALE * MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRICITY = 2 * sqrt(N) / (1 + N)
#: The same functions for arrays inside tasks.
ARRAYS = SimpleNamespace(
    radians=np.radians, degrees=np.degrees, sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, asin=np.arcsin, atan2=np.arctan2, asinh=np.arcsinh, atanh=np.arctanh, hypot=np.hypot, lit=float
)


def zone_of(srid: int) -> tuple[float, float]:
    """Central meridian in degrees and false northing of a UTM zone, EPSG 32601 to 32660 and 32701 to 32760."""
    half, zone = divmod(srid - 32600, 100)
    if half not in (0, 1) or not 1 <= zone <= 60:
        raise ValueError(f"no UTM zone on WGS 84: {srid}")
    return zone * 6.0 - 183.0, SOUTH * half


def to_utm(lon: Column, lat: Column, srid: int, m=F) -> tuple[Column, Column]:
    """East and north of degrees; of columns, or of arrays with ``ARRAYS``."""
    meridian, shift = zone_of(srid)
    away, phi = m.radians(lon - meridian), m.radians(lat)
    t = m.sinh(m.atanh(m.sin(phi)) - ECCENTRICITY * m.atanh(ECCENTRICITY * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(away)), m.asinh(m.sin(away) / m.hypot(t, m.cos(away)))
    east = eta + sum((m.cos(2 * j * xi) * m.sinh(2 * j * eta) * a for j, a in enumerate(FORWARD, 1)), m.lit(0.0))
    north = xi + sum((m.sin(2 * j * xi) * m.cosh(2 * j * eta) * a for j, a in enumerate(FORWARD, 1)), m.lit(0.0))
    return east * RADIUS + EAST, north * RADIUS + shift


def from_utm(x: Column, y: Column, srid: int, m=F) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of east and north."""
    meridian, shift = zone_of(srid)
    xi, eta = (y - shift) / RADIUS, (x - EAST) / RADIUS
    xi_0 = xi - sum((m.sin(2 * j * xi) * m.cosh(2 * j * eta) * b for j, b in enumerate(INVERSE, 1)), m.lit(0.0))
    eta_0 = eta - sum((m.cos(2 * j * xi) * m.sinh(2 * j * eta) * b for j, b in enumerate(INVERSE, 1)), m.lit(0.0))
    chi = m.asin(m.sin(xi_0) / m.cosh(eta_0))
    phi = chi + sum((m.sin(2 * j * chi) * d for j, d in enumerate(LATITUDE, 1)), m.lit(0.0))
    return m.atan2(m.sinh(eta_0), m.cos(xi_0)) * (180 / pi) + meridian, m.degrees(phi)


def transformed(x: Column, y: Column, source: int, target: int, m=F) -> tuple[Column, Column]:
    """Coordinates in another reference system; nothing is computed where both are the same."""
    if source == target:
        return x, y
    lon, lat = (x, y) if source == GEOGRAPHIC else from_utm(x, y, source, m)
    return (lon, lat) if target == GEOGRAPHIC else to_utm(lon, lat, target, m)


def transformed_rings(rings: Column, source: int, target: int) -> Column:
    """Every point of a polygon's rings in another reference system."""

    def point(p: Column) -> Column:
        x, y = transformed(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return rings if source == target else F.transform(rings, lambda r: F.transform(r, point))
