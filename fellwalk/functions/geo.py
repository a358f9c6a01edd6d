"""Geographic Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres in a degree, for sizing only.
DEGREE_M = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on the sphere."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return F.asin(F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b)) * (2 * EARTH_M)


def local_xy(lat: Column, lon: Column, lat0: Column, lon_lo: Column, lat_lo: Column) -> tuple[Column, Column]:
    """Equirectangular metres east and north of the lower left corner."""
    return F.radians(lon - lon_lo) * F.cos(F.radians(lat0)) * EARTH_M, F.radians(lat - lat_lo) * EARTH_M


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator position in tiles, with fractions."""
    n = float(1 << zoom)
    x = (lon + 180.0) / 360.0 * n
    return x, (F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n


def inside(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed box (west, south, east, north)."""
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def utm(lat: Column, lon: Column, zone: int = 32) -> tuple[Column, Column]:
    """WGS84 to UTM (north): Krueger's series in the third flattening, to third order."""
    a, f = 6_378_137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - float(zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    x, y = eta, xi
    for j, s in enumerate(series, 1):
        x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * s
        y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * s
    return x * (0.9996 * radius) + 500_000.0, y * (0.9996 * radius)
