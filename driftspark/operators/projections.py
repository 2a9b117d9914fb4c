"""Maps: metres about a point, the transverse Mercator, crossings of segments.  All are built-in expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftspark.functions import c, degrees_per_metre


def local_metres(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of a point, by the degrees that a metre spans there."""
    per_x, per_y = degrees_per_metre(F.lit(lat0))
    return (c(lon) - lon0) / per_x, (c(lat) - lat0) / per_y


def local_degrees(x, y, lon0: float, lat0: float) -> tuple[Column, Column]:
    per_x, per_y = degrees_per_metre(F.lit(lat0))
    return lon0 + c(x) * per_x, lat0 + c(y) * per_y


@dataclass(frozen=True)
class TransverseMercator:
    """An ellipsoid (half axis, flattening), the middle meridian, its scale, and the false origin."""

    lon0: float
    scale: float
    east: float
    north: float
    lat0: float = 0.0
    a: float = 6378137.0
    f: float = 1 / 298.257222101

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    @property
    def radius(self) -> float:
        """Of the rectifying circle, times the scale."""
        n = self.n
        return self.scale * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def forward_terms(self) -> list[float]:
        n = self.n
        return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]

    def back_terms(self) -> list[float]:
        n = self.n
        return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]

    def latitude_terms(self) -> list[float]:
        n = self.n
        return [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]


#: New Zealand's map.
NZTM = TransverseMercator(173.0, 0.9996, 1_600_000.0, 10_000_000.0)


def utm(zone: int, south: bool = False) -> TransverseMercator:
    return TransverseMercator(zone * 6 - 183.0, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0, f=1 / 298.257223563)


def to_map(lon, lat, m: TransverseMercator) -> tuple[Column, Column]:
    """East and north of degrees, by Krueger's series to the third order (under a millimetre within a zone)."""
    k = 2 * math.sqrt(m.n) / (1 + m.n)
    phi, turn = F.radians(c(lat)), F.radians(c(lon) - m.lon0)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(m.forward_terms(), 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return m.east + m.radius * east, m.north + m.radius * north


def from_map(east, north, m: TransverseMercator) -> tuple[Column, Column]:
    """Degrees of east and north."""
    xi, eta = (c(north) - m.north) / m.radius, (c(east) - m.east) / m.radius
    x, y = xi, eta
    for j, b in enumerate(m.back_terms(), 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(m.latitude_terms(), 1):
        lat = lat + d * F.sin(2 * j * chi)
    return m.lon0 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def crossing(one: tuple, two: tuple) -> tuple[Column, Column, Column]:
    """(x, y, whether they cross) of two segments (x1, y1, x2, y2); parallel ones don't."""
    x1, y1, x2, y2 = map(c, one)
    x3, y3, x4, y4 = map(c, two)
    d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    a = F.try_divide((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3), d)
    b = F.try_divide((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1), d)
    return x1 + a * (x2 - x1), y1 + a * (y2 - y1), F.coalesce(a.between(0, 1) & b.between(0, 1), F.lit(False))
