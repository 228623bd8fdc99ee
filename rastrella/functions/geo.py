"""Geodesy as column arithmetic: Web Mercator in 0..1 from the top left, UTM by the Krueger series."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_EQUATOR = 20037508.342789244
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _E0 = 0.9996, 500000.0


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in 0..1."""
    y = (F.lit(math.pi) - F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))) / F.lit(2 * math.pi)
    return (F.lit(math.pi) + F.radians(lon)) / F.lit(2 * math.pi), y


def geographic(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of Mercator coordinates."""
    lat = F.degrees(2 * F.atan(F.exp(F.lit(math.pi) * (1 - 2 * y))) - F.lit(math.pi / 2))
    return lat, 360 * x - 180


def utm(lat: Column, lon: Column, zone: Column, south: Column | bool = False) -> tuple[Column, Column]:
    """(easting, northing)."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    shift = F.when(F.lit(south) if isinstance(south, bool) else south, 1e7).otherwise(0.0)
    return F.lit(_E0) + F.lit(_K0 * _RECT) * x, shift + F.lit(_K0 * _RECT) * y


def utm_inverse(x: float, y: float, zone: int, south: bool = False) -> tuple[float, float]:
    """(lat, lon) of one point; for metadata, so in plain numbers."""
    xi, eta = (y - (1e7 if south else 0)) / (_K0 * _RECT), (x - _E0) / (_K0 * _RECT)
    a, b = xi, eta
    for j, c in enumerate(_BETA, 1):
        a -= c * math.sin(2 * j * xi) * math.cosh(2 * j * eta)
        b -= c * math.cos(2 * j * xi) * math.sinh(2 * j * eta)
    chi = math.asin(math.sin(a) / math.cosh(b))
    phi = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return math.degrees(phi), zone * 6 - 183 + math.degrees(math.atan2(math.sinh(b), math.cos(a)))


def geographic_of_utm(x: Column, y: Column, zone: Column, south: Column | bool = False) -> tuple[Column, Column]:
    """(lat, lon) of eastings and northings, as columns."""
    shift = F.when(F.lit(south) if isinstance(south, bool) else south, 1e7).otherwise(0.0)
    xi, eta = (y - shift) / F.lit(_K0 * _RECT), (x - F.lit(_E0)) / F.lit(_K0 * _RECT)
    a, b = xi, eta
    for j, c in enumerate(_BETA, 1):
        a = a - F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(phi), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))


def zone_of(epsg: Column) -> tuple[Column, Column]:
    """UTM zone and whether it is a southern one, of an EPSG code."""
    return epsg % 100, epsg >= 32701


def mercator_point(lat: float, lon: float) -> tuple[float, float]:
    return (math.pi + math.radians(lon)) / (2 * math.pi), (math.pi - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))) / (2 * math.pi)


def mercator_bounds_of_utm(xleft: float, ytop: float, xright: float, ybottom: float, zone: int, south: bool = False) -> tuple[float, float, float, float]:
    """Smallest Mercator box around the four projected corners."""
    corners = [mercator_point(*utm_inverse(x, y, zone, south)) for x in (xleft, xright) for y in (ytop, ybottom)]
    xs, ys = zip(*corners)
    return min(xs), min(ys), max(xs), max(ys)


def unit_of_quad(x: Column, y: Column, quad: tuple) -> tuple[Column, Column]:
    """(u, v) in the unit square that the perspective map onto the corners ``quad`` (clockwise from u = v = 0) takes to (x, y)."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    ax, ay, bx, by, sx, sy = x1 - x2, y1 - y2, x3 - x2, y3 - y2, x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    area = ax * by - bx * ay
    g, h = (sx * by - bx * sy) / area, (ax * sy - sx * ay) / area
    # columns of the forward matrix; its inverse is their cross products up to a factor, which cancels
    p, q, r = (x1 - x0 + g * x1, y1 - y0 + g * y1, g), (x3 - x0 + h * x3, y3 - y0 + h * y3, h), (x0, y0, 1.0)
    cross = lambda s, t: (s[1] * t[2] - s[2] * t[1], s[2] * t[0] - s[0] * t[2], s[0] * t[1] - s[1] * t[0])
    at = lambda n: F.lit(n[0]) * x + F.lit(n[1]) * y + F.lit(n[2])
    below = at(cross(p, q))
    return at(cross(q, r)) / below, at(cross(r, p)) / below


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def is_polar(lat_min: Column, lat_max: Column) -> Column:
    return (lat_min < -85) | (lat_max > 85)


def metres_to_unit(x: Column, y: Column) -> tuple[Column, Column]:
    """Web Mercator metres to 0..1 with y downwards."""
    return (x + HALF_EQUATOR) / (2 * HALF_EQUATOR), 1 - (y + HALF_EQUATOR) / (2 * HALF_EQUATOR)
