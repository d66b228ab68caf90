"""Plane and spherical geometry over ``x, y`` doubles and ``array<struct<x,y>>`` lines, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# The WGS84 ellipsoid and the scale and false easting of UTM.
_A, _F, _K0, _EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def edges(line: Column) -> Column:
    """The line's consecutive pairs of points: array<struct<x1,y1,x2,y2>>; empty for fewer than two points."""
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    return F.when(F.size(line) >= 2, F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), pair)).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def _edge_length(e: Column) -> Column:
    return F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])


def length(line: Column) -> Column:
    """Length of a line."""
    return F.aggregate(edges(line), F.lit(0.0), lambda s, e: s + _edge_length(e))


def moments(line: Column) -> Column:
    """struct<l, mx, my>: length and first moments, whose sums over lines give the centroid of their union."""
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(s: Column, e: Column) -> Column:
        n = _edge_length(e)
        return F.struct((s["l"] + n).alias("l"), (s["mx"] + n * (e["x1"] + e["x2"]) / 2).alias("mx"), (s["my"] + n * (e["y1"] + e["y2"]) / 2).alias("my"))

    return F.aggregate(edges(line), zero, add)


def first_point(line: Column) -> Column:
    """The line's first vertex; null for an empty line."""
    return F.get(line, F.lit(0))


def last_point(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)


def snap(value: Column, tolerance: float = 0.5) -> Column:
    """Grid number of a coordinate: rounded to the nearest multiple, halves to the even one."""
    return F.rint(value / F.lit(tolerance)).cast("bigint")


def node(point: Column, tolerance: float = 0.5) -> Column:
    """The snapped point as text, a key for joins."""
    return F.concat_ws(":", snap(point["x"], tolerance).cast("string"), snap(point["y"], tolerance).cast("string"))


def point_to_edge(px: Column, py: Column, e: Column) -> Column:
    """Distance of a point from a straight edge."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / n))).otherwise(0.0)
    gx, gy = px - e["x1"] - t * dx, py - e["y1"] - t * dy
    return F.sqrt(gx * gx + gy * gy)


def point_to_line(px: Column, py: Column, line: Column) -> Column:
    """Distance of a point from a line; null for an empty line, the distance from its point for a line of one."""
    far = F.aggregate(edges(line), F.lit(math.inf), lambda s, e: F.least(s, point_to_edge(px, py, e)))
    return F.when(F.size(line) >= 2, far).when(F.size(line) == 1, F.hypot(px - first_point(line)["x"], py - first_point(line)["y"]))


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def edge_to_edge(a: Column, b: Column) -> Column:
    """Distance of two straight edges: 0 where they cross, else that of the nearest end."""
    s1, s2 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]), _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    s3, s4 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]), _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    ends = F.least(point_to_edge(a["x1"], a["y1"], b), point_to_edge(a["x2"], a["y2"], b), point_to_edge(b["x1"], b["y1"], a), point_to_edge(b["x2"], b["y2"], a))
    return F.when((s1 * s2 < 0) & (s3 * s4 < 0), 0.0).otherwise(ends)


def line_to_line(a: Column, b: Column) -> Column:
    """Distance of two lines of at least two points each."""
    return F.aggregate(edges(a), F.lit(math.inf), lambda s, x: F.least(s, F.aggregate(edges(b), F.lit(math.inf), lambda t, y: F.least(t, edge_to_edge(x, y)))))


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by the parity of the edges to its right; the ring may be open or closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    crosses = lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    right = F.filter(edges(closed), lambda e: ((e["y1"] > py) != (e["y2"] > py)))
    return F.size(F.filter(right, crosses)) % 2 == 1


def bounds(line: Column) -> Column:
    """struct<x0, y0, x1, y1> of a line's points."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def utm_to_lat_lon(x: Column, y: Column, zone: int = 11) -> tuple[Column, Column]:
    """(lat, lon) in degrees of northern UTM coordinates, by the usual series, right to about a millimetre inside the zone."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / F.lit(_K0 * radius), (x - _EAST) / F.lit(_K0 * radius)
    xi0, eta0 = xi, eta
    for j, b in enumerate(beta, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.lit(zone * 6 - 183.0) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))


def lat_lon_to_utm(lat: Column, lon: Column, zone: int = 11) -> tuple[Column, Column]:
    """(x, y) in metres of degrees in a northern UTM zone."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    root = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6 - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - root * F.atanh(root * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(_EAST) + F.lit(_K0 * radius) * x, F.lit(_K0 * radius) * y
