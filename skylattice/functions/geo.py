"""Geodesy as column expressions; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_KM, LAT_M, LON_M, WGS84_A, WGS84_F

_E2 = WGS84_F * (2 - WGS84_F)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def geodetic_to_ecef(lat, lon, alt) -> Column:
    """struct(x, y, z) in metres on WGS84."""
    la, lo, h = F.radians(_c(lat)), F.radians(_c(lon)), _c(alt)
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(la) * F.sin(la))
    return F.struct(((n + h) * F.cos(la) * F.cos(lo)).alias("x"), ((n + h) * F.cos(la) * F.sin(lo)).alias("y"), ((n * (1 - _E2) + h) * F.sin(la)).alias("z"))


def ecef_to_geodetic(p: Column, rounds: int = 20) -> Column:
    """struct(lat, lon, alt) by fixed-point iteration on the latitude."""
    x, y, z = p["x"], p["y"], p["z"]
    r = F.sqrt(x * x + y * y)

    def step(lat, _):
        n = WGS84_A / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
        h = r / F.cos(lat) - n
        return F.atan2(z, r * (1 - _E2 * n / (n + h)))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z, r * (1 - _E2)), step)
    n = WGS84_A / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), (r / F.cos(lat) - n).alias("alt"))


def distance_3d(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "xyz"), F.lit(0.0)))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of the radius. Kilometres and metres have radii of their own."""
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2) - _c(lon1))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dl / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a1, a2, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(a2), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(dl))) + 360, F.lit(360.0))


def angle_difference(a, b) -> Column:
    """Smallest turn between two bearings, 0 to 180."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, 360 - d)


def local_axes(lat, lon) -> Column:
    """struct(east, north): unit vectors as structs."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    east = F.struct((-F.sin(lo)).alias("x"), F.cos(lo).alias("y"), F.lit(0.0).alias("z"))
    north = F.struct((-F.sin(la) * F.cos(lo)).alias("x"), (-F.sin(la) * F.sin(lo)).alias("y"), F.cos(la).alias("z"))
    return F.struct(east.alias("east"), north.alias("north"))


def to_plane(lat, lon, lat0, lon0) -> Column:
    """struct(east, north) in metres on the flat earth about an origin."""
    return F.struct(((_c(lon) - _c(lon0)) * LON_M * F.cos(F.radians(_c(lat0)))).alias("east"), ((_c(lat) - _c(lat0)) * LAT_M).alias("north"))


def from_plane(east, north, lat0, lon0) -> Column:
    return F.struct((_c(lat0) + _c(north) / LAT_M).alias("lat"), (_c(lon0) + _c(east) / (LON_M * F.cos(F.radians(_c(lat0))))).alias("lon"))


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def horizontal_error(truth: Column, estimate: Column) -> Column:
    """Length of the error in metres without its part along the truth's radial."""
    d = F.struct(*[(estimate[k] - truth[k]).alias(k) for k in "xyz"])
    along = dot(d, truth) / F.sqrt(dot(truth, truth))
    return F.sqrt(F.greatest(dot(d, d) - along * along, F.lit(0.0)))


def error_components(truth: Column, estimate: Column, lat, lon) -> Column:
    """struct(east, north, bearing) of the error along local axes at the truth."""
    d = F.struct(*[(estimate[k] - truth[k]).alias(k) for k in "xyz"])
    axes = local_axes(lat, lon)
    e, n = dot(d, axes["east"]), dot(d, axes["north"])
    return F.struct(e.alias("east"), n.alias("north"), F.pmod(F.degrees(F.atan2(e, n)) + 360, F.lit(360.0)).alias("bearing"))


def along_cross_track(lat, lon, lat_t, lon_t, heading) -> Column:
    """struct(along, cross) in metres on the flat earth, of an estimate against a truth that moves by heading."""
    p = to_plane(lat, lon, lat_t, lon_t)
    h = F.radians(_c(heading))
    return F.struct((p["east"] * F.sin(h) + p["north"] * F.cos(h)).alias("along"), (p["east"] * F.cos(h) - p["north"] * F.sin(h)).alias("cross"))


def cap_area_km2(radius_km) -> Column:
    """Area of the spherical cap within a surface distance."""
    import math

    return 2 * math.pi * EARTH_KM**2 * (1 - F.cos(_c(radius_km) / EARTH_KM))


def inside_box(lat, lon, alt) -> Column:
    """Sanity box of the surveillance area. Fixed values."""
    return _c(lat).between(-10, 45) & _c(lon).between(80, 140) & _c(alt).between(-500, 20_000)


def point_in_polygon(x, y, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule by crossing count, for polygons of a few vertices; the boundary is not special."""
    x, y = _c(x), _c(y)
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        if y1 != y2:
            hits = hits + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return hits % 2 == 1


def shoelace(vertices: Column) -> Column:
    """Signed area of an array of struct(x, y); ring open or closed."""
    nxt = F.concat(F.slice(vertices, 2, F.size(vertices)), F.slice(vertices, 1, 1))
    return F.aggregate(F.zip_with(vertices, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2
