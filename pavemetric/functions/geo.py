"""Planar and geodetic geometry on plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84
AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def meridian_radius(phi: Column) -> Column:
    s = F.sin(phi)
    return F.lit(AXIS * (1 - E2)) / F.pow(1.0 - E2 * s * s, F.lit(1.5))


def normal_radius(phi: Column) -> Column:
    s = F.sin(phi)
    return F.lit(AXIS) / F.sqrt(1.0 - E2 * s * s)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points that are near each other: the ellipsoid's radii at their middle latitude."""
    phi = F.radians((lat1 + lat2) / 2.0)
    north = F.radians(lat2 - lat1) * meridian_radius(phi)
    east = F.radians(lon2 - lon1) * normal_radius(phi) * F.cos(phi)
    return F.sqrt(north * north + east * east)


def azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees clockwise from north, -180 to 180, of the way between two near points."""
    phi = F.radians((lat1 + lat2) / 2.0)
    north = F.radians(lat2 - lat1) * meridian_radius(phi)
    east = F.radians(lon2 - lon1) * normal_radius(phi) * F.cos(phi)
    return F.degrees(F.atan2(east, north))


def clamp_azimuth(d: Column) -> Column:
    d = d % 360.0
    return F.when(d > 180.0, d - 360.0).when(d < -180.0, d + 360.0).otherwise(d)


def destination(lon: Column, lat: Column, bearing: Column, metres: float) -> tuple[Column, Column]:
    """The point some metres away in a direction."""
    phi, a = F.radians(lat), F.radians(bearing)
    return lon + F.degrees(metres * F.sin(a) / (normal_radius(phi) * F.cos(phi))), lat + F.degrees(metres * F.cos(a) / meridian_radius(phi))


def cross(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return ux * vy - uy * vx


def intersection_fraction(p: tuple[Column, Column, Column, Column], q: tuple[Column, Column, Column, Column]) -> Column:
    """Where line q (x0, y0, x1, y1) meets line p, as a fraction of p; null if parallel. May lie outside 0..1."""
    rx, ry, sx, sy = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    rxs = cross(rx, ry, sx, sy)
    return F.when(rxs != 0, cross(q[0] - p[0], q[1] - p[1], sx, sy) / rxs)


def crossing_time(t0: Column, t1: Column, fraction: Column) -> Column:
    """Milliseconds at a fraction of the way, truncated."""
    return ((t1 - t0) * fraction + t0).cast("long")


def line_length(coords: Column) -> Column:
    """Metres along an array of struct(lon, lat)."""
    n = F.size(coords)
    legs = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.when(i <= n, distance(F.element_at(coords, i - 1)["lon"], F.element_at(coords, i - 1)["lat"], F.element_at(coords, i)["lon"], F.element_at(coords, i)["lat"])).otherwise(0.0))
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)


def point_along(coords: Column, share: Column) -> Column:
    """struct(lon, lat, azimuth) at a share of the line's length, measured in degrees; the azimuth is of that leg."""
    legs = F.transform(F.sequence(F.lit(1), F.size(coords) - 1), lambda i: F.struct(F.element_at(coords, i).alias("a"), F.element_at(coords, i + 1).alias("b")))
    legs = F.transform(legs, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.hypot(s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]).alias("d")))
    total = F.aggregate(legs, F.lit(0.0), lambda t, s: t + s["d"])
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("azimuth"))

    def step(state: Column, leg: Column) -> Column:
        place, last = share * total, state["before"] + leg["d"]
        f = F.when(leg["d"] > 0, (place - state["before"]) / leg["d"]).otherwise(0.0)
        here = state["lon"].isNull() & (leg["d"] > 0) & (place <= last + 1e-12)
        lon = leg["a"]["lon"] + f * (leg["b"]["lon"] - leg["a"]["lon"])
        lat = leg["a"]["lat"] + f * (leg["b"]["lat"] - leg["a"]["lat"])
        way = azimuth(leg["a"]["lon"], leg["a"]["lat"], leg["b"]["lon"], leg["b"]["lat"])
        return F.struct(last.alias("before"), F.when(here, lon).otherwise(state["lon"]).alias("lon"), F.when(here, lat).otherwise(state["lat"]).alias("lat"), F.when(here, way).otherwise(state["azimuth"]).alias("azimuth"))

    return F.aggregate(legs, start, step)


#: How far a mitred corner may lie from the line's, in offsets; beyond it is cut off.
MITRE = 5.0


def offset_line(coords: Column, offset: float) -> Column:
    """The line moved to its right (left for a negative offset), in degrees: every leg lies at the offset from its own.

    Corners lie where the moved legs meet. One that would lie over MITRE offsets away, as at a hairpin, is cut off between the ends
    of the moved legs. Repeated points count once. Legs shorter than the offset on the inner side of a bend may cross.
    """
    n = F.size(coords)
    at = lambda i: F.element_at(coords, F.greatest(F.lit(1), F.least(i, n)))

    def way(a: Column, b: Column) -> tuple[Column, Column]:
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        d = F.hypot(dx, dy)
        return F.when(d > 0, dx / d).otherwise(0.0), F.when(d > 0, dy / d).otherwise(0.0)

    def moved(i: Column) -> Column:
        p = at(i)
        (x1, y1), (x2, y2) = way(at(i - 1), p), way(p, at(i + 1))
        # square of the corner's distance in offsets is 2 / c; an end or a repeated point has one leg, and c is 1
        c = F.lit(1.0) + x1 * x2 + y1 * y2
        point = lambda x, y: F.struct((p["lon"] + y * offset).alias("lon"), (p["lat"] - x * offset).alias("lat"))
        return F.when(c * MITRE * MITRE >= 2.0, F.array(point((x1 + x2) / c, (y1 + y2) / c))).otherwise(F.array(point(x1, y1), point(x2, y2)))

    return F.flatten(F.transform(F.sequence(F.lit(1), n), moved))


def wkt(coords: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(coords, lambda c: F.concat_ws(" ", c["lon"].cast("string"), c["lat"].cast("string"))), ", "), F.lit(")"))


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring, an array of struct(lon, lat)."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        return F.when(spans, (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(spans, b["lat"] - a["lat"]).otherwise(1.0) + a["lon"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), crosses), F.lit(0), lambda s, x: s + x) % 2 == 1


def ring_distance(lon: Column, lat: Column, ring: Column) -> Column:
    """Degrees from a point to the nearest leg of a ring."""
    n = F.size(ring)

    def leg(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        d2 = dx * dx + dy * dy
        f = F.when(d2 > 0, ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / F.when(d2 > 0, d2).otherwise(1.0)).otherwise(0.0)
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
        return F.hypot(lon - a["lon"] - f * dx, lat - a["lat"] - f * dy)

    return F.array_min(F.transform(F.sequence(F.lit(1), n), leg))


