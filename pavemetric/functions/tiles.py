"""Web-Mercator tiles (SP1-SP4, SP10-SP13)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import idiv

#: Zoom of areas that are loaded as a whole, and of the spatial index.
AREA_ZOOM, INDEX_ZOOM = 11, 18


#: Longitudes beyond this have no tile, so that no cast overflows; a little beyond 180 is left to callers.
MAX_LON = 1_000.0
#: Where the square of the Web-Mercator map ends.
MAX_LAT = math.degrees(math.atan(math.sinh(math.pi)))


def tile_x(lon: Column, zoom: int) -> Column:
    """Null for a longitude that is null, not finite, or beyond MAX_LON."""
    return F.when(lon.between(-MAX_LON, MAX_LON), F.floor((lon + 180.0) / 360.0 * float(1 << zoom)).cast("int"))


def tile_y(lat: Column, zoom: int) -> Column:
    """Null for a latitude that is null, not finite, or of no place."""
    phi = F.radians(lat)
    return F.when(lat.between(-90.0, 90.0), F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * float(1 << zoom)).cast("int"))


def tile_range(x0: Column, y0: Column, x1: Column, y1: Column, zoom: int, grow: int = 0) -> Column:
    """Array of struct(x, y): tiles of the box, x-major, with `grow` more tiles on every side. Corners in any order."""
    xs = F.sequence(tile_x(F.least(x0, x1), zoom) - grow, tile_x(F.greatest(x0, x1), zoom) + grow)
    ys = F.sequence(tile_y(F.greatest(y0, y1), zoom) - grow, tile_y(F.least(y0, y1), zoom) + grow)
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def tile_lon(x: Column, zoom: Column | int) -> Column:
    return x / _span(zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: Column | int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) - F.lit(2.0 * math.pi) * y / _span(zoom))))


def _span(zoom: Column | int) -> Column:
    return F.lit(float(1 << zoom)) if isinstance(zoom, int) else F.pow(F.lit(2.0), zoom)


def tile_envelope(x: Column, y: Column, zoom: Column | int) -> dict[str, Column]:
    return {"min_lon": tile_lon(x, zoom), "max_lon": tile_lon(x + 1, zoom), "min_lat": tile_lat(y + 1, zoom), "max_lat": tile_lat(y, zoom)}


def rezoom(x: Column, y: Column, z: int, to: int, mode: str = "fixed") -> Column:
    """Array of struct(x, y): tiles at zoom `to` that cover tile (x, y) at zoom z, or that it lies in.

    legacy scales by the difference of the zooms itself, as the known system does, instead of a power of two.
    """
    step = abs(to - z)
    scale = step if mode == "legacy" and step else 1 << step
    if to > z:
        parts = F.sequence(F.lit(0), F.lit(scale - 1))
        return F.flatten(F.transform(parts, lambda i: F.transform(parts, lambda j: F.struct((x * scale + i).cast("int").alias("x"), (y * scale + j).cast("int").alias("y")))))
    return F.array(F.struct(idiv(x, scale).cast("int").alias("x"), idiv(y, scale).cast("int").alias("y")))


def morton(x: Column, y: Column) -> Column:
    """The bits of two tile numbers in turn, so that tiles near each other have numbers near each other."""

    def spread(c: Column) -> Column:
        c = c.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))
