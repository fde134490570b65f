"""Polygons as a cover of cells: cells with one answer, and border cells with the edges that decide inside them (TZ1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settled

#: Degrees of the largest cells, sizes of cells, and parts of a side that one is cut in: powers of two, so that places divide exactly.
LARGEST, LEVELS, PARTS = 4.0, 3, 4
#: Edges (about 32 bytes each) and cells up to which a cover is broadcast.
BROADCAST_EDGES, BROADCAST_CELLS = 1_000_000, 500_000
#: The level of the one cell that stands for all places off the map.
OFF_MAP = -1
EDGE = "array<struct<ax:double,ay:double,bx:double,by:double>>"
COVER = f"level int, cx int, cy int, tzid string, border array<struct<tzid:string,ordinal:int,inside:boolean,edges:{EDGE},box:struct<x0:double,y0:double,x1:double,y1:double>>>"


def size_of(level: int) -> float:
    return LARGEST / PARTS**level


def edges(rings: Column) -> Column:
    """Edges of closed rings, an array of arrays of struct(lon, lat)."""

    def of(ring: Column) -> Column:
        n = F.size(ring)

        def edge(i: Column) -> Column:
            a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
            return F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), edge)).otherwise(F.array().cast(EDGE))

    return F.flatten(F.transform(rings, of))


def inside(lon: Column, lat: Column, edge_list: Column) -> Column:
    """Even-odd test of a point against edges, so that holes are outside."""

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > lat) != (e["by"] > lat)
        return spans & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.when(spans, e["by"] - e["ay"]).otherwise(1.0) + e["ax"])

    return F.size(F.filter(edge_list, crosses)) % 2 == 1


def beside(lon: Column, lat: Column, edge_list: Column, buffer: float) -> Column:
    """Whether an edge lies within some degrees of a point."""

    def near(e: Column) -> Column:
        dx, dy, px, py = e["bx"] - e["ax"], e["by"] - e["ay"], lon - e["ax"], lat - e["ay"]
        d2 = dx * dx + dy * dy
        f = F.when(d2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / d2))).otherwise(0.0)
        return (px - f * dx) * (px - f * dx) + (py - f * dy) * (py - f * dy) <= buffer * buffer

    return F.exists(edge_list, near)


class Shape:
    """A polygon seen from a cell: the edges that matter there (rows ax, ay, bx, by), or a zone's box (ordinal None).

    inside: whether all of the cell is inside, or none of it; None if neither is so.
    """

    def __init__(self, tzid: str, ordinal: int | None, box: tuple[float, float, float, float], edge_rows: np.ndarray, inside: bool | None = None):
        self.tzid, self.ordinal, self.box, self.edges, self.inside = tzid, ordinal, box, edge_rows, inside

    def seen(self, x0: float, y0: float, size: float, buffer: float) -> Shape | None:
        """The shape seen from a smaller cell; None if it has nothing to do with that."""
        if self.inside:
            return self
        x1, y1 = x0 + size, y0 + size
        if self.ordinal is None:
            bx0, by0, bx1, by1 = self.box
            if bx0 > x1 or bx1 < x0 or by0 > y1 or by1 < y0:
                return None
            return Shape(self.tzid, None, self.box, self.edges, True if bx0 <= x0 and bx1 >= x1 and by0 <= y0 and by1 >= y1 else None)
        ax, ay, bx, by = self.edges.T
        west, east, south, north = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
        near = (west - buffer <= x1) & (east + buffer >= x0) & (south - buffer <= y1) & (north + buffer >= y0)
        if near.any():
            # a ray to the east meets edges of the cell's band that don't lie west of it
            return Shape(self.tzid, self.ordinal, self.box, self.edges[near | ((south <= y1) & (north >= y0) & (east >= x0))])
        lon, lat = x0 + size / 2, y0 + size / 2
        spans = (ay > lat) != (by > lat)
        ax, ay, bx, by = ax[spans], ay[spans], bx[spans], by[spans]
        crossed = np.count_nonzero(lon < (bx - ax) * (lat - ay) / (by - ay) + ax)
        return Shape(self.tzid, self.ordinal, self.box, self.edges[:0], True) if crossed % 2 else None


def _parts(level: int, cx: int, cy: int, shapes: list[Shape], buffer: float) -> Iterator[tuple]:
    """The cover of a cell: level, cx, cy, tzid, border."""
    size = size_of(level)
    near = [x for s in shapes if (x := s.seen(cx * size, cy * size, size, buffer))]
    boxes, polygons = [s for s in near if s.ordinal is None], [s for s in near if s.ordinal is not None]
    if all(s.inside for s in boxes):
        first = min((s.ordinal for s in polygons if s.inside), default=math.inf)
        if len(boxes) == 1:
            yield level, cx, cy, boxes[0].tzid, None
            return
        if all(s.inside or s.ordinal > first for s in polygons):
            yield level, cx, cy, next((s.tzid for s in polygons if s.ordinal == first), None), None
            return
    if level == LEVELS - 1:
        keys, place = ("ax", "ay", "bx", "by"), ("x0", "y0", "x1", "y1")
        yield level, cx, cy, None, [{"tzid": s.tzid, "ordinal": s.ordinal, "inside": s.inside, "edges": [dict(zip(keys, e, strict=True)) for e in s.edges.tolist()], "box": dict(zip(place, s.box, strict=True))} for s in near]
        return
    for i in range(PARTS):
        for j in range(PARTS):
            yield from _parts(level + 1, cx * PARTS + i, cy * PARTS + j, near, buffer)


def cover(polygons: DataFrame, buffer: float) -> DataFrame:
    """level, cx, cy, tzid, border: cells that part the whole map, as a written table.

    polygons (tzid, ordinal, ring, holes if any). border is null where a cell has one answer, tzid; else what decides inside it. The
    answers are those of zones(). A cell is cut in smaller ones until it has one answer or is the smallest, and gets the edges near
    it and those that a ray from it to the east can meet; so no point sees a whole polygon. Largest cells are cut in parallel,
    each with the edges that matter in it.
    """
    rings = F.array("ring") if "holes" not in polygons.columns else F.concat(F.array("ring"), F.coalesce("holes", F.array().cast("array<array<struct<lon:double,lat:double>>>")))
    lons, lats = F.transform("ring", lambda c: c["lon"]), F.transform("ring", lambda c: c["lat"])
    shapes = polygons.where("size(ring) > 0").select("tzid", F.col("ordinal").cast("int").alias("ordinal"), edges(rings).alias("edges"), F.array(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)).alias("box"))
    b = [F.element_at("box", i + 1) for i in range(4)]
    # a zone's box spans all of its polygons
    boxes = shapes.groupBy("tzid").agg(F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])).alias("box"))
    every = shapes.unionByName(boxes.select("tzid", F.lit(None).cast("int").alias("ordinal"), F.array().cast(EDGE).alias("edges"), "box"))
    at = lambda v: F.floor(v / LARGEST).cast("int")
    span = lambda low, high: F.explode(F.sequence(at(b[low] - buffer), at(b[high] + buffer)))
    dealt = every.withColumn("cx", span(0, 2)).withColumn("cy", span(1, 3))
    x0, y0 = F.col("cx") * LARGEST, F.col("cy") * LARGEST
    matters = lambda e: (F.greatest(e["ax"], e["bx"]) + buffer >= x0) & (F.least(e["ay"], e["by"]) - buffer <= y0 + LARGEST) & (F.greatest(e["ay"], e["by"]) + buffer >= y0)
    numbers = F.flatten(F.transform(F.filter("edges", matters), lambda e: F.array(e["ax"], e["ay"], e["bx"], e["by"])))
    gathered = dealt.select("cx", "cy", F.struct("tzid", "ordinal", "box", numbers.alias("numbers")).alias("s")).groupBy("cx", "cy").agg(F.collect_list("s").alias("shapes"))
    # cells of the map that no shape is near have no zone, nor has what lies off the map
    out = every.sparkSession.range(1).select(F.explode(F.sequence(F.lit(-45), F.lit(45))).alias("cx")).select("cx", F.explode(F.sequence(F.lit(-23), F.lit(22))).alias("cy"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cx, cy, found in zip(batch["cx"], batch["cy"], batch["shapes"], strict=True):
                if (cx, cy) == (0, 0):
                    rows.append((OFF_MAP, 0, 0, None, None))
                listed = [Shape(s["tzid"], s["ordinal"], tuple(s["box"]), np.array(s["numbers"], np.float64).reshape(-1, 4)) for s in (found if found is not None else [])]
                rows += _parts(0, int(cx), int(cy), listed, buffer)
            yield pd.DataFrame(rows, columns=["level", "cx", "cy", "tzid", "border"])

    return settled(out.join(gathered, ["cx", "cy"], "left").mapInPandas(run, COVER))


def placed(points: DataFrame, cells: DataFrame, buffer: float) -> DataFrame:
    """points (lon, lat, ...) with the tzid of their cell of a cover; null off the map. One scan of points, if the cover is small."""
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("border", F.lit(0), lambda a, c: a + F.size(c["edges"]))), F.lit(0))).first()
    if n <= BROADCAST_CELLS and total <= BROADCAST_EDGES:
        cells = F.broadcast(cells)
    lon, lat = F.col("lon"), F.col("lat")
    on_map = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(lon / size_of(k)).cast("int").alias("cx"), F.floor(lat / size_of(k)).cast("int").alias("cy")) for k in range(LEVELS)])
    # of a point's cells of all sizes one is in the cover
    off = F.array(F.struct(F.lit(OFF_MAP).alias("level"), F.lit(0).alias("cx"), F.lit(0).alias("cy")))
    exploded = points.withColumn("k", F.explode(F.when(on_map, keys).otherwise(off))).select(*points.columns, "k.*")
    boxes = F.filter("border", lambda c: c["ordinal"].isNull() & lon.between(c["box"]["x0"], c["box"]["x1"]) & lat.between(c["box"]["y0"], c["box"]["y1"]))
    polygons = F.filter("border", lambda c: c["ordinal"].isNotNull())
    name = lambda cs: F.array_min(F.transform(cs, lambda c: F.struct(c["ordinal"].alias("ordinal"), c["tzid"].alias("tzid"))))["tzid"]
    within = F.filter(polygons, lambda c: F.coalesce(c["inside"], F.lit(False)) | inside(lon, lat, c["edges"]))
    around = F.filter(polygons, lambda c: beside(lon, lat, c["edges"], buffer))
    decided = F.when(F.size(boxes) == 1, F.element_at(F.transform(boxes, lambda c: c["tzid"]), 1)).otherwise(F.coalesce(name(within), name(around)))
    return exploded.join(cells, ["level", "cx", "cy"]).select(*points.columns, F.when(F.col("border").isNull(), F.col("tzid")).otherwise(decided).alias("tzid"))
