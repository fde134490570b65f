"""Loaded areas, their clusters, names and time zones (A1-A9, TZ1-TZ3, O3, Q15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles
from . import zone_cover
from .tables import settled, with_ids

# Share of its size that a cluster's box grows on each side; degrees around a zone's polygon.
GROW, ZONE_BUFFER = 0.05, 0.25
#: Degrees of the cells in which boxes, polygons and points meet.
CELL = 1.0
BOX = ["min_lon", "min_lat", "max_lon", "max_lat"]


def _cells(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Array of struct(cx, cy): cells of CELL degrees that a box touches."""
    at = lambda v: F.floor(v / CELL).cast("int")
    return F.flatten(F.transform(F.sequence(at(x0), at(x1)), lambda x: F.transform(F.sequence(at(y0), at(y1)), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _in_cells(df: DataFrame, *box: Column) -> DataFrame:
    return df.withColumn("_c", F.explode(_cells(*box))).select("*", "_c.cx", "_c.cy").drop("_c")


def _cell_of(points: DataFrame) -> DataFrame:
    return points.withColumn("cx", F.floor(F.col("lon") / CELL).cast("int")).withColumn("cy", F.floor(F.col("lat") / CELL).cast("int"))


def zones(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points (point_id, lon, lat) with the tzid of polygons (tzid, ordinal, ring, holes if any), null if none is near.

    In this order: a single zone's bounding box has the point; the first polygon that contains it; the first within
    ZONE_BUFFER degrees. See zone_cover for how.
    """
    return zone_cover.placed(points, zone_cover.cover(polygons, ZONE_BUFFER), ZONE_BUFFER)


def zone_offsets(points: DataFrame, polygons: DataFrame, offsets: DataFrame) -> DataFrame:
    """points with tzid and raw_offset_ms (tzid, raw_offset_ms; no daylight saving), 0 where unknown."""
    return zones(points, polygons).join(offsets, "tzid", "left").withColumn("raw_offset_ms", F.coalesce("raw_offset_ms", F.lit(0)))


def convert_time(time_ms: Column, raw_offset_ms: Column) -> Column:
    return time_ms + raw_offset_ms


def areas(tiles_xy: DataFrame, polygons: DataFrame, offsets: DataFrame, place_nodes: DataFrame | None = None, zoom: int = tiles.AREA_ZOOM) -> DataFrame:
    """id, x, y, z, place_name, place_pop, zone_offset and box of tiles (x, y).

    The zone is that of the centre. The name is that of the most populous place (lon, lat, name, population) in the tile.
    """
    box = tiles.tile_envelope(F.col("x"), F.col("y"), zoom)
    boxed = with_ids(tiles_xy.distinct().select("x", "y", F.lit(zoom).alias("z"), *[c.alias(n) for n, c in box.items()]), ["x", "y"], F.floor(F.col("x") / 16))
    centres = boxed.select(F.col("id").alias("point_id"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"))
    zoned = boxed.join(zone_offsets(centres, polygons, offsets).select(F.col("point_id").alias("id"), F.col("raw_offset_ms").alias("zone_offset")), "id")
    if place_nodes is None:
        named = zoned.withColumn("place_name", F.lit(None).cast("string")).withColumn("place_pop", F.lit(0).cast("long"))
    else:
        places = place_nodes.groupBy(tiles.tile_x(F.col("lon"), zoom).alias("x"), tiles.tile_y(F.col("lat"), zoom).alias("y")).agg(F.max_by("name", F.struct("population", "name")).alias("place_name"), F.max("population").alias("place_pop"))
        named = zoned.join(places, ["x", "y"], "left").withColumn("place_pop", F.coalesce("place_pop", F.lit(0).cast("long")))
    return named.select("id", "x", "y", "z", "place_name", "place_pop", "zone_offset", *BOX)


def place_names(boxes: DataFrame, places: DataFrame | None, key: str) -> DataFrame:
    """key and name, country -- city of the most populous place (lon, lat, country, city, population > 0) in each box; null without places."""
    if places is None:
        return boxes.select(key, F.lit(None).cast("string").alias("name"))
    within = (F.col("lon") >= F.col("min_lon")) & (F.col("lon") <= F.col("max_lon")) & (F.col("lat") >= F.col("min_lat")) & (F.col("lat") <= F.col("max_lat"))
    named = _cell_of(places.where("population > 0").select("lon", "lat", "population", F.concat_ws(" -- ", "country", "city").alias("name")))
    listed = _in_cells(boxes.select(key, *BOX), *(F.col(c) for c in BOX))
    best = listed.join(named, ["cx", "cy"]).where(within).groupBy(key).agg(F.max_by("name", F.struct("population", "name")).alias("name"))
    return boxes.select(key).join(best, key, "left")


def grown(box: dict[str, Column], share: float = GROW) -> dict[str, Column]:
    w, h = (box["max_lon"] - box["min_lon"]) * share, (box["max_lat"] - box["min_lat"]) * share
    return {"min_lon": box["min_lon"] - w, "max_lon": box["max_lon"] + w, "min_lat": box["min_lat"] - h, "max_lat": box["max_lat"] + h}


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"]) & (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"])


def clusters(area_table: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """area_id and cluster_id (its smallest area): areas whose clusters' grown boxes overlap or that share a name, if places are given.

    Each round names the clusters, links those that overlap or agree in name, and merges each into the smallest of its
    links and what that one is merged into, and so on; rounds end when nothing changes. Boxes meet in the cells that they
    touch.
    """
    members = settled(area_table.select(F.col("id").alias("area_id"), F.col("id").alias("cluster_id"), *BOX))
    while True:
        boxes = members.groupBy("cluster_id").agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))
        boxes = boxes.join(place_names(boxes, places, "cluster_id"), "cluster_id")
        wide = boxes.select("cluster_id", "name", *[c.alias(n) for n, c in grown({c: F.col(c) for c in BOX}).items()])
        listed = _in_cells(wide, *(F.col(c) for c in BOX))
        side = lambda df, p: df.select(*["cx", "cy"][: 2 * ("cx" in df.columns)], *[F.col(c).alias(f"{p}_{c}") for c in ("cluster_id", "name", *BOX)])
        of = lambda p: {c: F.col(f"{p}_{c}") for c in BOX}
        near = side(listed, "a").join(side(listed, "b"), ["cx", "cy"]).where(overlap(of("a"), of("b"))).select("a_cluster_id", "b_cluster_id")
        # of the clusters with one name each is linked with the smallest, which is enough to merge them
        first = wide.where("name is not null").groupBy("name").agg(F.min("cluster_id").alias("b_cluster_id"))
        alike = wide.select(F.col("cluster_id").alias("a_cluster_id"), "name").join(first, "name").select("a_cluster_id", "b_cluster_id")
        into = settled(near.unionByName(alike).groupBy(F.col("a_cluster_id").alias("cluster_id")).agg(F.min("b_cluster_id").alias("least")))
        if into.where("least <> cluster_id").isEmpty():
            return members.select("area_id", "cluster_id")
        while True:
            up = into.select(F.col("cluster_id").alias("least"), F.col("least").alias("up"))
            further = settled(into.join(up, "least").select("cluster_id", F.col("up").alias("least"), (F.col("up") < F.col("least")).alias("moved")))
            into = further.drop("moved")
            if further.where("moved").isEmpty():
                break
        members = settled(members.join(into, "cluster_id").select("area_id", F.col("least").alias("cluster_id"), *BOX))


def cluster_table(area_table: DataFrame, membership: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """cluster_id, areas, box, name and the tiles that it covers."""
    joined = area_table.join(membership, F.col("id") == F.col("area_id"))
    boxes = joined.groupBy("cluster_id").agg(F.count("*").alias("areas"), F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"), F.array_sort(F.collect_list(F.struct("x", "y"))).alias("coverage"))
    return boxes.join(place_names(boxes, places, "cluster_id"), "cluster_id")


def bounds(area_table: DataFrame) -> DataFrame:
    return area_table.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))

