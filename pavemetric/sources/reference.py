"""Readers of zones and places, and of map extracts by tile (SRC1, SRC6, SRC7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tiles
from . import osm_pbf

ZONE = "properties map<string,string>, geometry struct<type:string, coordinates:string>"
RING, PART = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """properties and geometry (type, coordinates as text) of GeoJSON features, one to a line; other lines are skipped."""
    return spark.read.text(path).select(F.from_json("value", ZONE).alias("f")).where("f.geometry is not null").select("f.*")


def zone_polygons(spark: SparkSession, path: str, name: str = "TZID") -> DataFrame:
    """tzid, ordinal, ring and holes of zones as GeoJSON polygons or multi-polygons, of which the first part counts.

    Zones called uninhabited and features without a name are left out; ordinal is the order of the names, then of the rings.
    """
    one = F.from_json("geometry.coordinates", RING)
    many = F.from_json("geometry.coordinates", PART)
    rings = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", F.try_element_at(many, F.lit(1)))
    points = lambda ring: F.transform(ring, lambda c: F.struct(F.element_at(c, 1).alias("lon"), F.element_at(c, 2).alias("lat")))
    found = features(spark, path).select(F.try_element_at("properties", F.lit(name)).alias("tzid"), F.transform(rings, points).alias("rings"))
    rows = found.select("tzid", F.try_element_at("rings", F.lit(1)).alias("ring"), F.filter("rings", lambda r, i: (i > 0) & (F.size(r) >= 3)).alias("holes")).where("tzid is not null and tzid <> 'uninhabited' and size(ring) >= 3")
    # polygons of zones are a dimension of thousands of rows
    return rows.select("tzid", F.row_number().over(Window.orderBy("tzid", F.col("ring").cast("string"))).alias("ordinal"), "ring", "holes")


def places(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, country, city and population of populated places as GeoJSON points (sov0name, adm1name, pop_max)."""
    point = F.from_json("geometry.coordinates", "array<double>")
    p = lambda n: F.try_element_at("properties", F.lit(n))
    rows = features(spark, path).where(F.col("geometry.type") == "Point").withColumn("p", point)
    return rows.select(F.element_at("p", 1).alias("lon"), F.element_at("p", 2).alias("lat"), p("sov0name").alias("country"), p("adm1name").alias("city"), F.coalesce(p("pop_max").cast("double").cast("long"), F.lit(0)).alias("population"))


def tile_bounds(x: int, y: int) -> tuple[float, float, float, float]:
    """South, west, north, east of an area tile."""
    import math

    lat = lambda k: math.degrees(math.atan(math.sinh(math.pi - 2 * math.pi * k / (1 << tiles.AREA_ZOOM))))
    lon = lambda k: k / (1 << tiles.AREA_ZOOM) * 360.0 - 180.0
    return lat(y + 1), lon(x), lat(y), lon(x + 1)


def load_tiles(spark: SparkSession, folder: str, wanted: list[tuple[int, int]], loaded: set[tuple[int, int]] | None = None, fetch: Callable[[str], bytes | None] | None = None) -> tuple[DataFrame | None, DataFrame | None, list[tuple[int, int]]]:
    """nodes and ways of the area tiles' extracts <folder>/11/x/y.osm.pbf, and the tiles that were read.

    Tiles in `loaded` are skipped. A missing extract is asked of fetch("S,W,N,E.pbf") and kept in the folder; without an
    answer the tile stays unloaded. Nodes and ways that several tiles have occur once. No tile: None twice.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    found: list[tuple[int, int]] = []
    for x, y in dict.fromkeys(wanted):
        if (x, y) in (loaded or set()):
            continue
        path = f"{base}/{tiles.AREA_ZOOM}/{x}/{y}.osm.pbf"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            data = fetch(",".join(f"{v:.6f}" for v in tile_bounds(x, y)) + ".pbf") if fetch else None
            if data is None:
                continue
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{path}.part") as out:
                out.write(data)
            store.move(f"{path}.part", path)
        found.append((x, y))
    if not found:
        return None, None, []
    spark.dataSource.register(osm_pbf.OsmPbf)

    def table(name: str, key: str) -> DataFrame:
        parts = [spark.read.format("osm_pbf").option("table", name).load(f"{folder}/{tiles.AREA_ZOOM}/{x}/{y}.osm.pbf") for x, y in found]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates([key])

    return table("nodes", "node_id"), table("ways", "way_id"), found
