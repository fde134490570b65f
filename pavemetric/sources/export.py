"""Lines as GeoJSON features and well-known text (SNK8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def geojson(items: DataFrame, properties: list[str]) -> DataFrame:
    """id and a GeoJSON feature of each item (id, coords)."""
    points = F.transform("coords", lambda c: F.array(c["lon"], c["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("id").alias("id"), F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return items.select("id", F.to_json(feature).alias("feature"))


def well_known_text(items: DataFrame) -> DataFrame:
    return items.select("id", geo.wkt(F.col("coords")).alias("wkt"))


def write_geojson(items: DataFrame, properties: list[str], path: str) -> None:
    """One feature per line."""
    geojson(items, properties).select("feature").write.text(path)
