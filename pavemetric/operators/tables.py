"""Keyed tables: surrogate ids, upserts, lookups by id, key and envelope (SRC12-14, SNK1-5, SP5-SP9, SP14-17)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tiles

# Fixed value: surrogate ids begin here.
FIRST_ID = 1_000_000_000
#: Where checkpoints go if spark.checkpoint.dir is unset, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
        folder = LOCAL_CHECKPOINTS
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder in the shared one that nobody else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder, so that what is built on it starts there.

    Spark deletes a checkpoint when nothing refers to it any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that grows as the other does: both are dealt by key, whatever size Spark guesses.

    Before a run Spark guesses that exploded rows are as few as those they come from, and would send such a side through the driver.
    """
    return df.hint("merge")


def next_id(existing: DataFrame | None, name: str = "id") -> int:
    """The id after the largest of a table, FIRST_ID for none or an empty one."""
    last = existing.agg(F.max(name)).first()[0] if existing is not None else None
    return FIRST_ID if last is None else last + 1


def with_ids(df: DataFrame, keys: list[str], cell: Column, name: str = "id", first: int = FIRST_ID) -> DataFrame:
    """Consecutive ids from `first` in the order of keys. `cell` is a coarse, monotonic function of the first key.

    Rows are settled, then numbered cell by cell, and only the counts of the cells are put in one order.
    """
    rows = settled(df.withColumn("_cell", cell))
    cells = rows.groupBy("_cell").count()
    cells = cells.select("_cell", (F.sum("count").over(Window.orderBy("_cell")) - F.col("count")).alias("_base"))
    number = F.row_number().over(Window.partitionBy("_cell").orderBy(*keys))
    return rows.withColumn("_n", number).join(cells, "_cell").withColumn(name, F.lit(first - 1) + F.col("_base") + F.col("_n")).drop("_cell", "_base", "_n")


def valid_lines(items: DataFrame) -> DataFrame:
    """items (coords, ...) with coords emptied where they are no line: null, under two points, or a point without a place."""
    bad = F.col("coords").isNull() | (F.size("coords") < 2) | F.exists("coords", lambda c: c.isNull() | c["lon"].isNull() | c["lat"].isNull() | F.isnan(c["lon"]) | F.isnan(c["lat"]))
    return items.withColumn("coords", F.when(bad, F.array().cast(items.schema["coords"].dataType)).otherwise(F.col("coords")))


def insert_absent(existing: DataFrame, items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing and the rows of items whose key it lacks; of items with the same key the first in order."""
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """existing with the rows of items in place of those with the same key."""
    return existing.join(items.select(key), key, "left_anti").unionByName(items.select(*existing.columns))


def delete(existing: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(items.select(*keys).distinct(), keys, "left_anti")


def item_tiles(items: DataFrame, x0: str, y0: str, x1: str, y1: str, zoom: int = tiles.INDEX_ZOOM, grow: int = 0) -> DataFrame:
    """A row per item and tile of its bounding box (tile_x, tile_y)."""
    exploded = items.withColumn("_t", F.explode(tiles.tile_range(F.col(x0), F.col(y0), F.col(x1), F.col(y1), zoom, grow)))
    return exploded.withColumn("tile_x", F.col("_t.x")).withColumn("tile_y", F.col("_t.y")).drop("_t")


def in_envelopes(items: DataFrame, envelopes: DataFrame, item_id: str, multiset: bool = False) -> DataFrame:
    """(envelope_id, item id) for items with an index tile among an envelope's, which are one more on every side.

    items (item_id, x0, y0, x1, y1), envelopes (envelope_id, min_lon, min_lat, max_lon, max_lat). multiset keeps a row
    for every tile in common.
    """
    left = item_tiles(envelopes, "min_lon", "min_lat", "max_lon", "max_lat", grow=1).select("envelope_id", "tile_x", "tile_y")
    right = item_tiles(items, "x0", "y0", "x1", "y1").select(item_id, "tile_x", "tile_y")
    found = right.join(left, ["tile_x", "tile_y"]).select("envelope_id", item_id)
    return found if multiset else found.distinct()


def segment_or_jumper(keys: DataFrame, segments: DataFrame, jumpers: DataFrame) -> DataFrame:
    """keys (way_id, start_node_id, end_node_id) with the ids of their segment, or else of the jumper between the nodes."""
    ends = ["start_node_id", "end_node_id"]
    direct = keys.join(segments.select("way_id", *ends, "id"), ["way_id", *ends], "left")
    exact = direct.where("id is not null").select("way_id", *ends, F.col("id").alias("segment_id"), F.lit(0).alias("place"))
    by_jumper = direct.where("id is null").drop("id").join(jumpers.select(*ends, "segments"), ends)
    expanded = by_jumper.select("way_id", *ends, F.posexplode("segments").alias("place", "segment_id"))
    return exact.unionByName(expanded.select(*exact.columns))
