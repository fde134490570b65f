"""Road-speed tables derived from the driver tables, for queries and tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tiles
from ..functions.arith import idiv

COLUMNS_OF_GRID = 101
HIGHWAYS = ["motorway", "secondary", "tertiary", "residential", "service"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def millis(ts: str) -> F.Column:
    """The nearest epoch millisecond, halves away from zero, as the SQL's epoch_ms has it; times without a zone are UTC's."""
    # a cast of these to timestamp takes the session's zone, in whose gaps and overlaps it can't be taken back
    since = (F.col(ts).cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)")
    us = F.when(F.typeof(ts) == "timestamp", F.unix_micros(F.col(ts).cast("timestamp"))).otherwise((since * 1_000_000).cast("long"))
    return idiv(us + F.when(us < 0, -500).otherwise(500), 1000)


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    """segment_id, time_ms, speed, street_type from events."""
    e = table(spark, folder, "events")
    return e.select(F.col("user_id").alias("segment_id"), millis("ts").alias("time_ms"), (F.col("value") / F.lit(3.6)).alias("speed"), (F.col("user_id") % 6).cast("int").alias("street_type"))


def order_samples(spark: SparkSession, folder: str) -> DataFrame:
    """segment_id, time_ms, speed from lineitem, for volume."""
    li = table(spark, folder, "lineitem")
    return li.select(F.col("l_suppkey").alias("segment_id"), (millis("l_shipdate") + F.col("l_linenumber") * 3_600_000).alias("time_ms"), (F.col("l_quantity") / F.lit(3.6)).alias("speed"))


def _x(i: F.Column) -> F.Column:
    return idiv(i, 5) * 840 + i % 5 * 200


def grid_nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("r"))
    grid = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS_OF_GRID - 1)))).withColumn("i", F.col("i").cast("long"))
    return grid.select((F.col("r") * 1000 + F.col("i")).alias("node_id"), (_x(F.col("i")) / 100000.0).alias("lon"), (F.lit(0.02) + F.col("r") * F.lit(0.01)).alias("lat"))


def grid_ways(spark: SparkSession, folder: str) -> DataFrame:
    """An east-west way for each row of the grid and a north-south way for each column."""
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("r"))
    kinds = F.array(*[F.lit(h) for h in HIGHWAYS])
    columns = F.sequence(F.lit(0), F.lit(COLUMNS_OF_GRID - 1))
    east = rows.select(F.col("r").alias("way_id"), F.transform(columns, lambda i: F.col("r") * 1000 + i.cast("long")).alias("nodes"), F.create_map(F.lit("highway"), F.element_at(kinds, (F.col("r") % 5 + 1).cast("int"))).alias("tags"))
    order = rows.agg(F.array_sort(F.collect_list("r")).alias("rs"))  # the grid has one row per nation
    north = order.withColumn("i", F.explode(columns)).select((F.lit(1000) + F.col("i")).cast("long").alias("way_id"), F.transform("rs", lambda r: r * 1000 + F.col("i")).alias("nodes"), F.create_map(F.lit("highway"), F.lit("residential")).alias("tags"))
    return east.unionByName(north)


#: A town for each supplier: places of its nodes (in 1e-5 degrees), and its ways with their nodes. Node 19 has no place.
TOWN_NODES = {**{k: (80 * k, 30 * (k % 2)) for k in range(10)}, **{k: (1000 + 10 * (k - 10), 100) for k in range(10, 16)}, 16: (240, 200), 17: (480, -200), 18: (1050, 300), 20: (300, 120), 21: (420, 90)}
TOWN_WAYS = {0: [*range(10)], 1: [16, 3], 2: [6, 17, 3], 3: [*range(10, 16)], 4: [18, 12], 5: [11, 18], 6: [13, 18], 7: [2, 0, 2], 8: [3, 20, 6, 21, 3], 9: [0, 19], 10: [1, 4]}
TOWN_STREETS = ["secondary", "motorway", "primary_link", "tertiary", "unclassified", "living_street"]


def _towns(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey").cast("long")
    return table(spark, folder, "supplier").select(s.alias("s"), (s % 100 * 2000).alias("x"), (idiv(s, 100) * 2000 + 100_000).alias("y"))


def town_nodes(spark: SparkSession, folder: str) -> DataFrame:
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in TOWN_NODES.items()])
    rows = _towns(spark, folder).withColumn("n", F.explode(places))
    return rows.select((F.col("s") * 100 + F.col("n.k")).alias("node_id"), ((F.col("x") + F.col("n.x")) / 100000.0).alias("lon"), ((F.col("y") + F.col("n.y")) / 100000.0).alias("lat"))


def town_ways(spark: SparkSession, folder: str) -> DataFrame:
    """Bent streets of several classes, one-way or not; a roundabout, a loop, chains of short pieces, a missing node, no street."""
    ways = F.array(*[F.struct(F.lit(j).alias("j"), F.array(*map(F.lit, ks)).alias("ks")) for j, ks in TOWN_WAYS.items()])
    rows = _towns(spark, folder).withColumn("w", F.explode(ways))
    s, j = F.col("s"), F.col("w.j")
    main = F.element_at(F.array(*map(F.lit, TOWN_STREETS)), (s % 6 + 1).cast("int"))
    highway = F.when(j == 0, main).when(j.isin(3, 8), "service").when(j == 7, "tertiary").when(j == 9, "primary").when(j < 10, "residential")
    oneway = F.when((j == 0) & (s % 4 == 0), "Yes").when((j == 0) & (s % 4 == 1), "no").when((j == 3) & (s % 3 == 0), "1")
    junction, building = F.when(j == 7, "roundabout"), F.when(j == 10, "yes")
    tags = F.map_filter(F.create_map(*[x for name, v in (("highway", highway), ("oneway", oneway), ("junction", junction), ("building", building)) for x in (F.lit(name), v)]), lambda k, v: v.isNotNull())
    return rows.select((s * 20 + j).alias("way_id"), F.transform("w.ks", lambda k: s * 100 + k).alias("nodes"), tags.alias("tags"))


def gps_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """seq, time_ms, vehicle_id, lon, lat, convert_to_local: a vehicle per user, driving east along a row of the grid."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.when(F.col("event_id") % 17 == 0, 0).otherwise(F.lit(60) + F.col("event_id") * 37 % 180)
    k = e.withColumn("k", F.row_number().over(w).cast("long")).withColumn("x", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    time = F.lit(1704067200000) + F.col("user_id") * 3600000 + F.col("k") * 10000 + idiv(F.col("k"), 29) * 400000
    lat = F.lit(0.02) + F.col("user_id") % 25 * F.lit(0.01) + (F.col("user_id") * 13 % 13 - 6) * F.lit(0.00001)
    return k.select(F.col("k").alias("seq"), time.alias("time_ms"), F.col("user_id").alias("vehicle_id"), (F.col("x") / 100000.0).alias("lon"), lat.alias("lat"), F.lit(True).alias("convert_to_local"))


#: The nodes that each of a town's vehicles drives over: its main street and back; both ways over chains of short pieces.
TOWN_DRIVES = {0: [*range(10), *range(8, -1, -1)], 1: [18, 11, 13, 18, 13, 11, 18], 2: [18, 12, 13, 18, 12, 11, 18]}


def town_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """As gps_fixes: three vehicles in each town, a fix at every node that they pass, 25 seconds apart."""
    places = [(v, k, *TOWN_NODES[n]) for v, drive in TOWN_DRIVES.items() for k, n in enumerate(drive, 1)]
    rows = _towns(spark, folder).withColumn("f", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for v, k, x, y in places])))
    time = F.lit(1704067200000) + F.col("s") * 7000 + F.col("f.k") * 25000
    return rows.select(F.col("f.k").cast("long").alias("seq"), time.alias("time_ms"), (F.col("s") * 3 + F.col("f.v")).alias("vehicle_id"), ((F.col("x") + F.col("f.x")) / 100000.0).alias("lon"), ((F.col("y") + F.col("f.y")) / 100000.0).alias("lat"), F.lit(True).alias("convert_to_local"))


#: What is put in place of a field in spoiled fixes, in turn.
SPOILED = [("lon", None), ("lat", math.nan), ("lon", math.inf), ("lat", 90.0), ("lat", -91.0), ("lon", 1e9), ("lon", 180.0), ("vehicle_id", None), ("time_ms", None), ("lat", None)]


def gps_fixes_with_faults(spark: SparkSession, folder: str) -> DataFrame:
    """gps_fixes, and between them a copy of each, with half a place in seq after it, that has one of SPOILED's faults."""
    fixes = gps_fixes(spark, folder)
    kind = (F.col("vehicle_id") + F.col("seq")) % len(SPOILED)
    bad = fixes.withColumn("kind", kind)
    for k, (name, value) in enumerate(SPOILED):
        bad = bad.withColumn(name, F.when(F.col("kind") == k, F.lit(value).cast(fixes.schema[name].dataType)).otherwise(F.col(name)))
    return fixes.withColumn("seq", F.col("seq") * 2).unionByName(bad.drop("kind").withColumn("seq", F.col("seq") * 2 + 1))


def fix_areas(fixes: DataFrame) -> DataFrame:
    """x, y, zone_offset of the area tiles of fixes."""
    xy = fixes.select(tiles.tile_x(F.col("lon"), tiles.AREA_ZOOM).alias("x"), tiles.tile_y(F.col("lat"), tiles.AREA_ZOOM).alias("y")).distinct()
    return xy.withColumn("zone_offset", F.col("x").cast("long") % 3 * 3600000)


def zone_polygons(spark: SparkSession) -> DataFrame:
    """tzid, ordinal, ring: three overlapping bands."""
    bands = [("A", 1, -0.01, 0.06), ("B", 2, 0.05, 0.12), ("C", 3, 0.11, 0.2)]
    corner = lambda x, y: f"named_struct('lon', {x}D, 'lat', {y}D)"
    rows = ", ".join(f"('{t}', {o}, array({corner(a, 0.0)}, {corner(b, 0.0)}, {corner(b, 0.4)}, {corner(a, 0.4)}, {corner(a, 0.0)}))" for t, o, a, b in bands)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(tzid, ordinal, ring)")


#: Corners of a bent zone, and of a hole in it, from the zone's own corner.
BENT = [(0.0, 0.0), (1.2, 0.0), (1.2, 0.5), (0.6, 0.5), (0.6, 1.2), (0.0, 1.2), (0.0, 0.0)]
HOLE = [(0.1, 0.1), (0.4, 0.1), (0.4, 0.4), (0.1, 0.4), (0.1, 0.1)]


def bent_zones(spark: SparkSession, folder: str) -> DataFrame:
    """tzid, ordinal, ring, holes: an L for each nation, every other one with a hole; seven zones of several parts."""
    r = F.col("n_nationkey").cast("long")
    x, y = r % 5 * F.lit(1.5), idiv(r, 5) * F.lit(1.5)
    ring = lambda corners: F.array(*[F.struct((x + F.lit(a)).alias("lon"), (y + F.lit(b)).alias("lat")) for a, b in corners])
    holes = F.when(r % 2 == 0, F.array(ring(HOLE))).otherwise(F.array().cast("array<array<struct<lon:double,lat:double>>>"))
    return table(spark, folder, "nation").select(F.concat(F.lit("Z"), (r % 7).cast("string")).alias("tzid"), (r + 1).cast("int").alias("ordinal"), ring(BENT).alias("ring"), holes.alias("holes"))


def scattered_points(spark: SparkSession, folder: str) -> DataFrame:
    """point_id, lon, lat: a place for each order, over the bent zones and around them."""
    k = F.col("o_orderkey").cast("long")
    return table(spark, folder, "orders").select(k.alias("point_id"), (k * 7919 % 9001 / 1000.0 - 0.75).alias("lon"), (k * 104729 % 8999 / 1000.0 - 0.75).alias("lat"))


def zone_offset_table(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('A', 0L), ('B', 3600000L), ('C', 7200000L) AS t(tzid, raw_offset_ms)")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """lon, lat, country, city, population: a place per nation."""
    n = table(spark, folder, "nation")
    r = F.col("n_nationkey").cast("long")
    return n.select((r % 10 * F.lit(0.01)).alias("lon"), (F.lit(0.02) + r * F.lit(0.01)).alias("lat"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("country"), F.col("n_name").alias("city"), (r * 7919 % 1000).alias("population"))


def envelopes(spark: SparkSession) -> DataFrame:
    q = F.col("id")
    return spark.range(10).select(q.alias("envelope_id"), (q * F.lit(0.01)).alias("min_lon"), (q * F.lit(0.01) + 0.02).alias("max_lon"), (F.lit(0.02) + q * F.lit(0.01)).alias("min_lat"), (F.lit(0.05) + q * F.lit(0.01)).alias("max_lat"))
