"""Street map to segments, trip lines and jumpers."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .tables import FIRST_ID, settled, shuffled, with_ids

# Segments up to this length (m) have no trip lines; a line's distance from the ends and half width (m).
MIN_SEGMENT, MARGIN, RADIUS = 60.0, 20.0, 10.0
# Road classes by their number; any other value of the highway tag is 5, none is 0.
ROAD_TYPES = {1: ["motorway", "trunk", "primary", "primary_link", "motorway_link", "unclassified"], 2: ["secondary"], 3: ["tertiary"], 4: ["residential"]}
TRUE_TAGS = ["yes", "true", "1"]
SEGMENT_KEY = ["way_id", "start_node_id", "end_node_id"]
#: Ways of a cell when segments are numbered; edges of a jumper at most: any number.
CELL_WAYS, MAX_EDGES = 256, math.inf


class Network:
    """Segments, computed once, and what follows from them."""

    def __init__(self, segments: DataFrame):
        self.segments = settled(segments)

    @cached_property
    def triplines(self) -> DataFrame:
        return settled(triplines(self.segments))

    @cached_property
    def jumpers(self) -> DataFrame:
        return settled(jumpers(self.segments))


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def road_type(highway: Column) -> Column:
    out = F.when(highway.isNull(), 0)
    for number, names in ROAD_TYPES.items():
        out = out.when(highway.isin(names), number)
    return out.otherwise(5)


def is_traffic(highway: Column) -> Column:
    return highway.isNotNull()


def is_oneway(oneway: Column, highway: Column, junction: Column) -> Column:
    return F.coalesce(F.lower(oneway).isin(TRUE_TAGS), F.lit(False)) | F.coalesce(highway == "motorway", F.lit(False)) | F.coalesce(junction == "roundabout", F.lit(False))


def traffic_ways(ways: DataFrame) -> DataFrame:
    """way_id, nodes, street_type and oneway of ways (way_id, nodes, tags) with a highway tag."""
    return ways.where(is_traffic(tag("highway"))).select("way_id", "nodes", road_type(tag("highway")).alias("street_type"), is_oneway(tag("oneway"), tag("highway"), tag("junction")).alias("oneway"))


def intersections(ways: DataFrame) -> DataFrame:
    """node_id and uses of nodes that occur at least twice in all traffic ways."""
    return ways.where(is_traffic(tag("highway"))).select(F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("uses")).where("uses >= 2")


def _placed(streets: DataFrame, nodes: DataFrame, crossings: DataFrame | None = None) -> DataFrame:
    """way_id, street_type, oneway, p: the places (pos, node_id, lon, lat, crossing) of streets whose nodes are all known.

    Two shuffles: places meet their nodes and are counted by node, then gathered by way. crossings (node_id) says which nodes are,
    if streets aren't all that there are.
    """
    places = streets.select("way_id", "street_type", "oneway", F.posexplode("nodes").alias("pos", "node_id")).join(shuffled(nodes.select("node_id", "lon", "lat")), "node_id", "left")
    if crossings is None:
        placed = places.withColumn("crossing", F.count(F.lit(1)).over(Window.partitionBy("node_id")) >= 2)
    else:
        placed = places.join(shuffled(crossings.select("node_id", F.lit(True).alias("crossing"))), "node_id", "left").withColumn("crossing", F.coalesce("crossing", F.lit(False)))
    gathered = placed.groupBy("way_id").agg(F.first("street_type").alias("street_type"), F.first("oneway").alias("oneway"), F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat", "crossing"))).alias("p"))
    return gathered.where(~F.exists("p", lambda c: c["lon"].isNull()))


def way_lines(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """way_id, pos, node_id, lon, lat of traffic ways all of whose nodes are known."""
    return _placed(traffic_ways(ways), nodes).select("way_id", F.inline("p")).drop("crossing")


def pieces(streets: DataFrame, nodes: DataFrame, crossings: DataFrame | None = None) -> DataFrame:
    """Directed pieces of streets (way_id, nodes, street_type, oneway) between crossings, a reverse one for each of a two-way street.

    way_id, start_node_id, end_node_id, length, oneway, street_type, coords. Pieces with the same way and end nodes are one, the
    first along the way, forward before reverse. crossings as in _placed.
    """
    lines = _placed(streets, nodes, crossings)
    n = F.size("p")
    cuts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (i == n) | F.element_at("p", i)["crossing"])
    lines = lines.where(n >= 2).withColumn("cuts", cuts)
    # the node at a cut ends one piece and starts the next
    piece = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.slice("p", F.element_at("cuts", k), F.element_at("cuts", k + 1) - F.element_at("cuts", k) + 1))
    cut = lines.select("way_id", "street_type", "oneway", F.posexplode(piece).alias("piece", "p"))
    cut = cut.withColumn("length", geo.line_length(F.col("p"))).withColumn("reverse", F.explode(F.when(F.col("oneway"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    cut = cut.withColumn("p", F.when(F.col("reverse") == 1, F.reverse("p")).otherwise(F.col("p")))
    coords = F.transform("p", lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat")))
    directed = cut.select("way_id", "piece", "reverse", F.element_at("p", 1)["node_id"].alias("start_node_id"), F.element_at("p", -1)["node_id"].alias("end_node_id"), "length", "oneway", "street_type", coords.alias("coords"))
    unique = directed.withColumn("n", F.row_number().over(Window.partitionBy(*SEGMENT_KEY).orderBy("reverse", "piece"))).where("n = 1")
    return unique.select(*SEGMENT_KEY, "length", "oneway", "street_type", "coords")


def street_segments(nodes: DataFrame, ways: DataFrame, first_id: int = FIRST_ID) -> DataFrame:
    """The pieces of the traffic ways of a map, numbered from first_id in the order of way and end nodes."""
    numbered = with_ids(pieces(traffic_ways(ways), nodes), SEGMENT_KEY, F.floor(F.col("way_id") / CELL_WAYS), first=first_id)
    return numbered.select("id", *SEGMENT_KEY, "length", "oneway", "street_type", "coords")


def triplines(segments: DataFrame) -> DataFrame:
    """Two lines across each segment over MIN_SEGMENT: MARGIN after its start and before its end, left end first."""
    long = segments.where(F.col("length") > MIN_SEGMENT).select("id", "length", "coords", F.explode(F.array(F.lit(1), F.lit(2))).alias("tripline_index"))
    dist = F.when(F.col("tripline_index") == 1, F.lit(MARGIN)).otherwise(F.col("length") - MARGIN)
    placed = long.withColumn("dist", dist).withColumn("at", geo.point_along(F.col("coords"), F.col("dist") / F.col("length")))
    lon, lat, way = F.col("at.lon"), F.col("at.lat"), F.col("at.azimuth")
    left, right = geo.destination(lon, lat, geo.clamp_azimuth(way - 90.0), RADIUS), geo.destination(lon, lat, geo.clamp_azimuth(way + 90.0), RADIUS)
    number = F.lit(FIRST_ID - 1) + (F.col("id") - FIRST_ID) * 2 + F.col("tripline_index")
    return placed.select(number.alias("id"), F.col("id").alias("segment_id"), "tripline_index", "dist", left[0].alias("x0"), left[1].alias("y0"), right[0].alias("x1"), right[1].alias("y1"))


def jumpers(segments: DataFrame, max_edges: float = MAX_EDGES) -> DataFrame:
    """Simple paths over segments up to MIN_SEGMENT: the shortest per pair of nodes, in travel order.

    Round k knows the shortest paths of up to 2**k edges. A longer one begins with one of exactly 2**k, as a shortest path has
    shortest beginnings and ends, so the next round joins only these with all; it is the last if there are none. Each pair of
    nodes that reach each other over short segments has a row, so a cluster of n such nodes has up to n * (n - 1).
    """
    edges = segments.where(F.col("length") <= MIN_SEGMENT).select("start_node_id", "end_node_id", "length", "id")
    paths = edges.select("start_node_id", "end_node_id", "length", F.array("id").alias("segments"), F.array("start_node_id", "end_node_id").alias("seen")).where("start_node_id <> end_node_id")
    paths, size = settled(_shortest(paths)), 1
    while size < max_edges:
        full = paths.where(F.size("segments") == size)
        if full.isEmpty():
            break
        rest = paths.select(F.col("start_node_id").alias("end_node_id"), F.col("end_node_id").alias("to"), F.col("length").alias("more"), F.col("segments").alias("next"), F.col("seen").alias("ahead"))
        # both ways hold the node where they meet, and nothing else in common
        met = full.join(shuffled(rest), "end_node_id").where((F.size("next") + size <= max_edges) & (F.size(F.array_intersect("seen", "ahead")) == 1))
        longer = met.select("start_node_id", F.col("to").alias("end_node_id"), (F.col("length") + F.col("more")).alias("length"), F.concat("segments", "next").alias("segments"), F.array_union("seen", "ahead").alias("seen"))
        paths, size = settled(_shortest(paths.unionByName(longer))), 2 * size
    return paths.select("start_node_id", "end_node_id", "length", "segments")


def _shortest(paths: DataFrame) -> DataFrame:
    best = F.min(F.struct(F.round("length", 6).alias("r"), "segments", "length", "seen"))
    return paths.groupBy("start_node_id", "end_node_id").agg(best.alias("b")).select("start_node_id", "end_node_id", "b.length", "b.segments", "b.seen")


def disjoint(a_start: Column, a_end: Column, b_start: Column, b_end: Column, gap_ab: Column, gap_ba: Column) -> Column:
    """False if the segments share a node end to start, or one's end lies within MIN_SEGMENT of the other's start."""
    return ~((a_end == b_start) | (b_end == a_start) | (gap_ab < MIN_SEGMENT) | (gap_ba < MIN_SEGMENT))


def segment_label(way: Column, start: Column, end: Column) -> Column:
    return F.format_string("ss_%d:%d-%d", way, start, end)


def tripline_label(segment: Column, index: Column) -> Column:
    return F.format_string("tl_%d-%d", segment, index)


def trace_label(start: Column, end: Column) -> Column:
    return F.format_string("tr_%d_%d", start, end)


def offset_geometry(segments: DataFrame, offset: float = -0.000025) -> DataFrame:
    """id and coords, two-way segments moved aside so that both directions can be told apart."""
    return segments.select("id", F.when(F.col("oneway"), F.col("coords")).otherwise(geo.offset_line(F.col("coords"), offset)).alias("coords"))


def build(nodes: DataFrame, ways: DataFrame, first_id: int = FIRST_ID) -> Network:
    return Network(street_segments(nodes, ways, first_id))
