"""GPS fixes to speed samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, tiles
from ..functions.arith import idiv
from ..functions.timebins import to_ms
from .network import MIN_SEGMENT
from .tables import settled, shuffled

# Fastest admissible speed (m/s); vehicles that a tile needs; longest time between two fixes of a pair (ms).
MAX_SPEED, MIN_VEHICLES = 31.0, 10
MAX_GAP_MS = {"fixed": 200_000, "legacy": 200_000_000}
#: A pair over more index tiles than this is matched by area tiles.
MAX_PAIR_TILES = 256


def fault(vehicle: Column, time: Column, lon: Column, lat: Column) -> Column:
    """Why a fix can't be used, or null: no vehicle, no time, no place (null or not finite), or one off the map.

    The map is the square of Web-Mercator tiles: longitudes from -180 to under 180, latitudes up to 85.05 either way.
    """
    nowhere = lambda c: c.isNull() | F.isnan(c) | c.isin(math.inf, -math.inf)
    off = ~(lon >= -180.0) | ~(lon < 180.0) | ~(F.abs(lat) < tiles.MAX_LAT)
    return F.when(vehicle.isNull(), "no vehicle").when(time.isNull(), "no time").when(nowhere(lon) | nowhere(lat), "no place").when(off, "off the map")


def _fault() -> Column:
    return fault(*(F.col(c) for c in ("vehicle_id", "time_ms", "lon", "lat")))


def valid_fixes(fixes: DataFrame) -> DataFrame:
    """fixes without those that have a fault: each is lost alone, and no other fix with it."""
    return fixes.where(_fault().isNull())


def fix_faults(fixes: DataFrame) -> DataFrame:
    """fault and fixes: how many fixes have which fault; null counts those without."""
    return fixes.groupBy(_fault().alias("fault")).agg(F.count("*").alias("fixes"))


def normalised(fixes: DataFrame) -> DataFrame:
    """Valid fixes with times in milliseconds; convert_to_local defaults to true."""
    return valid_fixes(fixes).withColumn("time_ms", to_ms(F.col("time_ms"))).withColumn("convert_to_local", F.coalesce("convert_to_local", F.lit(True)))


def local(fixes: DataFrame, areas: DataFrame) -> DataFrame:
    """Fixes in loaded areas, their times moved to the area's zone unless that is switched off."""
    placed = fixes.withColumn("x", tiles.tile_x(F.col("lon"), tiles.AREA_ZOOM)).withColumn("y", tiles.tile_y(F.col("lat"), tiles.AREA_ZOOM))
    joined = placed.join(areas.select("x", "y", "zone_offset"), ["x", "y"])
    return joined.withColumn("time_ms", F.col("time_ms") + F.when(F.col("convert_to_local"), F.col("zone_offset")).otherwise(0)).drop("zone_offset")


def pairs(fixes: DataFrame, mode: str = "fixed", max_gap_ms: int | None = None, by: str = "seq") -> DataFrame:
    """Consecutive fixes of a vehicle by arrival (or by another column): no long gaps, no time going back, no standing still.

    Of fixes with a column busy, both must be.
    """
    w = Window.partitionBy("vehicle_id").orderBy(*dict.fromkeys((by, "seq")))
    open_ = (F.col("busy") & F.lag("busy").over(w)) if "busy" in fixes.columns else F.lit(True)
    last = fixes.select("vehicle_id", "seq", open_.alias("open"), *[f(c).alias(n) for c, n in (("time_ms", "t"), ("lon", "x"), ("lat", "y")) for f, n in ((lambda c: F.lag(c).over(w), f"{n}0"), (F.col, f"{n}1"))])
    gap = F.col("t1") - F.col("t0")
    limit = MAX_GAP_MS[mode] if max_gap_ms is None else max_gap_ms
    kept = F.col("t0").isNotNull() & (gap <= limit) & (gap >= 0) & ~((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")))
    return last.where(kept & F.coalesce("open", F.lit(False))).drop("open")


def _corner(df: DataFrame, prefix: str) -> DataFrame:
    """Smallest index tile of the box of x0, y0, x1, y1."""
    return df.withColumn(f"{prefix}x", tiles.tile_x(F.least("x0", "x1"), tiles.INDEX_ZOOM)).withColumn(f"{prefix}y", tiles.tile_y(F.greatest("y0", "y1"), tiles.INDEX_ZOOM))


def _exploded(df: DataFrame, zoom: int) -> DataFrame:
    return df.withColumn("tile", F.explode(tiles.tile_range(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), zoom))).withColumn("tx", F.col("tile.x")).withColumn("ty", F.col("tile.y")).drop("tile")


def candidates(moves: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs and trip lines whose boxes share an index tile, each once, with the first such tile.

    An equi-join on tiles. A shared tile is the first one if its column and row are the larger of the two boxes' first
    ones, so no duplicates need to be removed. Pairs over many tiles are joined on area tiles instead.
    """
    p = _corner(moves, "p")
    right = _corner(lines.select(F.col("id").alias("tripline_id"), "segment_id", "tripline_index", "dist", "x0", "y0", "x1", "y1"), "l")
    x_end, y_end = tiles.tile_x(F.greatest("x0", "x1"), tiles.INDEX_ZOOM), tiles.tile_y(F.least("y0", "y1"), tiles.INDEX_ZOOM)
    p = p.withColumn("px_end", x_end).withColumn("py_end", y_end)
    right = right.withColumn("lx_end", x_end).withColumn("ly_end", y_end)
    tiles_of = (F.col("px_end") - F.col("px") + 1).cast("long") * (F.col("py_end") - F.col("py") + 1)
    line = [F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")]
    keep = ["tripline_id", "segment_id", "tripline_index", "dist", "lx", "ly", "lx_end", "ly_end"]

    def joined(part: DataFrame, zoom: int) -> DataFrame:
        shift = 1 << (tiles.INDEX_ZOOM - zoom)
        left, other = _exploded(part, zoom), _exploded(right, zoom).select("tx", "ty", *keep, *line)
        first_x, first_y = F.greatest("px", "lx"), F.greatest("py", "ly")
        both = left.join(shuffled(other), ["tx", "ty"]).withColumn("tile_x", first_x).withColumn("tile_y", first_y)
        # the area tiles of the boxes' first index tiles, so that a pair and a line meet once at either zoom
        mine = (F.col("tx") == F.greatest(idiv(F.col("px"), shift), idiv(F.col("lx"), shift))) & (F.col("ty") == F.greatest(idiv(F.col("py"), shift), idiv(F.col("ly"), shift)))
        overlap = (F.col("tile_x") <= F.least("px_end", "lx_end")) & (F.col("tile_y") <= F.least("py_end", "ly_end"))
        return both.where(mine & overlap)

    near = joined(p.where(tiles_of <= MAX_PAIR_TILES), tiles.INDEX_ZOOM)
    far = joined(p.where(tiles_of > MAX_PAIR_TILES), tiles.AREA_ZOOM)
    return near.unionByName(far).drop("tx", "ty", "px", "py", "px_end", "py_end", "lx", "ly", "lx_end", "ly_end")


def crossings(moves: DataFrame, lines: DataFrame) -> DataFrame:
    """vehicle_id, seq, n, time_ms, segment_id, tripline_index, tripline_id, dist: trip lines that pairs cross.

    n numbers a vehicle's crossings by pair, then time, tile and trip line.
    """
    move = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    line = tuple(F.col(c) for c in ("lx0", "ly0", "lx1", "ly1"))
    met = candidates(moves, lines).withColumn("f", geo.intersection_fraction(move, line)).withColumn("g", geo.intersection_fraction(line, move))
    met = met.where("f between 0 and 1 and g between 0 and 1").withColumn("time_ms", geo.crossing_time(F.col("t0"), F.col("t1"), F.col("f")))
    order = Window.partitionBy("vehicle_id").orderBy("seq", "time_ms", "tile_x", "tile_y", "tripline_id")
    return met.select("vehicle_id", "seq", F.row_number().over(order).alias("n"), "time_ms", "segment_id", "tripline_index", "tripline_id", "dist")


def completions(crossed: DataFrame) -> DataFrame:
    """vehicle_id, segment_id, n0, n1, time0, time1, dist0, dist1: first lines completed by the second line of a segment.

    A second line completes the latest pending first line of its segment, and then nothing is pending any more. So it
    does if that first line comes after the last completion; which ones do is a choice of intervals from the left, made
    inside each run of overlapping intervals, whose rows alone are gathered.
    """
    before = Window.partitionBy("vehicle_id", "segment_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    first = F.when(F.col("tripline_index") == 1, F.struct("n", "time_ms", "dist"))
    ends = crossed.withColumn("a", F.max(first).over(before)).where("tripline_index = 2 and a is not null")
    by_end = Window.partitionBy("vehicle_id").orderBy("n")
    ends = ends.withColumn("least", F.min("a.n").over(by_end.rowsBetween(0, Window.unboundedFollowing))).withColumn("last", F.lag("n").over(by_end))
    ends = ends.withColumn("run", F.sum(F.when(F.col("last") < F.col("least"), 1).otherwise(0)).over(by_end))
    item = F.struct(F.col("n").alias("n1"), F.col("a.n").alias("n0"), "segment_id", F.col("a.time_ms").alias("time0"), F.col("time_ms").alias("time1"), F.col("a.dist").alias("dist0"), F.col("dist").alias("dist1"))
    runs = ends.groupBy("vehicle_id", "run").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = F.filter("items", lambda x: F.lit(False))
    state = F.struct(F.lit(0).alias("last"), kept.alias("out"))
    chosen = F.aggregate("items", state, lambda s, x: F.struct(F.when(x["n0"] > s["last"], x["n1"]).otherwise(s["last"]).alias("last"), F.when(x["n0"] > s["last"], F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out")), lambda s: s["out"])
    return runs.select("vehicle_id", F.inline(chosen)).select("vehicle_id", "segment_id", "n0", "n1", "time0", "time1", "dist0", "dist1")


def pending(crossed: DataFrame, completed: DataFrame) -> DataFrame:
    """vehicle_id, segment_id, n, time_ms, tripline_id, dist: the first lines that still wait for their segment's second line.

    Those that a vehicle has crossed since its last completion, of each segment the latest; for a debugger.
    """
    last = completed.groupBy("vehicle_id").agg(F.max("n1").alias("done"))
    rest = crossed.where("tripline_index = 1").join(shuffled(last), "vehicle_id", "left").where("done is null or n > done")
    latest = rest.groupBy("vehicle_id", "segment_id").agg(F.max(F.struct("n", "time_ms", "tripline_id", "dist")).alias("c"))
    return latest.select("vehicle_id", "segment_id", "c.*")


def admissible(completed: DataFrame) -> DataFrame:
    """vehicle_id, n1, segment_id, time_ms (of the first line) and speed; whole seconds, none if 0 or over MAX_SPEED."""
    seconds = idiv(F.col("time1") - F.col("time0"), 1000)
    timed = completed.withColumn("dt", seconds).where("dt > 0").withColumn("speed", F.abs(F.col("dist1") - F.col("dist0")) / F.col("dt"))
    return timed.where(F.col("speed") <= MAX_SPEED).select("vehicle_id", "n1", "segment_id", F.col("time0").alias("time_ms"), "speed")


def jumper_samples(samples: DataFrame, segments: DataFrame, jumpers: DataFrame, mode: str = "fixed") -> DataFrame:
    """Samples of the short segments between a vehicle's consecutive samples that don't follow each other."""
    w = Window.partitionBy("vehicle_id").orderBy("n1")
    chained = samples.withColumn("last_segment", F.lag("segment_id").over(w)).withColumn("last_time", F.lag("time_ms").over(w)).where("last_segment is not null")
    nodes = shuffled(segments.select("id", "start_node_id", "end_node_id"))
    chained = chained.join(nodes.select(F.col("id").alias("last_segment"), F.col("end_node_id").alias("from_node")), "last_segment")
    chained = chained.join(nodes.select(F.col("id").alias("segment_id"), F.col("start_node_id").alias("to_node")), "segment_id").where("from_node <> to_node")
    paths = jumpers.select(F.col("start_node_id").alias("from_node"), F.col("end_node_id").alias("to_node"), F.col("length").alias("jump"), "segments")
    jumped = chained.join(shuffled(paths), ["from_node", "to_node"]).withColumn("dt", idiv(F.col("time_ms") - F.col("last_time"), 1000)).where("dt > 0")
    jumped = jumped.withColumn("speed", (F.col("jump") + 2 * MIN_SEGMENT) / F.col("dt"))
    if mode == "fixed":
        jumped = jumped.where(F.col("speed") <= MAX_SPEED)
    return jumped.select("vehicle_id", "n1", F.explode("segments").alias("segment_id"), "time_ms", "speed")


def speed_samples(fixes: DataFrame, areas: DataFrame, segments: DataFrame, lines: DataFrame, jumpers: DataFrame, mode: str = "fixed", min_vehicles: int = MIN_VEHICLES) -> DataFrame:
    """vehicle_id, segment_id, time_ms, speed and whether by a jumper, of fixes (seq, time_ms, vehicle_id, lon, lat, convert_to_local).

    Only ways between fixes in area tiles with min_vehicles or more count, so that nobody's way is published alone.
    """
    moves = pairs(gated(local(normalised(fixes), areas), min_vehicles), mode)
    main = settled(admissible(completions(crossings(moves, lines))))
    jumped = jumper_samples(main, segments, jumpers, mode)
    named = lambda df, by: df.select("vehicle_id", "segment_id", "time_ms", "speed", F.lit(by).alias("by_jumper"))
    return named(main, False).unionByName(named(jumped, True))


def tile_vehicles(fixes: DataFrame, mode: str = "fixed") -> DataFrame:
    """x, y, vehicles: distinct vehicles of each area tile. legacy counts a vehicle where it first was and where it left.

    Fixes without a place on the map count nowhere.
    """
    fixes = fixes.where(fault(F.col("vehicle_id"), F.lit(0), F.col("lon"), F.col("lat")).isNull())
    placed = fixes.select("vehicle_id", "seq", tiles.tile_x(F.col("lon"), tiles.AREA_ZOOM).alias("x"), tiles.tile_y(F.col("lat"), tiles.AREA_ZOOM).alias("y"))
    if mode == "legacy":
        w = Window.partitionBy("vehicle_id").orderBy("seq")
        tile = F.struct("x", "y")
        placed = placed.withColumn("first", F.row_number().over(w) == 1).withColumn("left", F.lead(tile).over(w) != tile).where("first or left")
    return placed.groupBy("x", "y").agg(F.countDistinct("vehicle_id").alias("vehicles"))


def busy_tiles(fixes: DataFrame, min_vehicles: int = MIN_VEHICLES) -> DataFrame:
    """x, y of area tiles with enough vehicles."""
    return tile_vehicles(fixes).where(F.col("vehicles") >= min_vehicles).select("x", "y")


def busiest_tiles(fixes: DataFrame, mode: str = "fixed") -> DataFrame:
    """x, y, vehicles and rank of area tiles, those with most vehicles first; ties by tile."""
    counts = tile_vehicles(fixes, mode)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("vehicles"), "x", "y")))  # a row for each tile


def gated(fixes: DataFrame, min_vehicles: int = MIN_VEHICLES, busy: DataFrame | None = None) -> DataFrame:
    """fixes with a column busy: whether their area tile has enough vehicles, or is in a given table (x, y)."""
    tile = {"x": tiles.tile_x(F.col("lon"), tiles.AREA_ZOOM), "y": tiles.tile_y(F.col("lat"), tiles.AREA_ZOOM)}
    found = (busy_tiles(fixes, min_vehicles) if busy is None else busy.select("x", "y").distinct()).withColumn("busy", F.lit(True))
    return fixes.withColumns(tile).join(found, ["x", "y"], "left").withColumn("busy", F.coalesce("busy", F.lit(False)))


def in_busy_tiles(fixes: DataFrame, min_vehicles: int = MIN_VEHICLES) -> DataFrame:
    """Fixes in area tiles with enough vehicles."""
    return gated(fixes, min_vehicles).where("busy").drop("busy")


def last_points(fixes: DataFrame) -> DataFrame:
    """Last valid fix of each vehicle with its area tile."""
    last = valid_fixes(fixes).groupBy("vehicle_id").agg(F.max_by(F.struct("time_ms", "lon", "lat"), "seq").alias("p"))
    return last.select("vehicle_id", "p.*", tiles.tile_x(F.col("p.lon"), tiles.AREA_ZOOM).alias("x"), tiles.tile_y(F.col("p.lat"), tiles.AREA_ZOOM).alias("y"))


def counters(fixes: DataFrame, samples: DataFrame) -> DataFrame:
    """vehicles, fixes and samples so far."""
    return fixes.agg(F.countDistinct("vehicle_id").alias("vehicles"), F.count("*").alias("fixes")).crossJoin(samples.agg(F.count("*").alias("samples")))
