"""Building blocks of the oracle SQL (DuckDB)."""

from __future__ import annotations

import re

from ..functions.geo import AXIS, E2
from ..operators.network import MARGIN, MIN_SEGMENT, RADIUS
from ..sources.adapters import HIGHWAYS, TOWN_DRIVES, TOWN_NODES, TOWN_STREETS, TOWN_WAYS


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def tile_x(lon: str, zoom: int) -> str:
    return f"CAST(floor(({lon} + 180.0) / 360.0 * {float(1 << zoom)}) AS INT)"


def tile_y(lat: str, zoom: int) -> str:
    return f"CAST(floor((1.0 - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * {float(1 << zoom)}) AS INT)"


def meridian(phi: str) -> str:
    return f"({d(AXIS * (1 - E2))} / pow(1.0 - {d(E2)} * sin({phi}) * sin({phi}), 1.5))"


def normal(phi: str) -> str:
    return f"({d(AXIS)} / sqrt(1.0 - {d(E2)} * sin({phi}) * sin({phi})))"


def north(y0: str, y1: str) -> str:
    return f"(radians({y1} - {y0}) * {meridian(f'radians(({y0} + {y1}) / 2.0)')})"


def east(x0: str, y0: str, x1: str, y1: str) -> str:
    phi = f"radians(({y0} + {y1}) / 2.0)"
    return f"(radians({x1} - {x0}) * {normal(phi)} * cos({phi}))"


def distance(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"sqrt({north(y0, y1)} * {north(y0, y1)} + {east(x0, y0, x1, y1)} * {east(x0, y0, x1, y1)})"


def ms(time: str) -> str:
    return f"(CASE WHEN {time} < 15000000000 THEN {time} * 1000 ELSE {time} END)"


def hour(time: str) -> str:
    return f"CAST((({ms(time)} // 3600000 - 96) % 168 + 168) % 168 AS INT)"


def week(time: str) -> str:
    return f"CAST(({ms(time)} - 345600000) // 604800000 AS INT)"


def speed_bin(speed: str) -> str:
    return f"CAST(least(floor({speed} * {d(3.6)} + 0.5), 119) AS INT)"


MEAN = f"CAST(sum_m AS DOUBLE) / ({d(7.2)} * n)"
STD = f"sqrt(CAST(CAST(n AS HUGEINT) * sum_mm - CAST(sum_m AS HUGEINT) * sum_m AS DOUBLE) / {d(51.84)}) / CAST(n AS DOUBLE)"
MOMENTS = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (2 * CAST(speed_bin AS BIGINT) - 1)) AS BIGINT) AS sum_m, CAST(sum(n * (2 * CAST(speed_bin AS BIGINT) - 1) * (2 * CAST(speed_bin AS BIGINT) - 1)) AS BIGINT) AS sum_mm"


def road_type(h: str) -> str:
    """Written out, so that it doesn't follow the library's table."""
    first = "'motorway', 'trunk', 'primary', 'primary_link', 'motorway_link', 'unclassified'"
    return f"CASE WHEN {h} IS NULL THEN 0 WHEN {h} IN ({first}) THEN 1 WHEN {h} = 'secondary' THEN 2 WHEN {h} = 'tertiary' THEN 3 WHEN {h} = 'residential' THEN 4 ELSE 5 END"


# Fixed values, written out by level, so that oracles don't follow the library's table; legacy is what P_999 reads there.
CRITICAL = {
    "P_90": [3.078, 1.886, 1.638, 1.533, 1.476, 1.440, 1.415, 1.397, 1.383, 1.372, 1.363, 1.356, 1.350, 1.345, 1.341, 1.337, 1.333, 1.330, 1.328, 1.325, 1.323, 1.321, 1.319, 1.318, 1.316, 1.315, 1.314, 1.313, 1.311, 1.310, 1.309, 1.309, 1.308, 1.307, 1.306],
    "P_95": [6.314, 2.920, 2.353, 2.132, 2.015, 1.943, 1.895, 1.860, 1.833, 1.812, 1.796, 1.782, 1.771, 1.761, 1.753, 1.746, 1.740, 1.734, 1.729, 1.725, 1.721, 1.717, 1.714, 1.711, 1.708, 1.706, 1.703, 1.701, 1.699, 1.697, 1.696, 1.694, 1.692, 1.691, 1.690],
    "P_975": [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042, 2.040, 2.037, 2.035, 2.032, 2.030],
    "P_99": [31.821, 6.965, 4.541, 3.747, 3.365, 3.143, 2.998, 2.896, 2.821, 2.764, 2.718, 2.681, 2.650, 2.624, 2.602, 2.583, 2.567, 2.552, 2.539, 2.528, 2.518, 2.508, 2.500, 2.492, 2.485, 2.479, 2.473, 2.467, 2.462, 2.457, 2.453, 2.449, 2.445, 2.441, 2.438],
    "P_999": [318.313, 22.327, 10.215, 7.173, 5.893, 5.208, 4.782, 4.499, 4.296, 4.143, 4.024, 3.929, 3.852, 3.787, 3.733, 3.686, 3.646, 3.610, 3.579, 3.552, 3.527, 3.505, 3.485, 3.467, 3.450, 3.435, 3.421, 3.408, 3.396, 3.385, 3.375, 3.365, 3.356, 3.348, 3.340],
    "legacy": [63.657, 9.925, 5.841, 4.604, 4.032, 3.707, 3.499, 3.355, 3.250, 3.169, 3.106, 3.055, 3.012, 2.977, 2.947, 2.921, 2.898, 2.878, 2.861, 2.845, 2.831, 2.819, 2.807, 2.797, 2.787, 2.779, 2.771, 2.763, 2.756, 2.750, 2.744, 2.738, 2.733, 2.728, 2.724],
}


CTES = {
    "ev": f"SELECT user_id AS segment_id, epoch_ms(ts) AS time_ms, value / {d(3.6)} AS speed, CAST(user_id % 6 AS INT) AS street_type FROM events",
    "li": f"SELECT l_suppkey AS segment_id, epoch_ms(l_shipdate) + l_linenumber * 3600000 AS time_ms, l_quantity / {d(3.6)} AS speed FROM lineitem",
    "hist": f"SELECT segment_id, {week('time_ms')} AS week, {hour('time_ms')} AS hour, {speed_bin('speed')} AS speed_bin, count(*) AS n FROM ev GROUP BY ALL",
    "hist_li": f"SELECT segment_id, {week('time_ms')} AS week, {hour('time_ms')} AS hour, {speed_bin('speed')} AS speed_bin, count(*) AS n FROM li GROUP BY ALL",
    "nodes": f"SELECT r * 1000 + i AS node_id, r, i, (i // 5 * 840 + i % 5 * 200) / {d(100000.0)} AS lon, {d(0.02)} + r * {d(0.01)} AS lat FROM (SELECT CAST(n_nationkey AS BIGINT) AS r FROM nation), range(0, 101) t(i)",
    "edges": f"""SELECT a.r AS way_id, a.node_id AS a_node, b.node_id AS b_node, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_, [{", ".join(repr(h) for h in HIGHWAYS)}][a.r % 5 + 1] AS highway FROM nodes a JOIN nodes b ON b.r = a.r AND b.i = a.i + 1
      UNION ALL SELECT 1000 + a.i, a.node_id, b.node_id, a.lon, a.lat, b.lon, b.lat, 'residential' FROM nodes a JOIN nodes b ON b.r = a.r + 1 AND b.i = a.i""",
    "directed": "SELECT way_id, a_node AS start_node_id, b_node AS end_node_id, ax, ay, bx, by_, highway FROM edges UNION ALL SELECT way_id, b_node, a_node, bx, by_, ax, ay, highway FROM edges WHERE highway <> 'motorway'",
    "segments": f"SELECT 999999999 + row_number() OVER (ORDER BY way_id, start_node_id, end_node_id) AS id, way_id, start_node_id, end_node_id, {distance('ax', 'ay', 'bx', 'by_')} AS length, highway = 'motorway' AS oneway, {road_type('highway')} AS street_type, ax, ay, bx, by_ FROM directed",
    "lines0": f"SELECT id AS segment_id, k AS tripline_index, length, CASE WHEN k = 1 THEN {d(MARGIN)} ELSE length - {d(MARGIN)} END AS dist, ax, ay, bx, by_, degrees(atan2({east('ax', 'ay', 'bx', 'by_')}, {north('ay', 'by_')})) AS way FROM segments, range(1, 3) t(k) WHERE length > {MIN_SEGMENT}",
    "lines1": "SELECT *, ax + dist / length * (bx - ax) AS lon, ay + dist / length * (by_ - ay) AS lat FROM lines0",
    "lines": f"""SELECT 999999999 + (segment_id - 1000000000) * 2 + tripline_index AS id, segment_id, CAST(tripline_index AS INT) AS tripline_index, dist,
      lon + degrees({d(RADIUS)} * sin(radians(way - 90.0)) / ({normal('radians(lat)')} * cos(radians(lat)))) AS x0, lat + degrees({d(RADIUS)} * cos(radians(way - 90.0)) / {meridian('radians(lat)')}) AS y0,
      lon + degrees({d(RADIUS)} * sin(radians(way + 90.0)) / ({normal('radians(lat)')} * cos(radians(lat)))) AS x1, lat + degrees({d(RADIUS)} * cos(radians(way + 90.0)) / {meridian('radians(lat)')}) AS y1 FROM lines1""",
    "jumpers": f"SELECT start_node_id, end_node_id, length, [id] AS segments FROM segments WHERE length <= {MIN_SEGMENT}",
    "gps": f"""SELECT k AS seq, 1704067200000 + user_id * 3600000 + k * 10000 + k // 29 * 400000 AS time_ms, user_id AS vehicle_id, CAST(x AS BIGINT) / {d(100000.0)} AS lon,
      {d(0.02)} + user_id % 25 * {d(0.01)} + (user_id * 13 % 13 - 6) * {d(0.00001)} AS lat
      FROM (SELECT user_id, row_number() OVER w AS k, sum(CASE WHEN event_id % 17 = 0 THEN 0 ELSE 60 + event_id * 37 % 180 END) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "gps_tiles": f"SELECT *, {tile_x('lon', 11)} AS x, {tile_y('lat', 11)} AS y FROM gps",
    "areas0": "SELECT DISTINCT x, y FROM gps_tiles",
    "gps_local": "SELECT *, time_ms + CAST(x AS BIGINT) % 3 * 3600000 AS local_ms FROM gps_tiles",
    "busy": "SELECT x, y FROM gps_tiles GROUP BY x, y HAVING count(DISTINCT vehicle_id) >= 10",
    "pairs": "SELECT vehicle_id, seq, t0, t1, x0, y0, x1, y1 FROM (SELECT vehicle_id, seq, lag(local_ms) OVER w AS t0, local_ms AS t1, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0, lon AS x1, lat AS y1, (x, y) AS tile1, lag((x, y)) OVER w AS tile0 FROM gps_local WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq)) WHERE tile0 IN (SELECT (x, y) FROM busy) AND tile1 IN (SELECT (x, y) FROM busy) AND t0 IS NOT NULL AND t1 - t0 BETWEEN 0 AND 200000 AND NOT (x0 = x1 AND y0 = y1)",
    "met": """SELECT p.vehicle_id, p.seq, p.t0, p.t1, p.x0 AS px0, p.y0 AS py0, p.x1 AS px1, p.y1 AS py1, l.* FROM pairs p JOIN lines l
      ON least(l.x0, l.x1) <= greatest(p.x0, p.x1) AND greatest(l.x0, l.x1) >= least(p.x0, p.x1) AND least(l.y0, l.y1) <= greatest(p.y0, p.y1) AND greatest(l.y0, l.y1) >= least(p.y0, p.y1)""",
    "met1": "SELECT *, (px1 - px0) * (y1 - y0) - (py1 - py0) * (x1 - x0) AS rxs FROM met",
    "met2": "SELECT *, CASE WHEN rxs <> 0 THEN ((x0 - px0) * (y1 - y0) - (y0 - py0) * (x1 - x0)) / rxs END AS f, CASE WHEN rxs <> 0 THEN ((px0 - x0) * (py1 - py0) - (py0 - y0) * (px1 - px0)) / ((x1 - x0) * (py1 - py0) - (y1 - y0) * (px1 - px0)) END AS g FROM met1",
    "crossed": f"""SELECT vehicle_id, seq, CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY seq, time_ms, tile_x, tile_y, id) AS INT) AS n, time_ms, segment_id, tripline_index, id AS tripline_id, dist FROM (
      SELECT *, CAST(trunc((t1 - t0) * f + t0) AS BIGINT) AS time_ms, greatest({tile_x('least(px0, px1)', 18)}, {tile_x('least(x0, x1)', 18)}) AS tile_x, greatest({tile_y('greatest(py0, py1)', 18)}, {tile_y('greatest(y0, y1)', 18)}) AS tile_y FROM met2 WHERE f BETWEEN 0 AND 1 AND g BETWEEN 0 AND 1)""",
    "ends": """SELECT * FROM (SELECT *, max(CASE WHEN tripline_index = 1 THEN n END) OVER (PARTITION BY vehicle_id, segment_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM crossed) WHERE tripline_index = 2 AND a IS NOT NULL""",
    "chain": """SELECT vehicle_id, min(n) AS n FROM ends GROUP BY vehicle_id
      UNION ALL SELECT ends.vehicle_id, min(ends.n) FROM chain JOIN ends ON ends.vehicle_id = chain.vehicle_id AND ends.a > chain.n GROUP BY ends.vehicle_id, chain.n""",
    "completed": """SELECT e.vehicle_id, e.segment_id, e.a AS n0, e.n AS n1, c.time_ms AS time0, e.time_ms AS time1, c.dist AS dist0, e.dist AS dist1
      FROM chain JOIN ends e ON e.vehicle_id = chain.vehicle_id AND e.n = chain.n JOIN crossed c ON c.vehicle_id = e.vehicle_id AND c.n = e.a""",
    "main": "SELECT vehicle_id, n1, segment_id, time0 AS time_ms, abs(dist1 - dist0) / ((time1 - time0) // 1000) AS speed FROM completed WHERE (time1 - time0) // 1000 > 0 AND abs(dist1 - dist0) / ((time1 - time0) // 1000) <= 31.0",
    "jumped": f"""SELECT vehicle_id, n1, unnest(j.segments) AS segment_id, time_ms, (j.length + {2 * MIN_SEGMENT}) / ((time_ms - last_time) // 1000) AS speed FROM (
      SELECT *, lag(segment_id) OVER w AS last_segment, lag(time_ms) OVER w AS last_time FROM main WINDOW w AS (PARTITION BY vehicle_id ORDER BY n1)) m
      JOIN segments a ON a.id = last_segment JOIN segments b ON b.id = m.segment_id JOIN jumpers j ON j.start_node_id = a.end_node_id AND j.end_node_id = b.start_node_id
      WHERE a.end_node_id <> b.start_node_id AND (time_ms - last_time) // 1000 > 0 AND (j.length + {2 * MIN_SEGMENT}) / ((time_ms - last_time) // 1000) <= 31.0""",
    "samples": "SELECT vehicle_id, segment_id, time_ms, speed, false AS by_jumper FROM main UNION ALL SELECT vehicle_id, segment_id, time_ms, speed, true FROM jumped",
    "gps_hist": f"SELECT segment_id, {week('time_ms')} AS week, {hour('time_ms')} AS hour, {speed_bin('speed')} AS speed_bin, count(*) AS n FROM samples GROUP BY ALL",
    "zones": "SELECT * FROM (VALUES ('A', 1, -0.01, 0.06, 0), ('B', 2, 0.05, 0.12, 3600000), ('C', 3, 0.11, 0.2, 7200000)) t(tzid, ordinal, x0, x1, raw_offset_ms)",
    "places": f"SELECT n_nationkey % 10 * {d(0.01)} AS lon, {d(0.02)} + CAST(n_nationkey AS BIGINT) * {d(0.01)} AS lat, 'region ' || n_regionkey AS country, n_name AS city, CAST(n_nationkey AS BIGINT) * 7919 % 1000 AS population FROM nation",
    "t_towns": "SELECT CAST(s_suppkey AS BIGINT) AS s, CAST(s_suppkey AS BIGINT) % 100 * 2000 AS tx, CAST(s_suppkey AS BIGINT) // 100 * 2000 + 100000 AS ty FROM supplier",
    "t_nodes": f"SELECT s * 100 + k AS node_id, (tx + x) / {d(100000.0)} AS lon, (ty + y) / {d(100000.0)} AS lat FROM t_towns, (VALUES {', '.join(f'({k}, {x}, {y})' for k, (x, y) in TOWN_NODES.items())}) v(k, x, y)",
    "t_ways0": f"""SELECT s, j, s * 20 + j AS way_id, list_transform(ks, lambda k: s * 100 + k) AS nodes,
      CASE WHEN j = 0 THEN [{", ".join(repr(h) for h in TOWN_STREETS)}][s % 6 + 1] WHEN j IN (3, 8) THEN 'service' WHEN j = 7 THEN 'tertiary' WHEN j = 9 THEN 'primary' WHEN j < 10 THEN 'residential' END AS highway FROM t_towns, (VALUES {', '.join(f'({j}, {ks})' for j, ks in TOWN_WAYS.items())}) v(j, ks)""",
    "t_ways": f"SELECT way_id, nodes, {road_type('highway')} AS street_type, (j = 0 AND s % 4 = 0) OR (j = 3 AND s % 3 = 0) OR highway = 'motorway' OR j = 7 AS oneway FROM t_ways0 WHERE highway IS NOT NULL",
    "t_places": "SELECT way_id, street_type, oneway, len(nodes) AS size, unnest(nodes) AS node_id, generate_subscripts(nodes, 1) AS pos FROM t_ways",
    "t_uses": "SELECT node_id, count(*) AS uses FROM t_places GROUP BY 1 HAVING count(*) >= 2",
    "t_line": "SELECT p.*, n.lon, n.lat, p.pos > 1 AND (u.uses IS NOT NULL OR p.pos = p.size) AS cut FROM t_places p LEFT JOIN t_nodes n USING (node_id) LEFT JOIN t_uses u USING (node_id) QUALIFY count(*) FILTER (n.lon IS NULL) OVER (PARTITION BY way_id) = 0",
    "t_cut": "SELECT *, CAST(coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS piece FROM t_line",
    "t_pts": "SELECT way_id, street_type, oneway, piece, pos, node_id, lon, lat FROM t_cut UNION ALL SELECT way_id, street_type, oneway, piece + 1, pos, node_id, lon, lat FROM t_cut WHERE cut AND pos < size",
    "t_legs": "SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM t_pts WINDOW w AS (PARTITION BY way_id, piece ORDER BY pos)",
    "t_pieces": f"SELECT way_id, street_type, oneway, piece, arg_min(node_id, pos) AS a, arg_max(node_id, pos) AS b, sum(CASE WHEN lon0 IS NOT NULL THEN {distance('lon0', 'lat0', 'lon', 'lat')} ELSE 0 END) AS length, list({{'lon': lon, 'lat': lat}} ORDER BY pos) AS coords FROM t_legs GROUP BY ALL HAVING count(*) >= 2",
    "t_directed": "SELECT way_id, street_type, oneway, piece, 0 AS reverse, a AS start_node_id, b AS end_node_id, length, coords FROM t_pieces UNION ALL SELECT way_id, street_type, oneway, piece, 1, b, a, length, list_reverse(coords) FROM t_pieces WHERE NOT oneway",
    "t_segments": "SELECT 999999999 + row_number() OVER (ORDER BY way_id, start_node_id, end_node_id) AS id, * FROM (SELECT * FROM t_directed QUALIFY row_number() OVER (PARTITION BY way_id, start_node_id, end_node_id ORDER BY reverse, piece) = 1)",
    "t_paths": f"""SELECT start_node_id, end_node_id, length, [id] AS segments, [start_node_id, end_node_id] AS seen FROM t_segments WHERE length <= {MIN_SEGMENT} AND start_node_id <> end_node_id
      UNION ALL SELECT p.start_node_id, e.end_node_id, p.length + e.length, list_append(p.segments, e.id), list_append(p.seen, e.end_node_id) FROM t_paths p JOIN t_segments e ON e.start_node_id = p.end_node_id AND e.length <= {MIN_SEGMENT} WHERE NOT list_contains(p.seen, e.end_node_id)""",
    "t_jumpers": "SELECT start_node_id, end_node_id, length, segments FROM t_paths QUALIFY row_number() OVER (PARTITION BY start_node_id, end_node_id ORDER BY round(length, 6), segments) = 1",
    "t_sides": "SELECT id, length, unnest(range(1, len(coords))) AS leg, coords FROM t_segments",
    "t_sides1": "SELECT id, length, leg, coords[leg].lon AS ax, coords[leg].lat AS ay, coords[leg + 1].lon AS bx, coords[leg + 1].lat AS by_ FROM t_sides",
    "t_sides2": "SELECT *, sum(h) OVER (PARTITION BY id) AS total, sum(h) OVER (PARTITION BY id ORDER BY leg) - h AS before FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS h FROM t_sides1)",
    "t_lines0": f"SELECT *, dist / length * total - before AS along FROM (SELECT *, CASE WHEN k = 1 THEN {d(MARGIN)} ELSE length - {d(MARGIN)} END AS dist FROM t_sides2, range(1, 3) t(k) WHERE length > {MIN_SEGMENT}) QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY CASE WHEN h > 0 AND dist / length * total <= before + h + 1e-12 THEN leg ELSE 1000000 END) = 1",
    "t_lines1": f"SELECT *, ax + along / h * (bx - ax) AS lon, ay + along / h * (by_ - ay) AS lat, degrees(atan2({east('ax', 'ay', 'bx', 'by_')}, {north('ay', 'by_')})) AS way FROM t_lines0",
    "t_lines": f"""SELECT 999999999 + (id - 1000000000) * 2 + k AS id, id AS segment_id, CAST(k AS INT) AS tripline_index, dist,
      lon + degrees({d(RADIUS)} * sin(radians(way - 90.0)) / ({normal('radians(lat)')} * cos(radians(lat)))) AS x0, lat + degrees({d(RADIUS)} * cos(radians(way - 90.0)) / {meridian('radians(lat)')}) AS y0,
      lon + degrees({d(RADIUS)} * sin(radians(way + 90.0)) / ({normal('radians(lat)')} * cos(radians(lat)))) AS x1, lat + degrees({d(RADIUS)} * cos(radians(way + 90.0)) / {meridian('radians(lat)')}) AS y1 FROM t_lines1""",
    "envelopes": f"SELECT q AS envelope_id, q * {d(0.01)} AS min_lon, q * {d(0.01)} + 0.02 AS max_lon, {d(0.02)} + q * {d(0.01)} AS min_lat, {d(0.05)} + q * {d(0.01)} AS max_lat FROM range(0, 10) t(q)",
}

NEEDS = {
    "hist": ["ev"], "hist_li": ["li"], "edges": ["nodes"], "directed": ["edges"], "segments": ["directed"], "lines0": ["segments"], "lines1": ["lines0"], "lines": ["lines1"], "jumpers": ["segments"],
    "gps_tiles": ["gps"], "areas0": ["gps_tiles"], "gps_local": ["gps_tiles"], "busy": ["gps_tiles"], "pairs": ["gps_local", "busy"], "met": ["pairs", "lines"], "met1": ["met"], "met2": ["met1"], "crossed": ["met2"], "ends": ["crossed"], "chain": ["ends"],
    "t_nodes": ["t_towns"], "t_ways0": ["t_towns"], "t_ways": ["t_ways0"], "t_places": ["t_ways"], "t_uses": ["t_places"], "t_line": ["t_nodes", "t_uses"], "t_cut": ["t_line"], "t_pts": ["t_cut"], "t_legs": ["t_pts"], "t_pieces": ["t_legs"],
    "t_directed": ["t_pieces"], "t_segments": ["t_directed"], "t_paths": ["t_segments"], "t_jumpers": ["t_paths"], "t_sides": ["t_segments"], "t_sides1": ["t_sides"], "t_sides2": ["t_sides1"], "t_lines0": ["t_sides2"], "t_lines1": ["t_lines0"], "t_lines": ["t_lines1"],
    "completed": ["chain"], "main": ["completed"], "jumped": ["main", "jumpers"], "samples": ["jumped"], "gps_hist": ["samples"],
}


#: The blocks from fixes to samples over the town map: the same ones, of other fixes, lines, segments and jumpers.
_OF_FIXES = ["gps_tiles", "areas0", "gps_local", "busy", "pairs", "met", "met1", "met2", "crossed", "ends", "chain", "completed", "main", "jumped", "samples"]
_RENAMED = {n: f"v_{n}" for n in ["gps", *_OF_FIXES]} | {n: f"t_{n}" for n in ("lines", "segments", "jumpers")}


def town_blocks() -> dict[str, str]:
    places = ", ".join(f"({v}, {k}, {TOWN_NODES[n][0]}, {TOWN_NODES[n][1]})" for v, drive in TOWN_DRIVES.items() for k, n in enumerate(drive, 1))
    fixes = f"SELECT CAST(k AS BIGINT) AS seq, 1704067200000 + s * 7000 + k * 25000 AS time_ms, s * 3 + v AS vehicle_id, (tx + x) / {d(100000.0)} AS lon, (ty + y) / {d(100000.0)} AS lat FROM t_towns, (VALUES {places}) f(v, k, x, y)"
    names = re.compile(r"(?<![.\w])(" + "|".join(_RENAMED) + r")(?!\w)")
    return {"v_gps": fixes} | {f"v_{n}": names.sub(lambda m: _RENAMED[m[1]], CTES[n]) for n in _OF_FIXES}


def oracle(body: str, *names: str, **more: str) -> str:
    """body after WITH clauses for the named blocks, what they need, and further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    blocks = [(n, CTES[n]) for n in order] + list(more.items())
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({sql})" for n, sql in blocks) + "\n" + body if blocks else body
