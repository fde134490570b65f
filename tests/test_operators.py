"""Operators against plain versions on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from pavemetric.functions import tiles
from pavemetric.operators import areas, compare, hist, matching, network, summary, tables

CROSSED = "vehicle_id long, seq long, n int, time_ms long, segment_id long, tripline_index int, tripline_id long, dist double"


def plain_completions(rows):
    """The pending fold, crossing by crossing."""
    out = []
    for v in {r[0] for r in rows}:
        pending = {}
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: r[2]):
            if r[5] == 2 and r[4] in pending:
                first = pending[r[4]]
                out.append((v, r[4], first[2], r[2]))
                pending = {}
            elif r[5] == 1:
                pending[r[4]] = r
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_completions(spark, seed):
    rng = random.Random(seed)
    rows = [(v, 0, n, n * 1000, rng.randint(1, 5), rng.randint(1, 2), 0, 20.0) for v in range(8) for n in range(1, 120)]
    out = matching.completions(spark.createDataFrame(rows, CROSSED)).collect()
    assert sorted((r.vehicle_id, r.segment_id, r.n0, r.n1) for r in out) == plain_completions(rows)


@pytest.mark.parametrize(("order", "done"), [("a1 b1 a2 b2", [(1, 3)]), ("a2 a1 a2 a2", [(2, 3)]), ("a1 a1 a2", [(2, 3)]), ("a1 b1 b2 a2 a1 a2", [(2, 3), (5, 6)])])
def test_pending_cases(spark, order, done):
    rows = [(1, 0, n, n, ord(c[0]), int(c[1]), 0, 0.0) for n, c in enumerate(order.split(), 1)]
    assert sorted((r.n0, r.n1) for r in matching.completions(spark.createDataFrame(rows, CROSSED)).collect()) == done


def test_admissible(spark):
    cases = [1999, 3999, 4000, 999, -5000, 0]
    rows = [(1, n, 7, 1000, 1000 + ms, 20.0, 120.0) for n, ms in enumerate(cases)]
    df = spark.createDataFrame(rows, "vehicle_id long, n1 int, segment_id long, time0 long, time1 long, dist0 double, dist1 double")
    assert [(r.n1, r.speed, r.time_ms) for r in matching.admissible(df).collect()] == [(2, 25.0, 1000)]


def test_pairs(spark):
    fixes = [(1, 0), (2, 1000), (3, 1000), (4, 201_001), (5, 401_001), (6, 400_000), (7, 410_000)]
    rows = [(s, t, 1, s * 0.1, 0.0) for s, t in fixes] + [(1, 0, 2, 0.5, 0.5), (2, 10, 2, 0.5, 0.5), (3, 20, 2, 0.6, 0.5)]
    df = spark.createDataFrame(rows, "seq long, time_ms long, vehicle_id long, lon double, lat double")
    assert sorted((r.vehicle_id, r.seq) for r in matching.pairs(df).collect()) == [(1, 2), (1, 3), (1, 5), (1, 7), (2, 3)]
    assert sorted(r.seq for r in matching.pairs(df, "legacy").where("vehicle_id = 1").collect()) == [2, 3, 4, 5, 7]


def map_tables(spark):
    nodes = [(1, 0.0, 0.0), (2, 0.002, 0.0), (3, 0.002, 0.001), (4, 0.004, 0.001), (5, 0.0041, 0.001), (6, 0.0042, 0.001), (7, 0.002, -0.002)]
    ways = [(10, [1, 2, 3, 4], {"highway": "secondary"}), (11, [7, 2], {"highway": "motorway"}), (12, [4, 5, 6], {"highway": "residential", "oneway": "yes"}), (13, [5, 7], {"highway": "service"}), (14, [1, 99], {"highway": "primary"}), (15, [1, 7], {"building": "yes"}), (16, [3, 3], {"highway": "tertiary", "junction": "roundabout"})]
    n = spark.createDataFrame([(i, x, y, {}) for i, x, y in nodes], "node_id long, lon double, lat double, tags map<string,string>")
    return n, spark.createDataFrame(ways, "way_id long, nodes array<long>, tags map<string,string>")


def test_segments(spark):
    net = network.build(*map_tables(spark))
    rows = {(r.way_id, r.start_node_id, r.end_node_id): r for r in net.segments.collect()}
    # node 1 and 3 count as used twice: ways 14 and 16 are traffic ways too
    assert set(rows) == {(10, 1, 2), (10, 2, 1), (10, 2, 3), (10, 3, 2), (10, 3, 4), (10, 4, 3), (11, 7, 2), (12, 4, 5), (12, 5, 6), (13, 5, 7), (13, 7, 5), (16, 3, 3)}
    assert sorted(r.id for r in rows.values()) == list(range(1_000_000_000, 1_000_000_012))
    assert rows[11, 7, 2].oneway and rows[11, 7, 2].street_type == 1 and rows[13, 5, 7].street_type == 5
    assert [tuple(c) for c in rows[10, 3, 2].coords] == [tuple(c) for c in reversed(rows[10, 2, 3].coords)]
    assert rows[12, 4, 5].length == pytest.approx(11.13, abs=0.01)
    lines = net.triplines.collect()
    assert len(lines) == 2 * sum(r.length > 60 for r in rows.values())
    assert all(abs(r.dist - 20) < 1e-9 for r in lines if r.tripline_index == 1)


def test_jumpers(spark):
    chain = [(i, i, i + 1, 10.0 + i) for i in range(1, 6)] + [(20 + i, i + 1, i, 10.0 + i) for i in range(1, 6)] + [(40, 1, 4, 50.0), (41, 9, 9, 5.0), (42, 5, 9, 70.0)]
    seg = spark.createDataFrame(chain, "id long, start_node_id long, end_node_id long, length double")
    best = {}

    def walk(start, at, length, path, seen):
        for i, a, b, m in chain:
            if a == at and b not in seen and m <= 60 and len(path) < network.MAX_EDGES:
                item = (length + m, [*path, i])
                best[start, b] = min(best.get((start, b), item), item)
                walk(start, b, *item, {*seen, b})

    for n in range(1, 10):
        walk(n, n, 0.0, [], {n})
    out = {(r.start_node_id, r.end_node_id): (r.length, r.segments) for r in network.jumpers(seg).collect()}
    assert out == {k: (pytest.approx(v[0]), v[1]) for k, v in best.items()}


def test_jumpers_over_long_chains(spark):
    # twelve short edges, and two over the last three that are longer together
    chain = [(i, i, i + 1, 10.0 + i / 10) for i in range(1, 13)] + [(50, 10, 20, 18.0), (51, 20, 13, 18.0)]
    seg = spark.createDataFrame(chain, "id long, start_node_id long, end_node_id long, length double")
    out = {(r.start_node_id, r.end_node_id): (r.length, r.segments) for r in network.jumpers(seg).collect()}
    for a in range(1, 13):
        for b in range(a + 1, 14):
            assert out[a, b] == (pytest.approx(sum(10.0 + i / 10 for i in range(a, b))), list(range(a, b)))
    assert len(out) == 78 + 11


def test_jumpers_are_shortest_whatever_the_edges(spark):
    rng = random.Random(5)
    edges = [(i, rng.randrange(14), rng.randrange(14), rng.choice([1.0, 1.0, 2.0, 12.5, 59.0])) for i in range(30)]
    best = {}

    def walk(start, at, length, path, seen):
        for i, a, b, m in edges:
            if a == at and b not in seen:
                item = (length + m, [*path, i])
                best[start, b] = min(best.get((start, b), item), item)
                walk(start, b, *item, {*seen, b})

    for n in range(14):
        walk(n, n, 0.0, [], {n})
    out = {(r.start_node_id, r.end_node_id): (r.length, r.segments) for r in network.jumpers(spark.createDataFrame(edges, "id long, start_node_id long, end_node_id long, length double")).collect()}
    assert out == best and max(len(p) for _, p in best.values()) > 3


def test_long_pairs_meet_each_line_once(spark):
    lines = spark.createDataFrame([(i, i, 1, 20.0, 0.01 * i, -0.0001, 0.01 * i, 0.0001) for i in range(1, 60)], "id long, segment_id long, tripline_index int, dist double, x0 double, y0 double, x1 double, y1 double")
    moves = spark.createDataFrame([(1, 2, 0, 0.0, -0.00005, 100_000, 0.605, 0.00005), (2, 2, 0, 0.0099, -0.00005, 1000, 0.0101, 0.00005)], "vehicle_id long, seq long, t0 long, x0 double, y0 double, t1 long, x1 double, y1 double")
    out = matching.crossings(moves, lines).collect()
    assert sorted(r.tripline_id for r in out if r.vehicle_id == 1) == list(range(1, 60))
    assert [r.n for r in sorted(out, key=lambda r: r.time_ms) if r.vehicle_id == 1] == list(range(1, 60))
    assert [r.tripline_id for r in out if r.vehicle_id == 2] == [1]


def test_jumper_samples(spark):
    seg = spark.createDataFrame([(1, 10, 11), (2, 12, 13)], "id long, start_node_id long, end_node_id long")
    jump = spark.createDataFrame([(11, 12, 30.0, [7, 8])], "start_node_id long, end_node_id long, length double, segments array<long>")
    main = spark.createDataFrame([(1, 1, 1, 1000, 9.0), (1, 2, 2, 11_500, 9.0), (1, 3, 1, 11_900, 9.0), (2, 1, 1, 0, 1.0), (2, 2, 2, 2000, 1.0)], "vehicle_id long, n1 int, segment_id long, time_ms long, speed double")
    out = matching.jumper_samples(main, seg, jump).collect()
    assert sorted((r.vehicle_id, r.segment_id, r.time_ms, r.speed) for r in out) == [(1, 7, 11_500, 15.0), (1, 8, 11_500, 15.0)]
    assert matching.jumper_samples(main, seg, jump, "legacy").count() == 4


def plain_summary(hist_rows):
    n = sum(r[4] for r in hist_rows)
    speeds = [((r[3] - 0.5) / 3.6, r[4]) for r in hist_rows]
    mean = sum(v * k for v, k in speeds) / n
    return n, mean, (sum(k * (v - mean) ** 2 for v, k in speeds) / n) ** 0.5


def hist_rows(seed=1):
    rng = random.Random(seed)
    keys = {(s, w, h, b) for s in range(4) for w in (1, 2, 3) for h in rng.sample(range(168), 5) for b in rng.sample(range(120), 3)}
    return [(*k, rng.randint(1, 40)) for k in sorted(keys)]


SCHEMA = "segment_id long, week int, hour int, speed_bin int, n long"


def test_summaries(spark):
    rows = hist_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for r in summary.summary(df, ["segment_id"]).collect():
        n, mean, sd = plain_summary([x for x in rows if x[0] == r.segment_id])
        assert (r.n, r.mean, r.std_dev) == (n, pytest.approx(mean), pytest.approx(sd))
    some = summary.chosen(df, spark.createDataFrame([(1,), (2,)], "segment_id long"), [1, 3], [])
    want = plain_summary([x for x in rows if x[0] in (1, 2) and x[1] in (1, 3)])
    got = summary.summary(some, []).first()
    assert (got.n, got.mean, got.std_dev) == (want[0], pytest.approx(want[1]), pytest.approx(want[2]))
    assert summary.summary(df.where("false"), []).first().mean is None
    hours = summary.summary_with_hours(df)
    assert hours.where("hour is null").count() == 4 and hours.count() == 4 + len({(x[0], x[2]) for x in rows})


def test_merging_is_the_histogram_of_the_union(spark):
    a, b = (spark.createDataFrame(hist_rows(s), SCHEMA) for s in (1, 2))
    total = lambda d: sorted(map(tuple, d.collect()))
    assert total(hist.merge(a, b)) == total(hist.merge(b, a)) == total(hist.merge(hist.merge(a), hist.merge(b)))
    assert total(hist.unpacked(hist.packed(a)).select(*hist.KEYS, "n")) == total(a)


def test_comparison(spark):
    row = lambda n, m, s: spark.createDataFrame([(1, n, m, s)], "segment_id long, n long, mean double, std_dev double")
    one = lambda a, b, **k: compare.compare(row(*a), row(*b), ["segment_id"], **k).first()
    r = one((50, 10.0, 2.0), (60, 9.0, 3.0))
    assert r.t_crit == 1.690 and r.mean_size == 55 and r.t_stat == pytest.approx(1 / (4 / 50 + 9 / 60) ** 0.5) and r.significant
    back = one((60, 9.0, 3.0), (50, 10.0, 2.0))
    assert back.significant and back.t_stat == pytest.approx(-r.t_stat) and back.difference_pct == pytest.approx(-1 / 9)
    old = one((60, 9.0, 3.0), (50, 10.0, 2.0), mode="legacy")
    assert old.mean_size == 60 and old.combined_sd == pytest.approx((9 / 60 + 9 / 50) ** 0.5) and old.significant
    assert one((1, 9.0, 0.0), (1, 9.0, 0.0)).t_crit == 6.314 and not one((1, 9.0, 0.0), (1, 9.0, 0.0)).significant
    v1, v2 = 4 / 10, 9 / 12
    df = (v1 + v2) ** 2 / (v1**2 / 9 + v2**2 / 11)
    assert one((10, 9.0, 2.0), (12, 9.0, 3.0)).t_crit == compare.critical_values()[int(df + 0.5) - 1]


def test_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, k string")
    base = df([(1, "a"), (2, "b")])
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(tables.insert_absent(base, df([(3, "b"), (5, "c"), (4, "c")]), ["k"], ["id"])) == [(1, "a"), (2, "b"), (4, "c")]
    assert got(tables.upsert(base, df([(2, "z"), (3, "y")]))) == [(1, "a"), (2, "z"), (3, "y")]
    assert got(tables.delete(base, df([(2, "?")]), ["id"])) == [(1, "a")]
    ids = tables.with_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), ["k"], F.floor(F.col("k") / 64)).collect()
    assert all(r.id == 1_000_000_000 + r.k for r in ids)


def test_clusters(spark):
    box = lambda i, x, y: (i, x, y, 11, None, 0, 0, x * 1.0, y * 1.0, x + 1.0, y + 1.0)
    table = spark.createDataFrame([box(1, 0, 0), box(2, 1, 0), box(3, 5, 5), box(4, 9, 9), box(5, 6, 5), box(6, 20, 20)], "id long, x int, y int, z int, place_name string, place_pop long, zone_offset long, min_lon double, min_lat double, max_lon double, max_lat double")
    places = spark.createDataFrame([(9.5, 9.5, "C", "T", 5), (20.5, 20.5, "C", "T", 9), (20.6, 20.5, "C", "U", 0)], "lon double, lat double, country string, city string, population long")
    out = {r.area_id: r.cluster_id for r in areas.clusters(table, places).collect()}
    # areas 4 and 6 share a name, and their box then reaches over area 3's cluster, but not over area 1's
    assert out[1] == out[2] == 1 and out[3] == out[5] == 3 and out[4] == out[6] == 4
    names = {r.cluster_id: r.name for r in areas.cluster_table(table, areas.clusters(table, places), places).collect()}
    assert names == {1: None, 3: None, 4: "C -- T"}


def test_a_row_of_areas_is_one_cluster(spark):
    rows = [(i, i, 0, 11, None, 0, 0, i * 1.0, 0.0, i + 1.0, 1.0) for i in range(1, 61)] + [(100, 99, 9, 11, None, 0, 0, 99.0, 9.0, 100.0, 10.0)]
    table = spark.createDataFrame(rows, "id long, x int, y int, z int, place_name string, place_pop long, zone_offset long, min_lon double, min_lat double, max_lon double, max_lat double")
    places = spark.createDataFrame([], "lon double, lat double, country string, city string, population long")
    assert {r.area_id: r.cluster_id for r in areas.clusters(table, places).collect()} == {**{i: 1 for i in range(1, 61)}, 100: 100}


def test_a_tile_with_nine_vehicles_yields_nothing(spark):
    net = network.build(*map_tables(spark))
    fix = lambda v, s, x: (s, 1_700_000_000_000 + s * 20_000, v, x, 0.0)
    for vehicles in (9, 10):
        rows = [fix(v, s, x) for v in range(vehicles) for s, x in enumerate((-0.0001, 0.0003, 0.0012, 0.0021))]
        fixes = spark.createDataFrame(rows, "seq long, time_ms long, vehicle_id long, lon double, lat double").withColumn("convert_to_local", F.lit(False))
        tiles_xy = matching.gated(fixes).select("x", "y").distinct().withColumn("zone_offset", F.lit(0))
        out = matching.speed_samples(fixes, tiles_xy, net.segments, net.triplines, net.jumpers)
        assert out.count() == (0 if vehicles < 10 else vehicles)
        assert matching.speed_samples(fixes, tiles_xy, net.segments, net.triplines, net.jumpers, min_vehicles=1).count() == vehicles


def test_pairs_by_time(spark):
    rows = [(1, 3000, 1, 0.3, 0.0), (2, 1000, 1, 0.1, 0.0), (3, 2000, 1, 0.2, 0.0)]
    df = spark.createDataFrame(rows, "seq long, time_ms long, vehicle_id long, lon double, lat double")
    assert [(r.t0, r.t1) for r in matching.pairs(df, by="time_ms").orderBy("t0").collect()] == [(1000, 2000), (2000, 3000)]
    assert [(r.t0, r.t1) for r in matching.pairs(df).collect()] == [(1000, 2000)]


def test_ids_continue(spark):
    assert tables.next_id(None) == tables.next_id(spark.createDataFrame([], "id long")) == tables.FIRST_ID
    once = tables.with_ids(spark.range(10).select(F.col("id").alias("k")), ["k"], F.lit(0))
    again = tables.with_ids(spark.range(5).select(F.col("id").alias("k")), ["k"], F.lit(0), first=tables.next_id(once))
    assert sorted(r.id for r in once.unionByName(again).collect()) == list(range(tables.FIRST_ID, tables.FIRST_ID + 15))


def test_geometries_that_are_no_lines(spark):
    rows = [(1, [(0.0, 1.0), (1.0, 1.0)]), (2, [(0.0, 1.0)]), (3, None), (4, [(0.0, None), (1.0, 1.0)]), (5, [(float("nan"), 0.0), (1.0, 1.0)])]
    out = tables.valid_lines(spark.createDataFrame(rows, "id long, coords array<struct<lon:double,lat:double>>")).collect()
    assert {r.id: len(r.coords) for r in out} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0}


def test_fixes_that_cannot_be_used_are_lost_alone(spark):
    net = network.build(*map_tables(spark))
    t = 1_700_000_000_000
    good = [(s * 10, t + s * 20_000, 1, x, 0.0) for s, x in enumerate((-0.0001, 0.0003, 0.0012, 0.0021))]
    nan, inf = float("nan"), float("inf")
    bad = [(None, 0.0), (0.0, None), (nan, 0.0), (0.0, nan), (inf, 0.0), (0.0, -inf), (0.0, 90.0), (0.0, 91.0), (0.0, -90.0), (1e9, 0.0), (-1e300, 0.0), (180.0, 0.0), (0.0, 85.06)]
    rows = good + [(k + 1 + 10 * (k % 3), t + k * 1000, 1, x, y) for k, (x, y) in enumerate(bad)] + [(5, None, 1, 0.0, 0.0), (6, t, None, 0.0, 0.0)]
    make = lambda r: spark.createDataFrame(r, "seq long, time_ms long, vehicle_id long, lon double, lat double").withColumn("convert_to_local", F.lit(False))
    areas_xy = matching.gated(make(good)).select("x", "y").distinct().withColumn("zone_offset", F.lit(0))
    samples = lambda r: sorted(map(tuple, matching.speed_samples(make(r), areas_xy, net.segments, net.triplines, net.jumpers, min_vehicles=1).collect()))
    assert samples(rows) == samples(good) and samples(good)
    counts = {r.fault: r.fixes for r in matching.fix_faults(make(rows)).collect()}
    assert counts == {None: 4, "no place": 6, "off the map": 7, "no time": 1, "no vehicle": 1}
    assert matching.tile_vehicles(make(rows[4:17])).count() == 0
    # null, not a number, infinite, 1e9 and -1e300; null, not a number, infinite, 91 and the south pole
    nulls = make(rows).select(tiles.tile_x(F.col("lon"), 11).alias("x"), tiles.tile_y(F.col("lat"), 11).alias("y"))
    assert nulls.where("x is null").count() == 5 and nulls.where("y is null").count() == 5


def test_busy_tiles(spark):
    rows = [(1, 0, v, 0.01, 0.02) for v in range(10)] + [(1, 0, v, 5.0, 5.0) for v in range(9)]
    df = spark.createDataFrame(rows, "seq long, time_ms long, vehicle_id long, lon double, lat double")
    assert matching.in_busy_tiles(df).count() == 10


def test_zones_by_tier(spark):
    sq = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    polygons = spark.createDataFrame([("A", 1, sq(0.0, 0.0, 2.0)), ("B", 2, sq(1.0, 0.0, 2.0)), ("B", 3, sq(8.0, 8.0, 1.0))], "tzid string, ordinal int, ring array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 2.5, 0.5), (4, 5.0, 5.0), (5, -0.2, 1.0), (6, -0.3, 1.0), (7, 9.2, 8.5)], "point_id long, lon double, lat double")
    assert {r.point_id: r.tzid for r in areas.zones(points, polygons).collect()} == {1: "A", 2: "A", 3: "B", 4: "B", 5: "A", 6: None, 7: "B"}


def test_joins_of_maps_are_dealt_by_key(spark):
    """Exploded rows look as few as those they come from; sides that grow with the map must not pass the driver for that."""
    from pavemetric.plans import queries as core

    sf = "/root/testdata/sf0.001"
    pieces = network.pieces(network.traffic_ways(core.ad.town_ways(spark, sf)), core.ad.town_nodes(spark, sf))
    moves = matching.pairs(core.ad.town_fixes(spark, sf))
    seg = core.town(spark, sf).segments
    met = matching.candidates(moves, network.triplines(seg))
    chained = matching.jumper_samples(spark.createDataFrame([], "vehicle_id long, n1 long, segment_id long, time_ms long, speed double"), seg, network.jumpers(seg))
    for df in (pieces, met, chained):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
