"""Stored tables, and readers of zones, places and tiles."""

import json

from pyspark.sql import functions as F

from pavemetric.operators import areas, hist, store, summary
from pavemetric.sources import adapters as ad
from pavemetric.sources import osm_pbf, reference

SF = "/root/testdata/sf0.001"


def test_store_from_map_to_statistics(spark, tmp_path):
    s = store.SpeedStore(spark, store.Settings(str(tmp_path / "store"), commit_id=7, cell_zoom=11, buckets=4))
    nodes, ways, fixes = ad.grid_nodes(spark, SF), ad.grid_ways(spark, SF), ad.gps_fixes(spark, SF)
    some = (F.col("way_id") < 12) | (F.col("way_id") >= 1000)
    s.load_map(nodes, ways.where(some))
    first = {(r.way_id, r.start_node_id, r.end_node_id): r.id for r in s.map.every("segments").collect()}
    s.load_map(nodes, ways)
    both = {(r.way_id, r.start_node_id, r.end_node_id): r.id for r in s.map.every("segments").collect()}
    # pieces that new streets cut are gone; the others keep their ids, and new ones go on after all that there were
    kept = set(first) & set(both)
    assert {k: both[k] for k in kept} == {k: first[k] for k in kept} and kept and set(first) - kept and len(both) > len(first)
    assert sorted(both[k] for k in set(both) - kept) == list(range(1_000_000_000 + len(first), 1_000_000_000 + len(first) + len(set(both) - kept)))
    areas = ad.fix_areas(fixes)
    s.load_fixes(fixes, areas, "a")
    once = sorted(map(tuple, s.histograms().collect()))
    s.load_fixes(fixes, areas, "a")
    assert sorted(map(tuple, s.histograms().collect())) == once and once
    s.load_fixes(fixes, areas, "b")
    assert s.histograms().agg(F.sum("n")).first()[0] == 2 * sum(r[4] for r in once)
    envelope = (0.0, 0.02, 0.03, 0.06)
    s.write_statistics(str(tmp_path / "tiles"), envelope, 99)
    back = s.read_statistics(str(tmp_path / "tiles")).collect()
    found = {(m.segment.way_id, m.segment.start_node_id, m.segment.end_node_id) for r in back for m in r.segments}
    inside = {r.id for r in s.segments_in(envelope).collect()}
    seen = {r.segment_id for r in s.histograms().select("segment_id").distinct().collect()}
    assert found == {k for k, i in both.items() if i in inside & seen} and 0 < len(found) < len(seen)
    assert {(r.header.osm_commit_id, r.header.creation_timestamp) for r in back} == {(7, 99)}
    log = {r.name: r for r in s.table_statistics().collect()}
    assert set(log) == {"nodes", "ways", "segments", "triplines", "jumpers", "loads", "weekly", "total"} and all(r.files and r.bytes and r.rows for r in log.values())


def test_off_map_traces(spark, tmp_path):
    s = store.SpeedStore(spark, store.Settings(str(tmp_path)))
    assert s.off_map_traces().count() == 0
    rows = spark.createDataFrame([(1, 2, [(0.0, 0.0), (0.1, 0.1)]), (3, None, [(5.0, 5.0), (5.1, 5.0)])], "start_node_id long, end_node_id long, coords array<struct<lon:double,lat:double>>")
    s.save_off_map_traces(rows)
    s.save_off_map_traces(rows)
    assert sorted(r.id for r in s.off_map_traces().collect()) == [1_000_000_000 + i for i in range(4)]
    assert {r.start_node_id for r in s.off_map_traces((4.9, 4.9, 5.2, 5.2)).collect()} == {3}


def test_type_statistics_round_trip(spark):
    stats = summary.type_statistics(ad.event_samples(spark, SF).where("street_type <> 2"))
    back = store.unpacked_types(store.packed_types(stats))
    key = lambda d: sorted((-1 if r.street_type is None else r.street_type, r.n, r.sum_kmh) for r in d.collect())
    assert key(back) == key(stats)


def test_zones_and_places(spark, tmp_path):
    square = lambda x: [[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]]
    lines = [
        {"type": "Feature", "properties": {"TZID": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(5.0), square(50.0)]}},
        {"type": "Feature", "properties": {"TZID": "A"}, "geometry": {"type": "Polygon", "coordinates": [*square(0.0), [[0.2, 0.2], [0.8, 0.2], [0.8, 0.8], [0.2, 0.8], [0.2, 0.2]]]}},
        {"type": "Feature", "properties": {"TZID": "uninhabited"}, "geometry": {"type": "Polygon", "coordinates": square(9.0)}},
        {"type": "Feature", "properties": {"sov0name": "C", "adm1name": "T", "pop_max": 12.0}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
    ]
    path = tmp_path / "f.json"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    zones = reference.zone_polygons(spark, str(path)).collect()
    assert [(r.tzid, r.ordinal, r.ring[0].lon, len(r.ring), len(r.holes)) for r in zones] == [("A", 1, 0.0, 5, 1), ("B", 2, 5.0, 5, 0)]
    inside = spark.createDataFrame([(1, 0.1, 0.9), (2, 0.5, 0.5), (3, 5.5, 0.5), (4, 30.0, 30.0), (5, None, 0.5), (6, 500.0, 0.5), (7, float("nan"), 0.5)], "point_id long, lon double, lat double")
    found = {r.point_id: r.tzid for r in areas.zones(inside, reference.zone_polygons(spark, str(path)).where("tzid = 'A'").withColumn("tzid", F.lit("A1")).unionByName(reference.zone_polygons(spark, str(path)))).collect()}
    # a point in two boxes is looked for in the polygons: in the hole it is near one, not within
    assert found == {1: "A", 2: None, 3: "B", 4: None, 5: None, 6: None, 7: None}
    assert [tuple(r) for r in reference.places(spark, str(path)).collect()] == [(1.5, 2.5, "C", "T", 12)]


def test_extracts_by_tile(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "11/1/2").parent.mkdir(parents=True)
    osm_pbf.write_pbf(f"{folder}/11/1/2.osm.pbf", [(1, 0.0, 0.0, {}), (2, 0.1, 0.0, {})], [(9, [1, 2], {"highway": "primary"})])
    osm_pbf.write_pbf(f"{folder}/other.pbf", [(2, 0.1, 0.0, {}), (3, 0.2, 0.0, {})], [(9, [1, 2], {"highway": "primary"})])
    asked = []

    def fetch(name):
        asked.append(name)
        return open(f"{folder}/other.pbf", "rb").read() if len(asked) == 1 else None

    nodes, ways, found = reference.load_tiles(spark, folder, [(1, 2), (1, 3), (1, 4), (7, 7)], {(7, 7)}, fetch)
    assert found == [(1, 2), (1, 3)] and sorted(r.node_id for r in nodes.collect()) == [1, 2, 3] and ways.count() == 1
    assert len(asked) == 2 and asked[0].count(",") == 3
    assert reference.load_tiles(spark, folder, [(1, 3)])[2] == [(1, 3)] and reference.load_tiles(spark, folder, [(5, 5)])[2] == []
