"""PBF, exchange messages, exports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from pavemetric.operators import hist, matching, network
from pavemetric.sources import adapters as ad
from pavemetric.sources import exchange, export, osm_pbf
from pavemetric.streaming import speed

SF = "/root/testdata/sf0.001"


def test_pbf(spark, tmp_path):
    nodes = [(i, round(i * 0.00123, 7), round(-i * 0.0007, 7), {"place": "town"} if i % 50 == 0 else {}) for i in range(1, 201)]
    ways = [(1000 + k, list(range(k + 1, k + 6)), {"highway": "residential", "name": f"straße {k}"}) for k in range(100)]
    path = str(tmp_path / "x.osm.pbf")
    osm_pbf.write_pbf(path, nodes, ways, block_rows=64)
    spark.dataSource.register(osm_pbf.OsmPbf)
    got = spark.read.format("osm_pbf").option("table", "nodes").load(path)
    assert got.rdd.getNumPartitions() == 6
    assert sorted((r.node_id, round(r.lon, 7), round(r.lat, 7), r.tags) for r in got.collect()) == nodes
    back = spark.read.format("osm_pbf").option("table", "ways").load(path)
    assert sorted((r.way_id, r.nodes, r.tags) for r in back.collect()) == ways
    assert network.street_segments(got, back).count() > 0


def test_damaged_pbf_fails(spark, tmp_path):
    path = tmp_path / "y.osm.pbf"
    osm_pbf.write_pbf(str(path), [(1, 0.0, 0.0, {})], [])
    data = bytearray(path.read_bytes())
    data[-4] ^= 255
    path.write_bytes(bytes(data))
    spark.dataSource.register(osm_pbf.OsmPbf)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("osm_pbf").load(str(path)).count()


def test_messages_round_trip():
    location = {"timestamp": 1_438_387_200_000, "lat": 1.5, "lon": -2.25, "heading": None, "speed": 3.5}
    row = {"source_id": -7, "messages": [{"vehicle_id": 1 << 60, "locations": [location, location | {"heading": 90}]}, {"vehicle_id": 2, "locations": []}]}
    assert exchange.decode("VehicleMessageEnvelope", exchange.encode("VehicleMessageEnvelope", row)) == row
    assert exchange.encode("VehicleLocation", {"timestamp": 300, "lat": 1.0, "lon": 0.0}).hex() == "08ac0211000000000000f03f190000000000000000"
    assert exchange.decode("BaselineStats", bytes.fromhex("1a080000803f00000040") + b"\x98\x06\x05")["hour_of_week_averages"] == [1.0, 2.0]


def test_exports(spark):
    items = spark.createDataFrame([(1, 5, [(0.0, 1.0), (2.0, 3.5)])], "id long, way_id long, coords array<struct<lon:double,lat:double>>")
    feature = json.loads(export.geojson(items, ["way_id"]).first().feature)
    assert feature == {"type": "Feature", "id": 1, "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.5]]}, "properties": {"way_id": 5}}
    assert export.well_known_text(items).first().wkt == "LINESTRING (0.0 1.0, 2.0 3.5)"


def test_quartiles(spark):
    h = spark.createDataFrame([(1, b, n) for b, n in ((10, 1), (20, 1), (30, 5), (40, 1))], "segment_id long, speed_bin int, n long")
    r = exchange.quartiles(h, ["segment_id"]).first()
    assert (r.bottom_quartile, r.top_quartile) == (20, 30)


def test_event_times_are_the_nearest_milliseconds(spark, tmp_path):
    """As DuckDB's epoch_ms: just under half a millisecond before an hour stays in the old one, from half on it is the next one's."""
    import duckdb

    micros = [1704070799999499, 1704070799999500, 1704070800000000, -500, -499, -1499, -1500, 0, None]
    rows = ", ".join(f"({i}, make_timestamp({'NULL' if m is None else m}::BIGINT), 1, 36.0)" for i, m in enumerate(micros))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, value)) TO '{tmp_path}/events.parquet'")
    want = [r[0] for r in duckdb.sql(f"SELECT epoch_ms(ts) FROM '{tmp_path}/events.parquet' ORDER BY event_id").fetchall()]
    got = [r.time_ms for r in ad.table(spark, str(tmp_path), "events").select("event_id", ad.millis("ts").alias("time_ms")).orderBy("event_id").collect()]
    assert got == want
    assert got[:2] == [1704070799999, 1704070800000]


def test_messages_are_coded_in_small_slices(spark, monkeypatch):
    """However many rows Spark hands over at once, a worker has a few of them as Python objects."""
    import pyarrow as pa

    rows = [{"source_id": i, "messages": [{"vehicle_id": i, "locations": [{"timestamp": k, "lat": 1.5, "lon": None, "heading": None, "speed": None} for k in range(40)]}]} for i in range(3000)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(list(exchange.arrow_type("VehicleMessageEnvelope"))))
    parts = list(exchange._sliced(batch))
    assert sum((p.to_pylist() for p in parts), []) == rows
    assert len(parts) > 8 and max(p.nbytes for p in parts) <= exchange.SLICE_BYTES
    assert [p.num_rows for p in exchange._sliced(batch.slice(0, 1))] == [1] and not list(exchange._sliced(batch.slice(0, 0)))
    df = spark.createDataFrame(rows, exchange.spark_type("VehicleMessageEnvelope"))
    back = exchange.decoded(exchange.encoded(df, "VehicleMessageEnvelope"), "VehicleMessageEnvelope")
    assert sorted((r.asDict(True) for r in back.collect()), key=lambda r: r["source_id"]) == rows
