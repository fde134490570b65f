"""The stream against the batch: any order within the delay, restarts, the gate, eviction, late fixes."""

import random

import pytest
from pyspark.sql import functions as F

from pavemetric.operators import hist, hist_store, matching, network
from pavemetric.sources import adapters as ad
from pavemetric.streaming import speed, vehicles

SF = "/root/testdata/sf0.001"
FIX = "seq long, time_ms long, vehicle_id long, lon double, lat double, convert_to_local boolean"
T0 = 1_700_000_000_000


@pytest.fixture(scope="module")
def street(spark, tmp_path_factory):
    """One east-west street of long and short pieces, its lines stored for the stream."""
    nodes = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate((0.0, 0.002, 0.004, 0.0043, 0.0063, 0.0083))], "node_id long, lon double, lat double")
    cross = [(10 + i, [i, 100 + i]) for i in range(6)]
    more = spark.createDataFrame([(100 + i, x, 0.001) for i, x in enumerate((0.0, 0.002, 0.004, 0.0043, 0.0063, 0.0083))], "node_id long, lon double, lat double")
    ways = spark.createDataFrame([(1, [0, 1, 2, 3, 4, 5], {"highway": "primary"})] + [(w, ns, {"highway": "primary"}) for w, ns in cross], "way_id long, nodes array<long>, tags map<string,string>")
    net = network.build(nodes.unionByName(more), ways)
    lines = str(tmp_path_factory.mktemp("lines") / "l")
    speed.write_lines(net, lines)
    return net, lines, net.jumpers.cache()


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def drive(vehicle, start, every=10_000, steps=22, bad=0):
    """Fixes along the street and back, in time; some standing still."""
    rng = random.Random(vehicle)
    out, x = [], -0.0005
    for s in range(steps):
        x += rng.choice([0.0, 0.0004, 0.0007, 0.0009]) * (1 if s < steps * 2 // 3 else -1)
        out.append((s, start + s * every, vehicle, x, rng.uniform(-0.00002, 0.00002), False))
    return out


def rounded(df):
    return sorted((r.vehicle_id, r.segment_id, r.time_ms, round(r.speed, 6), r.by_jumper) for r in df.collect())


def areas_of(spark, rows):
    return ad.fix_areas(spark.createDataFrame(rows, FIX)).withColumn("zone_offset", F.lit(0).cast("long")).cache()


def run(spark, folder, batches, street, rows, restarts=False, **options):
    """Samples of a stream of files, one micro-batch each; restarts: stopped and started again after each. Late rows counted."""
    net, lines, jumpers = street
    areas, late = areas_of(spark, rows), 0
    for k, batch in enumerate(batches, 1):
        spark.createDataFrame(batch, FIX).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if restarts or k == len(batches):
            stream = speed.speed_stream(speed.read_fixes(spark, f"{folder}/in"), areas, jumpers, lines, **options)
            query = speed.write_samples(stream, f"{folder}/out", f"{folder}/check")
            query.awaitTermination(180)
            late += vehicles.late_rows(query)
    return spark.read.parquet(f"{folder}/out"), late


def flush(after):
    """A fix of another vehicle, far from the street, that lets the watermark pass all others."""
    return [(0, after, 999, 0.0001, 0.0, False)]


def batch_samples(spark, street, rows, min_vehicles):
    net = street[0]
    return rounded(matching.speed_samples(spark.createDataFrame(rows, FIX), areas_of(spark, rows), net.segments, net.triplines, net.jumpers, min_vehicles=min_vehicles))


def test_any_order_within_the_delay_and_restarts(spark, tmp_path, street):
    rows = [f for v in range(4) for f in drive(v, T0 + v * 3000)]
    bad = [(1, T0, 1, float("nan"), 0.0, False), (2, T0, 2, 1e9, 0.0, False), (3, None, 2, 0.0, 0.0, False), (4, T0, None, 0.0, 0.0, False)]
    want = batch_samples(spark, street, rows, 1)
    assert any(r[4] for r in want) and len(want) > 10
    rng = random.Random(1)
    # each fix up to a minute out of order
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 55_000))
    assert late != sorted(rows, key=lambda r: r[1])
    third = len(late) // 3
    out, late_rows = run(spark, str(tmp_path), [late[:third] + bad, late[third : 2 * third], late[2 * third :], flush(T0 + 10_000_000), flush(T0 + 10_200_000)], street, rows, restarts=True, min_vehicles=None, delay="1 minute", idle_ms=None)
    assert rounded(out) == want and late_rows == 0


def test_late_fixes_are_counted(spark, tmp_path, street):
    rows = drive(1, T0)
    half = len(rows) // 2
    late = [(90, T0 + 1000, 2, 0.0, 0.0, False), (91, T0 + 2000, 2, 0.001, 0.0, False)]
    out, counts = run(spark, str(tmp_path), [rows[:half], flush(T0 + 3_600_000), rows[half:] + late, flush(T0 + 3_900_000)], street, rows, restarts=True, min_vehicles=None, delay="10 seconds", idle_ms=None)
    assert counts == len(rows) - half + 2
    assert rounded(out) == batch_samples(spark, street, rows[:half], 1)


@pytest.mark.parametrize("many", [9, 10])
def test_the_tenth_vehicle_opens_a_tile(spark, tmp_path, street, many):
    rows = [f for v in range(many) for f in drive(v, T0 + v * 20_000)]
    rows.sort(key=lambda r: r[1])
    half = len(rows) // 2
    # the last vehicle comes when the first ones are far ahead; they have waited
    out, _ = run(spark, str(tmp_path), [rows[:half], rows[half:], [(0, T0 + 10_000_000, 999, 1.0, 1.0, False)], [(1, T0 + 10_200_000, 999, 1.1, 1.0, False)]], street, [*rows, (0, T0, 999, 1.0, 1.0, False), (0, T0, 999, 1.1, 1.0, False)], hold_ms=3_600_000, idle_ms=None)
    want = batch_samples(spark, street, rows, 10)
    assert bool(want) == (many == 10) and rounded(out) == want


def test_a_tile_closes_when_vehicles_leave(spark, tmp_path, street):
    # ten vehicles, of which nine stop long before the tenth goes on alone
    rows = [f for v in range(9) for f in drive(v, T0)] + drive(9, T0) + [(50 + s, T0 + 3_600_000 + r[1] - T0, 9, *r[3:]) for s, r in enumerate(drive(9, T0))]
    rows.sort(key=lambda r: r[1])
    far = [(0, T0 + 20_000_000, 999, 1.0, 1.0, False)]
    out, _ = run(spark, str(tmp_path), [rows, far, [(1, T0 + 20_600_000, 999, 1.0, 1.0, False)]], street, [*rows, *far], hold_ms=60_000, idle_ms=300_000)
    want = batch_samples(spark, street, [r for r in rows if r[1] < T0 + 1_000_000], 10)
    assert rounded(out) == want and any(r[0] == 9 for r in want)


def test_a_vehicle_is_forgotten_after_its_time(spark, tmp_path, street):
    lines = {(r.segment_id, r.tripline_index): (r.x0 + r.x1) / 2 for r in street[0].triplines.where("abs(y0) < 0.0005").collect()}
    first = min(lines.items(), key=lambda kv: kv[1])[1]
    east = sorted(x for x in lines.values() if x >= first)
    # over the first line of a segment, a pause, then over its second line
    at = lambda s, ms, x: (s, T0 + ms, 1, x, 0.0, False)
    rows = [at(0, 0, east[0] - 0.0003), at(1, 10_000, east[0] + 0.0003), at(2, 10_000 + 150_000, east[0] + 0.0004), at(3, 10_000 + 170_000, 0.0019)]
    kept, _ = run(spark, str(tmp_path / "kept"), [rows[:2], flush(T0 + 100_000), rows[2:], flush(T0 + 5_000_000), flush(T0 + 5_400_000)], street, rows, restarts=True, min_vehicles=None, delay="0 seconds", idle_ms=200_000)
    gone, _ = run(spark, str(tmp_path / "gone"), [rows[:2], flush(T0 + 100_000), rows[2:], flush(T0 + 5_000_000), flush(T0 + 5_400_000)], street, rows, restarts=True, min_vehicles=None, delay="0 seconds", idle_ms=60_000)
    assert {r.vehicle_id for r in kept.collect()} == {1} and gone.where("vehicle_id = 1").count() == 0


def test_the_whole_table_as_a_stream(spark, tmp_path):
    fixes, net = ad.gps_fixes(spark, SF), network.build(ad.grid_nodes(spark, SF), ad.grid_ways(spark, SF))
    areas = ad.fix_areas(fixes).cache()
    batch = matching.speed_samples(fixes, areas, net.segments, net.triplines, net.jumpers)
    want = rounded(batch)
    assert any(r[4] for r in want) and not all(r[4] for r in want)
    lines, source = str(tmp_path / "lines"), str(tmp_path / "fixes")
    speed.write_lines(net, lines)
    jumpers = net.jumpers.cache()
    for part in range(2):
        fixes.where(F.pmod(F.hash("vehicle_id", "seq"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(source)
    far = spark.createDataFrame([(10**6 + k, T0 + 10**12 + k * 10**10, 0, 0.0, 0.02, False) for k in range(2)], FIX)
    for k in range(2):
        far.where(F.col("seq") == 10**6 + k).coalesce(1).write.mode("append").parquet(source)
    stream = speed.speed_stream(speed.read_fixes(spark, source), areas, jumpers, lines, delay="400 days", hold_ms=400 * 86_400_000, idle_ms=None)
    query = speed.write_samples(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(240)
    assert rounded(spark.read.parquet(str(tmp_path / "out"))) == want
    samples = spark.readStream.schema(spark.read.parquet(str(tmp_path / "out")).schema).parquet(str(tmp_path / "out"))
    store = hist_store.HistStore(spark, str(tmp_path / "hist"), 4)
    speed.write_histograms(samples, store, "samples", str(tmp_path / "check2")).awaitTermination(240)
    assert sorted(map(tuple, store.histograms().collect())) == sorted(map(tuple, hist.histogram(batch).collect()))


def test_messages_as_a_stream(spark, tmp_path):
    from pavemetric.sources import exchange, message_stream

    rng = random.Random(6)
    vehicles_of = lambda k: [{"vehicle_id": v, "locations": [{"timestamp": T0 + s, "lat": rng.random(), "lon": rng.random()} for s in range(rng.randint(0, 4))]} for v in range(k)]
    good = [{"source_id": i, "messages": vehicles_of(rng.randint(0, 3))} for i in range(12)]
    bodies = [exchange.encode("VehicleMessageEnvelope", e) for e in good]
    delimited = lambda bs: b"".join(exchange.varint_of(len(b)) + b for b in bs)
    folder = tmp_path / "in"
    folder.mkdir()
    # a message whose inner size runs beyond it, and one of a wire type that doesn't exist, between good ones; a file cut off
    (folder / "a.pb").write_bytes(delimited([*bodies[:4], b"\x12\x04\x08\x01\x12", bodies[4], b"\x0b", b"\x12\x01\x08"]))
    (folder / "b.pb").write_bytes(delimited(bodies[5:9]) + exchange.varint_of(50) + b"xyz")
    (folder / "c.pb").write_bytes(b"")
    (folder / "notes.txt").write_bytes(b"no messages")
    want = sorted((m["vehicle_id"], p["timestamp"], p["lon"], p["lat"]) for e in good[:9] for m in e["messages"] for p in m["locations"])
    files = spark.read.format("binaryFile").load(str(folder / "*.pb"))
    rows = message_stream.fixes_of_files(files, rows=3)
    key = lambda df: sorted((r.vehicle_id, r.time_ms, r.lon, r.lat) for r in df.collect())
    assert key(message_stream.fixes_of(rows)) == want
    assert sorted((r.file.rsplit("/", 1)[1], r.fault) for r in message_stream.faults_of(rows).collect()) == [("a.pb", "damaged")] * 3 + [("b.pb", "cut off")]

    def run():
        stream = message_stream.read_messages(spark, str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return message_stream.counted(q)

    assert run() == (len(want), 4)
    (folder / "d.pb").write_bytes(delimited(bodies[9:]))
    more = sorted((m["vehicle_id"], p["timestamp"], p["lon"], p["lat"]) for e in good for m in e["messages"] for p in m["locations"])
    assert run() == (len(more) - len(want), 0)
    assert key(message_stream.fixes_of(spark.read.parquet(str(tmp_path / "out")))) == more
