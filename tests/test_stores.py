"""Tables by coarse tile, versions, a map loaded piece by piece, histograms by loads, message files."""

import random

import pytest
from pyspark.sql import functions as F

from pavemetric.operators import hist, hist_store, map_store, network, tile_store, versions
from pavemetric.sources import adapters as ad
from pavemetric.sources import message_files

SF = "/root/testdata/sf0.001"
KEY = network.SEGMENT_KEY


def maps_of(segments, lines, jumpers):
    """A map without ids, which depend on the order of loads."""
    rows = segments.select("id", *KEY, "length", "oneway", "street_type", "coords").collect()
    name = {r.id: (r.way_id, r.start_node_id, r.end_node_id) for r in rows}
    assert len(name) == len(rows)
    return (
        sorted(repr(tuple(r)[1:]) for r in rows),
        sorted(repr((name[r.segment_id], r.tripline_index, r.dist, r.x0, r.y0, r.x1, r.y1)) for r in lines.collect()),
        sorted(repr((r.start_node_id, r.end_node_id, round(r.length, 6), [name[i] for i in r.segments])) for r in jumpers.collect()),
    )


def stored(m):
    return maps_of(m.every("segments"), m.every("triplines"), m.every("jumpers"))


@pytest.fixture(scope="module")
def towns(spark):
    """Two towns, and their map built at once."""
    some = (F.col("node_id") / 100).cast("int") < 3, (F.col("way_id") / 20).cast("int") < 3
    nodes = spark.createDataFrame(ad.town_nodes(spark, SF).where(some[0]).collect(), "node_id long, lon double, lat double").cache()
    ways = spark.createDataFrame(ad.town_ways(spark, SF).where(some[1]).collect(), "way_id long, nodes array<long>, tags map<string,string>").cache()
    net = network.build(nodes, ways)
    return nodes, ways, maps_of(net.segments, net.triplines, net.jumpers)


@pytest.mark.parametrize("seed", [1])
def test_a_map_by_loads_is_the_map_at_once(spark, tmp_path, towns, seed):
    nodes, ways, want = towns
    rng = random.Random(seed)
    m = map_store.MapStore(spark, str(tmp_path / "m"), 14)
    # parts that overlap, in any order; streets may come before their nodes, and nodes before their streets
    for _ in range(2):
        a, b = rng.randrange(2, 4), rng.randrange(2, 4)
        m.load(nodes.where(F.pmod(F.hash("node_id", F.lit(a)), F.lit(b)) > 0), ways.where(F.pmod(F.hash("way_id", F.lit(b)), F.lit(a)) > 0))
    ids = {tuple(r) for r in m.every("segments").select("id", *KEY).collect()}
    assert m.load(nodes, ways)
    assert stored(m) == want and not m.load(nodes, ways.unionByName(ways))
    now = {tuple(r)[1:]: r.id for r in m.every("segments").select("id", *KEY).collect()}
    assert all(now.get(k, i) == i for i, *k in ((i, *k) for i, *k in ids) for k in [tuple(k)])


def test_a_load_that_is_stopped_leaves_the_old_map(spark, tmp_path, towns, monkeypatch):
    nodes, ways, want = towns
    m = map_store.MapStore(spark, str(tmp_path / "m"), 14)
    m.load(nodes, ways.where("way_id % 20 < 3"))
    before = stored(m)

    def killed(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as p, pytest.raises(KeyboardInterrupt):
        p.setattr(m.versions, "commit", killed)
        m.load(nodes, ways)
    assert stored(m) == before != want
    m.load(nodes, ways)
    assert stored(m) == want
    gone = m.versions.vacuum()
    assert gone and stored(m) == want


def test_an_unfinished_manifest_is_passed_over_and_writers_conflict(spark, tmp_path):
    vs = versions.Versions(spark, str(tmp_path / "v"))
    a, b = vs.latest(), vs.latest()
    a.facts["by"] = "a"
    vs.commit(a)
    with pytest.raises(versions.Conflict):
        vs.commit(b)
    (tmp_path / "v/_versions/0000000001.json").write_text('{"number": 1, "par')
    v = vs.latest()
    assert (v.number, v.facts) == (2, {"by": "a"})
    vs.commit(v)
    assert vs.latest().number == 3


def scanned_files(df):
    """Files that the scans of a run have read."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
    return total


def test_an_envelope_reads_as_many_files_however_large_the_map(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = []
        for n in (1, 10):
            store = tile_store.TileStore(versions.Versions(spark, str(tmp_path / f"t{n}")), 11)
            v = store.versions.latest()
            store.declare(v, "items", "id long, x0 double, y0 double, x1 double, y1 double")
            items = spark.range(400 * n).select("id", (F.col("id") % 20 * 0.01 + F.floor(F.col("id") / 400) * 3).alias("x0"), (F.floor(F.col("id") / 20) % 20 * 0.01).alias("y0"))
            store.replace(v, "items", store.laid_out(items.withColumns({"x1": F.col("x0") + 0.004, "y1": F.col("y0") + 0.004})))
            store.versions.commit(v)
            found = store.in_envelope(store.versions.latest(), "items", (0.05, 0.05, 0.055, 0.055))
            assert sorted(r.id for r in found.collect()) == [105]
            assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
            counts.append(scanned_files(found))
            assert len(store.versions.latest().parts["items"]) >= 4 * n
        # a tile that several tasks wrote has a file of each
        assert counts[1] <= counts[0] <= 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("zoom", [9, 13])
def test_envelopes_find_each_item_once(spark, tmp_path, zoom):
    rng = random.Random(zoom)
    rows = []
    for i in range(150):
        x, y = rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3)
        rows.append((i, x, y, x + rng.choice([0.0, 0.001, -0.2]), y + rng.choice([0.0, -0.001, 0.2])))
    rows += [(900, None, 1.0, 1.0, 1.0), (901, 1.0, float("nan"), 1.0, 1.0)]
    store = tile_store.TileStore(versions.Versions(spark, str(tmp_path / "s")), zoom)
    v = store.versions.latest()
    ddl = "id long, x0 double, y0 double, x1 double, y1 double"
    store.declare(v, "items", ddl)
    for part in (rows[:70], rows[70:], [(5, *rows[5][1:])]):
        new = store.laid_out(spark.createDataFrame(part, ddl))
        store.replace(v, "items", new, new)
    envelopes = [(j, *(min(a, c), min(b, d), max(a, c), max(b, d))) for j in range(12) for a, b, c, d in [[rng.uniform(-0.3, 0.3) for _ in range(4)]]]
    got = sorted((r.envelope_id, r.id) for r in store.in_envelopes(v, "items", spark.createDataFrame(envelopes, "envelope_id int, min_lon double, min_lat double, max_lon double, max_lat double")).collect())
    from pavemetric.operators import tables

    want = tables.in_envelopes(spark.createDataFrame(rows[:150], ddl), spark.createDataFrame(envelopes, "envelope_id int, min_lon double, min_lat double, max_lon double, max_lat double"), "id")
    assert got == sorted((r.envelope_id, r.id) for r in want.collect())
    for j, *e in envelopes[:3]:
        assert sorted(r.id for r in store.in_envelope(v, "items", tuple(e)).collect()) == [i for k, i in got if k == j]
    assert sorted(r.id for r in store.every(v, "items").collect()) == sorted([*range(150), 900, 901])


HIST = "segment_id long, week int, hour int, speed_bin int, n long"


def test_histograms_by_loads(spark, tmp_path):
    rng = random.Random(2)
    store = hist_store.HistStore(spark, str(tmp_path / "h"), 4)
    kept, old = {}, None
    total = lambda loads: sorted((*k, n) for k, n in {k: sum(h.get(k, 0) for h in loads) for k in {k for h in loads for k in h}}.items() if n)
    for i in range(12):
        name = rng.choice("abc")
        h = {(rng.randrange(6), 1 + rng.randrange(2), rng.randrange(3), rng.randrange(4)): rng.randint(1, 9) for _ in range(rng.randrange(15))}
        kept[name] = h
        store.load(spark.createDataFrame([(*k, n) for k, n in h.items()], HIST), name)
        if i == 3:
            # a reader that began before what follows
            old = (store.histograms(), total(kept.values()))
        if i == 6:
            store.compact()
            assert all(len(f) == 1 for f in store.latest().parts["weekly"].values())
    want = total(kept.values())
    assert sorted(map(tuple, store.histograms().collect())) == want
    assert sorted(map(tuple, old[0].collect())) == old[1]
    assert all(len(f) <= hist_store.MOST_FOLDERS for f in store.latest().parts["weekly"].values())
    assert sorted(map(tuple, store.histograms([1, 2, 77]).collect())) == [r for r in want if r[0] in (1, 2)]
    sums = {}
    for s, _, h, b, n in want:
        sums[s, h, b] = sums.get((s, h, b), 0) + n
    assert sorted(map(tuple, store.cumulative().collect())) == sorted((*k, n) for k, n in sums.items())
    store.vacuum()
    assert sorted(map(tuple, store.histograms().collect())) == want
    store.add_batch(spark.createDataFrame([(1, 1, 1, 1, 5)], HIST), "s", 3)
    for number in (3, 2):
        store.add_batch(spark.createDataFrame([(1, 1, 1, 1, 7)], HIST), "s", number)
    assert store.histograms().agg(F.sum("n")).first()[0] == sum(r[4] for r in want) + 5
    with pytest.raises(ValueError):
        store.load(spark.createDataFrame([], HIST), "a/b")


def test_two_loaders_that_meet_both_count(spark, tmp_path, monkeypatch):
    store, other = (hist_store.HistStore(spark, str(tmp_path / "h"), 4) for _ in range(2))
    h = lambda n: spark.createDataFrame([(1, 1, 1, 1, n)], HIST)
    commit, met = store.versions.commit, []

    def slow(v):
        if not met:
            met.append(1)
            other.load(h(5), "b")
        commit(v)

    monkeypatch.setattr(store.versions, "commit", slow)
    store.load(h(3), "a")
    assert [tuple(r) for r in store.histograms().collect()] == [(1, 1, 1, 1, 8)] and store.latest().number == 2


def test_message_files(spark, tmp_path):
    path = str(tmp_path / "m")
    bodies = [bytes([i]) * (i * 37 % 400) for i in range(200)]
    df = spark.createDataFrame([(b,) for b in bodies], "message binary").repartition(4)
    message_files.write(df, path, range_bytes=2000)
    files = message_files.listed(path)
    assert len(files) == 4 and sum(f["messages"] for f in files) == 200 and max(len(f["ends"]) for f in files) > 3
    back = message_files.read(spark, path)
    assert sorted(bytes(r.message) for r in back.collect()) == sorted(bodies) and back.rdd.getNumPartitions() == sum(len(f["ends"]) for f in files)
    message_files.write(df.limit(3), path, mode="append")
    assert message_files.read(spark, path).count() == 203
    message_files.write(spark.createDataFrame([(b"x",), (None,)], "message binary").coalesce(1), path)
    assert [bytes(r.message) for r in message_files.read(spark, path).collect()] == [b"x"]
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "m").iterdir() if not p.name.startswith(".")) == ["_list.json", "part"]
    message_files.write(df.limit(0), path)
    assert message_files.read(spark, path).count() == 0 and message_files.read(spark, str(tmp_path / "none")).count() == 0


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    message_files.write(spark.createDataFrame([(b"old",)], "message binary"), path)
    bad = F.udf(lambda i: b"y" * 10 if i < 150 else 1 / 0, "binary")
    with pytest.raises(Exception, match="division"):
        message_files.write(spark.range(0, 200, 1, 4).select(bad("id").alias("message")), path)
    assert [bytes(r.message) for r in message_files.read(spark, path).collect()] == [b"old"]
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("part")]) == 1


def test_histogram_of_the_store_is_that_of_the_samples(spark, tmp_path):
    store = hist_store.HistStore(spark, str(tmp_path / "h"))
    e = ad.event_samples(spark, SF)
    store.load(hist.histogram(e), "all")
    assert sorted(map(tuple, store.histograms().collect())) == sorted(map(tuple, hist.histogram(e).collect()))


def test_stored_maps_meet_by_key(spark):
    """The lines of a stored map and its segments grow alike: neither is sent through the driver."""
    from pavemetric.plans import queries as core

    plan = core.QUERIES["o4_lines_by_loads"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
