"""A street map kept up to date by loads of extracts: what a load doesn't touch is neither read nor written (SRC1, SRC3, O1-O4, O14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import network, tables
from .tile_store import BOX, CELL_ZOOM, NOWHERE, Envelope, TileStore
from .versions import Version, Versions

BOXED = "x0 double, y0 double, x1 double, y1 double"
STREET = ["way_id", "nodes", "street_type", "oneway"]
SEGMENT = ["id", *network.SEGMENT_KEY, "length", "oneway", "street_type", "coords"]
SCHEMAS = {
    "nodes": f"node_id long, lon double, lat double, {BOXED}",
    "ways": f"way_id long, nodes array<long>, street_type int, oneway boolean, {BOXED}",
    "segments": f"id long, way_id long, start_node_id long, end_node_id long, length double, oneway boolean, street_type int, coords array<struct<lon:double,lat:double>>, {BOXED}",
    "triplines": f"id long, segment_id long, tripline_index int, dist double, {BOXED}",
    "jumpers": f"start_node_id long, end_node_id long, length double, segments array<long>, {BOXED}",
}
#: Degrees that a trip line may lie beyond its segment, with room to spare.
REACH = 0.001


class MapStore:
    """Nodes, streets, segments, trip lines and jumpers of all extracts loaded so far, by coarse tile.

    A load gives the map that all extracts would give at once, but for the ids of segments: those that stay keep theirs, new ones
    go on after the last. It looks at the new streets, and at the stored ones that a new crossing cuts or that waited for a node;
    lines follow their segments, and jumpers are found anew in the clusters of short segments that changed. All tables of a load
    become visible at once, when its manifest is committed.
    """

    def __init__(self, spark: SparkSession, folder: str, cell_zoom: int = CELL_ZOOM):
        self.versions = Versions(spark, folder)
        self.tiles = TileStore(self.versions, cell_zoom)

    def latest(self) -> Version:
        v = self.versions.latest()
        for name, schema in SCHEMAS.items():
            self.tiles.declare(v, name, schema)
        return v

    def load(self, nodes: DataFrame, ways: DataFrame) -> bool:
        """Adds an extract (nodes: node_id, lon, lat; ways: way_id, nodes, tags); whether there was anything new in it.

        Nodes and ways that are stored already, or come several times, count once. A street whose nodes aren't all known waits.
        A node that the extract lacks is looked for among those of its streets' tiles, then in the ids of all stored nodes.
        """
        v = self.latest()
        fresh_nodes, fresh_streets = self._unknown(v, nodes, ways)
        if fresh_nodes.isEmpty() and fresh_streets.isEmpty():
            return False
        affected = self._affected(v, fresh_nodes, fresh_streets)
        cells = self._store_streets(v, fresh_nodes, fresh_streets, affected)
        added, removed = self._segments(v, fresh_streets, affected, cells)
        self._lines(v, added, removed)
        self._jumpers(v, added, removed)
        self.versions.commit(v)
        return True

    # reading

    def every(self, name: str) -> DataFrame:
        """All items of a table."""
        return self._plain(name, self.tiles.every(self.latest(), name))

    def within(self, name: str, envelope: Envelope) -> DataFrame:
        """Items of a table near an envelope (see TileStore.in_envelope)."""
        return self._plain(name, self.tiles.in_envelope(self.latest(), name, envelope))

    def within_each(self, name: str, envelopes: DataFrame) -> DataFrame:
        """envelope_id and the items near each envelope (see TileStore.in_envelopes)."""
        return self._plain(name, self.tiles.in_envelopes(self.latest(), name, envelopes))

    def _plain(self, name: str, rows: DataFrame) -> DataFrame:
        return rows if name == "triplines" else rows.drop(*BOX)

    # a load's steps

    def _stored(self, v: Version, name: str, cells: set[str] | None, key: str) -> DataFrame:
        """Items of the given coarse tiles once each."""
        return self.tiles.bare(self.tiles.read(v, name, cells)).dropDuplicates([key])

    def _relaid(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """Laid-out rows with the copies that lie in other tiles, too."""
        return self.tiles.laid_out(self.tiles.bare(rows).dropDuplicates(key))

    def _point(self, nodes: DataFrame) -> DataFrame:
        return self.tiles.laid_out(nodes.select("node_id", "lon", "lat", *[F.col("lon" if c[0] == "x" else "lat").alias(c) for c in BOX]))

    def _unknown(self, v: Version, nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes (laid out) and streets of an extract that aren't stored."""
        given = nodes.where("node_id is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
        given = tables.settled(self._point(given.groupBy("node_id").agg(F.min(F.struct("lon", "lat")).alias("p")).select("node_id", "p.*")))
        cells = self.tiles.cells(given) | {NOWHERE}
        fresh_nodes = tables.settled(given.join(tables.shuffled(self._stored(v, "nodes", cells, "node_id").select("node_id")), "node_id", "left_anti"))
        first = F.min(F.struct("nodes", "street_type", "oneway"))
        streets = tables.settled(network.traffic_ways(ways).where("way_id is not null and size(nodes) > 0").groupBy("way_id").agg(first.alias("s")).select("way_id", "s.*"))
        # a stored street lies where its nodes lie; one of which the extract has no node may lie anywhere
        seen = self._places(streets).join(tables.shuffled(given.select("node_id")), "node_id", "left_semi").select("way_id").distinct()
        stray = not streets.join(tables.shuffled(seen), "way_id", "left_anti").isEmpty()
        fresh_streets = streets.join(tables.shuffled(self.tiles.read(v, "ways", None if stray else cells).select("way_id")), "way_id", "left_anti")
        return fresh_nodes, tables.settled(fresh_streets)

    def _places(self, streets: DataFrame) -> DataFrame:
        return streets.select("way_id", F.explode("nodes").alias("node_id"))

    def _near(self, v: Version, fresh_nodes: DataFrame, wanted: DataFrame, cells: set[str]) -> set[str]:
        """cells and the coarse tiles of further nodes (node_id), among them NOWHERE for those not known."""
        cells = cells | self.tiles.cells(fresh_nodes) | {NOWHERE}
        found = fresh_nodes.select("node_id").unionByName(self.tiles.read(v, "nodes", cells).select("node_id"))
        lost = tables.settled(wanted.join(tables.shuffled(found), "node_id", "left_anti"))
        if not lost.isEmpty():
            cells |= self.tiles.cells(self.tiles.read(v, "nodes").join(tables.shuffled(lost), "node_id", "left_semi"))
        return cells

    def _affected(self, v: Version, fresh_nodes: DataFrame, fresh_streets: DataFrame) -> DataFrame:
        """Stored streets (with their boxes) that a new crossing cuts or a new node completes, and whether by a node (moved)."""
        used = self._places(fresh_streets).select("node_id").distinct()
        near = tables.settled(self._stored(v, "ways", self._near(v, fresh_nodes, used, set()), "way_id"))
        places = self._places(near)
        # a stored node becomes a crossing by its second use; with more uses it is one already
        once = places.join(tables.shuffled(used), "node_id", "left_semi").groupBy("node_id").count().where("count = 1").select("node_id")
        cut = places.join(tables.shuffled(once), "node_id", "left_semi").select("way_id", F.lit(False).alias("moved"))
        waited = places.join(tables.shuffled(fresh_nodes.select("node_id")), "node_id", "left_semi").select("way_id", F.lit(True).alias("moved"))
        touched = cut.unionByName(waited).groupBy("way_id").agg(F.max("moved").alias("moved"))
        return tables.settled(near.join(tables.shuffled(touched), "way_id"))

    def _store_streets(self, v: Version, fresh_nodes: DataFrame, fresh_streets: DataFrame, affected: DataFrame) -> set[str]:
        """Puts new nodes and streets in place. The coarse tiles of all streets whose segments are to be looked at."""
        before = tables.settled(self.tiles.laid_out(affected, F.lit(True)))
        moved = before.where("moved")
        streets = tables.settled(fresh_streets.unionByName(affected.where("moved").select(*STREET)))
        wanted = tables.settled(self._places(streets).select("node_id").distinct())
        near = self._near(v, fresh_nodes, wanted, self.tiles.cells(before))
        known = self.tiles.read(v, "nodes", near).select("node_id", "lon", "lat").unionByName(fresh_nodes.select("node_id", "lon", "lat"))
        placed = self._places(streets).join(tables.shuffled(known), "node_id", "left")
        box = placed.groupBy("way_id").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), F.max(F.col("lon").isNull()).alias("waits"))
        # a street that waits for a node is kept among those without a place, too
        laid = tables.settled(self.tiles.laid_out(streets.join(tables.shuffled(box), "way_id"), F.col("waits")).drop("waits"))
        self.tiles.replace(v, "nodes", fresh_nodes)
        self.tiles.replace(v, "ways", laid, moved, "way_id")
        return near | self.tiles.cells(laid)

    def _segments(self, v: Version, fresh_streets: DataFrame, affected: DataFrame, cells: set[str]) -> tuple[DataFrame, DataFrame]:
        """Puts changed segments in place; the laid-out rows that are new or bent otherwise, and those taken out."""
        # in these tiles all streets and nodes that meet the changed ones are stored by now
        streets = tables.settled(fresh_streets.unionByName(affected.select(*STREET)))
        wanted = tables.settled(self._places(streets).select("node_id").distinct())
        uses = self._places(self._stored(v, "ways", cells, "way_id")).join(tables.shuffled(wanted), "node_id", "left_semi").groupBy("node_id").count()
        nodes = self.tiles.read(v, "nodes", cells).join(tables.shuffled(wanted), "node_id", "left_semi")
        now = tables.settled(tables.valid_lines(network.pieces(streets, nodes, uses.where("count >= 2"))))
        old = tables.settled(self._stored(v, "segments", cells, "id").join(tables.shuffled(affected.select("way_id")), "way_id", "left_semi"))
        key = network.SEGMENT_KEY
        joined = tables.settled(now.join(tables.shuffled(old.select("id", *key, F.col("coords").alias("was"))), key, "left"))
        first = v.facts.get("next_id", tables.FIRST_ID)
        fresh = joined.where("id is null").drop("id", "was")
        numbered = tables.with_ids(fresh, key, F.floor(F.col("way_id") / network.CELL_WAYS), first=first)
        v.facts["next_id"] = first + fresh.count()
        bent = joined.where("id is not null and coords <> was")
        ends = {f"{c}{k}": F.try_element_at("coords", F.lit(i))[n] for k, i in ((0, 1), (1, -1)) for c, n in (("x", "lon"), ("y", "lat"))}
        added = tables.settled(self.tiles.laid_out(numbered.select(*SEGMENT).unionByName(bent.select(*SEGMENT)).withColumns(ends)))
        gone = old.join(tables.shuffled(now), key, "left_anti").select("id").unionByName(bent.select("id"))
        removed = tables.settled(self.tiles.laid_out(old.join(tables.shuffled(gone), "id", "left_semi")))
        self.tiles.replace(v, "segments", added, removed)
        return added, removed

    def _lines(self, v: Version, added: DataFrame, removed: DataFrame) -> None:
        lines = tables.settled(self.tiles.laid_out(network.triplines(added.dropDuplicates(["id"]))))
        # lines cross their segment, so they may reach a little further
        wide = {c: (F.least(f"{c[0]}0", f"{c[0]}1") - REACH if c[1] == "0" else F.greatest(f"{c[0]}0", f"{c[0]}1") + REACH) for c in BOX}
        near = self.tiles.cells(self.tiles.laid_out(self.tiles.bare(removed).withColumns(wide)))
        old = self.tiles.read(v, "triplines", near).join(tables.shuffled(removed.select(F.col("id").alias("segment_id")).distinct()), "segment_id", "left_semi")
        self.tiles.replace(v, "triplines", lines, tables.settled(old))

    def _jumpers(self, v: Version, added: DataFrame, removed: DataFrame) -> None:
        """Finds jumpers anew in the clusters of short segments that have a changed one."""
        node = lambda name, i: F.struct(F.col(name).alias("node_id"), F.col(f"x{i}").alias("lon"), F.col(f"y{i}").alias("lat"))
        ends = lambda df: df.select(F.explode(F.array(node("start_node_id", 0), node("end_node_id", 1))).alias("e")).select("e.*").dropDuplicates(["node_id"])
        short = F.col("length") <= network.MIN_SEGMENT
        known = frontier = tables.settled(ends(added.where(short).select(*SEGMENT, *BOX).unionByName(removed.where(short).select(*SEGMENT, *BOX))))
        if frontier.isEmpty():
            return
        while v.parts.get("jumpers") and not frontier.isEmpty():
            # a node's stored jumpers reach all that it reaches and that reaches it
            near = self.tiles.read(v, "jumpers", self.tiles.cells(self._point(frontier)))
            met = [near.join(tables.shuffled(frontier.select(F.col("node_id").alias(c))), c, "left_semi").select(*near.columns) for c in ("start_node_id", "end_node_id")]
            frontier = tables.settled(ends(met[0].unionByName(met[1])).join(tables.shuffled(known.select("node_id")), "node_id", "left_anti"))
            known = tables.settled(known.unionByName(frontier))
        cells = self.tiles.cells(self._point(known))
        cluster = tables.shuffled(known.select(F.col("node_id").alias("start_node_id")))
        edges = self._stored(v, "segments", cells, "id").where(short).join(cluster, "start_node_id", "left_semi")
        place = lambda n, i: tables.shuffled(known.select(F.col("node_id").alias(n), F.col("lon").alias(f"x{i}"), F.col("lat").alias(f"y{i}")))
        found = network.jumpers(edges).join(place("start_node_id", 0), "start_node_id").join(place("end_node_id", 1), "end_node_id")
        old = self.tiles.read(v, "jumpers", cells).join(cluster, "start_node_id", "left_semi")
        self.tiles.replace(v, "jumpers", tables.settled(self.tiles.laid_out(found)), tables.settled(self._relaid(old, ["start_node_id", "end_node_id"])), "start_node_id")
