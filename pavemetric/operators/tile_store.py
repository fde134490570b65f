"""Items kept by coarse tile in Morton order, so that an envelope reads what lies in it (SRC8, SP5, SP6, SP14, SP16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles
from . import tables
from .versions import Version, Versions

#: Zoom of the tiles that have folders of their own: at most 65,536 of them.
CELL_ZOOM = 8
#: Where items without a place are kept.
NOWHERE = "none"
BOX = ["x0", "y0", "x1", "y1"]
TILE_BOX = ["tx0", "ty0", "tx1", "ty1"]
Envelope = tuple[float, float, float, float]


class TileStore:
    """Tables of items with a box (x0, y0, x1, y1: lon and lat of two corners, in any order).

    An item lies in the folder of each coarse tile that its box touches, with the index tiles of its box (tx0 to ty1); rows of
    a folder are in Morton order of the first of them. Of an item's copies a reader takes the one in the first coarse tile that
    the item and what is asked for share, so no rows are compared. Items whose box is null have a folder of their own.
    """

    def __init__(self, versions: Versions, cell_zoom: int = CELL_ZOOM):
        self.versions, self.shift = versions, tiles.INDEX_ZOOM - cell_zoom

    def laid_out(self, items: DataFrame, also_nowhere: Column | None = None) -> DataFrame:
        """A row for each item and coarse tile of its box: cell, cell_x, cell_y, tx0, ty0, tx1, ty1 and the Morton number z.

        also_nowhere: which items have a row among those without a place, too.
        """
        x, y = (lambda f, a, b: tiles.tile_x(f(a, b), tiles.INDEX_ZOOM)), (lambda f, a, b: tiles.tile_y(f(a, b), tiles.INDEX_ZOOM))
        # rows grow southwards
        box = items.withColumns({"tx0": x(F.least, "x0", "x1"), "tx1": x(F.greatest, "x0", "x1"), "ty0": y(F.greatest, "y0", "y1"), "ty1": y(F.least, "y0", "y1")})
        known = F.col("tx0").isNotNull() & F.col("ty0").isNotNull()
        span = lambda a, b: F.sequence(self.cell_of(F.col(a)), self.cell_of(F.col(b)))
        cells = F.when(known, F.flatten(F.transform(span("tx0", "tx1"), lambda i: F.transform(span("ty0", "ty1"), lambda j: F.struct(i.alias("x"), j.alias("y"))))))
        out = F.array(F.struct(F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y")))
        everywhere = F.coalesce(cells, out) if also_nowhere is None else F.when(also_nowhere & known, F.concat(cells, out)).otherwise(F.coalesce(cells, out))
        placed = box.withColumn("c", F.explode(everywhere)).withColumns({"cell_x": F.col("c.x"), "cell_y": F.col("c.y")}).drop("c")
        name = F.when(F.col("cell_x").isNull(), NOWHERE).otherwise(F.concat_ws("_", "cell_x", "cell_y"))
        return placed.withColumns({"cell": name, "z": F.when(F.col("cell_x").isNotNull(), tiles.morton(F.col("tx0"), F.col("ty0")))})

    def declare(self, version: Version, name: str, schema: str) -> None:
        """Makes a table of items known, if it isn't yet."""
        if name not in version.schemas:
            version.schemas[name] = self.laid_out(self.versions.spark.createDataFrame([], schema)).schema.json()

    def cell_of(self, tile: Column) -> Column:
        return F.shiftright(tile, self.shift)

    def cells(self, rows: DataFrame) -> set[str]:
        """The coarse tiles of laid-out rows: no more than there are."""
        return {r["cell"] for r in rows.select("cell").distinct().collect()}

    def write(self, version: Version, name: str, rows: DataFrame, cells: set[str]) -> None:
        """Puts laid-out rows in place of those of the given coarse tiles, in a version that is yet to be committed."""
        # a crowded tile is dealt over several tasks; each writes its stretch of the order
        ordered = rows.repartitionByRange("cell", "z").sortWithinPartitions("cell", "z").withColumn("part", F.col("cell"))
        found = self.versions.written(ordered, name, "part")
        parts = {c: f for c, f in version.parts.get(name, {}).items() if c not in cells}
        version.parts[name] = parts | {c: [f] for c, f in found.items()}

    def replace(self, version: Version, name: str, added: DataFrame, removed: DataFrame | None = None, key: str = "id") -> None:
        """Adds laid-out rows and takes out those with the keys of removed, which are laid out too. Other tiles aren't read."""
        cells = self.cells(added)
        if removed is not None:
            cells |= self.cells(removed)
        if not cells:
            return
        kept = self.read(version, name, cells)
        if removed is not None:
            kept = kept.join(tables.shuffled(removed.select(key).distinct()), key, "left_anti")
        self.write(version, name, kept.select(*added.columns).unionByName(added), cells)

    def read(self, version: Version, name: str, cells: set[str] | None = None) -> DataFrame:
        """Laid-out rows, so an item once for each of its coarse tiles."""
        return self.versions.read(version, name, cells)

    def every(self, version: Version, name: str) -> DataFrame:
        """Each item once."""
        home = (F.col("cell_x") == self.cell_of(F.col("tx0"))) & (F.col("cell_y") == self.cell_of(F.col("ty0")))
        return self.bare(self.read(version, name).where(home | F.col("tx0").isNull() | F.col("ty0").isNull()))

    def bare(self, rows: DataFrame) -> DataFrame:
        """Laid-out rows without what laying out has added."""
        return rows.drop("cell", "cell_x", "cell_y", "z", *TILE_BOX)

    def in_envelope(self, version: Version, name: str, envelope: Envelope) -> DataFrame:
        """Items with an index tile among those of (min_lon, min_lat, max_lon, max_lat), which are one more on every side.

        Folders of other coarse tiles aren't listed; of theirs, row groups beyond the envelope are skipped by their bounds.
        """
        lon, lat = [F.lit(float(envelope[i])) for i in (0, 2)], [F.lit(float(envelope[i])) for i in (1, 3)]
        z = tiles.INDEX_ZOOM
        row = self.versions.spark.range(1).select(tiles.tile_x(F.least(*lon), z) - 1, tiles.tile_y(F.greatest(*lat), z) - 1, tiles.tile_x(F.greatest(*lon), z) + 1, tiles.tile_y(F.least(*lat), z) + 1)
        x0, y0, x1, y1 = row.first()
        if None in (x0, y0, x1, y1):
            raise ValueError(f"{envelope} is no envelope on the map")
        wanted = {c for c in version.parts.get(name, {}) if c != NOWHERE and x0 >> self.shift <= int(c.split("_")[0]) <= x1 >> self.shift and y0 >> self.shift <= int(c.split("_")[1]) <= y1 >> self.shift}
        touching = (F.col("tx0") <= x1) & (F.col("tx1") >= x0) & (F.col("ty0") <= y1) & (F.col("ty1") >= y0)
        first = (F.col("cell_x") == F.greatest(self.cell_of(F.col("tx0")), F.lit(x0 >> self.shift))) & (F.col("cell_y") == F.greatest(self.cell_of(F.col("ty0")), F.lit(y0 >> self.shift)))
        return self.bare(self.read(version, name, wanted).where(touching & first))

    def in_envelopes(self, version: Version, name: str, envelopes: DataFrame) -> DataFrame:
        """envelope_id and the items of each envelope (envelope_id, min_lon, min_lat, max_lon, max_lat), as in_envelope has them.

        An equi-join on coarse tiles, over the folders of those that any envelope touches.
        """
        t = lambda f, a, b, by: f(F.least(a, b) if by < 0 else F.greatest(a, b), tiles.INDEX_ZOOM) + (by if f is tiles.tile_x else -by)
        e = envelopes.select("envelope_id", t(tiles.tile_x, "min_lon", "max_lon", -1).alias("ex0"), t(tiles.tile_x, "min_lon", "max_lon", 1).alias("ex1"), t(tiles.tile_y, "min_lat", "max_lat", 1).alias("ey0"), t(tiles.tile_y, "min_lat", "max_lat", -1).alias("ey1"))
        span = lambda a, b: F.sequence(self.cell_of(F.col(a)), self.cell_of(F.col(b)))
        e = e.where("ex0 is not null and ey0 is not null").withColumn("cell_x", F.explode(span("ex0", "ex1"))).withColumn("cell_y", F.explode(span("ey0", "ey1")))
        e = tables.settled(e)
        wanted = {f"{r['cell_x']}_{r['cell_y']}" for r in e.select("cell_x", "cell_y").distinct().collect()}
        both = self.read(version, name, wanted).join(e, ["cell_x", "cell_y"])
        touching = (F.col("tx0") <= F.col("ex1")) & (F.col("tx1") >= F.col("ex0")) & (F.col("ty0") <= F.col("ey1")) & (F.col("ty1") >= F.col("ey0"))
        first = (F.col("cell_x") == self.cell_of(F.greatest("tx0", "ex0"))) & (F.col("cell_y") == self.cell_of(F.greatest("ty0", "ey0")))
        return self.bare(both.where(touching & first)).drop("ex0", "ex1", "ey0", "ey1")
