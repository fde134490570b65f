"""Trip lines by area tile, for executors to look up."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from ..functions import tiles
from ..operators.network import Network
from ..operators.tables import item_tiles
from ..sources.files import filesystem

LINE = ["id", "segment_id", "tripline_index", "dist", "x0", "y0", "x1", "y1", "start_node_id", "end_node_id"]


def write_lines(net: Network, path: str) -> None:
    """Trip lines with their segments' nodes as a table partitioned by area tile, for executors to look up."""
    nodes = net.segments.select(F.col("id").alias("segment_id"), "start_node_id", "end_node_id")
    tiled = item_tiles(net.triplines.join(nodes, "segment_id"), "x0", "y0", "x1", "y1", tiles.AREA_ZOOM)
    tiled.select(*LINE, "tile_x", "tile_y").repartition("tile_x", "tile_y").write.partitionBy("tile_x", "tile_y").mode("overwrite").parquet(path)


def _tile(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    phi = math.radians(lat)
    return math.floor((lon + 180.0) / 360.0 * (1 << zoom)), math.floor((1.0 - math.log(math.tan(phi) + 1.0 / math.cos(phi)) / math.pi) / 2.0 * (1 << zoom))


class LineStore:
    """Trip lines by area tile, each tile read when it is first touched; the least recently used ones are dropped."""

    def __init__(self, path: str, keep: int = 256):
        self.path, self.keep = path, keep
        self.tiles: dict[tuple[int, int], np.ndarray | None] = {}

    def tile(self, x: int, y: int) -> np.ndarray | None:
        if (x, y) in self.tiles:
            self.tiles[x, y] = self.tiles.pop((x, y))
        else:
            self.tiles[x, y] = self._read(x, y)
            if len(self.tiles) > self.keep:
                del self.tiles[next(iter(self.tiles))]
        return self.tiles[x, y]

    def _read(self, x: int, y: int) -> np.ndarray | None:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = filesystem(self.path)
        folder = f"{path}/tile_x={x}/tile_y={y}"
        if store.get_file_info(folder).type != fs.FileType.Directory:
            return None
        table = ds.dataset(folder, filesystem=store, format="parquet").to_table(columns=LINE).to_pandas()
        return table[LINE].to_records(index=False)

    def crossings(self, p0: tuple[int, float, float], p1: tuple[int, float, float]) -> list[tuple]:
        """(time, tile_x, tile_y, line id, line) of the lines that the way from p0 to p1 (time, lon, lat) crosses, in order."""
        (t0, px0, py0), (t1, px1, py1) = p0, p1
        west, east, south, north = min(px0, px1), max(px0, px1), min(py0, py1), max(py0, py1)
        x0, y0 = _tile(west, north, tiles.AREA_ZOOM)
        x1, y1 = _tile(east, south, tiles.AREA_ZOOM)
        found: dict[int, tuple] = {}
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                lines = self.tile(x, y)
                if lines is None:
                    continue
                lx0, ly0, lx1, ly1 = lines.x0, lines.y0, lines.x1, lines.y1
                near = (np.minimum(lx0, lx1) <= east) & (np.maximum(lx0, lx1) >= west) & (np.minimum(ly0, ly1) <= north) & (np.maximum(ly0, ly1) >= south)
                for line in lines[near]:
                    rx, ry, sx, sy = px1 - px0, py1 - py0, line.x1 - line.x0, line.y1 - line.y0
                    rxs = rx * sy - ry * sx
                    if rxs == 0:
                        continue
                    f = ((line.x0 - px0) * sy - (line.y0 - py0) * sx) / rxs
                    g = ((px0 - line.x0) * ry - (py0 - line.y0) * rx) / (sx * ry - sy * rx)
                    if 0 <= f <= 1 and 0 <= g <= 1:
                        first = _tile(min(line.x0, line.x1), max(line.y0, line.y1), tiles.INDEX_ZOOM)
                        mine = _tile(west, north, tiles.INDEX_ZOOM)
                        found[int(line.id)] = (int((t1 - t0) * f + t0), max(first[0], mine[0]), max(first[1], mine[1]), int(line.id), line)
        return sorted(found.values(), key=lambda c: c[:4])


@cache
def line_store(path: str) -> LineStore:
    """The lines of a path that this Python worker has read."""
    return LineStore(path)
