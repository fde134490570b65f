"""Stored tables of the road-speed side and one object over them (K1, K5, SRC8-14, SNK1-17, M1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import exchange, message_files
from . import hist, matching, tables
from .hist_store import BUCKETS, HistStore
from .map_store import BOXED, MapStore
from .tile_store import CELL_ZOOM, Envelope, TileStore
from .versions import Versions

TRACE = f"id long, start_node_id long, end_node_id long, coords array<struct<lon:double,lat:double>>, {BOXED}"
#: Street types of type statistics, from no street to any other.
STREET_TYPES = 6


@dataclass
class Settings:
    """Where tables lie, and how samples are made."""

    folder: str
    mode: str = "fixed"
    min_vehicles: int = matching.MIN_VEHICLES
    commit_id: int = 0
    cell_zoom: int = CELL_ZOOM
    buckets: int = BUCKETS


class SpeedStore:
    """From map and fixes to stored histograms, and what is read from them.

    The map, the histograms and the off-map traces are tables in versions of their own under the folder: a load is seen as a whole
    or not at all, and one that is stopped leaves what was there.
    """

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.map = MapStore(spark, self.path("map"), settings.cell_zoom)
        self.hist = HistStore(spark, self.path("histograms"), settings.buckets)
        self.traces = TileStore(Versions(spark, self.path("off_map_traces")), settings.cell_zoom)

    def path(self, name: str) -> str:
        return f"{self.settings.folder.rstrip('/')}/{name}"

    def load_map(self, nodes: DataFrame, ways: DataFrame) -> bool:
        """Adds an extract to the map (see MapStore.load)."""
        return self.map.load(nodes, ways)

    def load_fixes(self, fixes: DataFrame, areas: DataFrame, load: str) -> None:
        """Adds the histogram of the samples of fixes under the name of a load, in place of what it gave before."""
        s = self.settings
        found = matching.speed_samples(fixes, areas, self.map.every("segments"), self.map.every("triplines"), self.map.every("jumpers"), s.mode, s.min_vehicles)
        self.hist.load(hist.histogram(found), load)

    def histograms(self) -> DataFrame:
        return self.hist.histograms()

    def segments_in(self, envelope: Envelope) -> DataFrame:
        """Segments with an index tile among those of (min_lon, min_lat, max_lon, max_lat), which are one more on every side."""
        return self.map.within("segments", envelope)

    def baseline(self, envelope: Envelope | None = None, created_ms: int = 0) -> DataFrame:
        """Encoded BaselineTile messages (message) of the segments in an envelope, or of all."""
        chosen = self.map.every("segments") if envelope is None else self.segments_in(envelope)
        return exchange.encoded(exchange.baseline_tiles(self.histograms(), chosen, self.settings.commit_id, created_ms), "BaselineTile")

    def write_statistics(self, path: str, envelope: Envelope | None = None, created_ms: int = 0) -> None:
        """The messages as files, one for each task that has any (see message_files)."""
        message_files.write(self.baseline(envelope, created_ms), path)

    def read_statistics(self, path: str) -> DataFrame:
        """The fields of the messages of such files."""
        return exchange.decoded(message_files.read(self.spark, path), "BaselineTile")

    def save_off_map_traces(self, traces: DataFrame) -> None:
        """Adds traces (start_node_id, end_node_id, coords), numbered after the stored ones."""
        v = self.traces.versions.latest()
        self.traces.declare(v, "traces", TRACE)
        plain = tables.valid_lines(traces.select("start_node_id", "end_node_id", "coords"))
        first = v.facts.get("next_id", tables.FIRST_ID)
        numbered = tables.settled(tables.with_ids(plain, ["start_node_id", "end_node_id"], F.floor(F.coalesce("start_node_id", F.lit(0)) / 1024), first=first))
        v.facts["next_id"] = first + numbered.count()
        all_ = lambda c: F.transform("coords", lambda p: p[c])
        box = {f"{c}{k}": f(all_(n)) for c, n in (("x", "lon"), ("y", "lat")) for k, f in ((0, F.array_min), (1, F.array_max))}
        self.traces.replace(v, "traces", tables.settled(self.traces.laid_out(numbered.select("id", "start_node_id", "end_node_id", "coords").withColumns(box))))
        self.traces.versions.commit(v)

    def off_map_traces(self, envelope: Envelope | None = None) -> DataFrame:
        """Traces near an envelope (see TileStore.in_envelope), or all."""
        v = self.traces.versions.latest()
        self.traces.declare(v, "traces", TRACE)
        found = self.traces.every(v, "traces") if envelope is None else self.traces.in_envelope(v, "traces", envelope)
        return found.drop("x0", "y0", "x1", "y1")

    def table_statistics(self) -> DataFrame:
        """name, files, bytes and rows of the parts that the last versions name, for a log. Items count in each of their coarse tiles."""
        rows = []
        for versions, v in ((self.map.versions, self.map.latest()), (self.hist.versions, self.hist.latest()), (self.traces.versions, self.traces.versions.latest())):
            for name, parts in v.parts.items():
                files = size = 0
                for folder in (f for fs in parts.values() for f in fs):
                    p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                    found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p)
                    files, size = files + found.getFileCount(), size + found.getLength()
                rows.append((name, files, size, versions.read(v, name).count()))
        return self.spark.createDataFrame(rows, "name string, files long, bytes long, rows long")


def packed_types(stats: DataFrame) -> DataFrame:
    """One row: sample_count, sample_sum and arrays by street type of type statistics (street_type null: all)."""
    pick = lambda k, c: F.coalesce(F.sum(F.when(F.col("street_type").eqNullSafe(F.lit(k).cast("int")), F.col(c))), F.lit(0)).cast("long")
    array = lambda c: F.array(*[pick(k, c) for k in range(STREET_TYPES)])
    return stats.agg(pick(None, "n").alias("sample_count"), pick(None, "sum_kmh").alias("sample_sum"), array("n").alias("counts"), array("sum_kmh").alias("sums"))


def unpacked_types(packed: DataFrame) -> DataFrame:
    """The type statistics of such a row, types without samples left out."""
    total = F.struct(F.lit(None).cast("int").alias("street_type"), F.col("sample_count").alias("n"), F.col("sample_sum").alias("sum_kmh"))
    by_type = F.transform("counts", lambda n, k: F.struct(k.alias("street_type"), n.alias("n"), F.element_at("sums", k + 1).alias("sum_kmh")))
    return packed.select(F.inline(F.concat(F.array(total), by_type))).where("n > 0")
