"""Histograms by bucket of segments, kept up to date by loads and merged now and then (SRC11, H1, H2, H5, H6)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hist, tables
from .versions import Conflict, Version, Versions

#: Buckets of segments, and folders of a bucket that are merged into one when a load adds another.
BUCKETS, MOST_FOLDERS = 64, 8
TRIES = 20
TOTAL_KEYS = ["segment_id", "hour", "speed_bin"]
SCHEMAS = {"weekly": "segment_id long, week int, hour int, speed_bin int, n long", "total": "segment_id long, hour int, speed_bin int, n long", "loads": "segment_id long, week int, hour int, speed_bin int, n long"}


class HistStore:
    """Histograms by segment, week, hour and speed, and their totals over all weeks.

    A load writes what it changes, once by week and once in total, into new folders of the buckets that it touches; its counts are
    added to the others, so loads may come in any order. A load that comes again under its name replaces what it gave before: what
    changes is the difference. Micro-batches of a stream are numbered; one that comes again changes nothing. A bucket with
    MOST_FOLDERS folders is merged by the load that adds the next. Readers read one version; of two writers that meet, the second
    adds its difference to what the first has committed.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.buckets, self.versions = spark, buckets, Versions(spark, folder)

    def latest(self) -> Version:
        v = self.versions.latest()
        if v.facts.setdefault("buckets", self.buckets) != self.buckets:
            raise ValueError(f"the store has {v.facts['buckets']} buckets")
        for name, schema in SCHEMAS.items():
            v.schemas.setdefault(name, self.spark.createDataFrame([], schema).schema.json())
        return v

    def load(self, histogram: DataFrame, load: str) -> None:
        """Adds a histogram (hist.KEYS, n) under the name of a load, in place of what that load gave before."""
        if not load or any(c in load for c in "/=\\%"):
            raise ValueError(f"{load!r} can't be the name of a folder")
        new = tables.settled(hist.merge(histogram))

        def change(v: Version) -> DataFrame:
            before = self.versions.read(v, "loads", {load})
            found = self.versions.written(new.withColumn("load", F.lit(load)), "loads", "load")
            v.parts.setdefault("loads", {})[load] = list(found.values())
            return hist.merge(new, before.withColumn("n", -F.col("n"))).where("n <> 0")

        self._apply(change)

    def add_batch(self, histogram: DataFrame, stream: str, number: int) -> None:
        """Adds a stream's micro-batch, if one with this number or a later one hasn't been added."""
        new = tables.settled(hist.merge(histogram))

        def change(v: Version) -> DataFrame | None:
            last = v.facts.setdefault("streams", {})
            if number <= last.get(stream, -1):
                return None
            last[stream] = number
            return new

        self._apply(change)

    def _apply(self, change) -> None:  # noqa: ANN001
        for attempt in range(TRIES):
            v = self.latest()
            rows = change(v)
            if rows is None:
                return
            rows = tables.settled(rows)
            self._append(v, "weekly", rows, hist.KEYS)
            self._append(v, "total", rows, TOTAL_KEYS)
            try:
                self.versions.commit(v)
                return
            except Conflict:
                if attempt == TRIES - 1:
                    raise

    def _bucket(self, column: str = "segment_id"):  # noqa: ANN202
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.buckets))  # an int has another hash

    def _append(self, v: Version, name: str, rows: DataFrame, keys: list[str]) -> None:
        added = rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
        found = self.versions.written(self._dealt(added), name, "bucket")
        parts = v.parts.setdefault(name, {})
        for bucket, folder in found.items():
            parts.setdefault(bucket, []).append(folder)
        self._merge(v, name, keys, [b for b in found if len(parts[b]) > MOST_FOLDERS])

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", "segment_id")

    def _merge(self, v: Version, name: str, keys: list[str], buckets: Iterable[str]) -> None:
        if buckets := set(buckets):
            merged = self.versions.read(v, name, buckets).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
            found = self.versions.written(self._dealt(merged), name, "bucket")
            v.parts[name] = {b: f for b, f in v.parts[name].items() if b not in buckets} | {b: [f] for b, f in found.items()}

    def compact(self) -> None:
        """Merges every bucket that has several folders. Readers go on with the version that they have; a writer may meet a Conflict."""
        v = self.latest()
        for name, keys in (("weekly", hist.KEYS), ("total", TOTAL_KEYS)):
            self._merge(v, name, keys, [b for b, fs in v.parts.get(name, {}).items() if len(fs) > 1])
        self.versions.commit(v)

    def vacuum(self) -> list[str]:
        """Deletes the folders that the last version doesn't name. No reader of an older one, and no writer, may be at work."""
        return self.versions.vacuum()

    def _read(self, name: str, keys: list[str], segments: list[int] | None) -> DataFrame:
        v, wanted = self.latest(), None
        if segments is not None:
            ids = self.spark.createDataFrame([(i,) for i in set(segments)], "segment_id long")
            wanted = {str(r["b"]) for r in ids.select(self._bucket().alias("b")).collect()}
        parts = v.parts.get(name, {})
        once = {b for b, fs in parts.items() if len(fs) == 1 and (wanted is None or b in wanted)}
        several = {b for b in parts if b not in once and (wanted is None or b in wanted)}
        # a bucket with one folder has each key once
        out = self.versions.read(v, name, once).unionByName(self.versions.read(v, name, several).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0").select(*keys, "n"))
        return out if segments is None else out.where(F.col("segment_id").isin(segments))

    def histograms(self, segments: list[int] | None = None) -> DataFrame:
        """hist.KEYS and n, of all segments or of a few, whose buckets alone are read then."""
        return self._read("weekly", hist.KEYS, segments)

    def cumulative(self, segments: list[int] | None = None) -> DataFrame:
        """segment_id, hour, speed_bin, n over all weeks."""
        return self._read("total", TOTAL_KEYS, segments)
