"""Structured Streaming: GPS fixes to speed samples and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tiles
from ..functions.arith import idiv
from ..operators import hist
from ..operators.hist_store import HistStore
from ..operators.matching import MAX_SPEED, MIN_VEHICLES, local, normalised
from ..operators.network import MIN_SEGMENT
from . import vehicles
from .lines import write_lines  # noqa: F401

FIXES = "seq long, time_ms long, vehicle_id long, lon double, lat double, convert_to_local boolean"


def samples_of_events(events: DataFrame, jumpers: DataFrame, mode: str = "fixed") -> DataFrame:
    """Main samples and those of the jumpers between them: vehicle_id, segment_id, time_ms, speed, by_jumper."""
    # one pass over the stream: each event yields its own sample and its jumper's
    # the state operator's rows are columnar; a computed column makes them plain rows before they are shuffled
    events = events.withColumn("seconds", idiv(F.col("time_ms") - F.col("from_ms"), 1000))
    joined = events.join(jumpers.select(F.col("start_node_id").alias("from_node"), F.col("end_node_id").alias("to_node"), F.col("length").alias("jump"), "segments"), ["from_node", "to_node"], "left")
    pace = F.when(F.col("seconds") > 0, (F.col("jump") + 2 * MIN_SEGMENT) / F.col("seconds"))
    usable = pace.isNotNull() if mode == "legacy" else pace <= MAX_SPEED
    sample = lambda segment, speed, by: F.struct(segment.alias("segment_id"), speed.alias("speed"), F.lit(by).alias("by_jumper"))
    own = F.array(sample(F.col("segment_id"), F.col("speed"), False))
    more = F.when(usable, F.transform("segments", lambda s: sample(s, pace, True))).otherwise(F.filter(own, lambda x: F.lit(False)))
    return joined.withColumn("pace", pace).select("vehicle_id", "time_ms", F.explode(F.concat(own, F.coalesce(more, F.filter(own, lambda x: F.lit(False))))).alias("s")).select("vehicle_id", "s.segment_id", "time_ms", "s.speed", "s.by_jumper")


def speed_stream(fixes: DataFrame, areas: DataFrame, jumpers: DataFrame, lines_path: str, mode: str = "fixed", min_vehicles: int | None = MIN_VEHICLES, delay: str = "1 minute", hold_ms: int = vehicles.IDLE_MS, idle_ms: int | None = vehicles.IDLE_MS) -> DataFrame:
    """The streaming counterpart of matching.speed_samples; fixes that can't be used are left out (see matching.valid_fixes).

    Event time is the fix's own, before it is moved to a zone. A tile counts as open from its min_vehicles-th vehicle on, as long as
    so many have been there within idle_ms (None: for good); fixes wait hold_ms for that. See vehicles.sample_events.
    """
    timed = normalised(fixes).withColumn("event_time", F.timestamp_millis("time_ms"))
    tile = {"x": tiles.tile_x(F.col("lon"), tiles.AREA_ZOOM), "y": tiles.tile_y(F.col("lat"), tiles.AREA_ZOOM)}
    placed = local(timed, areas).withColumns(tile)
    return samples_of_events(vehicles.sample_events(placed, lines_path, mode, min_vehicles, delay, hold_ms, idle_ms), jumpers, mode)


def read_fixes(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of fixes from Parquet files, so many per micro-batch."""
    return spark.readStream.schema(FIXES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_samples(samples: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends samples to a Parquet table exactly once; without an interval, what is there now and then stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return samples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def write_histograms(samples: DataFrame, store: HistStore, stream: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Adds each micro-batch's histogram to a store, once, whatever is repeated; stream names it among others."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def put(batch: DataFrame, number: int) -> None:
        store.add_batch(hist.histogram(batch), stream, number)

    return samples.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows of the last micro-batch and rows per second."""
    last = query.lastProgress
    return {"input_rows": last["numInputRows"], "rows_per_second": last["processedRowsPerSecond"]} if last else {}
