"""Speed histograms by segment, week and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timebins as tb

KEYS = ["segment_id", "week", "hour", "speed_bin"]


def histogram(samples: DataFrame) -> DataFrame:
    """segment_id, week, hour, speed_bin, n of samples (segment_id, time_ms, speed)."""
    binned = samples.select("segment_id", tb.week(F.col("time_ms")).alias("week"), tb.hour_of_week(F.col("time_ms")).alias("hour"), tb.speed_bin(F.col("speed")).alias("speed_bin"))
    return binned.groupBy(*KEYS).agg(F.count("*").alias("n"))


def merge(*hists: DataFrame) -> DataFrame:
    """One histogram of several."""
    out = hists[0].select(*KEYS, "n")
    for h in hists[1:]:
        out = out.unionByName(h.select(*KEYS, "n"))
    return out.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def cumulative(hist: DataFrame) -> DataFrame:
    """Histogram of each segment over all weeks."""
    return hist.groupBy("segment_id", "hour", "speed_bin").agg(F.sum("n").alias("n"))


def weeks(hist: DataFrame) -> DataFrame:
    return hist.select("week").distinct()


def has_week(hist: DataFrame, week: int) -> DataFrame:
    """One row: whether the week has samples."""
    return hist.where(F.col("week") == week).limit(1).agg((F.count("*") > 0).alias("found"))


def size(hist: DataFrame) -> DataFrame:
    """One row: histograms (segments and weeks) and samples."""
    return hist.groupBy("segment_id", "week").agg(F.sum("n").alias("n")).agg(F.count("*").alias("histograms"), F.sum("n").alias("samples"))


def packed(hist: DataFrame) -> DataFrame:
    """segment_id, week and a map from packed bin to count, for export. Samples without a time have the bins from -1 down."""
    number = F.coalesce(tb.pack_bin(F.col("hour"), F.col("speed_bin")), -1 - F.col("speed_bin"))
    entry = F.struct(number.alias("bin"), "n")
    return hist.groupBy("segment_id", "week").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("bins"))


def unpacked(bins: DataFrame) -> DataFrame:
    """The histogram of such maps."""
    flat = bins.select("segment_id", "week", F.explode("bins").alias("bin", "n"))
    timed = F.col("bin") >= 0
    hour, speed_bin = F.when(timed, tb.packed_hour(F.col("bin"))), F.when(timed, tb.packed_speed_bin(F.col("bin"))).otherwise(-1 - F.col("bin"))
    return flat.select("segment_id", "week", hour.alias("hour"), speed_bin.alias("speed_bin"), "n")
