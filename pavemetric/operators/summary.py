"""Means and spreads of histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import safe_div


def chosen(hist: DataFrame, segments: DataFrame | None = None, weeks: list[int] | None = None, hours: list[int] | None = None) -> DataFrame:
    """The part of a histogram in the given segments (segment_id), weeks and hours; None or an empty list: all."""
    if weeks:
        hist = hist.where(F.col("week").isin(weeks))
    if hours:
        hist = hist.where(F.col("hour").isin(hours))
    return hist.join(segments.select("segment_id").distinct(), "segment_id", "left_semi") if segments is not None else hist


def moments(n: Column, speed_bin: Column) -> list[Column]:
    """Exact integer sums: samples, and of m = 2 * bin - 1 and its square. A bin's mean speed is m / 7.2 m/s."""
    m = speed_bin.cast("long") * 2 - 1
    return [F.sum(n).alias("n"), F.sum(n * m).alias("sum_m"), F.sum(n * m * m).alias("sum_mm")]


def mean(n: Column, sum_m: Column) -> Column:
    return safe_div(sum_m.cast("double"), F.lit(7.2) * n)


def std_dev(n: Column, sum_m: Column, sum_mm: Column) -> Column:
    """Population standard deviation, from an exact numerator."""
    wide = lambda c: c.cast("decimal(19,0)")
    numerator = (wide(n) * wide(sum_mm) - wide(sum_m) * wide(sum_m)).cast("double")
    return safe_div(F.sqrt(numerator / F.lit(51.84)), n.cast("double"))


def summary(hist: DataFrame, by: list[str]) -> DataFrame:
    """n, mean and std_dev (m/s) of the histogram by some of segment_id, week, hour; no keys: one row over all of it."""
    sums = hist.groupBy(*by).agg(*moments(F.col("n"), F.col("speed_bin")))
    c = [F.col(x) for x in ("n", "sum_m", "sum_mm")]
    return sums.select(*by, "n", mean(c[0], c[1]).alias("mean"), std_dev(*c).alias("std_dev"))


def summary_with_hours(hist: DataFrame) -> DataFrame:
    """By segment and hour, and by segment over all hours (hour null), in one pass."""
    sums = hist.groupingSets([["segment_id"], ["segment_id", "hour"]], "segment_id", "hour").agg(*moments(F.col("n"), F.col("speed_bin")))
    c = [F.col(x) for x in ("n", "sum_m", "sum_mm")]
    return sums.select("segment_id", "hour", "n", mean(c[0], c[1]).alias("mean"), std_dev(*c).alias("std_dev"))


def normalized_summary(hist: DataFrame, by: list[str], mode: str = "fixed") -> DataFrame:
    """As summary, each segment and week weighing the same in the spread; the mean stays that of the samples.

    legacy divides the weighted squares by the count of samples instead of the sum of weights.
    """
    totals = hist.groupBy("segment_id", "week").agg(F.sum("n").alias("total"))
    weighted = hist.join(totals, ["segment_id", "week"]).withColumn("w", F.col("n") / F.col("total"))
    m = F.col("speed_bin").cast("long") * 2 - 1
    sums = weighted.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * m).alias("sum_m"), F.sum("w").alias("w"), F.sum(F.col("w") * m).alias("wm"), F.sum(F.col("w") * m * m).alias("wmm"))
    centre = F.col("sum_m") / F.col("n")
    squares = F.col("wmm") - 2 * centre * F.col("wm") + centre * centre * F.col("w")
    over = F.col("n") if mode == "legacy" else F.col("w")
    return sums.select(*by, "n", mean(F.col("n"), F.col("sum_m")).alias("mean"), F.sqrt(F.greatest(squares, F.lit(0.0)) / over / F.lit(51.84)).alias("std_dev"))


def type_statistics(samples: DataFrame) -> DataFrame:
    """street_type, count and sum of km/h bins of samples (street_type, speed), and their overall (street_type null)."""
    from ..functions.timebins import speed_bin

    binned = samples.withColumn("kmh", speed_bin(F.col("speed")))
    return binned.groupingSets([[], ["street_type"]], "street_type").agg(F.count("*").alias("n"), F.sum("kmh").alias("sum_kmh"))


def merged_type_statistics(stats: DataFrame) -> DataFrame:
    return stats.groupBy("street_type").agg(F.sum("n").alias("n"), F.sum("sum_kmh").alias("sum_kmh"))


def average_of_averages(stats: DataFrame) -> DataFrame:
    """street_type, parts and mean of the means of several type statistics, empty ones left out."""
    return stats.where("n > 0").groupBy("street_type").agg(F.count("*").alias("parts"), F.avg(F.col("sum_kmh") / F.col("n")).alias("mean_kmh"))
