"""Calendar buckets and speed bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import half_up, idiv

# A time below the limit is in seconds; weeks begin on Monday 1970-01-05; bins are km/h, capped.
SECONDS_LIMIT = 15_000_000_000
HOUR_MS, WEEK_MS, FIRST_MONDAY_MS = 3_600_000, 604_800_000, 345_600_000
HOURS, MAX_SPEED_BIN, BIN_STRIDE, KMH = 168, 119, 168, 3.6


def to_ms(time: Column) -> Column:
    """Epoch milliseconds of a time in seconds or milliseconds."""
    return F.when(time < SECONDS_LIMIT, time * 1000).otherwise(time)


def hour_of_week(time: Column) -> Column:
    """Hour since Monday 00:00 UTC, 0 to 167."""
    return F.pmod(idiv(to_ms(time), HOUR_MS) - 96, F.lit(HOURS)).cast("int")


def week(time: Column) -> Column:
    """Whole weeks since Monday 1970-01-05 00:00 UTC."""
    return idiv(to_ms(time) - FIRST_MONDAY_MS, WEEK_MS).cast("int")


def week_start(week: Column) -> Column:
    """First millisecond of a week."""
    return F.lit(FIRST_MONDAY_MS) + week.cast("long") * WEEK_MS


def speed_bin(speed: Column) -> Column:
    """km/h bin of a speed in m/s. NaN is in the last bin, as the greatest number; so is null."""
    return half_up(F.least(speed * F.lit(KMH), F.lit(float(MAX_SPEED_BIN)))).cast("int")


def bin_mean(speed_bin: Column, shift: float = 0.5) -> Column:
    """Speed in m/s that a bin stands for."""
    return (speed_bin - F.lit(shift)) / F.lit(KMH)


def pack_bin(hour: Column, speed_bin: Column) -> Column:
    """Hour and speed bin as one number."""
    return (hour * BIN_STRIDE + speed_bin).cast("int")


def packed_speed_bin(packed: Column) -> Column:
    return (packed % BIN_STRIDE).cast("int")


def packed_hour(packed: Column) -> Column:
    return idiv(packed - packed % BIN_STRIDE, BIN_STRIDE).cast("int")


def week_hour_label(week: Column, hour: Column) -> Column:
    return F.concat_ws("_", week.cast("string"), hour.cast("string"))
