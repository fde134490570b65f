"""Integer and rounding helpers with the semantics of both engines' integer types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column | str, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b) if isinstance(b, int) else b)


def half_up(x: Column) -> Column:
    """Nearest integer, halves upward (also of negative numbers)."""
    return F.floor(x + F.lit(0.5))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.when(b != 0, a / b)
