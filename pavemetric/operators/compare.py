"""Comparison of two summaries by a t test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import half_up, safe_div

# One-sided critical values of Student's t. Columns: probabilities 0.90, 0.95, 0.975, 0.99, 0.995 and 0.999; rows: 1 to 35
# degrees of freedom, the last one for more.
T_CRIT = [
    [3.078, 6.314, 12.706, 31.821, 63.657, 318.313],
    [1.886, 2.920, 4.303, 6.965, 9.925, 22.327],
    [1.638, 2.353, 3.182, 4.541, 5.841, 10.215],
    [1.533, 2.132, 2.776, 3.747, 4.604, 7.173],
    [1.476, 2.015, 2.571, 3.365, 4.032, 5.893],
    [1.440, 1.943, 2.447, 3.143, 3.707, 5.208],
    [1.415, 1.895, 2.365, 2.998, 3.499, 4.782],
    [1.397, 1.860, 2.306, 2.896, 3.355, 4.499],
    [1.383, 1.833, 2.262, 2.821, 3.250, 4.296],
    [1.372, 1.812, 2.228, 2.764, 3.169, 4.143],
    [1.363, 1.796, 2.201, 2.718, 3.106, 4.024],
    [1.356, 1.782, 2.179, 2.681, 3.055, 3.929],
    [1.350, 1.771, 2.160, 2.650, 3.012, 3.852],
    [1.345, 1.761, 2.145, 2.624, 2.977, 3.787],
    [1.341, 1.753, 2.131, 2.602, 2.947, 3.733],
    [1.337, 1.746, 2.120, 2.583, 2.921, 3.686],
    [1.333, 1.740, 2.110, 2.567, 2.898, 3.646],
    [1.330, 1.734, 2.101, 2.552, 2.878, 3.610],
    [1.328, 1.729, 2.093, 2.539, 2.861, 3.579],
    [1.325, 1.725, 2.086, 2.528, 2.845, 3.552],
    [1.323, 1.721, 2.080, 2.518, 2.831, 3.527],
    [1.321, 1.717, 2.074, 2.508, 2.819, 3.505],
    [1.319, 1.714, 2.069, 2.500, 2.807, 3.485],
    [1.318, 1.711, 2.064, 2.492, 2.797, 3.467],
    [1.316, 1.708, 2.060, 2.485, 2.787, 3.450],
    [1.315, 1.706, 2.056, 2.479, 2.779, 3.435],
    [1.314, 1.703, 2.052, 2.473, 2.771, 3.421],
    [1.313, 1.701, 2.048, 2.467, 2.763, 3.408],
    [1.311, 1.699, 2.045, 2.462, 2.756, 3.396],
    [1.310, 1.697, 2.042, 2.457, 2.750, 3.385],
    [1.309, 1.696, 2.040, 2.453, 2.744, 3.375],
    [1.309, 1.694, 2.037, 2.449, 2.738, 3.365],
    [1.308, 1.692, 2.035, 2.445, 2.733, 3.356],
    [1.307, 1.691, 2.032, 2.441, 2.728, 3.348],
    [1.306, 1.690, 2.030, 2.438, 2.724, 3.340],
]
#: From so many samples on both sides the last row holds.
ROWS, LARGE = 35, 35
#: Column by level; legacy reads 0.995 for P_999.
LEVELS = {"fixed": {"P_90": 0, "P_95": 1, "P_975": 2, "P_99": 3, "P_999": 5}, "legacy": {"P_90": 0, "P_95": 1, "P_975": 2, "P_99": 3, "P_999": 4}}


def critical_values(level: str = "P_95", mode: str = "fixed") -> list[float]:
    """Of 1 to ROWS degrees of freedom."""
    return [row[LEVELS[mode][level]] for row in T_CRIT]


def degrees_row(n1: Column, n2: Column, sd1: Column, sd2: Column) -> Column:
    """Row of the table, from 0: the last for two large samples, else by Satterthwaite's formula."""
    v1, v2 = sd1 * sd1 / n1, sd2 * sd2 / n2
    under = safe_div(v1 * v1, n1 - 1.0), safe_div(v2 * v2, n2 - 1.0)
    df = safe_div((v1 + v2) * (v1 + v2), under[0] + under[1])
    row = F.greatest(F.lit(0), F.least(F.lit(ROWS - 1), half_up(df).cast("int") - 1))
    return F.when((n1 > LARGE) & (n2 > LARGE), ROWS - 1).when(df.isNull(), 0).otherwise(row)


def compare(first: DataFrame, second: DataFrame, by: list[str], level: str = "P_95", mode: str = "fixed") -> DataFrame:
    """Two summaries (by, n, mean, std_dev) side by side, for keys that both have.

    mean_size, difference (first - second), difference_pct (a share of the first), combined_sd, t_stat, t_crit and
    significant. fixed: |t| over the critical value. legacy: the first summary's count and spread in place of the
    second's, and true for t <= 0 or none.
    """
    names = ("n", "mean", "std_dev")
    both = first.select(*by, *[F.col(c).alias(f"{c}1") for c in names]).join(second.select(*by, *[F.col(c).alias(f"{c}2") for c in names]), by)
    n1, n2, m1, m2, s1, s2 = (F.col(c) for c in ("n1", "n2", "mean1", "mean2", "std_dev1", "std_dev2"))
    other_n, other_s = (n1, s1) if mode == "legacy" else (n2, s2)
    values = F.array(*[F.lit(v) for v in critical_values(level, mode)])
    spread = F.sqrt(s1 * s1 / n1 + other_s * other_s / n2)
    out = both.withColumn("difference", m1 - m2).withColumn("combined_sd", spread)
    out = out.withColumn("t_stat", safe_div(F.col("difference"), F.col("combined_sd"))).withColumn("t_crit", F.element_at(values, degrees_row(n1, n2, s1, s2) + 1))
    t = F.col("t_stat")
    decision = F.when(t > 0, t > F.col("t_crit")).otherwise(True) if mode == "legacy" else F.coalesce(F.abs(t) > F.col("t_crit"), F.lit(False))
    return out.select(*by, "n1", "n2", ((n1 + other_n) / 2.0).alias("mean_size"), "difference", safe_div(F.col("difference"), m1).alias("difference_pct"), "combined_sd", "t_stat", "t_crit", decision.alias("significant"))
