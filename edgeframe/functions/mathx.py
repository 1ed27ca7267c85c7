"""Mathematical functions that Spark lacks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _poly(x: Column, *high_first: float) -> Column:
    out = F.lit(high_first[0])
    for c in high_first[1:]:
        out = out * x + c
    return out


# Abramowitz and Stegun 7.1.26.
ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592, 0.0)
ERF_P = 0.3275911
# Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
ACKLAM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
ACKLAM_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
ACKLAM_LOW = 0.02425


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    y = 1 - _poly(t, *ERF) * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def phi(x: Column) -> Column:
    """Standard normal distribution function."""
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


def with_phi_inv(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Adds the inverse of ``phi`` at ``p``, with one Halley step; infinite at 0 and 1.

    Each step is a column of its own, so that no expression repeats the ones before it.
    """
    tail = lambda q: _poly(q, *ACKLAM_C) / _poly(q, *ACKLAM_D)
    c = F.col
    df = df.withColumn("__raw", p).withColumn("__p", F.least(F.greatest(c("__raw"), F.lit(1e-300)), F.lit(1 - 1e-16)))
    df = df.withColumn("__q", c("__p") - 0.5).withColumn("__low", F.sqrt(-2 * F.log("__p"))).withColumn("__high", F.sqrt(-2 * F.log(1 - c("__p")))).withColumn("__qq", c("__q") * c("__q"))
    middle = _poly(c("__qq"), *ACKLAM_A) * c("__q") / _poly(c("__qq"), *ACKLAM_B)
    df = df.withColumn("__x", F.when(c("__p") < ACKLAM_LOW, tail(c("__low"))).when(c("__p") > 1 - ACKLAM_LOW, -tail(c("__high"))).otherwise(middle))
    df = df.withColumn("__e", phi(c("__x")) - c("__p")).withColumn("__u", c("__e") * F.sqrt(F.lit(2 * 3.141592653589793)) * F.exp(c("__x") * c("__x") / 2))
    df = df.withColumn(out, F.when(c("__raw") <= 0, F.lit(float("-inf"))).when(c("__raw") >= 1, F.lit(float("inf"))).otherwise(c("__x") - c("__u") / (1 + c("__x") * c("__u") / 2)))
    return df.drop("__raw", "__p", "__q", "__low", "__high", "__qq", "__x", "__e", "__u")


def wilson_low(wins_pct: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the win rate in percent."""
    p, m = wins_pct / 100, F.nullif(n.cast("double"), F.lit(0.0))
    low = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(low, F.lit(0.0)) * 100).otherwise(0.0)


def p_one_sided(t: Column) -> Column:
    return F.greatest(F.least(1 - phi(t), F.lit(1.0)), F.lit(0.0))
