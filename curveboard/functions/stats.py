"""Column formulas for correlations and their uncertainty."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def fisher_interval(r: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Confidence bounds of a Pearson r by the Fisher z transform."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    clipped = F.greatest(F.lit(-0.999999999), F.least(F.lit(0.999999999), r))
    half = F.lit(z) / F.sqrt(n - F.lit(3.0))
    return F.tanh(F.atanh(clipped) - half), F.tanh(F.atanh(clipped) + half)


def pearson_standard_error(r: Column, n: Column) -> Column:
    return (F.lit(1.0) - r * r) / F.sqrt(n - F.lit(3.0))


def half_width(low: Column, high: Column) -> Column:
    return (high - low) / 2


# Fixed value: two-sided 5 % point of the normal distribution.
NORMAL_5_PERCENT = 1.959963984540054


def kendall_z(tau: Column, n: Column) -> Column:
    """Normal approximation of Kendall's tau under independence."""
    n = n.cast("double")
    return 3.0 * tau * F.sqrt(n * (n - 1)) / F.sqrt(2.0 * (2.0 * n + 5.0))


def pearson_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson r; null where it is perfect or n is below 3."""
    return F.try_divide(r * F.sqrt(F.greatest(n - F.lit(2.0), F.lit(0.0))), F.sqrt(1.0 - r * r))
