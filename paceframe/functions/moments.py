"""Sample statistics that differ from Spark's population versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness_sample(c: str) -> Column:
    """Bias-corrected skewness; null below three values, 0 for a constant."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(corrected, F.lit(0.0)))


def kurtosis_sample(c: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values, 0 for a constant."""
    n = F.count(c).cast("double")
    scaled = (n - 1) * ((n + 1) * F.kurtosis(c) + 6)
    corrected = scaled / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows with both values; null when one side is constant.

    Spark's ``corr`` raises a division by zero there.
    """
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
