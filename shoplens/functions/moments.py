"""Aggregate expressions for moments that Spark has no ready function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corrected_skewness(value: Column) -> Column:
    """Bias-corrected sample skewness; NULL below three values, 0 when all values are equal."""
    n = F.count(value).cast("double")
    # Equal values have no spread: guard, since the plain skewness divides by it.
    plain = F.coalesce(F.skewness(value), F.lit(0.0))
    plain = F.when(F.max(value) == F.min(value), 0.0).otherwise(plain)
    return F.when(n >= 3, plain * F.sqrt(n * (n - 1)) / (n - 2))

