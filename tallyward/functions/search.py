"""Locating values between sorted boundaries held in an array column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_bucket(df: DataFrame, value: str, bounds: str, size: int, name: str = "bucket") -> DataFrame:
    """Add the number of boundaries that are <= value, by binary search in generated code.

    ``bounds`` is a sorted array of at most ``size`` values. Each halving step is its own
    projection, so the position is computed once per step.
    """
    out = df.withColumn(name, F.lit(0))
    step = 1 << max(size.bit_length() - 1, 0)
    while step:
        reach = F.col(name) + step
        fits = (reach <= F.size(bounds)) & (F.try_element_at(F.col(bounds), reach) <= F.col(value))
        out = out.withColumn(name, F.when(fits, reach).otherwise(F.col(name)))
        step >>= 1
    return out
