"""Statistical expressions used by the drift and fairness operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def kolmogorov_p(distance: Column, n_left: Column, n_right: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value.

    Large arguments use the alternating series, small ones the theta-function form of the same
    distribution, since the series does not converge near 0.
    """
    n_left, n_right = n_left.cast("double"), n_right.cast("double")
    lam = F.sqrt(n_left * n_right / (n_left + n_right)) * distance
    tail = sum(
        (F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam) for k in range(1, 6)),
        F.lit(0.0),
    )
    body = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * sum(
        (F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8.0) / (lam * lam)) for k in range(1, 6)),
        F.lit(0.0),
    )
    p = F.when(distance <= 0, F.lit(1.0)).when(lam < 1.0, body).otherwise(tail)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """Chi-square survival function. Applied to one row per tested column, never to data rows.

    The functions are local so that they travel to the executors by value.
    """

    def upper_gamma(a: float, x: float) -> float:
        """Regularised upper incomplete gamma Q(a, x)."""
        if x <= 0:
            return 1.0
        if math.isinf(x):
            return 0.0
        front = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1.0 / a
            n = a
            while term > total * 1e-15:
                n += 1
                term *= x / n
                total += term
            return max(0.0, 1.0 - front * total)
        b = x + 1 - a
        c, d = 1e300, 1.0 / b
        h = d
        for i in range(1, 100_000):
            an = -i * (i - a)
            b += 2
            d = 1.0 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return min(1.0, front * h)

    @F.pandas_udf(T.DoubleType())
    def survival(values: pd.Series, freedom: pd.Series) -> pd.Series:
        out = [1.0 if k < 1 else upper_gamma(k / 2.0, s / 2.0) for s, k in zip(values, freedom)]
        return pd.Series(out, dtype="float64")

    return survival(statistic, dof)
