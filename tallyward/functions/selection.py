"""The n-th row of an order, without sorting the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyward.functions.reshape import quoted

CUTS = 64
SMALL = 10_000


def nth_row(df: DataFrame, keys: Sequence[str], index: int, cuts: int = CUTS, small: int = SMALL) -> Row | None:
    """The row at ``index`` (from 0) in the rising order of numeric ``keys``; None outside the table.

    Rows are counted between approximate quantiles of the first key, and the search goes on in the one range that
    holds the index, until at most ``small`` rows are left or the key is the same in all of them, when the next key
    takes over. Only the rows of the last range are sorted; the counts are exact, so the answer is too. Rows equal in
    every key are interchangeable. Nulls come first.
    """
    rest, left = df, index
    for key in keys:
        value = F.coalesce(quoted(key).cast("double"), F.lit(float("-inf")))
        while True:
            marks = [i / cuts for i in range(1, cuts)]
            facts = rest.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
                             F.percentile_approx(value, marks, 20 * cuts).alias("q")).first()
            if not 0 <= left < facts["n"]:
                return None
            if facts["n"] <= small:
                return rest.orderBy(*[quoted(k) for k in keys]).offset(left).limit(1).first()
            if facts["low"] == facts["high"] or facts["low"] != facts["low"]:  # one value, or nothing but NaN
                break
            # The largest value is no bound: behind it nothing would be left to tell apart.
            bounds = sorted({q for q in facts["q"] if q == q and not q >= facts["high"]} | {facts["low"]})
            place = reduce(lambda a, b: a + b, [(value > F.lit(b)).cast("int") for b in bounds])
            counts = {r["place"]: r["n"] for r in rest.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
            for p in range(len(bounds) + 1):
                if left < counts.get(p, 0):
                    rest = rest.where(place == p)
                    break
                left -= counts.get(p, 0)
    return rest.limit(1).first()
