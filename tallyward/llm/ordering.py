"""The next row in a total order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.session import written


def with_next(rows: DataFrame, order: list[str], descending: bool = False, around: bool = False) -> DataFrame:
    """The rows and ``next``, a struct of the ``order`` columns of the row that follows; nulls come first.

    ``rows`` should be narrow: they are dealt into ranges and written once. Rows find their next inside their
    range; the last of a range takes the first of the following range, of which there is one row per range. The
    last of all gets null, or with ``around`` the first of all. Without ``descending`` smaller rows come first.
    """
    keys = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    stored = written(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "order")
    here = F.struct(*order)
    lead = F.lead(here).over(Window.partitionBy("range").orderBy(*keys))
    edge: Column = (F.max if descending else F.min)(here)
    starts = stored.groupBy("range").agg(edge.alias("start"))
    by_range = Window.orderBy("range")
    follows = F.lead("start").over(by_range)
    if around:
        follows = F.coalesce(follows, F.first("start").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    following = starts.select("range", follows.alias("follows"))
    joined = stored.withColumn("next", lead).join(F.broadcast(following), "range")
    return joined.select(*rows.columns, F.coalesce("next", "follows").alias("next"))
