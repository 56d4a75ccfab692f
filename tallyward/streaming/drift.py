"""PSI of event-time windows of a stream against a static reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.constants import CRITICAL_PSI, PSI_BINS
from tallyward.functions.reshape import as_double, long_numeric, quoted
from tallyward.operators.drift import slot, stability_index
from tallyward.session import written


def reference_bins(reference: DataFrame, columns: Sequence[str], bins: int = PSI_BINS) -> DataFrame:
    """(column, lo, hi, b0..): the reference's range and bin counts, one row per column."""
    values = long_numeric(reference, columns)
    ranges = values.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = values.join(F.broadcast(ranges), "column").select(
        "column", "lo", "hi", slot(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("slot")
    )
    return placed.groupBy("column", "lo", "hi").agg(
        *[F.count_if(F.col("slot") == i).alias(f"b{i}") for i in range(bins)]
    )


def stream_drift(
    events: DataFrame,
    reference: DataFrame,
    columns: Sequence[str],
    time: str,
    window: str = "1 day",
    delay: str = "1 hour",
    bins: int = PSI_BINS,
) -> DataFrame:
    """(window, column, n, psi, severity) for each closed window.

    The stream keeps ten counters per open window and column; the reference's bins are written once, before
    the stream starts, as one row per column, which bounds both broadcasts.
    """
    facts = written(reference_bins(reference, columns, bins), "reference-bins")
    values = events.select(
        F.col(time).cast("timestamp").alias("_time"), *[as_double(quoted(c)).alias(c) for c in columns]
    ).withWatermark("_time", delay)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns])
    placed = (
        values.select("_time", F.inline(pairs))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .join(F.broadcast(facts.select("column", "lo", "hi")), "column")
        .select("_time", "column", slot(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("slot"))
    )
    counted = placed.groupBy(F.window("_time", window), "column").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("slot") == i).alias(f"c{i}") for i in range(bins)]
    )
    index = stability_index([F.col(f"b{i}") for i in range(bins)], [F.col(f"c{i}") for i in range(bins)])
    return (
        counted.join(F.broadcast(facts), "column")
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "column",
            "n",
            F.when(F.col("hi") > F.col("lo"), index).otherwise(0.0).alias("psi"),
        )
        .withColumn("is_critical", F.col("psi") >= CRITICAL_PSI)
    )
