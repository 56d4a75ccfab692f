"""Quality rules over event-time windows of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.reshape import stack_rows
from tallyward.operators.quality import ROW_RULES, QualityRule, _configuration_error, _violation


def stream_quality(
    events: DataFrame, rules: Sequence[QualityRule], time: str, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """One result row per closed window and row-level rule.

    State is one row of counters per open window, combined before the shuffle. Uniqueness is left
    out, since it would have to keep every value of a window.
    """
    rules = [r for r in rules if r.active]
    for rule in rules:
        if rule.rule_type not in ROW_RULES:
            raise ValueError(f"'{rule.rule_type}' cannot run on a stream")
        problem = _configuration_error(events, rule, False)
        if problem:
            raise ValueError(problem)
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    counted = timed.groupBy(F.window("_time", window)).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_violation(events, r)).alias(f"failed_{i}") for i, r in enumerate(rules)],
    )
    rows = [
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"failed_{i}").alias("records_failed"))
        for i, r in enumerate(rules)
    ]
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.col("n").alias("records_evaluated"),
        stack_rows(rows),
    ).withColumn("status", F.when(F.col("records_failed") == 0, "passed").otherwise("failed"))
