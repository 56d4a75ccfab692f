"""Group fairness metrics from one aggregate per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.constants import BIAS_FAIL_GAP, BIAS_WARN_GAP
from tallyward.functions.reshape import quoted
from tallyward.functions.stats import ratio


def _text(df: DataFrame, column: str) -> Column:
    """Value as text; a missing value reads ``None`` and forms its own group."""
    value = quoted(column).cast("string")
    if isinstance(df.schema[column].dataType, T.BooleanType):
        value = F.initcap(value)
    return F.coalesce(value, F.lit("None"))


def binarize(df: DataFrame, column: str, positive: object = "1") -> Column:
    """1 where the value's text equals the positive label's text, else 0."""
    return (_text(df, column) == F.lit(str(positive))).cast("int")


def group_metrics(
    df: DataFrame,
    attributes: str | Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    positive: object = "1",
) -> DataFrame:
    """Counts and rates per (attribute, group), several attributes in the same pass."""
    attributes = [attributes] if isinstance(attributes, str) else list(attributes)
    for needed in (*attributes, label, prediction):
        if needed not in df.columns:
            raise ValueError(f"column '{needed}' not found")
    groups = F.array(
        *[F.struct(F.lit(a).alias("attribute"), _text(df, a).alias("group")) for a in attributes]
    )
    actual, predicted = F.col("actual") == 1, F.col("predicted") == 1
    counts = (
        df.select(
            F.inline(groups),
            binarize(df, label, positive).alias("actual"),
            binarize(df, prediction, positive).alias("predicted"),
        )
        .groupBy("attribute", "group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(actual).alias("positives"),
            F.count_if(predicted).alias("selected"),
            F.count_if(actual & predicted).alias("hits"),
        )
    )
    n, positives, selected, hits = (F.col(c) for c in ("n", "positives", "selected", "hits"))
    return counts.select(
        "attribute",
        "group",
        "n",
        ratio(selected, n).alias("selection_rate"),
        ratio(hits, positives).alias("true_positive_rate"),
        ratio(selected - hits, n - positives).alias("false_positive_rate"),
        ratio(hits, selected).alias("precision"),
    )


def _rate(metrics: DataFrame, column: str) -> DataFrame:
    return metrics.select("attribute", "group", F.round(column, 4).alias(column))


def demographic_parity(metrics: DataFrame) -> DataFrame:
    return _rate(metrics, "selection_rate")


def equal_opportunity(metrics: DataFrame) -> DataFrame:
    return _rate(metrics, "true_positive_rate")


def predictive_parity(metrics: DataFrame) -> DataFrame:
    return _rate(metrics, "precision")


def _spread(column: str) -> Column:
    return F.max(column) - F.min(column)


def gaps(metrics: DataFrame) -> DataFrame:
    """Demographic parity gap, and the larger of the TPR and FPR gaps, per attribute."""
    return metrics.groupBy("attribute").agg(
        F.round(_spread("selection_rate"), 4).alias("demographic_parity_gap"),
        F.round(
            F.greatest(_spread("true_positive_rate"), _spread("false_positive_rate")), 4
        ).alias("equal_opportunity_gap"),
        F.count(F.lit(1)).alias("groups"),
    )


def bias_verdict(dp_gap: Column, eo_gap: Column) -> Column:
    """fail, warning or pass by the larger rounded gap."""
    worst = F.greatest(dp_gap, eo_gap)
    return F.when(worst > BIAS_FAIL_GAP, "fail").when(worst > BIAS_WARN_GAP, "warning").otherwise("pass")


def bias_test(
    df: DataFrame,
    attributes: str | Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    positive: object = "1",
) -> tuple[DataFrame, DataFrame]:
    """(per-group metrics, per-attribute verdict with summary text)."""
    metrics = group_metrics(df, attributes, label, prediction, positive)
    dp, eo = F.col("demographic_parity_gap"), F.col("equal_opportunity_gap")
    verdict = gaps(metrics).withColumn("verdict", bias_verdict(dp, eo))
    return metrics, verdict.withColumn(
        "summary",
        F.concat(F.lit("Verdict="), "verdict", F.lit(" (DP gap "), dp, F.lit(", EO gap "), eo, F.lit(")")),
    )
