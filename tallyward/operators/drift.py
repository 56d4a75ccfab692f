"""Drift between a reference and a current table: PSI, KS and category tests, many columns at once.

All tests work on long frames (dataset, column, is_current, value), so any number of columns and of
dataset pairs shares the same shuffles. Per-series facts (ranges, totals, boundaries) have one row
per tested column; that bounds every broadcast below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.constants import (
    CRITICAL_KS,
    CRITICAL_PSI,
    DATASET_DRIFT_SHARE,
    DRIFT_P_VALUE,
    PSI_BINS,
    PSI_FLOOR,
)
from tallyward.functions.reshape import long_numeric, long_text, numeric_columns
from tallyward.functions.search import with_bucket
from tallyward.functions.stats import chi_square_p, kolmogorov_p

SERIES = ["dataset", "column"]
DISCRETE_LIMIT = 5


def _sides(reference: DataFrame, current: DataFrame, columns: Sequence[str], dataset: str, long) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            long(side, columns).select(
                F.lit(dataset).alias("dataset"), "column", F.lit(flag).alias("is_current"), "value"
            )
            for side, flag in ((reference, False), (current, True))
        ],
    )


def numeric_sides(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], dataset: str = ""
) -> DataFrame:
    """Long frame of the numeric values of both sides; nulls and non-numbers are skipped."""
    return _sides(reference, current, columns, dataset, long_numeric)


def text_sides(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], dataset: str = ""
) -> DataFrame:
    """Long frame of the values of both sides as text; nulls are skipped."""
    return _sides(reference, current, columns, dataset, long_text).where(F.col("value").isNotNull())


def slot(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value: below the range the first, from its top on the last."""
    inner = F.least(F.floor((value - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return F.when(value < lo, 0).when(value >= hi, bins - 1).otherwise(inner)


def base_ranges(sides: DataFrame) -> DataFrame:
    """Reference range per series; null where the reference is empty."""
    base = F.when(~F.col("is_current"), F.col("value"))
    return sides.groupBy(*SERIES).agg(F.min(base).alias("lo"), F.max(base).alias("hi"))


def stability_index(base: Sequence[Column], current: Sequence[Column]) -> Column:
    """Sum over bins of (c - b) ln(c / b) of the two sides' shares, from bin counts."""

    def shares(counts: Sequence[Column]) -> list[Column]:
        total = reduce(lambda a, b: a + b, counts)
        return [F.greatest(F.try_divide(c, total), F.lit(PSI_FLOOR)) for c in counts]

    terms = [(c - b) * F.log(c / b) for b, c in zip(shares(base), shares(current))]
    return F.round(reduce(lambda a, b: a + b, terms), 4)


def psi(sides: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per series over equal bins of the reference range.

    0 when a side is empty or the reference range has no width.
    """
    base = ~F.col("is_current")
    counts = (
        sides.join(F.broadcast(base_ranges(sides)), SERIES)
        .select(*SERIES, "is_current", "lo", "hi", slot(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("slot"))
        .groupBy(*SERIES)
        .agg(
            F.count_if(base).alias("n_base"),
            F.count_if(~base).alias("n_current"),
            (F.first("hi") > F.first("lo")).alias("has_width"),
            *[F.count_if(base & (F.col("slot") == i)).alias(f"b{i}") for i in range(bins)],
            *[F.count_if(~base & (F.col("slot") == i)).alias(f"c{i}") for i in range(bins)],
        )
    )
    index = stability_index(
        [F.col(f"b{i}") for i in range(bins)], [F.col(f"c{i}") for i in range(bins)]
    )
    comparable = (F.col("n_base") > 0) & (F.col("n_current") > 0) & F.col("has_width")
    return counts.select(*SERIES, F.when(comparable, index).otherwise(0.0).alias("psi"))


def value_counts(sides: DataFrame) -> DataFrame:
    """(series, value, n_base, n_current): combined before the shuffle, so hot values stay small."""
    return sides.groupBy(*SERIES, "value").agg(
        F.count_if(~F.col("is_current")).alias("n_base"), F.count_if("is_current").alias("n_current")
    )


def _bucket_count(df: DataFrame) -> int:
    """Buckets of the ordered pass: a power of two above the session's shuffle parallelism."""
    parallelism = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(max(1 << (2 * parallelism).bit_length(), 16), 8192)


def ks_from_counts(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Exact two-sample KS distance and asymptotic p-value per series.

    The order that the distance needs is built in two levels: approximate quantiles of the distinct
    values cut each series into buckets of even size, running sums are taken inside the buckets in
    parallel, and only one row per bucket enters the final running sum. No task ever sorts a series.
    """
    buckets = buckets or _bucket_count(counts)
    probabilities = [i / buckets for i in range(1, buckets)]
    totals = counts.groupBy(*SERIES).agg(
        F.percentile_approx("value", probabilities, max(10_000, 10 * buckets)).alias("bounds"),
        F.sum("n_base").alias("total_base"),
        F.sum("n_current").alias("total_current"),
    )
    located = with_bucket(counts.join(F.broadcast(totals), SERIES), "value", "bounds", buckets)
    running = Window.partitionBy(*SERIES, "bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )

    def gap(base: Column, current: Column) -> Column:
        return F.coalesce(F.try_divide(base, F.col("total_base")), F.lit(0.0)) - F.coalesce(
            F.try_divide(current, F.col("total_current")), F.lit(0.0)
        )

    inside = (
        located.select(*SERIES, "bucket", "value", "n_base", "n_current", "total_base", "total_current")
        .withColumn("gap", gap(F.sum("n_base").over(running), F.sum("n_current").over(running)))
        .groupBy(*SERIES, "bucket")
        .agg(
            F.max("gap").alias("highest"),
            F.min("gap").alias("lowest"),
            F.sum("n_base").alias("n_base"),
            F.sum("n_current").alias("n_current"),
            F.first("total_base").alias("total_base"),
            F.first("total_current").alias("total_current"),
        )
    )
    before = Window.partitionBy(*SERIES).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = gap(
        F.coalesce(F.sum("n_base").over(before), F.lit(0)), F.coalesce(F.sum("n_current").over(before), F.lit(0))
    )
    distance = (
        inside.withColumn("offset", offset)
        .groupBy(*SERIES)
        .agg(
            F.max(
                F.greatest(F.abs(F.col("offset") + F.col("highest")), F.abs(F.col("offset") + F.col("lowest")))
            ).alias("distance"),
            F.first("total_base").alias("n_base"),
            F.first("total_current").alias("n_current"),
        )
    )
    comparable = (F.col("n_base") > 0) & (F.col("n_current") > 0)
    p = kolmogorov_p(F.col("distance"), F.col("n_base"), F.col("n_current"))
    return distance.where(comparable).select(
        *SERIES, "distance", p.alias("p_value"), "n_base", "n_current"
    )


def ks_test(sides: DataFrame, buckets: int | None = None) -> DataFrame:
    return ks_from_counts(value_counts(sides), buckets)


def drift_check(sides: DataFrame, p_val: float = DRIFT_P_VALUE) -> DataFrame:
    """KS verdict per series with PSI alongside and a severity when there is drift."""
    found = F.col("p_value") < p_val
    severe = (F.col("distance") >= CRITICAL_KS) | (F.col("psi") >= CRITICAL_PSI)
    return (
        ks_test(sides)
        .join(psi(sides), SERIES)
        .select(
            *SERIES,
            found.alias("drift"),
            F.when(found & severe, "critical").when(found, "warning").alias("severity"),
            F.round("distance", 4).alias("ks_distance"),
            F.round("p_value", 4).alias("p_value"),
            "psi",
        )
    )


def drift_alert(verdicts: DataFrame, model_version_id: str, detected_at: str) -> DataFrame:
    """Alert rows, only for series that drifted."""
    return verdicts.where("drift").select(
        F.lit(model_version_id).alias("model_version_id"),
        F.lit("data_drift").alias("drift_type"),
        "severity",
        F.array("column").alias("affected_features"),
        F.struct("ks_distance", "p_value", "psi").alias("detection_metrics"),
        F.lit("open").alias("status"),
        F.lit(detected_at).cast("timestamp_ntz").alias("detected_at"),
    )


def categories_from_counts(counts: DataFrame) -> DataFrame:
    """Category test per series: current counts against the scaled reference counts.

    Two categories use the two-proportion z-test (its square as a chi-square with one degree of
    freedom), more use Pearson's chi-square. A category unknown to the reference makes the statistic
    infinite.
    """
    totals = counts.groupBy(*SERIES).agg(
        F.sum("n_base").alias("total_base"),
        F.sum("n_current").alias("total_current"),
        F.count(F.lit(1)).alias("categories"),
    )
    expected = F.col("n_base") * F.col("total_current") / F.col("total_base")
    observed = F.col("n_current").cast("double")
    term = F.when(
        F.col("n_base") == 0, F.when(F.col("n_current") == 0, 0.0).otherwise(F.lit(float("inf")))
    ).otherwise((observed - expected) * (observed - expected) / expected)
    pooled = (F.col("n_base") + F.col("n_current")) / (F.col("total_base") + F.col("total_current"))
    spread = pooled * (1 - pooled) * (1 / F.col("total_base") + 1 / F.col("total_current"))
    difference = F.col("n_base") / F.col("total_base") - F.col("n_current") / F.col("total_current")
    squared_z = F.coalesce(F.try_divide(difference * difference, spread), F.lit(0.0))
    tested = (
        counts.join(F.broadcast(totals), SERIES)
        .where((F.col("total_base") > 0) & (F.col("total_current") > 0))
        .groupBy(*SERIES)
        .agg(
            F.sum(term).alias("pearson"),
            F.max(squared_z).alias("squared_z"),
            F.first("categories").alias("categories"),
        )
    )
    binary = F.col("categories") <= 2
    return tested.select(
        *SERIES,
        F.when(binary, "z").otherwise("chisquare").alias("test"),
        F.when(binary, F.col("squared_z")).otherwise(F.col("pearson")).alias("statistic"),
        F.greatest(F.col("categories") - 1, F.lit(0)).alias("dof"),
    ).withColumn("p_value", chi_square_p(F.col("statistic"), F.col("dof").cast("double")))


def categorical_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    p_val: float = DRIFT_P_VALUE,
    dataset: str = "",
) -> DataFrame:
    counts = value_counts(text_sides(reference, current, columns, dataset))
    return categories_from_counts(counts).withColumn("drift", F.col("p_value") < p_val)


def shared_columns(reference: DataFrame, current: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns that both sides have; times are not tested."""
    common = [c for c in reference.columns if c in current.columns]
    numbers = set(numeric_columns(reference)) & set(numeric_columns(current))
    kinds = (T.StringType, T.BooleanType, T.NumericType)
    testable = [
        c
        for c in common
        if isinstance(reference.schema[c].dataType, kinds) and isinstance(current.schema[c].dataType, kinds)
    ]
    return [c for c in testable if c in numbers], [c for c in testable if c not in numbers]


def _column_tests(
    numeric: DataFrame | None, textual: DataFrame | None, p_val: float, discrete_limit: int
) -> DataFrame:
    """KS for continuous columns, category tests for text and for numbers with few values."""
    parts = []
    category_counts = [value_counts(textual)] if textual is not None else []
    if numeric is not None:
        counts = value_counts(numeric)
        distinct = counts.groupBy(*SERIES).agg(F.count_if(F.col("n_base") > 0).alias("base_values"))
        flagged = counts.join(F.broadcast(distinct), SERIES)
        few = F.col("base_values") <= discrete_limit
        parts.append(
            ks_from_counts(flagged.where(~few).select(counts.columns)).select(
                *SERIES, F.lit("ks").alias("test"), "p_value"
            )
        )
        category_counts.append(
            flagged.where(few).select(*SERIES, F.col("value").cast("string").alias("value"), "n_base", "n_current")
        )
    merged = reduce(DataFrame.unionByName, category_counts)
    parts.append(categories_from_counts(merged).select(*SERIES, "test", "p_value"))
    return reduce(DataFrame.unionByName, parts).select(
        *SERIES,
        (F.col("p_value") < p_val).alias("drift_detected"),
        F.round("p_value", 4).alias("drift_score"),
        "test",
    )


def column_drift(
    reference: DataFrame,
    current: DataFrame,
    p_val: float = DRIFT_P_VALUE,
    discrete_limit: int = DISCRETE_LIMIT,
    dataset: str = "",
) -> DataFrame:
    """Test result of each column that both sides have."""
    return drift_of_pairs([(dataset, reference, current)], p_val, discrete_limit)


def drift_of_pairs(
    pairs: Iterable[tuple[str, DataFrame, DataFrame]],
    p_val: float = DRIFT_P_VALUE,
    discrete_limit: int = DISCRETE_LIMIT,
) -> DataFrame:
    """Column tests of several (name, reference, current) pairs in the same shuffles."""
    numeric, textual = [], []
    for name, reference, current in pairs:
        numbers, texts = shared_columns(reference, current)
        if numbers:
            numeric.append(numeric_sides(reference, current, numbers, name))
        if texts:
            textual.append(text_sides(reference, current, texts, name))
    if not numeric and not textual:
        raise ValueError("no column can be compared")
    return _column_tests(
        reduce(DataFrame.unionByName, numeric) if numeric else None,
        reduce(DataFrame.unionByName, textual) if textual else None,
        p_val,
        discrete_limit,
    )


def dataset_drift(columns: DataFrame, share_limit: float = DATASET_DRIFT_SHARE) -> DataFrame:
    """Verdict per dataset from its column tests."""
    share = F.col("drifted_columns") / F.col("total_columns")
    return (
        columns.groupBy("dataset")
        .agg(
            F.count_if("drift_detected").alias("drifted_columns"),
            F.count(F.lit(1)).alias("total_columns"),
            # Bounded by the number of columns of the table.
            F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("column")))).alias(
                "affected_features"
            ),
        )
        .select(
            "dataset",
            (share >= share_limit).alias("dataset_drift"),
            "drifted_columns",
            "total_columns",
            F.round(share, 4).alias("share_drifted"),
            "affected_features",
        )
    )


def dataset_drift_alert(verdicts: DataFrame, model_version_id: str) -> DataFrame:
    """A warning for each drifted dataset."""
    return verdicts.where("dataset_drift").select(
        F.lit(model_version_id).alias("model_version_id"),
        F.lit("data_drift").alias("drift_type"),
        F.lit("warning").alias("severity"),
        "affected_features",
        "drifted_columns",
        "share_drifted",
    )


@dataclass(frozen=True)
class MonitorConfig:
    config_id: str
    model_version_id: str
    reference: str | None
    current: str | None
    is_active: bool = True


@dataclass
class _Sweep:
    """The dataset pairs of active configurations, which configuration checks which pair, and why others are left out."""

    pairs: dict[str, tuple[str, DataFrame, DataFrame]]
    rows: list[tuple[str, str, str]]
    skipped: list[tuple[str, str]]


def _prepared(configs: Sequence[MonitorConfig], load: Callable[[str], DataFrame]) -> _Sweep:
    frames: dict[str, DataFrame | str] = {}

    def loaded(name: str) -> DataFrame | str:
        """A dataset, or why it cannot be read."""
        if name not in frames:
            try:
                frames[name] = load(name)
            except Exception as error:  # noqa: BLE001 - an unreadable dataset skips its configurations, with its reason
                frames[name] = f"{name}: {type(error).__name__}: {str(error).strip().splitlines()[0] if str(error).strip() else ''}"
        return frames[name]

    sweep = _Sweep({}, [], [])
    for config in (c for c in configs if c.is_active):
        if not (config.reference and config.current):
            sweep.skipped.append((config.config_id, "no reference or no current dataset"))
            continue
        reference, current = loaded(config.reference), loaded(config.current)
        unread = [x for x in (reference, current) if isinstance(x, str)]
        if unread:
            sweep.skipped.append((config.config_id, "; ".join(dict.fromkeys(unread))))
        elif not any(shared_columns(reference, current)):
            sweep.skipped.append((config.config_id, "no column in common"))
        else:
            name = f"{config.reference}\u0001{config.current}"
            sweep.pairs[name] = (name, reference, current)
            sweep.rows.append((config.config_id, config.model_version_id, name))
    return sweep


def skipped_configs(spark: SparkSession, configs: Sequence[MonitorConfig], load: Callable[[str], DataFrame]) -> DataFrame:
    """(config_id, reason) of the active configurations that a sweep leaves out before any test."""
    return spark.createDataFrame(_prepared(configs, load).skipped, "config_id string, reason string")


def monitor_sweep(
    configs: Sequence[MonitorConfig], load: Callable[[str], DataFrame], **options
) -> tuple[DataFrame, DataFrame]:
    """(alerts, summary) over every active configuration.

    Configurations that name the same pair of datasets share one test, and all pairs share the same
    shuffles. A configuration without both datasets, with a dataset that cannot be loaded or with an
    empty side is skipped; :func:`skipped_configs` tells why.
    """
    active = [c for c in configs if c.is_active]
    sweep = _prepared(configs, load)
    pairs, rows = sweep.pairs, sweep.rows
    spark = next(iter(pairs.values()))[1].sparkSession if pairs else SparkSession.active()
    known = spark.createDataFrame(rows, "config_id string, model_version_id string, dataset string")
    if pairs:
        tests = drift_of_pairs(pairs.values(), **options)
    else:  # nothing can be checked: no alerts, and a summary that says so
        tests = spark.createDataFrame([], "dataset string, column string, drift_detected boolean")
    verdicts = dataset_drift(tests)
    checked = known.join(F.broadcast(verdicts), "dataset")
    alerts = checked.where("dataset_drift").select(
        "model_version_id",
        "config_id",
        F.lit("data_drift").alias("drift_type"),
        F.when(F.col("share_drifted") >= DATASET_DRIFT_SHARE, "critical").otherwise("warning").alias("severity"),
        "affected_features",
        "drifted_columns",
        "share_drifted",
    )
    summary = checked.agg(
        F.lit(len(active)).cast("bigint").alias("active_configs"),
        F.count(F.lit(1)).alias("checked"),
        F.count_if("dataset_drift").alias("alerts_raised"),
        (F.lit(len(active)) - F.count(F.lit(1))).alias("skipped"),
    )
    return alerts, summary


def list_alerts(alerts: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """Newest alerts, optionally of one status."""
    if status:
        alerts = alerts.where(F.col("status") == status)
    return alerts.orderBy(F.desc("detected_at"), "id").limit(limit)
