"""Catalog assets as DataFrames, previews, and appended result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.reshape import long_numeric, quoted


LARGEST_PREVIEW = 100

def table_path(external_id: str, asset_type: str) -> str:
    """A column asset stands for its parent table."""
    if asset_type != "column":
        return external_id
    return external_id.rpartition(".")[0]


def load_dataset(
    assets: DataFrame, asset_id: str, resolve: Callable[[str], DataFrame], limit: int | None = None
) -> DataFrame:
    """Rows of a table asset, or of a column asset's table; the whole table unless limited."""
    found = assets.where(F.col("id") == asset_id).select("external_id", "asset_type").first()
    if found is None:
        raise ValueError("dataset asset not found")
    rows = resolve(table_path(found["external_id"], found["asset_type"]))
    return rows.limit(limit) if limit else rows


def numeric_series(df: DataFrame, column: str) -> DataFrame:
    """A column as doubles; nulls, blanks and non-numbers are skipped."""
    return long_numeric(df, [column]).select("value")


def sample_rows(df: DataFrame, limit: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """A preview of at most LARGEST_PREVIEW rows, every value as text; a larger one is refused."""
    if limit > LARGEST_PREVIEW:
        raise ValueError(f"a preview holds at most {LARGEST_PREVIEW} rows")
    picked = df.orderBy(*order_by) if order_by else df
    return picked.limit(limit).select([quoted(c).cast("string").alias(c) for c in df.columns])


def write_results(df: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    """Append result rows (runs, findings, alerts, audit entries), partitioned by run date."""
    df.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("append").partitionBy(
        "run_date"
    ).format(fmt).save(path)
