"""Column profiles as mergeable sketches: a part of a table is profiled once, and parts are merged when read.

Per part and column there are exact row and null counts, a theta sketch of the distinct values and, for numbers, a KLL
sketch of their distribution. Sketches of a few kilobytes are all that is shuffled or stored. A new day is profiled
alone and written beside the others; writing a part again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.reshape import is_numeric, quoted, stack_rows

#: Entries of a theta sketch as a power of two: relative standard error 1 / sqrt(4096), about 1.6 %.
THETA_LOG = 12
#: Size of a KLL sketch: ranks err by less than about 1.7 % at 99 % confidence.
KLL_SIZE = 200

_COLUMNS = "column string, row_count bigint, non_null bigint, is_numeric boolean, theta binary, kll binary"


def theta_error(entries_log: int = THETA_LOG) -> float:
    """Relative standard error of a distinct count."""
    return 1 / (1 << entries_log) ** 0.5


def profile_parts(df: DataFrame, part: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(part, column, row_count, non_null, is_numeric, theta, kll) of every value of the ``part`` column, from one aggregate.

    Distinct values are counted by their 64-bit hashes, nulls left out. Sketches combine before the shuffle.
    """
    columns = list(columns or [c for c in df.columns if c != part])
    aggregates = [F.count(F.lit(1)).alias("n")]
    rows = []
    for i, c in enumerate(columns):
        value, numeric = quoted(c), is_numeric(df, c)
        aggregates += [
            F.count(value).alias(f"filled_{i}"),
            F.theta_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), THETA_LOG).alias(f"theta_{i}"),
        ]
        if numeric:
            number = value.cast("double")
            aggregates.append(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), KLL_SIZE).alias(f"kll_{i}"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.col("n").alias("row_count"), F.col(f"filled_{i}").alias("non_null"),
                F.lit(numeric).alias("is_numeric"), F.col(f"theta_{i}").alias("theta"),
                (F.col(f"kll_{i}") if numeric else F.lit(None).cast("binary")).alias("kll"),
            )
        )
    return df.groupBy(quoted(part).cast("string").alias("part")).agg(*aggregates).select("part", stack_rows(rows))


def write_part(df: DataFrame, path: str, part: str, columns: Sequence[str] | None = None) -> None:
    """Profile one part of a table and store it under its name; other parts stay as they are. An empty part has no rows."""
    columns = list(columns or df.columns)
    profile = profile_parts(df.withColumn("__part", F.lit(part)), "__part", columns).drop("part")
    profile.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}")


def write_parts(df: DataFrame, path: str, part: str, columns: Sequence[str] | None = None) -> None:
    """Profile a table with all its parts and store them, in one pass."""
    profile_parts(df, part, columns).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_COLUMNS}, part string").parquet(path)


def merged_profile(parts: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of all parts together, like ``profile_columns`` with an estimated distinct count.

    ``quantiles`` holds the values at ``ranks``, null for columns that are not numbers or have none.
    """
    merged = parts.groupBy("column").agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null").alias("non_null"), F.bool_or("is_numeric").alias("is_numeric"),
        F.theta_union_agg("theta", THETA_LOG).alias("theta"),
        # A part without numbers has an empty sketch, which adds nothing.
        F.kll_merge_agg_double("kll", KLL_SIZE).alias("kll"),
    )
    has = F.col("is_numeric") & (F.kll_sketch_get_n_double("kll") > 0)
    quantiles = F.when(has, F.array(*[F.kll_sketch_get_quantile_double("kll", F.lit(float(r))) for r in ranks]))
    return merged.select(
        "column", "row_count", (F.col("row_count") - F.col("non_null")).alias("null_count"), "non_null",
        F.theta_sketch_estimate("theta").alias("distinct_count"), "is_numeric", quantiles.alias("quantiles"),
    )
