"""Wide-to-long reshaping: many columns of a table in one scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def quoted(column: str) -> Column:
    """Reference a top-level column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows with every value as text; reads only ``columns``."""
    return df.select([quoted(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "value"
    )


def long_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of doubles; nulls, blanks, non-numbers and NaN are skipped."""
    wide = df.select([as_double(quoted(c)).alias(c) for c in columns])
    return wide.unpivot([], [quoted(c) for c in columns], "column", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def same_typed(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Columns grouped by the type in which their values can be compared side by side."""

    def common(kind: T.DataType) -> str:
        if isinstance(kind, T.IntegralType):
            return "bigint"
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return kind.simpleString()
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            return kind.simpleString()
        return "string"

    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(common(df.schema[c].dataType), []).append(c)
    return list(groups.items())


def as_double(column: Column) -> Column:
    return column.try_cast("double")


def stack_rows(structs: Sequence[Column]) -> Column:
    """Generator that turns a row into one output row per struct."""
    return F.inline(F.array(*structs))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used; inside a lambda nothing else shares it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the same one on every run: the greatest by the text of its other columns."""
    rest = F.struct(*[quoted(c) for c in df.columns if c not in keys])
    kept = df.groupBy(*keys).agg(F.max_by(rest, F.to_json(rest)).alias("kept"))
    return kept.select(*keys, "kept.*").select(*df.columns)
