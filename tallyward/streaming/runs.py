"""Running a stream over what is available and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyward.session import scratch_path


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start appending a stream to parquet files; all available data by default."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_available(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Drain a stream into a fresh table below the shared folder and read it back."""
    path = scratch_path(spark, label)
    query = append_to(stream, path, scratch_path(spark, f"{label}-state"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
