"""Lake files, file inventories, script corpora and lineage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.openlineage import EVENT_SCHEMA
from tallyward.operators.scripts import extension

LAKE_FORMATS = ("parquet", "csv", "json")


def scan_files(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """A parquet, csv or json-lines file or folder. The format follows the extension if not given.

    Parquet brings its schema; for the text formats a given ``schema`` saves the inference pass.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in LAKE_FORMATS:
        raise ValueError(f"unsupported file format '{fmt}'")
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    return reader.format(fmt).load(path)


def file_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of each column of a file."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File inventory below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.col("path").alias("external_id"),
        name.alias("name"),
        F.lit("file").alias("asset_type"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent_id"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("file_format"),
    )


def scan_scripts(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, external_id, content) of all .sql and .py files below a folder, .git left out."""
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{sql,py}")
        .select(F.col("_metadata.file_path").alias("full_path"), F.col("value").alias("content"))
    )
    label = root.rstrip("/").rsplit("/", 1)[-1]
    start = F.locate(f"/{label}/", F.col("full_path")) + len(label) + 2
    relative = F.url_decode(F.substring("full_path", start, F.length("full_path")))
    return (
        files.where(~F.col("full_path").contains("/.git/"))
        .select(relative.alias("path"), "content")
        .where(extension(F.col("path")).isin("sql", "py"))
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.concat(F.lit(f"repo://{label}/"), "path").alias("external_id"),
            "content",
        )
    )


def read_lineage_events(spark: SparkSession, path: str) -> DataFrame:
    """Runtime lineage events, one JSON document per line."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def stream_lineage_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same files as a stream."""
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    )
