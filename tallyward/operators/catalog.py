"""Building the catalog: discovery, merging, parents and removal of a source."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.constants import DEFAULT_SENSITIVITY
from tallyward.functions.names import asset_id
from tallyward.functions.reshape import one_per_key

DISCOVERED = (
    "external_id string, name string, asset_type string, parent_external_id string, "
    "metadata map<string,string>"
)
ASSET_KEY = ["org_id", "source_id", "external_id"]


def discover_tables(tables: Mapping[str, DataFrame], database: str, schema: str) -> DataFrame:
    """One row per schema, table and column of file-backed tables.

    Columns come from the schemas, without a job. The row counts are metadata-only scans.
    """
    root = f"{database}.{schema}"
    rows = [(root, schema, "schema", database, {"database": database})]
    for name, df in tables.items():
        path = f"{root}.{name}"
        rows.append((path, name, "table", root, {"table_type": "BASE TABLE"}))
        for position, field in enumerate(df.schema.fields, 1):
            rows.append(
                (
                    f"{path}.{field.name}",
                    field.name,
                    "column",
                    path,
                    {
                        "data_type": field.dataType.simpleString(),
                        "is_nullable": "YES" if field.nullable else "NO",
                        "position": str(position),
                    },
                )
            )
    spark = next(iter(tables.values())).sparkSession
    found = spark.createDataFrame(rows, DISCOVERED)
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(f"{root}.{name}").alias("external_id"), "row_count"
            )
            for name, df in tables.items()
        ],
    )
    counted = F.map_concat("metadata", F.create_map(F.lit("row_count"), F.col("row_count").cast("string")))
    # One row per table bounds the broadcast.
    return found.join(F.broadcast(counts), "external_id", "left").select(
        "external_id",
        "name",
        "asset_type",
        "parent_external_id",
        F.when(F.col("row_count").isNotNull(), counted).otherwise(F.col("metadata")).alias("metadata"),
    )


def discover_information_schema(tables: DataFrame, columns: DataFrame, database: str, has_schemas: bool = True) -> DataFrame:
    """The same rows from information_schema frames; without schemas the database is the schema node."""
    root = F.concat_ws(".", F.lit(database), "table_schema") if has_schemas else F.lit(database)
    path = F.concat_ws(".", root, "table_name")

    def text_map(**fields):
        pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metadata")

    schemas = tables.select(
        root.alias("external_id"),
        (F.col("table_schema") if has_schemas else F.lit(database)).alias("name"),
        F.lit("schema").alias("asset_type"),
        F.lit(database if has_schemas else None).cast("string").alias("parent_external_id"),
    ).distinct().withColumn("metadata", F.create_map(F.lit("database"), F.lit(database)))
    table_rows = tables.select(
        path.alias("external_id"),
        F.col("table_name").alias("name"),
        F.lit("table").alias("asset_type"),
        root.alias("parent_external_id"),
        text_map(table_type=F.col("table_type"), row_count=F.col("row_count")),
    )
    column_rows = columns.select(
        F.concat_ws(".", path, "column_name").alias("external_id"),
        F.col("column_name").alias("name"),
        F.lit("column").alias("asset_type"),
        path.alias("parent_external_id"),
        text_map(
            data_type=F.col("data_type"),
            is_nullable=F.col("is_nullable"),
            default_value=F.col("column_default"),
            max_length=F.col("character_maximum_length"),
            position=F.col("ordinal_position"),
        ),
    )
    return schemas.unionByName(table_rows).unionByName(column_rows)


def upsert_assets(catalog: DataFrame, discovered: DataFrame, org_id: str, source_id: str, seen_at: str) -> DataFrame:
    """The catalog after a crawl: discovered rows update name, type, parent and metadata, or are added.

    Business fields (sensitivity, score, domain, first seen) survive; rows that were not discovered
    stay as they are. Running it twice changes nothing. Only rows of the crawled source are merged; the
    rest of the catalog passes by without a shuffle.
    """
    own = F.col("org_id").eqNullSafe(F.lit(org_id)) & F.col("source_id").eqNullSafe(F.lit(source_id))
    new = (
        one_per_key(discovered, ["external_id"])
        .withColumn("org_id", F.lit(org_id))
        .withColumn("source_id", F.lit(source_id))
        .withColumn("found", F.lit(True))
    )
    old, fresh = catalog.where(own).alias("o"), new.alias("n")
    joined = old.join(fresh, ASSET_KEY, "full_outer")
    found = F.coalesce(F.col("n.found"), F.lit(False))

    def newest(column):
        return F.when(found, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}")).alias(column)

    merged = joined.select(
        F.coalesce(F.col("o.id"), asset_id(F.col("org_id"), F.col("source_id"), F.col("external_id"))).alias("id"),
        *ASSET_KEY,
        newest("name"),
        newest("asset_type"),
        newest("parent_external_id"),
        newest("metadata"),
        F.coalesce(F.col("o.sensitivity_level"), F.lit(DEFAULT_SENSITIVITY)).alias("sensitivity_level"),
        F.col("o.quality_score").alias("quality_score"),
        F.col("o.domain").alias("domain"),
        F.coalesce(F.col("o.first_seen_at"), F.lit(seen_at).cast("timestamp_ntz")).alias("first_seen_at"),
    )
    return merged.unionByName(catalog.where(~own).select(*merged.columns))


def resolve_parents(assets: DataFrame) -> DataFrame:
    """Parent id of each asset; null when the parent is not in the catalog. Order-free."""
    parents = assets.select(
        "org_id", "source_id", F.col("external_id").alias("parent_external_id"), F.col("id").alias("parent_id")
    )
    return assets.join(parents, ["org_id", "source_id", "parent_external_id"], "left")


# The tables that depend on a source, with the columns that tie their rows to it.
_CHILDREN_OF_ASSETS = {
    "lineage_edges": ("source_id", "target_id", "transform_id"),
    "bias_test_runs": ("test_dataset_id",),
    "compliance_mappings": ("asset_id",),
    "classification_results": ("asset_id",),
    "quality_rules": ("asset_id",),
    "quality_check_runs": ("asset_id",),
}
_CHILDREN_OF_MODELS = {"ai_model_versions": "model_id", "risk_assessments": "model_id"}
_CHILDREN_OF_VERSIONS = {"monitoring_configs": "model_version_id", "bias_test_runs": "model_version_id"}


def drop_source_cascade(
    tables: Mapping[str, DataFrame], source_id: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(remaining tables, removed rows per table) after a source and its dependents are gone.

    An edge goes when the source's assets play any role in it. Each dependent table loses its rows
    through anti joins on the doomed ids.
    """
    doomed_assets = tables["assets"].where(F.col("source_id") == source_id).select("id")
    remaining: dict[str, DataFrame] = {}
    for name in ("assets", "ai_models", "classification_runs"):
        if name in tables:
            remaining[name] = tables[name].where(~F.col("source_id").eqNullSafe(source_id))
    if "data_sources" in tables:
        remaining["data_sources"] = tables["data_sources"].where(F.col("id") != source_id)

    def without(name: str, column: str, ids: DataFrame) -> None:
        frame = remaining.get(name, tables.get(name))
        if frame is not None:
            remaining[name] = frame.join(
                ids.select(F.col("id").alias(column)), column, "left_anti"
            ).select(tables[name].columns)

    for parent, column in (("quality_check_runs", "run_id"), ("quality_rules", "rule_id")):
        if parent in tables and "quality_check_results" in tables and column in tables["quality_check_results"].columns:
            doomed = doomed_assets.select(F.col("id").alias("asset_id"))
            without("quality_check_results", column, tables[parent].join(doomed, "asset_id", "left_semi").select("id"))
    for name, columns in _CHILDREN_OF_ASSETS.items():
        for column in columns:
            if name in tables and column in tables[name].columns:
                without(name, column, doomed_assets)
    if "ai_models" in tables:
        doomed_models = tables["ai_models"].where(F.col("source_id") == source_id).select("id")
        for name, column in _CHILDREN_OF_MODELS.items():
            without(name, column, doomed_models)
        if "ai_model_versions" in tables:
            versions = tables["ai_model_versions"]
            doomed_versions = versions.join(
                doomed_models.select(F.col("id").alias("model_id")), "model_id", "left_semi"
            ).select("id")
            for name, column in _CHILDREN_OF_VERSIONS.items():
                if name in tables and column in tables[name].columns:
                    without(name, column, doomed_versions)
            without("drift_alerts", "model_version_id", doomed_versions)
            if "monitoring_configs" in tables and "drift_alerts" in tables:
                configs = tables["monitoring_configs"]
                doomed_configs = configs.join(
                    doomed_versions.select(F.col("id").alias("model_version_id")), "model_version_id", "left_semi"
                ).select("id")
                without("drift_alerts", "monitoring_config_id", doomed_configs)
    for name, frame in tables.items():
        remaining.setdefault(name, frame)

    def size(frame: DataFrame, name: str, column: str) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias(column)).select(F.lit(name).alias("table"), column)

    before = reduce(DataFrame.unionByName, [size(tables[n], n, "before") for n in tables])
    after = reduce(DataFrame.unionByName, [size(remaining[n], n, "after") for n in tables])
    removed = before.join(F.broadcast(after), "table").select(
        "table", (F.col("before") - F.col("after")).alias("removed")
    )
    return remaining, removed
