"""Model registry: promotion of crawled model assets, cards, training lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.names import asset_id
from tallyward.functions.reshape import one_per_key

DEFAULT_STAGE = "development"


def _meta(column: str, key: str) -> Column:
    """A metadata entry; blank counts as missing."""
    return F.nullif(F.col(column).getItem(key), F.lit(""))


def sync_models(
    assets: DataFrame, models: DataFrame, versions: DataFrame, org_id: str, source_id: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, versions, counts) after promoting a source's model assets.

    ``assets`` carries metadata, tags, metrics and params maps. A value that the crawl lacks keeps
    the registered one; framework and model type fall back to tags; running it twice adds nothing.
    """
    own = assets.where(F.col("source_id") == source_id)
    model_assets = own.where(F.col("asset_type") == "ml_model")
    model_assets = one_per_key(model_assets, ["external_id"])
    crawled = model_assets.select(
        F.lit(org_id).alias("org_id"),
        "external_id",
        F.col("name").alias("new_name"),
        _meta("metadata", "description").alias("new_description"),
        *[
            F.coalesce(_meta("metadata", k), _meta("tags", k)).alias(f"new_{k}")
            for k in ("framework", "model_type")
        ],
        F.lit(True).alias("crawled"),
    )
    merged = models.join(crawled, ["org_id", "external_id"], "full_outer")
    is_crawled = F.coalesce("crawled", F.lit(False))
    all_models = merged.select(
        F.coalesce("id", asset_id(F.col("org_id"), F.lit("model"), F.col("external_id"))).alias("id"),
        "org_id",
        "external_id",
        F.when(is_crawled, F.lit(source_id)).otherwise(F.col("source_id")).alias("source_id"),
        F.coalesce("new_name", "name").alias("name"),
        *[F.coalesce(f"new_{k}", k).alias(k) for k in ("description", "framework", "model_type")],
        F.col("id").isNull().alias("is_new"),
        is_crawled.alias("crawled"),
    )

    parents = model_assets.select(F.col("id").alias("parent_id"), F.col("external_id").alias("model_path"))
    model_ids = all_models.where("crawled").select(
        F.col("external_id").alias("model_path"), F.col("id").alias("model_id")
    )
    version_assets = own.where(F.col("asset_type") == "ml_model_version")
    fallback = F.element_at(F.split("external_id", "/"), -1)
    crawled_versions = (
        version_assets.join(parents.join(model_ids, "model_path"), "parent_id")
        .select(
            "model_id",
            F.coalesce(_meta("metadata", "version"), fallback).alias("version_number"),
            F.col("external_id").alias("new_external_id"),
            F.when(F.size("metrics") > 0, F.col("metrics")).alias("new_metrics"),
            F.when(F.size("params") > 0, F.col("params")).alias("new_params"),
            _meta("metadata", "stage").alias("new_stage"),
        )
    )
    crawled_versions = one_per_key(crawled_versions, ["model_id", "version_number"])
    all_versions = versions.join(crawled_versions, ["model_id", "version_number"], "full_outer").select(
        F.coalesce("id", F.sha2(F.concat_ws("\u0001", "model_id", "version_number"), 256)).alias("id"),
        "model_id",
        "version_number",
        F.coalesce("new_external_id", "external_version_id").alias("external_version_id"),
        F.coalesce("new_metrics", "metrics", F.create_map().cast("map<string,double>")).alias("metrics"),
        F.coalesce("new_params", "hyperparameters", F.create_map().cast("map<string,string>")).alias(
            "hyperparameters"
        ),
        F.coalesce("new_stage", "stage", F.lit(DEFAULT_STAGE)).alias("stage"),
        F.col("id").isNull().alias("is_new"),
    )

    def counted(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        count = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return df.agg(count.alias("n")).select(F.lit(name).alias("measure"), "n")

    counts = (
        counted(all_models, "models_synced", F.col("is_new"))
        .unionByName(counted(all_versions, "versions_synced", F.col("is_new")))
        .unionByName(counted(model_assets, "models_total"))
        .unionByName(counted(version_assets, "versions_total"))
    )
    return all_models.drop("is_new", "crawled"), all_versions.drop("is_new"), counts


def latest_assessment(assessments: DataFrame) -> DataFrame:
    """Newest assessment per model; the larger id on a tie."""
    fields = [c for c in assessments.columns if c != "model_id"]
    newest = F.max_by(F.struct(*fields), F.struct("created_at", "id"))
    return assessments.groupBy("model_id").agg(newest.alias("a")).select("model_id", "a.*")


def model_cards(models: DataFrame, versions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Card rows: model attributes and latest assessment beside each version.

    A card is one model's rows. They stay rows rather than a nested list, so a model with very many
    versions is never gathered in one place; a model without versions has one row.
    """
    latest = latest_assessment(assessments).select(
        "model_id",
        F.col("risk_tier").alias("assessed_tier"),
        F.col("category").alias("assessed_category"),
        "risk_factors",
        "required_actions",
    )
    carded = models.withColumnRenamed("id", "model_id").join(latest, "model_id", "left")
    shown = versions.select("model_id", "version_number", "stage", "metrics")
    # An inner join lets a model with very many versions be split over tasks, which an outer join
    # would not; models without versions are added from a second, short branch.
    versioned = shown.join(carded, "model_id")
    lone = carded.join(versions.select("model_id").distinct(), "model_id", "left_anti")
    return versioned.unionByName(lone, allowMissingColumns=True).select(
        "model_id",
        "name",
        "description",
        "owner",
        "use_case",
        "business_domain",
        "framework",
        "model_type",
        "risk_tier",
        "deployment_status",
        "version_number",
        "stage",
        "metrics",
        "assessed_tier",
        "assessed_category",
        "required_actions",
        F.col("use_case").alias("intended_use"),
        F.coalesce("risk_factors", F.array().cast("array<string>")).alias("ethical_considerations"),
    )


def model_lineage(versions: DataFrame, assets: DataFrame) -> DataFrame:
    """Training datasets of each version, one row per dataset, with names where they are known."""
    used = versions.select(
        "model_id",
        F.col("id").alias("version_id"),
        "version_number",
        "stage",
        F.posexplode_outer("training_dataset_ids").alias("position", "dataset_id"),
    )
    names = assets.select(
        F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), F.col("asset_type").alias("dataset_type")
    )
    return used.join(names, "dataset_id", "left").withColumn(
        "dataset_name",
        F.when(F.col("dataset_id").isNotNull(), F.coalesce("dataset_name", F.lit("(unknown asset)"))),
    )
