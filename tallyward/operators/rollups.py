"""Catalog queries: search, counts, facets and the overview figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.constants import PII_SENSITIVITIES, QUALITY_BANDS, RECENT_ASSET_TYPES


LARGEST_PAGE = 500


def asset_filter(
    assets: DataFrame,
    q: str | None = None,
    asset_type: str | None = None,
    sensitivity: str | None = None,
    source_id: str | None = None,
    domain: str | None = None,
    has_pii: bool | None = None,
) -> DataFrame:
    """Assets that meet all given conditions; ``q`` matches name or external id, ignoring case."""
    tests: list[Column] = []
    if q:
        tests.append(F.ilike("name", F.lit(f"%{q}%")) | F.ilike("external_id", F.lit(f"%{q}%")))
    equal = {"asset_type": asset_type, "sensitivity_level": sensitivity, "source_id": source_id, "domain": domain}
    tests += [F.col(column) == value for column, value in equal.items() if value]
    if has_pii:
        tests.append(F.col("sensitivity_level").isin(*PII_SENSITIVITIES))
    return assets.where(reduce(lambda a, b: a & b, tests)) if tests else assets


#: Sort -> (column, falls). Nulls come last in a falling order and first in a rising one.
SORTS = {"recent": ("first_seen_at", True), "name": ("name", False), "quality": ("quality_score", True)}


def _order(sort: str) -> tuple[str, bool, list[Column]]:
    column, falls = SORTS.get(sort, SORTS["recent"])
    return column, falls, [F.desc_nulls_last(column) if falls else F.asc_nulls_first(column), F.asc("id")]


def _behind(sort: str, value: object, last_id: object) -> Column:
    """Rows that come after (value, last_id) in a sort order."""
    column, falls, _ = _order(sort)
    col = F.col(column)
    if value is None:
        rest = col.isNull() & (F.col("id") > F.lit(last_id))
        return rest if falls else rest | col.isNotNull()
    tied = (col == F.lit(value)) & (F.col("id") > F.lit(last_id))
    return (col < F.lit(value)) | tied | col.isNull() if falls else (col > F.lit(value)) | tied


def search_assets(
    assets: DataFrame, sort: str = "recent", limit: int = 50, offset: int = 0, after: tuple | None = None, **conditions
) -> DataFrame:
    """One page of at most LARGEST_PAGE matching assets; ties are broken by id and a larger page is refused.

    ``after`` is the sort value and the id of the last row seen: the page then costs the same however far down it is,
    and over :func:`write_search_layout` only files that can hold later rows are read. ``offset`` skips rows instead,
    all of which are ranked again for every page.
    """
    if limit > LARGEST_PAGE:
        raise ValueError(f"a page holds at most {LARGEST_PAGE} assets")
    found = asset_filter(assets, **conditions)
    if after is not None:
        found = found.where(_behind(sort, *after))
    page = found.orderBy(*_order(sort)[2])
    return (page.offset(offset) if offset else page).limit(limit)


def page_end(page: DataFrame, sort: str = "recent") -> tuple | None:
    """What ``after`` takes for the page behind this one; None behind the last. A page is at most LARGEST_PAGE rows."""
    column, falls, order = _order(sort)
    turned = [F.asc_nulls_first(column) if falls else F.desc_nulls_last(column), F.desc("id")]
    last = page.orderBy(*turned).select(column, "id").first()
    return None if last is None else tuple(last)


def write_search_layout(assets: DataFrame, path: str, sort: str = "recent") -> None:
    """Store assets ranged and sorted by a sort order, so that statistics of files and row groups cut a page's scan."""
    order = _order(sort)[2]
    assets.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def search_total(assets: DataFrame, **conditions) -> DataFrame:
    return asset_filter(assets, **conditions).agg(F.count(F.lit(1)).alias("total"))


def asset_children(assets: DataFrame, asset: str) -> DataFrame:
    return assets.where(F.col("parent_id") == asset)


def asset_findings(findings: DataFrame, assets: DataFrame, asset: str) -> DataFrame:
    """Findings of an asset and of its children, newest first."""
    family = assets.where((F.col("id") == asset) | (F.col("parent_id") == asset)).select(
        F.col("id").alias("asset_id"), F.col("name").alias("column")
    )
    return (
        findings.join(family, "asset_id")
        .select("id", "column", "category", "sensitivity_level", "confidence", "detected_at")
        .orderBy(F.desc("detected_at"), "id")
    )


def best_finding_per_column(findings: DataFrame) -> DataFrame:
    """Highest-confidence finding of each column; the newest on a tie."""
    best = F.max_by(
        F.struct("category", "sensitivity_level", "confidence"), F.struct("confidence", "detected_at", "id")
    )
    return findings.groupBy("column").agg(best.alias("best")).select("column", "best.*")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def count_by_source(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Assets per source name, largest first; sources without assets drop out."""
    per_source = count_by(assets, "source_id")
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return (
        per_source.join(names, "source_id")
        .groupBy("source")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "source")
    )


def top_domains(assets: DataFrame, limit: int = 8) -> DataFrame:
    named = assets.where(F.col("domain").isNotNull())
    return count_by(named, "domain").orderBy(F.desc("count"), "domain").limit(limit)


def quality_buckets(assets: DataFrame) -> DataFrame:
    """Scored assets per quality band, empty bands included."""
    score = F.col("quality_score")
    counts, rows, above = [], [], F.lit(True)
    for i, (label, lower) in enumerate(QUALITY_BANDS):
        inside = above if lower is None else above & (score >= lower)
        counts.append(F.count_if(inside & score.isNotNull()).alias(f"band_{i}"))
        rows.append(F.struct(F.lit(label).alias("bucket"), F.col(f"band_{i}").alias("count")))
        if lower is not None:
            above = above & (score < lower)
    return assets.agg(*counts).select(F.inline(F.array(*rows)))


def avg_quality(assets: DataFrame) -> DataFrame:
    return assets.agg(F.round(F.avg("quality_score"), 1).alias("avg_quality"))


def count_pii_columns(assets: DataFrame) -> DataFrame:
    is_pii = (F.col("asset_type") == "column") & F.col("sensitivity_level").isin(*PII_SENSITIVITIES)
    return assets.agg(F.count_if(is_pii).alias("pii_columns"))


def total_governed_rows(assets: DataFrame) -> DataFrame:
    """Sum of the tables' recorded row counts; unreadable counts are skipped."""
    rows = F.col("metadata").getItem("row_count").try_cast("bigint")
    return assets.where(F.col("asset_type") == "table").agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("total_rows")
    )


def recent_assets(assets: DataFrame, limit: int = 8) -> DataFrame:
    shown = assets.where(F.col("asset_type").isin(*RECENT_ASSET_TYPES))
    return shown.orderBy(F.desc("first_seen_at"), "id").limit(limit)


def facets(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """(facet, value, label, count) for source, type, sensitivity and domain from one pass."""
    keys = ["source_id", "asset_type", "sensitivity_level", "domain"]
    counted = assets.groupingSets(
        [[F.col(k)] for k in keys], *[F.col(k) for k in keys]
    ).agg(F.grouping_id(*keys).alias("level"), F.count(F.lit(1)).alias("count"))
    masks = {0b0111: "source", 0b1011: "asset_type", 0b1101: "sensitivity", 0b1110: "domain"}
    facet = reduce(
        lambda chain, item: chain.when(F.col("level") == item[0], item[1]), masks.items(), F
    )
    rows = counted.select(
        facet.alias("facet"), F.coalesce(*keys).alias("value"), F.col("count")
    ).where(F.col("value").isNotNull() | F.col("facet").isin("asset_type", "sensitivity"))
    names = sources.select(F.lit("source").alias("facet"), F.col("id").alias("value"), F.col("name").alias("label"))
    return rows.join(names, ["facet", "value"], "left").where(
        (F.col("facet") != "source") | F.col("label").isNotNull()
    ).select("facet", "value", F.coalesce("label", "value").alias("label"), "count")


def dashboard(
    assets: DataFrame, sources: DataFrame, edges: DataFrame, models: DataFrame, alerts: DataFrame
) -> DataFrame:
    """(metric, key, value) of the governance overview; the asset figures share one pass."""

    def total(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit(metric).alias("metric"), F.lit("").alias("key"), "value"
        )

    mixes = assets.groupingSets(
        [[], [F.col("sensitivity_level")], [F.col("asset_type")]], F.col("sensitivity_level"), F.col("asset_type")
    ).agg(
        F.grouping_id("sensitivity_level", "asset_type").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("quality_score"), 1).alias("quality"),
    )

    def row(metric: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))

    asset_rows = mixes.select(
        F.inline(
            F.when(
                F.col("level") == 3,
                F.array(
                    row("total_assets", F.lit(""), F.col("n")),
                    row("avg_quality_score", F.lit(""), F.col("quality")),
                ),
            )
            .when(F.col("level") == 1, F.array(row("sensitivity_mix", F.col("sensitivity_level"), F.col("n"))))
            .otherwise(F.array(row("asset_type_mix", F.col("asset_type"), F.col("n"))))
        )
    )
    tiers = count_by(models, "risk_tier").select(
        F.lit("risk_tier_mix").alias("metric"),
        F.col("risk_tier").alias("key"),
        F.col("count").cast("double").alias("value"),
    )
    return reduce(
        DataFrame.unionByName,
        [
            asset_rows,
            tiers,
            total(sources, "data_sources"),
            total(edges, "lineage_edges"),
            total(models, "ai_models"),
            total(alerts.where(F.col("status") == "open"), "open_drift_alerts"),
        ],
    )


def recent_activity(audit: DataFrame, limit: int = 10) -> DataFrame:
    return (
        audit.orderBy(F.desc("occurred_at"), "id")
        .limit(limit)
        .select("action", "resource_type", "resource_name", "occurred_at")
    )
