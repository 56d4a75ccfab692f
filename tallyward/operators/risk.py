"""Risk scoring of model questionnaires, compliance requirements and the audit log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.constants import (
    FRAMEWORKS,
    HIGH_RISK_SCORE,
    PROHIBITED_FACTOR,
    REQUIREMENTS,
    RISK_QUESTIONS,
    RISK_TIERS,
)

ANY_TIER = "*"
BROADCAST_REQUIREMENTS = 10_000


LARGEST_AUDIT_PAGE = 2000

def _yes(responses: Column, key: str) -> Column:
    return F.coalesce(responses.getItem(key), F.lit(False))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def risk_score(questionnaires: DataFrame, responses: str = "responses") -> DataFrame:
    """Adds score, tier, category, factors and actions to each questionnaire; no shuffle."""
    answers = F.col(responses)
    prohibited = _yes(answers, "prohibited_use")
    talks = _yes(answers, "human_interaction") | _yes(answers, "generates_content")
    total = reduce(
        lambda a, b: a + b,
        [F.when(_yes(answers, key), weight).otherwise(0) for key, weight, _ in RISK_QUESTIONS],
    )
    factors = F.array_compact(F.array(*[F.when(_yes(answers, key), text) for key, _, text in RISK_QUESTIONS]))
    tier = (
        F.when(prohibited, "unacceptable")
        .when(total >= HIGH_RISK_SCORE, "high")
        .when(talks, "limited")
        .otherwise("minimal")
    )

    def by_tier(position: int, build) -> Column:
        chain = F
        for name, row in RISK_TIERS.items():
            chain = chain.when(F.col("risk_tier") == name, build(row[position]))
        return chain

    return (
        questionnaires.withColumn("risk_tier", tier)
        .withColumn("score", F.when(prohibited, 100).otherwise(total))
        .withColumn("eu_ai_act_category", by_tier(0, F.lit))
        .withColumn("risk_factors", F.when(prohibited, _texts([PROHIBITED_FACTOR])).otherwise(factors))
        .withColumn("required_actions", by_tier(1, _texts))
    )


def risk_tier_mix(models: DataFrame) -> DataFrame:
    return models.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("count"))


def requirements(spark: SparkSession) -> DataFrame:
    """The fixed requirement rows; ``risk_tiers`` is null when all tiers are meant."""
    return spark.createDataFrame(
        [(f, r, t, d, list(tiers) if tiers else None) for f, r, t, d, tiers in REQUIREMENTS],
        "framework string, article_reference string, title string, description string, risk_tiers array<string>",
    )


def framework_requirements(spark: SparkSession) -> DataFrame:
    """Frameworks with their requirements nested."""
    nested = F.array_sort(F.collect_list(F.struct("article_reference", "title", "description", "risk_tiers")))
    frameworks = spark.createDataFrame(FRAMEWORKS, "framework string, version string, description string")
    return frameworks.join(requirements(spark).groupBy("framework").agg(nested.alias("requirements")), "framework")


def requirements_for_model(models: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Requirements that apply to each model's tier, as an equi-join on tier or "any tier".

    The seeded requirements are a fixed short list. A given frame is counted up to the limit first:
    a short one is broadcast, since the few tiers would make very uneven shuffle keys; a longer one
    is shuffled, with the heavy tiers left to the skew handling of adaptive execution.
    """
    rows = requirements(models.sparkSession) if required is None else required
    keyed = rows.withColumn(
        "tier", F.explode(F.coalesce("risk_tiers", F.array(F.lit(ANY_TIER))))
    ).drop("risk_tiers", "description")
    if required is None or required.limit(BROADCAST_REQUIREMENTS + 1).count() <= BROADCAST_REQUIREMENTS:
        keyed = F.broadcast(keyed)
    tiers = F.explode(F.array_distinct(F.array(F.coalesce("risk_tier", F.lit(ANY_TIER)), F.lit(ANY_TIER))))
    return (
        models.select(F.col("id").alias("model_id"), "risk_tier", tiers.alias("tier"))
        .join(keyed, "tier")
        .select("model_id", "risk_tier", "framework", "article_reference", "title")
    )


def compliance_summary(mappings: DataFrame) -> DataFrame:
    """Mappings per status, and a total row (null status) with the compliant share."""
    return mappings.rollup("status").agg(
        F.grouping("status").alias("is_total"),
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg((F.col("status") == "compliant").cast("double")), 3).alias("share"),
    ).select(
        "status",
        (F.col("is_total") == 1).alias("is_total"),
        "count",
        F.when((F.col("is_total") == 1) & (F.col("count") > 0), F.col("share")).alias("compliance_rate"),
    )


def audit_search(
    audit: DataFrame, action: str | None = None, resource_type: str | None = None, limit: int = 200
) -> DataFrame:
    """Newest matching audit rows, at most LARGEST_AUDIT_PAGE; a larger page is refused."""
    if limit > LARGEST_AUDIT_PAGE:
        raise ValueError(f"a page holds at most {LARGEST_AUDIT_PAGE} audit rows")
    if action:
        audit = audit.where(F.col("action") == action)
    if resource_type:
        audit = audit.where(F.col("resource_type") == resource_type)
    return audit.orderBy(F.desc("occurred_at"), "id").limit(limit)


def audit_by_family(audit: DataFrame) -> DataFrame:
    """Audit rows per action family, the part before the first dot."""
    return audit.groupBy(F.substring_index("action", ".", 1).alias("family")).agg(
        F.count(F.lit(1)).alias("count")
    )
