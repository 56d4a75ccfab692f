"""Fairness queries: documents with labels, grouped by language and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators import fairness as f
from tallyward.plans.registry import Registry
from tallyward.plans.tables import table

REGISTRY = Registry()
_query = REGISTRY.query

ATTRIBUTES = ["lang", "source"]


def scored(spark, folder) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, folder, "labels"), "doc_id").selectExpr(
        "lang", "source", "quality AS label", "int(n_chars > 2500) AS prediction"
    )


def _metrics(spark, folder) -> DataFrame:
    return f.group_metrics(scored(spark, folder), ATTRIBUTES)


_METRICS_SQL = """s AS (SELECT lang, source, quality AS y, CAST(n_chars > 2500 AS INT) AS p
   FROM documents JOIN labels USING (doc_id)),
 l AS (SELECT 'lang' AS attribute, lang AS "group", y, p FROM s UNION ALL SELECT 'source', source, y, p FROM s),
 m AS (SELECT attribute, "group", count(*)::BIGINT AS n, avg(p) AS selection_rate,
   coalesce(sum(y * p) / nullif(sum(y), 0), 0) AS true_positive_rate,
   coalesce(sum((1 - y) * p) / nullif(sum(1 - y), 0), 0) AS false_positive_rate,
   coalesce(sum(y * p) / nullif(sum(p), 0), 0) AS precision FROM l GROUP BY 1, 2),
 g AS (SELECT attribute, round(max(selection_rate) - min(selection_rate), 4) AS demographic_parity_gap,
   round(greatest(max(true_positive_rate) - min(true_positive_rate),
     max(false_positive_rate) - min(false_positive_rate)), 4) AS equal_opportunity_gap,
   count(*)::BIGINT AS groups FROM m GROUP BY 1)"""


def _rate_sql(column: str) -> str:
    return f'WITH {_METRICS_SQL} SELECT attribute, "group", round({column}, 4) AS {column} FROM m'


@_query("demographic_parity", _rate_sql("selection_rate"))
def demographic_parity(spark, folder):
    return f.demographic_parity(_metrics(spark, folder))


@_query("equal_opportunity", _rate_sql("true_positive_rate"))
def equal_opportunity(spark, folder):
    return f.equal_opportunity(_metrics(spark, folder))


@_query("predictive_parity", _rate_sql("precision"))
def predictive_parity(spark, folder):
    return f.predictive_parity(_metrics(spark, folder))


@_query(
    "binarize",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f, CASE WHEN o_custkey = 7 THEN 1 ELSE 0 END AS is_7,
       count(*)::BIGINT AS n FROM orders GROUP BY 1, 2""",
)
def binarize(spark, folder):
    orders = table(spark, folder, "orders")
    flags = orders.select(
        f.binarize(orders, "o_orderstatus", "F").alias("is_f"), f.binarize(orders, "o_custkey", 7).alias("is_7")
    )
    return flags.groupBy("is_f", "is_7").agg(F.count(F.lit(1)).alias("n"))


@_query("dp_gap", f"WITH {_METRICS_SQL} SELECT attribute, demographic_parity_gap FROM g")
def dp_gap(spark, folder):
    return f.gaps(_metrics(spark, folder)).select("attribute", "demographic_parity_gap")


@_query("eo_gap", f"WITH {_METRICS_SQL} SELECT attribute, equal_opportunity_gap FROM g")
def eo_gap(spark, folder):
    return f.gaps(_metrics(spark, folder)).select("attribute", "equal_opportunity_gap")


_VERDICT_SQL = """CASE WHEN greatest(demographic_parity_gap, equal_opportunity_gap) > 0.2 THEN 'fail'
  WHEN greatest(demographic_parity_gap, equal_opportunity_gap) > 0.1 THEN 'warning' ELSE 'pass' END"""


@_query("bias_verdict", f"WITH {_METRICS_SQL} SELECT attribute, {_VERDICT_SQL} AS verdict FROM g")
def bias_verdict(spark, folder):
    return f.gaps(_metrics(spark, folder)).select(
        "attribute",
        f.bias_verdict(F.col("demographic_parity_gap"), F.col("equal_opportunity_gap")).alias("verdict"),
    )


@_query(
    "bias_test",
    f"""WITH {_METRICS_SQL} SELECT attribute, demographic_parity_gap, equal_opportunity_gap, groups, {_VERDICT_SQL} AS verdict,
      'Verdict=' || {_VERDICT_SQL} || ' (DP gap ' || demographic_parity_gap || ', EO gap ' || equal_opportunity_gap || ')' AS summary
    FROM g""",
)
def bias_test(spark, folder):
    return f.bias_test(scored(spark, folder), ATTRIBUTES)[1]
