"""Risk, compliance, audit and reporting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.constants import REQUIREMENTS, RISK_QUESTIONS, RISK_TIERS
from tallyward.operators import etl, risk
from tallyward.plans.registry import Registry
from tallyward.plans.tables import table

REGISTRY = Registry()
_query = REGISTRY.query

KEYS = [key for key, _, _ in RISK_QUESTIONS]
# A customer answers yes to question i when its key has a fixed remainder; few say yes to the first.
_YES = {key: f"c_custkey % {23 if i == 0 else 7 + i} = {i}" for i, key in enumerate(KEYS)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def questionnaires(spark, folder) -> DataFrame:
    pairs = ", ".join(f"'{key}', {test}" for key, test in _YES.items())
    return table(spark, folder, "customer").selectExpr("c_custkey AS model_id", f"map({pairs}) AS responses")


_TOTAL_SQL = " + ".join(f"CASE WHEN {_YES[key]} THEN {weight} ELSE 0 END" for key, weight, _ in RISK_QUESTIONS)
_RISK_SQL = f"""scored AS (SELECT c_custkey AS model_id, {_YES['prohibited_use']} AS banned, {_TOTAL_SQL} AS total,
   ({_YES['human_interaction']}) OR ({_YES['generates_content']}) AS talks,
   concat_ws('|', {', '.join(f"CASE WHEN {_YES[k]} THEN {_quoted(t)} END" for k, _, t in RISK_QUESTIONS)}) AS factors FROM customer),
 tiers AS (SELECT *, CASE WHEN banned THEN 'unacceptable' WHEN total >= 30 THEN 'high' WHEN talks THEN 'limited' ELSE 'minimal' END AS risk_tier FROM scored)"""


@_query(
    "risk_score",
    f"""WITH {_RISK_SQL} SELECT model_id, risk_tier, CASE WHEN banned THEN 100 ELSE total END::INT AS score,
        CASE risk_tier {' '.join(f"WHEN '{t}' THEN {_quoted(row[0])}" for t, row in RISK_TIERS.items())} END AS eu_ai_act_category,
        CASE WHEN banned THEN 'Prohibited use case under the EU AI Act' ELSE factors END AS factors,
        CASE risk_tier {' '.join(f"WHEN '{t}' THEN {_quoted('|'.join(row[1]))}" for t, row in RISK_TIERS.items())} END AS actions
        FROM tiers""",
)
def risk_score(spark, folder):
    return risk.risk_score(questionnaires(spark, folder)).select(
        "model_id",
        "risk_tier",
        "score",
        "eu_ai_act_category",
        F.array_join("risk_factors", "|").alias("factors"),
        F.array_join("required_actions", "|").alias("actions"),
    )


@_query("risk_tier_mix", f"WITH {_RISK_SQL} SELECT risk_tier, count(*)::BIGINT AS count FROM tiers GROUP BY 1")
def risk_tier_mix(spark, folder):
    return risk.risk_tier_mix(risk.risk_score(questionnaires(spark, folder)))


_REQUIRED_SQL = "required(framework, article_reference, title, tiers) AS (VALUES " + ", ".join(
    f"({_quoted(f)}, {_quoted(a)}, {_quoted(t)}, {_quoted(','.join(tiers)) if tiers else 'NULL'})"
    for f, a, t, _, tiers in REQUIREMENTS
) + ")"


@_query(
    "requirements_for_model",
    f"""WITH {_RISK_SQL}, {_REQUIRED_SQL} SELECT model_id, risk_tier, framework, article_reference, title
        FROM tiers JOIN required ON tiers IS NULL OR list_contains(string_split(tiers, ','), risk_tier)""".replace(
        "tiers IS NULL OR list_contains(string_split(tiers, ',')",
        "required.tiers IS NULL OR list_contains(string_split(required.tiers, ',')",
    ),
)
def requirements_for_model(spark, folder):
    models = risk.risk_score(questionnaires(spark, folder)).withColumnRenamed("model_id", "id")
    return risk.requirements_for_model(models)


@_query(
    "framework_requirements",
    f"""WITH {_RISK_SQL}, {_REQUIRED_SQL} SELECT framework, article_reference, count(*)::BIGINT AS models
        FROM tiers JOIN required ON required.tiers IS NULL OR list_contains(string_split(required.tiers, ','), risk_tier) GROUP BY 1, 2""",
)
def framework_requirements(spark, folder):
    """Framework requirements with the number of models that each one binds."""
    spread = risk.framework_requirements(spark).select(
        "framework", F.inline("requirements")
    )
    models = risk.risk_score(questionnaires(spark, folder)).withColumnRenamed("model_id", "id")
    return (
        risk.requirements_for_model(models, spread)
        .groupBy("framework", "article_reference")
        .agg(F.count(F.lit(1)).alias("models"))
    )


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'compliant' WHEN 'O' THEN 'in_progress' ELSE 'non_compliant' END"


@_query(
    "compliance_summary",
    f"""WITH m AS (SELECT {_STATUS} AS status FROM orders)
        SELECT status, false AS is_total, count(*)::BIGINT AS count, CAST(NULL AS DOUBLE) AS compliance_rate FROM m GROUP BY 1
        UNION ALL SELECT NULL, true, count(*), round(avg(CASE WHEN status = 'compliant' THEN 1.0 ELSE 0.0 END), 3) FROM m""",
)
def compliance_summary(spark, folder):
    return risk.compliance_summary(table(spark, folder, "orders").selectExpr(f"{_STATUS} AS status"))


def audit_log(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id AS id",
        "concat(event_type, '.', if(user_id % 2 = 0, 'created', 'updated')) AS action",
        "if(user_id % 3 = 0, 'asset', 'model') AS resource_type",
        "ts AS occurred_at",
    )


_AUDIT_SQL = """audit AS (SELECT event_id AS id, event_type || '.' || CASE WHEN user_id % 2 = 0 THEN 'created' ELSE 'updated' END AS action,
   CASE WHEN user_id % 3 = 0 THEN 'asset' ELSE 'model' END AS resource_type, ts AS occurred_at FROM events)"""


@_query(
    "audit_search",
    f"""WITH {_AUDIT_SQL} SELECT * FROM audit WHERE action = 'click.created' AND resource_type = 'model'
        ORDER BY occurred_at DESC, id LIMIT 200""",
)
def audit_search(spark, folder):
    return risk.audit_search(audit_log(spark, folder), "click.created", "model")


@_query(
    "audit_by_family",
    f"WITH {_AUDIT_SQL} SELECT string_split(action, '.')[1] AS family, count(*)::BIGINT AS count FROM audit GROUP BY 1",
)
def audit_by_family(spark, folder):
    return risk.audit_by_family(audit_log(spark, folder))


# ---- reporting queries -------------------------------------------------------------------------------

_SHOP_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'shipped' ELSE 'pending' END"


def shop(spark, folder) -> dict[str, DataFrame]:
    """The driver tables in the shop's shape; money as decimals, so that sums are exact."""
    def rows(name, *expressions):
        return table(spark, folder, name).selectExpr(*expressions)

    return {
        "customers": rows("customer", "c_custkey AS id", "c_name AS email", "c_mktsegment AS country"),
        "orders": rows(
            "orders", "o_orderkey AS id", "o_custkey AS customer_id", f"{_SHOP_STATUS} AS status",
            "cast(o_orderdate AS date) AS order_date", "cast(o_totalprice AS decimal(12,2)) AS total_amount",
        ),
        "items": rows(
            "lineitem", "l_partkey AS product_id", "cast(l_quantity AS int) AS quantity",
            "cast(l_extendedprice AS decimal(12,2)) AS unit_price",
        ),
        "products": rows("part", "p_partkey AS id", "p_name AS name", "p_brand AS category"),
        "payments": rows("lineitem", "l_orderkey AS order_id", "cast(l_extendedprice AS decimal(12,2)) AS amount"),
    }


_SHOP_SQL = f"""customers AS (SELECT c_custkey AS id, c_name AS email, c_mktsegment AS country FROM customer),
 shop_orders AS (SELECT o_orderkey AS id, o_custkey AS customer_id, {_SHOP_STATUS} AS status, CAST(o_orderdate AS DATE) AS order_date,
   CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount FROM orders)"""


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@_query(
    "etl_customer_revenue",
    f"""WITH {_SHOP_SQL} SELECT c.id AS customer_id, c.country, CAST(sum(o.total_amount) AS DOUBLE) AS revenue, count(o.id)::BIGINT AS order_count
        FROM shop_orders o JOIN customers c ON c.id = o.customer_id WHERE o.status = 'paid' GROUP BY 1, 2""",
)
def etl_customer_revenue(spark, folder):
    s = shop(spark, folder)
    return _as_double(etl.customer_revenue(s["orders"], s["customers"]), "revenue")


@_query(
    "etl_daily_sales",
    f"""WITH {_SHOP_SQL} SELECT order_date, CAST(sum(total_amount) AS DOUBLE) AS total_revenue, count(*)::BIGINT AS num_orders
        FROM shop_orders WHERE status IN ('paid', 'shipped') GROUP BY 1""",
)
def etl_daily_sales(spark, folder):
    return _as_double(etl.daily_sales(shop(spark, folder)["orders"]), "total_revenue")


@_query(
    "etl_product_performance",
    """SELECT p_partkey AS product_id, p_name AS name, p_brand AS category, sum(CAST(l_quantity AS INT))::BIGINT AS units_sold,
         CAST(sum(CAST(l_quantity AS INT) * CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS gross_sales
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""",
)
def etl_product_performance(spark, folder):
    s = shop(spark, folder)
    return _as_double(etl.product_performance(s["items"], s["products"]), "gross_sales")


@_query(
    "etl_payment_summary",
    f"""WITH {_SHOP_SQL} SELECT o.id AS order_id, CAST(o.total_amount AS DOUBLE) AS order_total,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS paid_total
        FROM lineitem JOIN shop_orders o ON o.id = l_orderkey GROUP BY 1, o.total_amount""",
)
def etl_payment_summary(spark, folder):
    s = shop(spark, folder)
    return _as_double(etl.payment_summary(s["payments"], s["orders"]), "order_total", "paid_total")


@_query(
    "etl_customer_360",
    f"""WITH {_SHOP_SQL} SELECT c.id AS customer_id, c.email, c.country, count(o.id)::BIGINT AS orders,
          CAST(sum(o.total_amount) AS DOUBLE) AS lifetime_value
        FROM customers c LEFT JOIN shop_orders o ON o.customer_id = c.id GROUP BY 1, 2, 3""",
)
def etl_customer_360(spark, folder):
    s = shop(spark, folder)
    return _as_double(etl.customer_360(s["customers"], s["orders"]), "lifetime_value")
