"""Drift queries: events before and after mid-January, orders and line items early and late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators import drift as d
from tallyward.plans.registry import Registry
from tallyward.plans.tables import table

REGISTRY = Registry()
_query = REGISTRY.query

EVENT_SPLIT = "2024-01-16 00:00:00"
ORDER_SPLIT = "1998-04-01 00:00:00"
SHIP_SPLIT = "1999-01-01 00:00:00"


def _before(df: DataFrame, column: str, moment: str) -> DataFrame:
    return df.where(F.col(column) < F.lit(moment).cast("timestamp_ntz"))


def _since(df: DataFrame, column: str, moment: str) -> DataFrame:
    return df.where(F.col(column) >= F.lit(moment).cast("timestamp_ntz"))


def numeric_pair(spark, folder) -> DataFrame:
    """Long frame of the numeric columns of both pairs."""
    events, lines = table(spark, folder, "events"), table(spark, folder, "lineitem")
    return d.numeric_sides(
        _before(events, "ts", EVENT_SPLIT), _since(events, "ts", EVENT_SPLIT), ["value", "user_id"], "events"
    ).unionByName(
        d.numeric_sides(
            _before(lines, "l_shipdate", SHIP_SPLIT),
            _since(lines, "l_shipdate", SHIP_SPLIT).withColumn("l_quantity", F.col("l_quantity") * 1.5),
            ["l_quantity", "l_extendedprice"],
            "lineitem",
        )
    )


def _long_sql(source: str, dataset: str, columns: dict[str, str], late: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{dataset}' AS dataset, '{c}' AS "column", {late} AS is_current, {expr} AS value FROM {source}"""
        for c, expr in columns.items()
    )


_SIDES_SQL = "sides AS ({} UNION ALL {})".format(
    _long_sql(
        "events", "events", {"value": "value", "user_id": "CAST(user_id AS DOUBLE)"}, f"ts >= TIMESTAMP '{EVENT_SPLIT}'"
    ),
    _long_sql(
        "lineitem",
        "lineitem",
        {
            "l_quantity": f"CASE WHEN l_shipdate >= TIMESTAMP '{SHIP_SPLIT}' THEN l_quantity * 1.5 ELSE l_quantity END",
            "l_extendedprice": "l_extendedprice",
        },
        f"l_shipdate >= TIMESTAMP '{SHIP_SPLIT}'",
    ),
)
_PSI_SQL = """ranges AS (SELECT dataset, "column", min(value) AS lo, max(value) AS hi FROM sides WHERE NOT is_current GROUP BY 1, 2),
 slots AS (SELECT s.dataset, s."column", is_current,
   CASE WHEN value < lo THEN 0 WHEN value >= hi THEN 9 ELSE least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS INT), 9) END AS slot
   FROM sides s JOIN ranges r ON s.dataset = r.dataset AND s."column" = r."column"),
 filled AS (SELECT k.dataset, k."column", b.slot,
     greatest((count(*) FILTER (WHERE s.slot = b.slot AND NOT is_current)) / (count(*) FILTER (WHERE NOT is_current)), 1e-6) AS pb,
     greatest((count(*) FILTER (WHERE s.slot = b.slot AND is_current)) / (count(*) FILTER (WHERE is_current)), 1e-6) AS pc
   FROM ranges k, (SELECT unnest(range(0, 10)) AS slot) b, slots s
   WHERE s.dataset = k.dataset AND s."column" = k."column" GROUP BY 1, 2, 3),
 psis AS (SELECT dataset, "column", round(sum((pc - pb) * ln(pc / pb)), 4) AS psi FROM filled GROUP BY 1, 2)"""


def _p_sql(distance: str, lam: str) -> str:
    tail = " + ".join(f"({2.0 * (-1) ** (k - 1)}) * exp({-2.0 * k * k} * {lam} * {lam})" for k in range(1, 6))
    body = " + ".join(f"exp(-{(2 * k - 1) ** 2} * pi() * pi() / (8 * {lam} * {lam}))" for k in range(1, 6))
    return f"""greatest(0.0, least(1.0, CASE WHEN {distance} <= 0 THEN 1.0
      WHEN {lam} < 1 THEN 1.0 - sqrt(2 * pi()) / {lam} * ({body}) ELSE {tail} END))"""


def _ks_sql(source: str, where: str = "true") -> str:
    return f"""vc AS (SELECT dataset, "column", value, count(*) FILTER (WHERE NOT is_current) AS nb,
     count(*) FILTER (WHERE is_current) AS nc FROM {source} WHERE {where} GROUP BY 1, 2, 3),
 cum AS (SELECT dataset, "column",
     sum(nb) OVER w / sum(nb) OVER k - sum(nc) OVER w / sum(nc) OVER k AS gap, sum(nb) OVER k AS tb, sum(nc) OVER k AS tc
   FROM vc WINDOW w AS (PARTITION BY dataset, "column" ORDER BY value), k AS (PARTITION BY dataset, "column")),
 dist AS (SELECT dataset, "column", max(abs(gap)) AS distance, CAST(max(tb) AS DOUBLE) AS tb, CAST(max(tc) AS DOUBLE) AS tc FROM cum GROUP BY 1, 2),
 lams AS (SELECT *, sqrt(tb * tc / (tb + tc)) * distance AS lam FROM dist),
 kss AS (SELECT dataset, "column", distance, {_p_sql('distance', 'lam')} AS p_value FROM lams)"""


@_query("psi", f"WITH {_SIDES_SQL}, {_PSI_SQL} SELECT * FROM psis")
def psi(spark, folder):
    return d.psi(numeric_pair(spark, folder))


@_query(
    "ks_test",
    f"""WITH {_SIDES_SQL}, {_ks_sql('sides')} SELECT dataset, "column", round(distance, 4) AS distance,
    round(p_value, 4) AS p_value FROM kss""",
)
def ks_test(spark, folder):
    return d.ks_test(numeric_pair(spark, folder)).select(
        "dataset", "column", F.round("distance", 4).alias("distance"), F.round("p_value", 4).alias("p_value")
    )


_CHECK_SQL = f"""{_SIDES_SQL}, {_PSI_SQL}, {_ks_sql('sides')},
 checks AS (SELECT dataset, "column", p_value < 0.05 AS drift,
   CASE WHEN p_value < 0.05 AND (distance >= 0.5 OR psi >= 0.25) THEN 'critical' WHEN p_value < 0.05 THEN 'warning' END AS severity,
   round(distance, 4) AS ks_distance, round(p_value, 4) AS p_value, psi FROM kss JOIN psis USING (dataset, "column"))"""


@_query("drift_check", f"WITH {_CHECK_SQL} SELECT * FROM checks")
def drift_check(spark, folder):
    return d.drift_check(numeric_pair(spark, folder))


@_query(
    "drift_alert",
    f"""WITH {_CHECK_SQL} SELECT 'model-1' AS model_version_id, 'data_drift' AS drift_type, severity,
      "column" AS affected, ks_distance, psi, 'open' AS status FROM checks WHERE drift""",
)
def drift_alert(spark, folder):
    alerts = d.drift_alert(d.drift_check(numeric_pair(spark, folder)), "model-1", "2024-02-01 00:00:00")
    return alerts.select(
        "model_version_id",
        "drift_type",
        "severity",
        F.array_join("affected_features", ",").alias("affected"),
        "detection_metrics.ks_distance",
        "detection_metrics.psi",
        "status",
    )


def order_halves(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Early orders, and late ones with prices up by a fifth."""
    orders = table(spark, folder, "orders").withColumn("is_final", F.col("o_orderstatus") == "F")
    late = _since(orders, "o_orderdate", ORDER_SPLIT)
    return _before(orders, "o_orderdate", ORDER_SPLIT), late.withColumn("o_totalprice", F.col("o_totalprice") * 1.2)


_LATE = f"o_orderdate >= TIMESTAMP '{ORDER_SPLIT}'"
_TEXT_SQL = _long_sql(
    "orders",
    "orders",
    {
        "o_orderstatus": "o_orderstatus",
        "o_orderpriority": "o_orderpriority",
        "is_final": "CAST(o_orderstatus = 'F' AS VARCHAR)",
    },
    _LATE,
)
_NUMERIC_SQL = _long_sql(
    "orders",
    "orders",
    {
        "o_orderkey": "CAST(o_orderkey AS DOUBLE)",
        "o_custkey": "CAST(o_custkey AS DOUBLE)",
        "o_totalprice": f"CASE WHEN {_LATE} THEN o_totalprice * 1.2 ELSE o_totalprice END",
    },
    _LATE,
)
_CATEGORY_SQL = """cc AS (SELECT dataset, "column", value, CAST(count(*) FILTER (WHERE NOT is_current) AS DOUBLE) AS nb,
   CAST(count(*) FILTER (WHERE is_current) AS DOUBLE) AS nc FROM texts GROUP BY 1, 2, 3),
 ct AS (SELECT dataset, "column", sum(nb) AS tb, sum(nc) AS tc, count(*) AS k FROM cc GROUP BY 1, 2),
 stats AS (SELECT cc.dataset, cc."column", max(k) AS k,
   sum(CASE WHEN nb = 0 AND nc > 0 THEN 'inf'::DOUBLE WHEN nb = 0 THEN 0
       ELSE (nc - nb * tc / tb) * (nc - nb * tc / tb) / (nb * tc / tb) END) AS pearson,
   max((nb / tb - nc / tc) * (nb / tb - nc / tc) / ((nb + nc) / (tb + tc) * (1 - (nb + nc) / (tb + tc)) * (1 / tb + 1 / tc))) AS z2
   FROM cc JOIN ct ON cc.dataset = ct.dataset AND cc."column" = ct."column" GROUP BY 1, 2),
 chosen AS (SELECT dataset, "column", CASE WHEN k <= 2 THEN 'z' ELSE 'chisquare' END AS test,
   CASE WHEN k <= 2 THEN z2 ELSE pearson END AS statistic, (k - 1)::BIGINT AS dof FROM stats),
 cats AS (SELECT *, CASE WHEN statistic / 2 > 300 THEN 0.0 WHEN statistic <= 0 THEN 1.0 ELSE 1.0 - list_sum(list_transform(range(0, 400),
     lambda n: exp((dof / 2 + n) * ln(statistic / 2) - statistic / 2 - lgamma(dof / 2 + n + 1)))) END AS p_value FROM chosen)"""


@_query(
    "categorical_drift",
    f"""WITH texts AS ({_TEXT_SQL}), {_CATEGORY_SQL} SELECT "column", test, round(statistic, 4) AS statistic, dof,
      round(p_value, 4) AS p_value, p_value < 0.05 AS drift FROM cats""",
)
def categorical_drift(spark, folder):
    early, late = order_halves(spark, folder)
    tested = d.categorical_drift(early, late, ["o_orderstatus", "o_orderpriority", "is_final"])
    return tested.select(
        "column",
        "test",
        F.round("statistic", 4).alias("statistic"),
        "dof",
        F.round("p_value", 4).alias("p_value"),
        "drift",
    )


_COLUMNS_SQL = f"""texts AS ({_TEXT_SQL}), nums AS ({_NUMERIC_SQL}), {_CATEGORY_SQL}, {_ks_sql('nums')},
 tests AS (SELECT "column", p_value < 0.05 AS drift_detected, round(p_value, 4) AS drift_score, test FROM cats
   UNION ALL SELECT "column", p_value < 0.05, round(p_value, 4), 'ks' FROM kss)"""


@_query("column_drift", f"WITH {_COLUMNS_SQL} SELECT * FROM tests")
def column_drift(spark, folder):
    return d.column_drift(*order_halves(spark, folder)).drop("dataset")


_VERDICT_SQL = f"""{_COLUMNS_SQL}, verdict AS (SELECT count(*) FILTER (WHERE drift_detected) / count(*) >= 0.5 AS dataset_drift,
   (count(*) FILTER (WHERE drift_detected))::BIGINT AS drifted_columns, count(*)::BIGINT AS total_columns,
   round(count(*) FILTER (WHERE drift_detected) / count(*), 4) AS share_drifted,
   coalesce(string_agg("column", ',' ORDER BY "column") FILTER (WHERE drift_detected), '') AS affected FROM tests)"""


def _flat_verdict(verdict: DataFrame) -> DataFrame:
    return verdict.withColumn("affected", F.array_join("affected_features", ",")).drop("affected_features")


@_query("dataset_drift", f"WITH {_VERDICT_SQL} SELECT * FROM verdict")
def dataset_drift(spark, folder):
    return _flat_verdict(d.dataset_drift(d.column_drift(*order_halves(spark, folder)))).drop("dataset")


@_query(
    "dataset_drift_alert",
    f"""WITH {_VERDICT_SQL} SELECT 'model-2' AS model_version_id, 'data_drift' AS drift_type, 'warning' AS severity,
      affected, drifted_columns, share_drifted FROM verdict WHERE share_drifted >= 0.1""",
)
def dataset_drift_alert(spark, folder):
    verdict = d.dataset_drift(d.column_drift(*order_halves(spark, folder)), share_limit=0.1)
    return _flat_verdict(d.dataset_drift_alert(verdict, "model-2"))


def _sweep(spark, folder):
    early, late = order_halves(spark, folder)
    prices = ["o_totalprice", "o_orderkey"]
    datasets = {
        "early": early.select(prices),
        "late": late.select(prices),
        "early_keys": early.select("o_orderkey", "o_orderstatus"),
        "late_keys": late.select("o_orderkey", "o_orderstatus"),
    }
    configs = [
        d.MonitorConfig("m1", "v1", "early", "late"),
        d.MonitorConfig("m2", "v2", "early", "late"),
        d.MonitorConfig("m3", "v3", "early_keys", "late_keys"),
        d.MonitorConfig("m4", "v4", "early", None),
        d.MonitorConfig("m5", "v5", "early", "absent"),
        d.MonitorConfig("m6", "v6", "early", "late", is_active=False),
    ]
    return d.monitor_sweep(configs, lambda name: datasets[name])


_SWEEP_SQL = f"""{_COLUMNS_SQL}, pairs AS (
   SELECT 'prices' AS pair, count(*) FILTER (WHERE drift_detected) AS bad, count(*) AS k,
     string_agg("column", ',' ORDER BY "column") FILTER (WHERE drift_detected) AS affected FROM tests WHERE "column" IN ('o_totalprice', 'o_orderkey')
   UNION ALL SELECT 'keys', count(*) FILTER (WHERE drift_detected), count(*),
     string_agg("column", ',' ORDER BY "column") FILTER (WHERE drift_detected) FROM tests WHERE "column" IN ('o_orderkey', 'o_orderstatus')),
 checked AS (SELECT c.*, p.* FROM (VALUES ('m1', 'v1', 'prices'), ('m2', 'v2', 'prices'), ('m3', 'v3', 'keys')) c(config_id, model_version_id, pr)
   JOIN pairs p ON p.pair = c.pr)"""


@_query(
    "monitor_sweep",
    f"""WITH {_SWEEP_SQL} SELECT model_version_id, config_id, 'data_drift' AS drift_type, 'critical' AS severity, affected,
      bad::BIGINT AS drifted_columns, round(bad / k, 4) AS share_drifted FROM checked WHERE bad / k >= 0.5""",
)
def monitor_sweep(spark, folder):
    return _flat_verdict(_sweep(spark, folder)[0])


@_query(
    "monitor_sweep_summary",
    f"""WITH {_SWEEP_SQL} SELECT 5::BIGINT AS active_configs, count(*)::BIGINT AS checked,
      (count(*) FILTER (WHERE bad / k >= 0.5))::BIGINT AS alerts_raised, (5 - count(*))::BIGINT AS skipped FROM checked""",
)
def monitor_sweep_summary(spark, folder):
    return _sweep(spark, folder)[1]


@_query(
    "list_alerts",
    """SELECT event_id AS id, ts AS detected_at, 'open' AS status, value FROM events
       WHERE event_type IN ('error', 'click') ORDER BY ts DESC, event_id LIMIT 200""",
)
def list_alerts(spark, folder):
    alerts = table(spark, folder, "events").selectExpr(
        "event_id AS id",
        "ts AS detected_at",
        "if(event_type IN ('error', 'click'), 'open', 'acknowledged') AS status",
        "value",
    )
    return d.list_alerts(alerts, "open")


@_query(
    "numeric_series",
    """SELECT 'props' AS "column", count(*)::BIGINT AS n, round(sum(v), 4) AS total FROM (
         SELECT try_cast(CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v
         FROM events) WHERE v IS NOT NULL""",
)
def numeric_series(spark, folder):
    from tallyward.functions.reshape import long_numeric

    texts = table(spark, folder, "events").selectExpr(
        "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN event_type ELSE cast(value AS string) END AS props"
    )
    return (
        long_numeric(texts, ["props"])
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    )
