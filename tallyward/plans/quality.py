"""Quality queries over the driver tables, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators import profiles
from tallyward.operators import quality as q
from tallyward.operators.quality import QualityRule
from tallyward.plans.registry import Registry
from tallyward.plans.sensitive import SCANNED
from tallyward.plans.tables import table
from tallyward.session import scratch_path

REGISTRY = Registry()
_query = REGISTRY.query

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _flat(results: DataFrame) -> DataFrame:
    shown = F.transform("sample_failures", lambda v: F.coalesce(v, F.lit("null")))
    return results.select(
        "rule_id",
        "column",
        "status",
        "records_evaluated",
        "records_failed",
        F.round("failure_percentage", 4).alias("failure_percentage"),
        F.array_join(shown, "|").alias("samples"),
    )


def _oracle(rule_id: str, column: str, source: str, violation: str, value: str | None = None) -> str:
    value = value or column
    return f"""
    SELECT '{rule_id}' AS rule_id, '{column}' AS "column",
           CASE WHEN bad = 0 THEN 'passed' ELSE 'failed' END AS status,
           n AS records_evaluated, bad AS records_failed,
           round(100.0 * bad / n, 4) AS failure_percentage,
           coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (
             SELECT coalesce(CAST({value} AS VARCHAR), 'null') AS v FROM {source}
             WHERE {violation} ORDER BY v LIMIT 10)), '') AS samples
    FROM (SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE {violation}))::BIGINT AS bad FROM {source})"""


def _unique_oracle(rule_id: str, column: str, source: str) -> str:
    dup = f"{column} IN (SELECT {column} FROM {source} GROUP BY 1 HAVING count(*) > 1)"
    return _oracle(rule_id, column, source, dup)


_SEGMENTED = "(SELECT nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"


@_query("quality_not_null", _oracle("segment_filled", "c_mktsegment", _SEGMENTED, "c_mktsegment IS NULL"))
def quality_not_null(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")
    )
    return _flat(q.evaluate_rules(customers, [QualityRule("segment_filled", "not_null", "c_mktsegment")]))


@_query(
    "quality_unique",
    _unique_oracle("orderkey_unique", "l_orderkey", "lineitem")
    + " UNION ALL "
    + _unique_oracle("partkey_unique", "l_partkey", "lineitem"),
)
def quality_unique(spark, folder):
    rules = [
        QualityRule("orderkey_unique", "unique", "l_orderkey"),
        QualityRule("partkey_unique", "unique", "l_partkey"),
    ]
    return _flat(q.evaluate_rules(table(spark, folder, "lineitem"), rules))


_TEXTS_UNIQUE = {"text_unique": ("documents", "text"), "source_unique": ("documents", "source"), "url_unique": ("pages", "url")}


@_query("quality_unique_text", " UNION ALL ".join(_unique_oracle(rule, column, name) for rule, (name, column) in _TEXTS_UNIQUE.items()))
def quality_unique_text(spark, folder):
    """Whole texts: those that occur once are never shuffled."""
    found = [
        q.evaluate_rules(table(spark, folder, name), [QualityRule(rule, "unique", column)]) for rule, (name, column) in _TEXTS_UNIQUE.items()
    ]
    return _flat(found[0].unionByName(found[1]).unionByName(found[2]))


@_query(
    "quality_regex",
    _oracle("language_code", "lang", "documents", "NOT regexp_matches(lang, '^e')")
    + " UNION ALL "
    + _oracle("source_name", "source", "documents", "NOT regexp_matches(source, '^src1?[0-9]$')"),
)
def quality_regex(spark, folder):
    rules = [
        QualityRule("language_code", "regex", "lang", pattern="^e"),
        QualityRule("source_name", "regex", "source", pattern="^src1?[0-9]$"),
    ]
    return _flat(q.evaluate_rules(table(spark, folder, "documents"), rules))


@_query("quality_range", _oracle("balance", "c_acctbal", "customer", "c_acctbal < 0"))
def quality_range(spark, folder):
    return _flat(
        q.evaluate_rules(
            table(spark, folder, "customer"), [QualityRule("balance", "range", "c_acctbal", min_value=0)]
        )
    )


@_query("quality_in_set", _oracle("status_known", "o_orderstatus", "orders", "o_orderstatus NOT IN ('O', 'F')"))
def quality_in_set(spark, folder):
    rule = QualityRule("status_known", "in_set", "o_orderstatus", values=("O", "F"))
    return _flat(q.evaluate_rules(table(spark, folder, "orders"), [rule]))


@_query(
    "quality_column_exists",
    """
    SELECT r.rule_id, r.col AS "column",
           CASE WHEN n.n = 0 THEN 'error' WHEN r.present THEN 'passed' ELSE 'failed' END AS status,
           0::BIGINT AS records_evaluated, 0::BIGINT AS records_failed,
           CAST(0 AS DOUBLE) AS failure_percentage, '' AS samples
    FROM (VALUES ('has_name', 'p_name', true), ('has_color', 'p_color', false)) r(rule_id, col, present),
         (SELECT count(*) AS n FROM part) n""",
)
def quality_column_exists(spark, folder):
    rules = [QualityRule("has_name", "column_exists", "p_name"), QualityRule("has_color", "custom", "p_color")]
    return _flat(q.evaluate_rules(table(spark, folder, "part"), rules))


@_query(
    "quality_freshness",
    """
    SELECT r.rule_id, 'ts' AS "column",
           CASE WHEN e.latest >= TIMESTAMP '2024-02-01' - r.age THEN 'passed' ELSE 'failed' END AS status,
           0::BIGINT AS records_evaluated, 0::BIGINT AS records_failed,
           CAST(0 AS DOUBLE) AS failure_percentage, '' AS samples
    FROM (VALUES ('weekly', INTERVAL 7 DAY), ('hourly', INTERVAL 1 HOUR)) r(rule_id, age),
         (SELECT max(ts) AS latest FROM events) e""",
)
def quality_freshness(spark, folder):
    rules = [
        QualityRule("weekly", "freshness", "ts", max_age="7 days"),
        QualityRule("hourly", "freshness", "ts", max_age="1 hour"),
    ]
    return _flat(q.evaluate_rules(table(spark, folder, "events"), rules, now="2024-02-01 00:00:00"))


_MIXED = [
    QualityRule("key_unique", "unique", "o_orderkey"),
    QualityRule("customer_unique", "unique", "o_custkey"),
    QualityRule("price_limit", "range", "o_totalprice", min_value=1000, max_value=450000),
    QualityRule("urgent_only", "in_set", "o_orderpriority", values=("1-URGENT",)),
    QualityRule("missing_column", "not_null", "o_comment"),
]


@_query(
    "quality_result_row",
    " UNION ALL ".join(
        [
            _unique_oracle("key_unique", "o_orderkey", "orders"),
            _unique_oracle("customer_unique", "o_custkey", "orders"),
            _oracle("price_limit", "o_totalprice", "orders", "o_totalprice < 1000 OR o_totalprice > 450000"),
            _oracle("urgent_only", "o_orderpriority", "orders", "o_orderpriority <> '1-URGENT'"),
            """SELECT 'missing_column', 'o_comment', 'error', 0, 0, 0.0,
               'column ''o_comment'' not found'""",
        ]
    ),
)
def quality_result_row(spark, folder):
    return _flat(q.evaluate_rules(table(spark, folder, "orders"), _MIXED))


_SCORECARD = {
    "customer": [
        QualityRule("c1", "not_null", "c_name"),
        QualityRule("c2", "unique", "c_custkey"),
        QualityRule("c3", "range", "c_acctbal", min_value=0),
        QualityRule("c4", "in_set", "c_mktsegment", values=("BUILDING", "MACHINERY")),
    ],
    "orders": [
        QualityRule("o1", "unique", "o_orderkey"),
        QualityRule("o2", "range", "o_totalprice", min_value=0),
        QualityRule("o3", "in_set", "o_orderstatus", values=("F", "O", "P")),
    ],
    "lineitem": [
        QualityRule("l1", "unique", "l_orderkey"),
        QualityRule("l2", "range", "l_quantity", min_value=1, max_value=50),
        QualityRule("l3", "regex", "l_returnflag", pattern="^[ANR]$"),
        QualityRule("l4", "not_null", "l_shipdate"),
    ],
    "supplier": [],
}


def scorecard(spark, folder):
    tables = {name: table(spark, folder, name) for name in _SCORECARD}
    return q.quality_run(tables, _SCORECARD, samples=0).withColumn("score", F.round("score", 4))


_query(
    "quality_run",
    """
    WITH checks AS (
      SELECT 'customer' AS asset, count(*) FILTER (WHERE c_name IS NULL) = 0 AS ok FROM customer
      UNION ALL SELECT 'customer', count(c_custkey) = count(DISTINCT c_custkey) FROM customer
      UNION ALL SELECT 'customer', count(*) FILTER (WHERE c_acctbal < 0) = 0 FROM customer
      UNION ALL SELECT 'customer', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) = 0 FROM customer
      UNION ALL SELECT 'orders', count(o_orderkey) = count(DISTINCT o_orderkey) FROM orders
      UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_totalprice < 0) = 0 FROM orders
      UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) = 0 FROM orders
      UNION ALL SELECT 'lineitem', count(l_orderkey) = count(DISTINCT l_orderkey) FROM lineitem
      UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 50) = 0 FROM lineitem
      UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE NOT regexp_matches(l_returnflag, '^[ANR]$')) = 0 FROM lineitem
      UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE l_shipdate IS NULL) = 0 FROM lineitem)
    SELECT asset, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 4) AS score,
           count(*)::BIGINT AS total_rules, (count(*) FILTER (WHERE ok))::BIGINT AS passed,
           (count(*) FILTER (WHERE NOT ok))::BIGINT AS failed
    FROM checks GROUP BY asset
    UNION ALL SELECT 'supplier', NULL, 0, 0, 0""",
)(scorecard)


@_query(
    "quality_latest_runs",
    """
    SELECT asset, run_id, run_at, score FROM (
      SELECT user_id AS asset, event_id AS run_id, ts AS run_at, value AS score,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank
      FROM events) WHERE rank <= 3""",
)
def quality_latest_runs(spark, folder):
    runs = table(spark, folder, "events").selectExpr(
        "user_id AS asset", "event_id AS run_id", "ts AS run_at", "value AS score"
    )
    return q.latest_runs(runs, 3)


_PROFILED = SCANNED | {"embeddings": [*SCANNED["embeddings"], "embedding"]}
_NUMBERS = {
    "r_regionkey", "n_nationkey", "n_regionkey", "c_custkey", "c_nationkey", "c_acctbal", "s_suppkey", "s_nationkey", "s_acctbal",
    "p_partkey", "p_size", "p_retailprice", "o_orderkey", "o_custkey", "o_totalprice", "l_orderkey", "l_partkey", "l_suppkey",
    "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "event_id", "user_id", "value", "doc_id", "n_chars",
    "vec_id", "label", "page_id", "item_id", "quality", "toxic", "conv_id", "turn",
}
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS asset, '{c}' AS "column", count(*)::BIGINT AS row_count,
        (count(*) - count({c}))::BIGINT AS null_count, count({c})::BIGINT AS non_null,
        count(DISTINCT {c})::BIGINT AS distinct_count, {str(c in _NUMBERS).lower()} AS is_numeric FROM {t}"""
    for t, columns in _PROFILED.items()
    for c in columns
)


def _profiles(spark, folder):
    parts = [
        q.profile_columns(table(spark, folder, t), columns).withColumn("asset", F.lit(t))
        for t, columns in _PROFILED.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@_query("profile_columns", _PROFILE_SQL)
def profile_columns(spark, folder):
    """Every column of every table."""
    return _profiles(spark, folder)


_EVENT_COLUMNS = SCANNED["events"]


@_query(
    "profile_sketches",
    "WITH "
    + "p AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*)::BIGINT AS row_count, (count(*) - count({c}))::BIGINT AS null_count,
        {str(c in _NUMBERS).lower()} AS is_numeric FROM events"""
        for c in _EVENT_COLUMNS
    )
    + """) SELECT *, true AS distinct_fits, CASE WHEN is_numeric THEN true END AS median_fits,
      (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events)::BIGINT AS parts FROM p""",
)
def profile_sketches(spark, folder):
    """Events profiled by day, the last day alone, and merged: counts are exact, estimates within their bounds.

    Distinct counts may err by four standard errors, the rank of the median by three hundredths.
    """
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts").cast("string"))
    path = scratch_path(spark, "profile-parts")
    last = events.agg(F.max("day")).first()[0]
    profiles.write_parts(events.where(F.col("day") < last), path, "day", _EVENT_COLUMNS)
    profiles.write_part(events.where(F.col("day") == last), path, last, _EVENT_COLUMNS)
    merged = profiles.merged_profile(profiles.read_parts(spark, path))
    exact = q.profile_columns(table(spark, folder, "events"), _EVENT_COLUMNS).select("column", F.col("distinct_count").alias("exact"))
    medians = {r.column: r.quantiles[1] for r in merged.where("quantiles IS NOT NULL").select("column", "quantiles").collect()}
    below = [F.avg((F.col(c) <= F.lit(m)).cast("double")) for c, m in medians.items()]
    ranks = events.agg(*[F.struct(F.lit(c).alias("column"), b.alias("rank")).alias(f"r{i}") for i, (c, b) in enumerate(zip(medians, below, strict=True))])
    ranks = ranks.select(F.inline(F.array(*ranks.columns)))
    fits = F.abs(F.col("distinct_count") - F.col("exact")) <= 4 * profiles.theta_error() * F.col("exact")
    parts = profiles.read_parts(spark, path).agg(F.count_distinct("part").alias("parts"))
    return merged.join(exact, "column").join(ranks, "column", "left").join(parts, F.lit(True)).select(
        "column", "row_count", "null_count", "is_numeric", fits.alias("distinct_fits"),
        (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_fits"), "parts",
    )


@_query(
    "suggest_rules",
    f"""
    WITH profile AS ({_PROFILE_SQL}),
    candidates AS (
      SELECT "column", 'not_null' AS rule_type, 'completeness' AS dimension,
             CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS VARCHAR) AS pattern
      FROM profile WHERE null_count = 0 AND non_null > 0
      UNION ALL
      SELECT "column", 'unique', 'uniqueness', NULL, NULL FROM profile
      WHERE non_null > 1 AND distinct_count = non_null
        AND ("column" = 'id' OR "column" LIKE '%\\_id' ESCAPE '\\' OR "column" LIKE '%email%'
             OR distinct_count = row_count)
      UNION ALL
      SELECT "column", 'range', 'validity', 0, NULL FROM profile WHERE is_numeric
        AND regexp_matches("column", 'amount|price|total|revenue|cost|qty|quantity|count|balance|salary|fee')
      UNION ALL
      SELECT "column", 'regex', 'validity', NULL, '{EMAIL}' FROM profile WHERE "column" LIKE '%email%')
    SELECT * FROM candidates WHERE NOT (rule_type = 'not_null' AND "column" IN ('o_orderkey', 'p_name'))""",
)
def suggest_rules(spark, folder):
    existing = spark.createDataFrame(
        [("not_null", "o_orderkey"), ("not_null", "p_name")], "rule_type string, column string"
    )
    return q.suggest_rules(_profiles(spark, folder), existing)
