"""Classification and personal-data queries over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.constants import ENTITIES, SYSTEM_RULES
from tallyward.operators import classify as c
from tallyward.operators import pii as p
from tallyward.plans.registry import Registry
from tallyward.plans.tables import table

REGISTRY = Registry()
_query = REGISTRY.query


# Every table is scanned whole, with every column but the embedding vectors.
SCANNED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS asset, '{col}' AS \"column\", CAST({col} AS VARCHAR) AS v FROM {t}"
        for t, columns in SCANNED.items()
        for col in columns
    )


def _rule_test(rule: tuple, text: str) -> str:
    _, _, _, method, pattern, keywords = rule
    if method == "regex":
        return f"regexp_matches({text}, {_quoted('(?i)' + pattern)})"
    return "(" + " OR ".join(f"contains(lower({text}), {_quoted(k)})" for k in keywords) + ")"


_FINDINGS_SQL = (
    f"WITH vals AS ({_values_sql()}), flags AS (SELECT asset, \"column\", "
    + ", ".join(
        f"coalesce(bool_or({_rule_test(rule, 'v')}), false) OR {_rule_test(rule, chr(34) + 'column' + chr(34))} AS hit_{i}"
        for i, rule in enumerate(SYSTEM_RULES)
    )
    + ' FROM vals GROUP BY asset, "column"), findings AS ('
    + " UNION ALL ".join(
        f"""SELECT asset, "column", {_quoted(rule[0])} AS rule, {_quoted(rule[1])} AS category,
            {_quoted(rule[2])} AS sensitivity_level, CAST(0.9 AS DOUBLE) AS confidence
            FROM flags WHERE hit_{i}"""
        for i, rule in enumerate(SYSTEM_RULES)
    )
    + ")"
)
_RANK_SQL = "greatest(coalesce(list_position(['public','internal','confidential','restricted'], {}), 0) - 1, 0)"


def _findings(spark, folder) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [c.classify_columns(table(spark, folder, t), columns=cols, asset=t) for t, cols in SCANNED.items()],
    )


@_query("classify_columns", _FINDINGS_SQL + " SELECT * FROM findings")
def classify_columns(spark, folder):
    return _findings(spark, folder)


@_query(
    "max_sensitivity",
    _FINDINGS_SQL
    + f""" SELECT asset, "column",
      (['public','internal','confidential','restricted'])[1 + max({_RANK_SQL.format('sensitivity_level')})] AS sensitivity_level
      FROM findings GROUP BY asset, "column" """,
)
def max_sensitivity(spark, folder):
    return c.max_sensitivity(_findings(spark, folder), "asset", "column")


@_query(
    "classification_run",
    _FINDINGS_SQL
    + """ SELECT 'run-1' AS run_id, 'classification' AS scan_type,
      (SELECT count(DISTINCT (asset, "column")) FROM vals)::BIGINT AS columns_scanned,
      (SELECT count(*) FROM findings)::BIGINT AS total_findings""",
)
def classification_run(spark, folder):
    columns = spark.createDataFrame(
        [(t, col) for t, cols in SCANNED.items() for col in cols], "asset string, column string"
    )
    return c.classification_run(_findings(spark, folder), columns, "run-1")


def _stored_findings(spark, folder):
    """Documents as assets; a finding for every document that mentions an address-like token."""
    documents = table(spark, folder, "documents")
    findings = documents.select(
        F.concat(F.lit("f"), "doc_id").alias("id"),
        F.col("doc_id").alias("asset_id"),
        F.concat(F.lit("run-"), F.col("doc_id") % 3).alias("run_id"),
        "lang",
        F.col("n_chars").alias("detected_at"),
    )
    assets = documents.select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return findings, assets


@_query(
    "findings_for_run",
    """SELECT 'f' || doc_id AS id, doc_id AS asset_id, lang, n_chars AS detected_at,
       'run-' || (doc_id % 3) AS run_id, source AS "column" FROM documents WHERE doc_id % 3 = 1""",
)
def findings_for_run(spark, folder):
    findings, assets = _stored_findings(spark, folder)
    return c.findings_for_run(findings, assets, "run-1")


@_query(
    "latest_findings",
    """SELECT 'f' || doc_id AS id, doc_id AS asset_id, lang, n_chars AS detected_at,
       'run-' || (doc_id % 3) AS run_id, source AS "column" FROM documents
       ORDER BY n_chars DESC, 'f' || doc_id LIMIT 500""",
)
def latest_findings(spark, folder):
    findings, assets = _stored_findings(spark, folder)
    return c.latest_findings(findings, assets)


@_query(
    "scan_history",
    """SELECT event_id AS id, 'org' || (user_id % 4) AS org_id, ts AS started_at FROM events
       WHERE user_id % 4 = 1 ORDER BY ts DESC, event_id LIMIT 100""",
)
def scan_history(spark, folder):
    runs = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("org"), F.col("user_id") % 4).alias("org_id"),
        F.col("ts").alias("started_at"),
    )
    return c.scan_history(runs, "org1")


def _recognizer_sql(r: p.Recognizer) -> str:
    found = f"regexp_matches(v, {_quoted(r.pattern)})"
    if r.check is None:
        return found
    candidates = f"regexp_extract_all(v, {_quoted(r.pattern)})"
    if r.check == "luhn":
        digits = "regexp_replace(m, '[ -]', '', 'g')"
        test = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
            CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substr({digits}, i, 1) AS INT)
                 WHEN CAST(substr({digits}, i, 1) AS INT) > 4 THEN 2 * CAST(substr({digits}, i, 1) AS INT) - 9
                 ELSE 2 * CAST(substr({digits}, i, 1) AS INT) END)) % 10 = 0"""
    else:
        moved = "(substr(m, 5) || substr(m, 1, 4))"
        test = f"""list_reduce(list_transform(range(1, length({moved}) + 1), lambda i: CAST(ascii(substr({moved}, i, 1)) AS BIGINT)),
            lambda a, d: CASE WHEN d >= 65 THEN (a * 100 + d - 55) % 97 ELSE (a * 10 + d - 48) % 97 END, 0) = 1"""
    return f"{found} AND len(list_filter({candidates}, lambda m: {test})) > 0"


_HITS_SQL = (
    f"WITH vals AS ({_values_sql()}), hits AS ("
    + " UNION ALL ".join(
        f"""SELECT asset, "column", '{r.entity}' AS entity, CAST({r.score} AS DOUBLE) AS score
            FROM vals WHERE v IS NOT NULL AND v <> '' AND {_recognizer_sql(r)} GROUP BY asset, "column" """
        for r in p.DEFAULT_RECOGNIZERS
    )
    + "), info(entity, category, level, weight, priority) AS (VALUES "
    + ", ".join(f"('{e}', '{a}', '{s}', {w}, {n})" for e, (a, s, w, n) in ENTITIES.items())
    + """), ranked AS (
      SELECT h.*, category, level, row_number() OVER (
        PARTITION BY asset, "column" ORDER BY weight * score DESC, priority DESC) AS rank
      FROM hits h JOIN info USING (entity) WHERE score >= 0.4)"""
)


def _hits(spark, folder) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [p.detect_pii_values(table(spark, folder, t), cols, asset=t) for t, cols in SCANNED.items()],
    )


@_query("detect_pii_values", _HITS_SQL + " SELECT * FROM hits")
def detect_pii_values(spark, folder):
    return _hits(spark, folder)


@_query("pick_entity", _HITS_SQL + ' SELECT asset, "column", entity, score FROM ranked WHERE rank = 1')
def pick_entity(spark, folder):
    return p.pick_entity(_hits(spark, folder))


_RECORD_SQL = """SELECT asset, "column", category || ':' || entity AS category,
    level AS sensitivity_level, round(score, 3) AS confidence FROM ranked WHERE rank = 1"""


@_query("record_pii", f"{_HITS_SQL} {_RECORD_SQL}")
def record_pii(spark, folder):
    return p.record_pii(p.pick_entity(_hits(spark, folder)))


@_query(
    "bump_sensitivity",
    _HITS_SQL
    + f""", recorded AS ({_RECORD_SQL}),
    cols AS (SELECT DISTINCT asset, "column", CASE "column" WHEN 'html' THEN 'restricted' WHEN 'lang' THEN 'internal'
             ELSE 'unclassified' END AS current FROM vals)
    SELECT c.asset, c."column",
      CASE WHEN r.sensitivity_level IS NOT NULL
            AND {_RANK_SQL.format('r.sensitivity_level')} > {_RANK_SQL.format('c.current')}
           THEN r.sensitivity_level ELSE c.current END AS sensitivity_level
    FROM cols c LEFT JOIN recorded r ON c.asset = r.asset AND c."column" = r."column" """,
)
def bump_sensitivity(spark, folder):
    columns = spark.createDataFrame(
        [
            (t, col, {"html": "restricted", "lang": "internal"}.get(col, "unclassified"))
            for t, cols in SCANNED.items()
            for col in cols
        ],
        "asset string, column string, sensitivity_level string",
    )
    return p.bump_assets(columns, p.record_pii(p.pick_entity(_hits(spark, folder))))


@_query(
    "pii_scan_summary",
    _HITS_SQL
    + """ SELECT a.asset, a.columns_scanned, coalesce(f.findings, 0)::BIGINT AS findings FROM
      (SELECT asset, count(DISTINCT "column")::BIGINT AS columns_scanned FROM vals GROUP BY asset) a
      LEFT JOIN (SELECT asset, count(*) AS findings FROM ranked WHERE rank = 1 GROUP BY asset) f USING (asset)""",
)
def pii_scan_summary(spark, folder):
    columns = spark.createDataFrame(
        [(t, col) for t, cols in SCANNED.items() for col in cols], "asset string, column string"
    )
    return p.pii_scan_summary(columns, p.pick_entity(_hits(spark, folder)))


@_query(
    "pii_strategy",
    """SELECT category, CASE WHEN category IN ('iam', 'model_registry') THEN 'skipped'
         WHEN category IN ('database', 'warehouse') THEN 'values' ELSE 'column_names' END AS strategy,
       count(*)::BIGINT AS sources
       FROM (SELECT (['database', 'warehouse', 'datalake', 'iam', 'model_registry', 'etl'])[1 + (s_suppkey % 6)] AS category
             FROM supplier) GROUP BY category""",
)
def pii_strategy(spark, folder):
    kinds = F.array(*[F.lit(k) for k in ("database", "warehouse", "datalake", "iam", "model_registry", "etl")])
    sources = table(spark, folder, "supplier").select(
        F.element_at(kinds, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("category")
    )
    return (
        sources.withColumn("strategy", p.pii_strategy(F.col("category")))
        .groupBy("category", "strategy")
        .agg(F.count(F.lit(1)).alias("sources"))
    )
