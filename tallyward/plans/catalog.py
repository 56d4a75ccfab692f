"""Catalog queries: nations are tables, parts their columns, customers models and pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators import catalog as c
from tallyward.operators import registry as r
from tallyward.operators import rollups as q
from tallyward.operators import scripts
from tallyward.plans.registry import Registry
from tallyward.plans.tables import TABLES, table
from tallyward.sources import datasets, files, listing
from tallyward.session import scratch_path

REGISTRY = Registry()
_query = REGISTRY.query

LEVELS = "CASE {0} % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'restricted' ELSE 'unclassified' END"
_COLUMNS = (
    "id", "name", "external_id", "asset_type", "parent_id", "source_id", "sensitivity_level", "domain",
    "quality_score", "first_seen_at", "row_count",
)
# The three kinds of assets, as expressions that both dialects read; {day} adds days to a date.
_ASSETS = {
    "nation": (
        "'n' || n_nationkey", "n_name", "'geo.r' || n_regionkey || '.' || n_name", "'table'", "'r' || n_regionkey",
        "'src' || (n_nationkey % 3)", LEVELS.format("n_nationkey"),
        "CASE WHEN n_nationkey % 4 <> 0 THEN 'dom' || (n_nationkey % 4) END",
        "CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 4.0 END", ("2024-01-01", "n_nationkey"),
        "CASE WHEN n_nationkey % 6 = 5 THEN 'n/a' ELSE CAST(n_nationkey * 10 AS {text}) END",
    ),
    "part": (
        "'p' || p_partkey", "p_name", "'geo.parts.' || p_brand || '.' || p_partkey", "'column'",
        "'n' || (p_partkey % 25)", "'src' || (p_size % 4)", LEVELS.format("p_size"), "p_brand",
        "CASE WHEN p_size % 7 <> 0 THEN p_size * 2.0 END", ("2024-02-01", "p_size"), "CAST(NULL AS {text})",
    ),
    "customer": (
        "'m' || c_custkey", "c_name", "'reg/' || c_name",
        "CASE WHEN c_custkey % 2 = 0 THEN 'ml_model' ELSE 'etl_pipeline' END", "CAST(NULL AS {text})",
        "'src' || (c_nationkey % 5)", "'unclassified'", "c_mktsegment", "CAST(NULL AS DOUBLE)",
        ("2023-01-01", "c_nationkey"), "CAST(NULL AS {text})",
    ),
}


def _expressions(row: tuple, spark_sql: bool) -> list[str]:
    out = []
    for name, value in zip(_COLUMNS, row):
        if isinstance(value, tuple):
            start, days = value
            value = (
                f"timestamp_ntz'{start} 00:00:00' + make_dt_interval({days})"
                if spark_sql
                else f"TIMESTAMP '{start} 00:00:00' + to_days(CAST({days} AS INT))"
            )
        value = value.replace("{text}", "string" if spark_sql else "VARCHAR")
        if name == "quality_score":
            value = f"CAST({value} AS DOUBLE)"
        out.append(f"{value} AS {name}")
    return out


def governed_assets(spark, folder) -> DataFrame:
    parts = [table(spark, folder, t).selectExpr(*_expressions(row, True)) for t, row in _ASSETS.items()]
    return reduce(DataFrame.unionByName, parts).withColumn(
        "metadata", F.create_map(F.lit("row_count"), F.col("row_count"))
    )


def sources(spark, folder) -> DataFrame:
    return table(spark, folder, "region").selectExpr("'src' || r_regionkey AS id", "r_name AS name")


ASSETS_SQL = "assets AS ({}), sources AS (SELECT 'src' || r_regionkey AS id, r_name AS name FROM region)".format(
    " UNION ALL ".join(f"SELECT {', '.join(_expressions(row, False))} FROM {t}" for t, row in _ASSETS.items())
)
_SHOWN = ["id", "name", "asset_type", "sensitivity_level", "domain", "quality_score", "first_seen_at"]
_SHOWN_SQL = ", ".join(_SHOWN)


# ---- sources and sinks -----------------------------------------------------------------------------


@_query(
    "scan_files",
    """SELECT p_type, count(*)::BIGINT AS parts, round(max(p_retailprice), 2) AS top_price FROM part
       WHERE p_size >= 10 GROUP BY 1""",
)
def scan_files(spark, folder):
    parts = files.scan_files(spark, f"{folder}/part.parquet")
    return parts.where("p_size >= 10").groupBy("p_type").agg(
        F.count(F.lit(1)).alias("parts"), F.round(F.max("p_retailprice"), 2).alias("top_price")
    )


@_query(
    "file_inventory",
    " UNION ALL ".join(f"SELECT '{t}' AS name, 'parquet' AS file_format, count(*)::BIGINT AS row_count, true AS size_matches FROM {t}" for t in TABLES),
)
def file_inventory(spark, folder):
    """Listed files of every table with the rows they hold; the size listed is the one that the scan of the rows sees."""
    kept = listing.listed(spark, folder).where(F.endswith("name", F.lit(".parquet")))
    ends = F.regexp_extract("path", r"(?:^|/)([^/]+)\.parquet(?:/|$)", 1)
    listed = kept.select("name", "size_bytes", ends.alias("table"), F.lower(F.element_at(F.split("name", r"\."), -1)).alias("file_format"))
    scanned = reduce(
        DataFrame.unionByName,
        [
            table(spark, folder, t).groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("scanned_bytes"))
            .agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(t))
            for t in TABLES
        ],
    )
    met = listed.join(scanned, ["table", "name"], "left")
    return met.groupBy(F.col("table").alias("name"), "file_format").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.bool_and(F.coalesce(F.col("size_bytes") == F.col("scanned_bytes"), F.lit(True))).alias("size_matches")
    )


@_query(
    "scan_scripts",
    """SELECT p_size AS size, count(*)::BIGINT AS statements, count(DISTINCT p_type)::BIGINT AS sources,
       count(DISTINCT p_partkey % 5)::BIGINT AS targets FROM part GROUP BY 1""",
)
def scan_scripts(spark, folder):
    """A statement per part, written as .sql files by size and scanned again."""
    root = scratch_path(spark, "script-corpus")
    lines = table(spark, folder, "part").selectExpr(
        "p_size AS size", "concat('INSERT INTO mart.m', p_partkey % 5, ' SELECT 1 FROM raw.\"', p_type, '\"; -- from x.y') AS line"
    )
    writer = lines.repartition(4, "size").write.partitionBy("size").option("quote", "").option("sep", "\u0001").option("escape", "\u0002")
    writer.option("extension", "sql").csv(f"{root}/etl")
    found = scripts.sql_table_refs(files.scan_scripts(spark, root))
    each = found.select(F.regexp_extract("path", r"size=(\d+)", 1).cast("int").alias("size"), "sources", "targets")
    return each.groupBy("size").agg(
        F.count(F.lit(1)).alias("statements"), F.count_distinct(F.element_at("sources", 1)).alias("sources"),
        F.count_distinct(F.element_at("targets", 1)).alias("targets"),
    )


@_query("list_files")
def list_files(spark, folder):
    return files.list_files(spark, folder)


@_query(
    "sample_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus
       FROM orders ORDER BY orders.o_orderkey DESC LIMIT 20""",
)
def sample_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return datasets.sample_rows(orders, 20, [F.desc("o_orderkey")])


@_query(
    "load_dataset",
    """SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1""",
)
def load_dataset(spark, folder):
    """Loads the table that holds a column asset of the discovered catalog."""
    orders = table(spark, folder, "orders")
    assets = c.discover_tables({"orders": orders}, "lake", "shop").withColumn("id", F.col("external_id"))
    rows = datasets.load_dataset(
        assets, "lake.shop.orders.o_orderpriority", lambda path: table(spark, folder, path.split(".")[-1])
    )
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "write_results",
    """SELECT event_type, CAST('2024-02-01' AS DATE) AS run_date, count(*)::BIGINT AS findings FROM events GROUP BY 1
       UNION ALL SELECT event_type, CAST('2024-02-02' AS DATE), count(*) FROM events WHERE value > 100 GROUP BY 1""",
)
def write_results(spark, folder):
    """Appends two runs to a result table and reads it back."""
    events = table(spark, folder, "events")
    path = scratch_path(spark, "results")
    for day, rows in (("2024-02-01", events), ("2024-02-02", events.where("value > 100"))):
        counted = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("findings"))
        datasets.write_results(counted, path, day)
    return spark.read.parquet(path).select("event_type", "run_date", "findings")


# ---- building --------------------------------------------------------------------------------------


def _discovered(spark, folder) -> DataFrame:
    return c.discover_tables({t: table(spark, folder, t) for t in TABLES}, "lake", "shop")


@_query(
    "discover_tables",
    """SELECT 'lake.shop' AS external_id, 'shop' AS name, 'schema' AS asset_type, 'lake' AS parent_external_id, CAST(NULL AS VARCHAR) AS row_count
       UNION ALL """
    + " UNION ALL ".join(
        f"""SELECT 'lake.shop.{t}', '{t}', 'table', 'lake.shop', CAST((SELECT count(*) FROM {t}) AS VARCHAR)
        UNION ALL SELECT 'lake.shop.{t}.' || column_name, column_name, 'column', 'lake.shop.{t}', NULL
        FROM (DESCRIBE {t})"""
        for t in TABLES
    ),
)
def discover_tables(spark, folder):
    return _discovered(spark, folder).select(
        "external_id", "name", "asset_type", "parent_external_id", F.col("metadata")["row_count"].alias("row_count")
    )


def _old_catalog(spark, folder) -> DataFrame:
    """Stored assets of two sources: suppliers under the crawled source, customers under another."""
    shape = [
        "'org' AS org_id", "{s} AS source_id", "{e} AS external_id", "{n} AS name", "'table' AS asset_type",
        "'old' AS parent_external_id", "map('k', 'v') AS metadata", "'restricted' AS sensitivity_level",
        "cast({q} AS double) AS quality_score", "cast(null AS string) AS domain",
        "timestamp_ntz'2023-01-01 00:00:00' AS first_seen_at", "{i} AS id",
    ]

    def rows(name, **parts):
        return table(spark, folder, name).selectExpr(*[x.format(**parts) for x in shape])

    return rows("supplier", s="'src'", e="'s' || s_suppkey", n="s_name", q="s_suppkey", i="'old-s' || s_suppkey").unionByName(
        rows("customer", s="'other'", e="'s' || c_custkey", n="c_name", q="c_custkey", i="'old-c' || c_custkey")
    )


def _crawl(spark, folder) -> DataFrame:
    """Rediscovered suppliers (every second one) and new parts."""
    def rows(name, e, n, where="true"):
        return table(spark, folder, name).where(where).selectExpr(
            f"{e} AS external_id", f"{n} AS name", "'table' AS asset_type", "'geo' AS parent_external_id", "map('a', 'b') AS metadata"
        )

    return rows("supplier", "'s' || s_suppkey", "'new ' || s_name", "s_suppkey % 2 = 0").unionByName(
        rows("part", "'p' || p_partkey", "p_name")
    )


_NEW_ID = "sha256('org' || chr(1) || 'src' || chr(1) || {})"


@_query(
    "upsert_assets",
    f"""SELECT 'old-s' || s_suppkey AS id, 'src' AS source_id, 's' || s_suppkey AS external_id,
         CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name ELSE s_name END AS name,
         CASE WHEN s_suppkey % 2 = 0 THEN 'geo' ELSE 'old' END AS parent_external_id, 'restricted' AS sensitivity_level,
         CAST(s_suppkey AS DOUBLE) AS quality_score, TIMESTAMP '2023-01-01' AS first_seen_at FROM supplier
       UNION ALL SELECT 'old-c' || c_custkey, 'other', 's' || c_custkey, c_name, 'old', 'restricted', CAST(c_custkey AS DOUBLE),
         TIMESTAMP '2023-01-01' FROM customer
       UNION ALL SELECT {_NEW_ID.format("'p' || p_partkey")}, 'src', 'p' || p_partkey, p_name, 'geo', 'unclassified', NULL,
         TIMESTAMP '2024-03-01' FROM part""",
)
def upsert_assets(spark, folder):
    merged = c.upsert_assets(_old_catalog(spark, folder), _crawl(spark, folder), "org", "src", "2024-03-01 00:00:00")
    return merged.select(
        "id", "source_id", "external_id", "name", "parent_external_id", "sensitivity_level", "quality_score", "first_seen_at"
    )


@_query(
    "resolve_parents",
    """WITH a AS (SELECT 'n' || n_nationkey AS id, 'n' || n_nationkey AS external_id, 'r' || n_regionkey AS parent_external_id FROM nation
         UNION ALL SELECT 'id-' || s_suppkey, 's' || s_suppkey, 'n' || (s_nationkey * 2) FROM supplier
         UNION ALL SELECT 'id-' || c_custkey, 'c' || c_custkey, 's' || (c_custkey % 50) FROM customer)
       SELECT a.id, a.external_id, p.id AS parent_id FROM a LEFT JOIN a p ON a.parent_external_id = p.external_id""",
)
def resolve_parents(spark, folder):
    def rows(name, i, e, p):
        return table(spark, folder, name).selectExpr(
            "'org' AS org_id", "'src' AS source_id", f"{i} AS id", f"{e} AS external_id", f"{p} AS parent_external_id"
        )

    assets = (
        rows("nation", "'n' || n_nationkey", "'n' || n_nationkey", "'r' || n_regionkey")
        .unionByName(rows("supplier", "'id-' || s_suppkey", "'s' || s_suppkey", "'n' || (s_nationkey * 2)"))
        .unionByName(rows("customer", "'id-' || c_custkey", "'c' || c_custkey", "'s' || (c_custkey % 50)"))
    )
    return c.resolve_parents(assets).select("id", "external_id", "parent_id")


@_query(
    "drop_source_cascade",
    """WITH a AS (SELECT s_suppkey AS id, s_nationkey % 3 = 1 AS doomed FROM supplier),
       m AS (SELECT c_custkey AS id, c_nationkey % 3 = 1 AS doomed FROM customer),
       v AS (SELECT o_orderkey AS id, doomed FROM orders JOIN m ON o_custkey = m.id)
       SELECT 'data_sources' AS "table", 1::BIGINT AS removed
       UNION ALL SELECT 'assets', (count(*) FILTER (WHERE doomed))::BIGINT FROM a
       UNION ALL SELECT 'ai_models', count(*) FILTER (WHERE doomed) FROM m
       UNION ALL SELECT 'ai_model_versions', count(*) FILTER (WHERE doomed) FROM v
       UNION ALL SELECT 'drift_alerts', count(*) FROM events JOIN v ON user_id = v.id WHERE doomed
       UNION ALL SELECT 'lineage_edges', count(*) FROM lineitem WHERE l_suppkey IN (SELECT id FROM a WHERE doomed)
         OR l_linenumber IN (SELECT id FROM a WHERE doomed) OR l_partkey IN (SELECT id FROM a WHERE doomed)""",
)
def drop_source_cascade(spark, folder):
    def rows(name, *expressions):
        return table(spark, folder, name).selectExpr(*expressions)

    tables = {
        "data_sources": rows("region", "cast(r_regionkey AS string) AS id").where("id < 3"),
        "assets": rows("supplier", "s_suppkey AS id", "cast(s_nationkey % 3 AS string) AS source_id"),
        "ai_models": rows("customer", "c_custkey AS id", "cast(c_nationkey % 3 AS string) AS source_id"),
        "ai_model_versions": rows("orders", "o_orderkey AS id", "o_custkey AS model_id"),
        "drift_alerts": rows("events", "event_id AS id", "user_id AS model_version_id"),
        "lineage_edges": rows(
            "lineitem", "l_suppkey AS source_id", "cast(l_linenumber AS bigint) AS target_id", "l_partkey AS transform_id"
        ),
    }
    return c.drop_source_cascade(tables, "1")[1]


# ---- queries ---------------------------------------------------------------------------------------


@_query(
    "search_assets",
    f"""WITH {ASSETS_SQL} SELECT {_SHOWN_SQL} FROM assets
        WHERE (name ILIKE '%RING%' OR external_id ILIKE '%RING%') AND asset_type = 'column'
          AND sensitivity_level IN ('confidential', 'restricted')
        ORDER BY quality_score DESC NULLS LAST, id LIMIT 50 OFFSET 10""",
)
def search_assets(spark, folder):
    page = q.search_assets(
        governed_assets(spark, folder), "quality", 50, 10, q="RING", asset_type="column", has_pii=True
    )
    return page.select(*_SHOWN)


@_query(
    "search_pages",
    f"WITH {ASSETS_SQL} SELECT {_SHOWN_SQL} FROM assets WHERE asset_type = 'column' ORDER BY quality_score DESC NULLS LAST, id LIMIT 40 OFFSET 120",
)
def search_pages(spark, folder):
    """The fourth page over a stored layout, each found from the end of the one before it."""
    path = scratch_path(spark, "search-layout")
    q.write_search_layout(governed_assets(spark, folder).drop("metadata"), path, "quality")
    stored, after = spark.read.parquet(path), None
    for _ in range(3):
        after = q.page_end(q.search_assets(stored, "quality", 40, after=after, asset_type="column"), "quality")
    return q.search_assets(stored, "quality", 40, after=after, asset_type="column").select(*_SHOWN)


@_query(
    "search_total",
    f"WITH {ASSETS_SQL} SELECT count(*)::BIGINT AS total FROM assets WHERE name ILIKE '%ring%' OR external_id ILIKE '%ring%'",
)
def search_total(spark, folder):
    return q.search_total(governed_assets(spark, folder), q="ring")


@_query("asset_children", f"WITH {ASSETS_SQL} SELECT {_SHOWN_SQL} FROM assets WHERE parent_id = 'n7'")
def asset_children(spark, folder):
    return q.asset_children(governed_assets(spark, folder), "n7").select(*_SHOWN)


def _findings(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "'p' || l_partkey AS asset_id", "l_returnflag AS category",
        "l_linestatus AS sensitivity_level", "l_discount AS confidence", "l_shipdate AS detected_at",
    )


_FINDINGS_SQL = """f AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'p' || l_partkey AS asset_id, l_returnflag AS category,
   l_linestatus AS sensitivity_level, l_discount AS confidence, l_shipdate AS detected_at FROM lineitem)"""


@_query(
    "asset_findings",
    f"""WITH {ASSETS_SQL}, {_FINDINGS_SQL} SELECT f.id, a.name AS "column", category, f.sensitivity_level, confidence, detected_at
        FROM f JOIN assets a ON a.id = f.asset_id WHERE a.id = 'n7' OR a.parent_id = 'n7'""",
)
def asset_findings(spark, folder):
    return q.asset_findings(_findings(spark, folder), governed_assets(spark, folder), "n7")


@_query(
    "best_finding_per_column",
    f"""WITH {_FINDINGS_SQL} SELECT "column", category, sensitivity_level, confidence FROM (
          SELECT asset_id AS "column", *, row_number() OVER (PARTITION BY asset_id
            ORDER BY confidence DESC, detected_at DESC, id DESC, category DESC) AS k FROM f) WHERE k = 1""",
)
def best_finding_per_column(spark, folder):
    findings = _findings(spark, folder).withColumnRenamed("asset_id", "column")
    unique = findings.groupBy("column", "id", "confidence", "detected_at").agg(
        F.max(F.struct("category", "sensitivity_level")).alias("top")
    )
    return q.best_finding_per_column(unique.select("*", "top.*"))


for _name, _column in (("count_by_type", "asset_type"), ("count_by_sensitivity", "sensitivity_level")):
    _query(_name, f"WITH {ASSETS_SQL} SELECT {_column}, count(*)::BIGINT AS count FROM assets GROUP BY 1")(
        lambda spark, folder, column=_column: q.count_by(governed_assets(spark, folder), column)
    )


@_query(
    "count_by_source",
    f"""WITH {ASSETS_SQL} SELECT s.name AS source, count(*)::BIGINT AS count FROM assets a JOIN sources s ON s.id = a.source_id GROUP BY 1""",
)
def count_by_source(spark, folder):
    return q.count_by_source(governed_assets(spark, folder), sources(spark, folder))


@_query(
    "top_domains",
    f"""WITH {ASSETS_SQL} SELECT domain, count(*)::BIGINT AS count FROM assets WHERE domain IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""",
)
def top_domains(spark, folder):
    return q.top_domains(governed_assets(spark, folder))


@_query(
    "quality_buckets",
    f"""WITH {ASSETS_SQL} SELECT b.bucket, count(a.id)::BIGINT AS count FROM (VALUES ('90-100'), ('70-89'), ('50-69'), ('<50')) b(bucket)
        LEFT JOIN assets a ON quality_score IS NOT NULL AND bucket = CASE WHEN quality_score >= 90 THEN '90-100'
          WHEN quality_score >= 70 THEN '70-89' WHEN quality_score >= 50 THEN '50-69' ELSE '<50' END GROUP BY 1""",
)
def quality_buckets(spark, folder):
    return q.quality_buckets(governed_assets(spark, folder))


@_query("avg_quality", f"WITH {ASSETS_SQL} SELECT round(avg(quality_score), 1) AS avg_quality FROM assets")
def avg_quality(spark, folder):
    return q.avg_quality(governed_assets(spark, folder))


@_query(
    "count_pii_columns",
    f"""WITH {ASSETS_SQL} SELECT count(*)::BIGINT AS pii_columns FROM assets
        WHERE asset_type = 'column' AND sensitivity_level IN ('confidential', 'restricted')""",
)
def count_pii_columns(spark, folder):
    return q.count_pii_columns(governed_assets(spark, folder))


@_query(
    "total_governed_rows",
    f"""WITH {ASSETS_SQL} SELECT coalesce(sum(try_cast(row_count AS BIGINT)), 0)::BIGINT AS total_rows FROM assets WHERE asset_type = 'table'""",
)
def total_governed_rows(spark, folder):
    return q.total_governed_rows(governed_assets(spark, folder))


@_query(
    "recent_assets",
    f"""WITH {ASSETS_SQL} SELECT {_SHOWN_SQL} FROM assets WHERE asset_type IN ('table', 'ml_model', 'etl_pipeline')
        ORDER BY first_seen_at DESC, id LIMIT 8""",
)
def recent_assets(spark, folder):
    return q.recent_assets(governed_assets(spark, folder)).select(*_SHOWN)


@_query(
    "facets",
    f"""WITH {ASSETS_SQL} SELECT 'source' AS facet, s.id AS value, s.name AS label, count(*)::BIGINT AS count
          FROM assets a JOIN sources s ON s.id = a.source_id GROUP BY 2, 3
        UNION ALL SELECT 'asset_type', asset_type, asset_type, count(*) FROM assets GROUP BY 2
        UNION ALL SELECT 'sensitivity', sensitivity_level, sensitivity_level, count(*) FROM assets GROUP BY 2
        UNION ALL SELECT 'domain', domain, domain, count(*) FROM assets WHERE domain IS NOT NULL GROUP BY 2""",
)
def facets(spark, folder):
    return q.facets(governed_assets(spark, folder), sources(spark, folder))


@_query(
    "dashboard",
    f"""WITH {ASSETS_SQL}, v AS (
          SELECT 'total_assets' AS metric, '' AS key, count(*) AS value FROM assets
          UNION ALL SELECT 'avg_quality_score', '', round(avg(quality_score), 1) FROM assets
          UNION ALL SELECT 'sensitivity_mix', sensitivity_level, count(*) FROM assets GROUP BY 2
          UNION ALL SELECT 'asset_type_mix', asset_type, count(*) FROM assets GROUP BY 2
          UNION ALL SELECT 'risk_tier_mix', c_mktsegment, count(*) FROM customer GROUP BY 2
          UNION ALL SELECT 'data_sources', '', count(*) FROM region
          UNION ALL SELECT 'lineage_edges', '', count(*) FROM lineitem
          UNION ALL SELECT 'ai_models', '', count(*) FROM customer
          UNION ALL SELECT 'open_drift_alerts', '', count(*) FROM events WHERE event_type = 'error')
        SELECT metric, key, CAST(value AS DOUBLE) AS value FROM v""",
)
def dashboard(spark, folder):
    return q.dashboard(
        governed_assets(spark, folder),
        sources(spark, folder),
        table(spark, folder, "lineitem"),
        table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "risk_tier"),
        table(spark, folder, "events").selectExpr("if(event_type = 'error', 'open', 'acknowledged') AS status"),
    )


@_query(
    "recent_activity",
    """SELECT event_type AS action, 'user' AS resource_type, 'u' || user_id AS resource_name, ts AS occurred_at FROM events
       ORDER BY ts DESC, event_id LIMIT 10""",
)
def recent_activity(spark, folder):
    audit = table(spark, folder, "events").selectExpr(
        "event_id AS id", "event_type AS action", "'user' AS resource_type", "'u' || user_id AS resource_name", "ts AS occurred_at"
    )
    return q.recent_activity(audit)


# ---- model registry --------------------------------------------------------------------------------


def _model_assets(spark, folder) -> DataFrame:
    """Customers as models, their orders as versions."""
    models = table(spark, folder, "customer").selectExpr(
        "'a' || c_custkey AS id", "'src' AS source_id", "'reg/' || c_name AS external_id", "c_name AS name",
        "'ml_model' AS asset_type", "cast(null AS string) AS parent_id",
        "map('description', if(c_custkey % 2 = 0, c_mktsegment, ''), 'framework', if(c_custkey % 3 = 0, 'sk', cast(null AS string))) AS metadata",
        "map('framework', 'torch', 'model_type', if(c_custkey % 5 = 0, 'clf', '')) AS tags",
        "cast(map() AS map<string,double>) AS metrics", "cast(map() AS map<string,string>) AS params",
    )
    versions = table(spark, folder, "orders").selectExpr(
        "'v' || o_orderkey AS id", "'src' AS source_id", "'reg/x/' || o_orderkey AS external_id", "'v' AS name",
        "'ml_model_version' AS asset_type", "'a' || (o_custkey * 2) AS parent_id",
        "map('version', if(o_orderkey % 2 = 0, 'r' || o_orderkey, ''), 'stage', if(o_orderstatus = 'F', 'production', '')) AS metadata",
        "cast(map() AS map<string,string>) AS tags", "map('auc', o_totalprice) AS metrics",
        "cast(map() AS map<string,string>) AS params",
    )
    return models.unionByName(versions)


def _registered(spark, folder) -> tuple[DataFrame, DataFrame]:
    models = table(spark, folder, "customer").where("c_custkey % 4 = 1").selectExpr(
        "'m' || c_custkey AS id", "'org' AS org_id", "'reg/' || c_name AS external_id", "'before' AS source_id",
        "'old name' AS name", "'kept' AS description", "cast(null AS string) AS framework", "'kept type' AS model_type",
    )
    versions = spark.createDataFrame(
        [],
        "id string, model_id string, version_number string, external_version_id string, metrics map<string,double>, "
        "hyperparameters map<string,string>, stage string",
    )
    return models, versions


_MODEL_ID = "CASE WHEN c_custkey % 4 = 1 THEN 'm' || c_custkey ELSE sha256('org' || chr(1) || 'model' || chr(1) || 'reg/' || c_name) END"


@_query(
    "sync_models",
    f"""SELECT {_MODEL_ID} AS id, 'src' AS source_id, c_name AS name,
          coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 4 = 1 THEN 'kept' END) AS description,
          CASE WHEN c_custkey % 3 = 0 THEN 'sk' ELSE 'torch' END AS framework,
          coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'clf' END, CASE WHEN c_custkey % 4 = 1 THEN 'kept type' END) AS model_type FROM customer""",
)
def sync_models(spark, folder):
    models, _, _ = r.sync_models(_model_assets(spark, folder), *_registered(spark, folder), "org", "src")
    return models.select("id", "source_id", "name", "description", "framework", "model_type")


@_query(
    "sync_model_versions",
    f"""WITH m AS (SELECT c_custkey, {_MODEL_ID} AS model_id FROM customer)
        SELECT model_id, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS version_number,
          'reg/x/' || o_orderkey AS external_version_id, o_totalprice AS auc,
          CASE WHEN o_orderstatus = 'F' THEN 'production' ELSE 'development' END AS stage
        FROM orders JOIN m ON c_custkey = o_custkey * 2""",
)
def sync_model_versions(spark, folder):
    _, versions, _ = r.sync_models(_model_assets(spark, folder), *_registered(spark, folder), "org", "src")
    return versions.select(
        "model_id", "version_number", "external_version_id", F.col("metrics")["auc"].alias("auc"), "stage"
    )


@_query(
    "latest_assessment",
    """SELECT model_id, id, created_at, risk_tier FROM (SELECT o_custkey AS model_id, o_orderkey AS id, o_orderdate AS created_at,
         o_orderpriority AS risk_tier, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
       FROM orders) WHERE k = 1""",
)
def latest_assessment(spark, folder):
    return r.latest_assessment(
        table(spark, folder, "orders").selectExpr(
            "o_custkey AS model_id", "o_orderkey AS id", "o_orderdate AS created_at", "o_orderpriority AS risk_tier"
        )
    )


@_query(
    "model_cards",
    """WITH latest AS (SELECT * FROM (SELECT o_custkey, o_orderpriority, o_orderstatus,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1)
       SELECT c.c_custkey AS model_id, c_name AS name, c_mktsegment AS intended_use, CAST(v.o_orderkey AS VARCHAR) AS version_number,
         v.o_orderstatus AS stage, v.o_totalprice AS auc, a.o_orderpriority AS assessed_tier,
         CASE WHEN a.o_orderstatus IS NULL THEN '' ELSE 'factor ' || a.o_orderstatus END AS ethical
       FROM customer c LEFT JOIN latest a ON a.o_custkey = c_custkey LEFT JOIN orders v ON v.o_custkey = c_custkey""",
)
def model_cards(spark, folder):
    orders = table(spark, folder, "orders")
    models = table(spark, folder, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "cast(null AS string) AS description", "cast(null AS string) AS owner",
        "c_mktsegment AS use_case", "cast(null AS string) AS business_domain", "'sk' AS framework", "'clf' AS model_type",
        "'high' AS risk_tier", "'live' AS deployment_status",
    )
    versions = orders.selectExpr(
        "o_custkey AS model_id", "cast(o_orderkey AS string) AS version_number", "o_orderstatus AS stage",
        "map('auc', o_totalprice) AS metrics",
    )
    assessments = orders.selectExpr(
        "o_custkey AS model_id", "o_orderkey AS id", "o_orderdate AS created_at", "o_orderpriority AS risk_tier",
        "'cat' AS category", "array('factor ' || o_orderstatus) AS risk_factors", "array('act') AS required_actions",
    )
    cards = r.model_cards(models, versions, assessments)
    return cards.select(
        "model_id", "name", "intended_use", "version_number", "stage", F.col("metrics")["auc"].alias("auc"),
        "assessed_tier", F.array_join("ethical_considerations", ",").alias("ethical"),
    )


@_query(
    "model_lineage",
    """WITH u AS (SELECT o_custkey AS model_id, o_orderkey AS version_id, unnest([0, 1]) AS position,
          unnest(['p' || (o_orderkey % 3000), 'p' || (o_custkey % 3000)]) AS dataset_id FROM orders WHERE o_orderstatus <> 'P')
       SELECT model_id, version_id, position, dataset_id, coalesce(p_name, '(unknown asset)') AS dataset_name
       FROM u LEFT JOIN part ON dataset_id = 'p' || p_partkey
       UNION ALL SELECT o_custkey, o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderstatus = 'P'""",
)
def model_lineage(spark, folder):
    versions = table(spark, folder, "orders").selectExpr(
        "o_custkey AS model_id", "o_orderkey AS id", "'1' AS version_number", "o_orderstatus AS stage",
        "if(o_orderstatus = 'P', cast(null AS array<string>), array('p' || (o_orderkey % 3000), 'p' || (o_custkey % 3000))) AS training_dataset_ids",
    )
    assets = table(spark, folder, "part").selectExpr("'p' || p_partkey AS id", "p_name AS name", "'table' AS asset_type")
    return r.model_lineage(versions, assets).select("model_id", "version_id", "position", "dataset_id", "dataset_name")
