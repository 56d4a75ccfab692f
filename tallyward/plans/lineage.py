"""Lineage queries over the driver tables: parts and suppliers serve as the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.names import segments
from tallyward.operators import column_refs as text_columns
from tallyward.operators import graph, lineage, openlineage, scripts
from tallyward.plans.registry import Registry
from tallyward.plans.tables import spread, table
from tallyward.session import scratch_path
from tallyward.sources import files

REGISTRY = Registry()
_query = REGISTRY.query

# ---- scripts, one per part ---------------------------------------------------------------------


def _sql_scripts(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "part")).selectExpr(
        "concat('etl/p', p_partkey, '.sql') AS path",
        """concat('-- FROM skipped.t\\nINSERT INTO mart.size_', p_size, ' SELECT * FROM raw.', p_type,
           if(p_partkey % 2 = 0, ' a', ''), ' JOIN raw."', p_brand, '"', if(p_partkey % 3 = 0, ' AS b', ''),
           ' ON a.k = ''; insert into x.y select 1 from z.z -- '';\\nSELECT 1 FROM nowhere;') AS content""",
    )


@_query(
    "sql_table_refs",
    """SELECT 'etl/p' || p_partkey || '.sql' AS path, 'insert' AS statement, 'mart.size_' || p_size AS target,
       array_to_string(list_sort(['raw.' || p_type, 'raw.' || p_brand]), ',') AS sources FROM part""",
)
def sql_table_refs(spark, folder):
    return scripts.sql_table_refs(_sql_scripts(spark, folder)).select(
        "path",
        "statement",
        F.element_at("targets", 1).alias("target"),
        F.array_join(F.array_sort("sources"), ",").alias("sources"),
    )


@_query(
    "dbt_refs",
    """SELECT 'models/m' || p_partkey || '.sql' AS path, 'm' || p_partkey AS target,
       array_to_string(list_sort(['stg_' || lower(p_type), 'raw.size_' || p_size]), ',') AS sources FROM part""",
)
def dbt_refs(spark, folder):
    models = spread(table(spark, folder, "part")).selectExpr(
        "concat('models/m', p_partkey, '.sql') AS path",
        """concat('select * from {{ ref(''stg_', lower(p_type), ''') }} join {{ source( "raw", "size_',
           p_size, '") }} using (k)') AS content""",
    )
    return scripts.dbt_refs(models).select(
        "path",
        F.element_at("targets", 1).alias("target"),
        F.array_join(F.array_sort("sources"), ",").alias("sources"),
    )


def _python_scripts(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "part")).selectExpr(
        "p_partkey",
        "concat('jobs/j', p_partkey, '.py') AS path",
        """concat('df = spark.read.parquet("s3://lake/', p_type, '")\\n',
           'spark.sql(\"\"\"create table mart.t', p_size, ' as select * from raw.', p_type, '\"\"\")\\n',
           'df.write.mode("overwrite").saveAsTable("mart.out_', p_size, '")') AS content""",
    )


@_query(
    "embedded_sql",
    """SELECT 'jobs/j' || p_partkey || '.py' AS path, 'create' AS statement, 'mart.t' || p_size AS target,
       'raw.' || p_type AS sources FROM part""",
)
def embedded_sql(spark, folder):
    return scripts.embedded_sql(_python_scripts(spark, folder)).select(
        "path",
        "statement",
        F.element_at("targets", 1).alias("target"),
        F.array_join("sources", ",").alias("sources"),
    )


@_query(
    "script_dataset_literals",
    """SELECT 'jobs/j' || p_partkey || '.py' AS path, 'read' AS direction, 's3://lake/' || p_type AS dataset FROM part
       UNION ALL SELECT 'jobs/j' || p_partkey || '.py', 'write', 'mart.out_' || p_size FROM part""",
)
def script_dataset_literals(spark, folder):
    return scripts.script_dataset_literals(_python_scripts(spark, folder))


@_query(
    "script_kind",
    """SELECT kind, count(*)::BIGINT AS scripts FROM (
         SELECT unnest(['sql_script', 'spark_job', CASE p_partkey % 3 WHEN 0 THEN 'airflow_dag'
           WHEN 1 THEN 'dbt_model' ELSE 'python_script' END]) AS kind FROM part) GROUP BY kind""",
)
def script_kind(spark, folder):
    other = table(spark, folder, "part").selectExpr(
        "concat('x/o', p_partkey, if(p_partkey % 3 = 1, '.sql', '.py')) AS path",
        """CASE p_partkey % 3 WHEN 0 THEN concat('from airflow import DAG\\n# ', p_name)
           WHEN 1 THEN concat('select * from {{ ref(''', p_type, ''') }}')
           ELSE concat('print(''', p_name, ''')') END AS content""",
    )
    corpus = (
        _sql_scripts(spark, folder)
        .unionByName(_python_scripts(spark, folder).select("path", "content"))
        .unionByName(other)
    )
    return (
        corpus.select(scripts.script_kind(F.col("path"), F.col("content")).alias("kind"))
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("scripts"))
    )


# ---- catalog and references --------------------------------------------------------------------

_PATH = "concat_ws('.', p_brand, p_type, replace(p_name, ' ', '_'))"


def catalog(spark, folder, with_columns: bool = False) -> DataFrame:
    parts = (
        table(spark, folder, "part")
        .selectExpr("concat('p', p_partkey) AS id", "p_name AS name", f"{_PATH} AS external_id")
        .groupBy("name", "external_id")
        .agg(F.min("id").alias("id"))
    )
    suppliers = table(spark, folder, "supplier").selectExpr(
        "concat('s', s_suppkey) AS id", "s_name AS name", "concat('supply.', s_name) AS external_id"
    )
    assets = parts.unionByName(suppliers).selectExpr(
        "id", "name", "external_id", "'table' AS asset_type", "'unclassified' AS sensitivity_level"
    )
    if not with_columns:
        return assets
    columns = assets.selectExpr(
        "concat('c-', id) AS id", "'amount' AS name", "concat(external_id, '.amount') AS external_id",
        "'column' AS asset_type", "sensitivity_level",
    )
    return assets.unionByName(columns)


_BASE_SQL = f"""base AS (
  SELECT min('p' || p_partkey) AS id, p_name AS name, {_PATH} AS external_id FROM part GROUP BY 2, 3
  UNION ALL SELECT 's' || s_suppkey, s_name, 'supply.' || s_name FROM supplier)"""
_TABLES_SQL = f"{_BASE_SQL}, assets AS (SELECT *, 'table' AS asset_type FROM base)"
_COLUMNS_SQL = f"""{_BASE_SQL}, assets AS (SELECT *, 'table' AS asset_type FROM base
  UNION ALL SELECT 'c-' || id, 'amount', external_id || '.amount', 'column' FROM base)"""
_INDEX_SQL = """seg AS (SELECT *, list_filter(string_split_regex(lower(external_id), '[./]'), lambda x: x <> '') AS s FROM assets),
 idx AS (SELECT kind, key, min(id) AS asset_id, min(id) = max(id) AS is_unique FROM (
   SELECT id, 'exact' AS kind, lower(external_id) AS key FROM assets
   UNION ALL SELECT id, 'name', lower(name) FROM assets
   UNION ALL SELECT id, 'suffix', array_to_string(s[-k:], '.') FROM seg, (VALUES (1), (2), (3)) n(k) WHERE k <= len(s))
   GROUP BY kind, key)"""
_RESOLVE_SQL = """rseg AS (SELECT ref, list_filter(string_split_regex(lower(ref), '[./]'), lambda x: x <> '') AS s
   FROM (SELECT DISTINCT ref FROM refs)),
 cand AS (SELECT ref, 0 AS pref, 'exact' AS kind, lower(ref) AS key, 1.0 AS score FROM rseg
   UNION ALL SELECT ref, 4 - k, 'suffix', array_to_string(s[-k:], '.'), CASE WHEN k > 1 THEN 0.9 ELSE 0.75 END
     FROM rseg, (VALUES (1), (2), (3)) n(k) WHERE k <= len(s)
   UNION ALL SELECT ref, 4, 'name', s[-1], NULL FROM rseg),
 resolved AS (SELECT ref, asset_id, confidence FROM (
   SELECT ref, asset_id, CAST(coalesce(score, CASE WHEN is_unique THEN 0.7 ELSE 0.4 END) AS DOUBLE) AS confidence,
     row_number() OVER (PARTITION BY ref ORDER BY pref) AS rank
   FROM cand JOIN idx USING (kind, key) WHERE kind <> 'suffix' OR is_unique) WHERE rank = 1)"""


@_query("match_index", f"WITH {_TABLES_SQL}, {_INDEX_SQL} SELECT * FROM idx")
def match_index(spark, folder):
    return lineage.match_index(catalog(spark, folder))


_REFS_SQL = f"""refs AS (
   SELECT {_PATH} AS ref FROM part
   UNION ALL SELECT 'db.' || {_PATH} FROM part
   UNION ALL SELECT p_type || '.' || replace(p_name, ' ', '_') FROM part
   UNION ALL SELECT p_name FROM part
   UNION ALL SELECT s_name FROM supplier
   UNION ALL SELECT 'nowhere.' || c_name FROM customer)"""


@_query(
    "resolve_refs",
    f"WITH {_TABLES_SQL}, {_INDEX_SQL}, {_REFS_SQL}, {_RESOLVE_SQL} SELECT * FROM resolved",
)
def resolve_refs(spark, folder):
    part = table(spark, folder, "part")
    refs = part.select(
        F.explode(
            F.array(
                F.expr(_PATH),
                F.expr(f"concat('db.', {_PATH})"),
                F.expr("concat(p_type, '.', replace(p_name, ' ', '_'))"),
                F.col("p_name"),
            )
        ).alias("ref")
    )
    refs = refs.union(table(spark, folder, "supplier").selectExpr("s_name")).union(
        table(spark, folder, "customer").selectExpr("concat('nowhere.', c_name)")
    )
    return lineage.resolve_refs(refs, lineage.match_index(catalog(spark, folder)))


# One statement per line item: two suppliers feed a part.
_SUPPLIER_REF = "concat('Supplier#', lpad(cast({} AS {}), 9, '0'))"


def statements(spark, folder) -> DataFrame:
    parts = table(spark, folder, "part").selectExpr("p_partkey", f"{_PATH} AS path")
    first, second = (_SUPPLIER_REF.format(x, "string") for x in ("l_suppkey", "l_suppkey + 1"))
    return (
        table(spark, folder, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .selectExpr(
            "concat('t', l_orderkey % 20) AS transform_id",
            "concat('etl/', l_returnflag, '/job', l_linenumber, '.sql') AS logic",
            f"array({first}, {second}) AS sources",
            "array(path) AS targets",
        )
    )


_PAIRS_SQL = f"""st AS (
   SELECT 't' || (l_orderkey % 20) AS transform_id, 'etl/' || l_returnflag || '/job' || l_linenumber || '.sql' AS logic,
     unnest([{_SUPPLIER_REF.format('l_suppkey', 'varchar')}, {_SUPPLIER_REF.format('l_suppkey + 1', 'varchar')}]) AS source_ref,
     {_PATH} AS target_ref
   FROM lineitem JOIN part ON l_partkey = p_partkey),
 refs AS (SELECT source_ref AS ref FROM st UNION SELECT target_ref FROM st)"""


def _edge_sql(name: str, pairs: str, kind: str, minus: str = "") -> str:
    return f"""{name} AS (SELECT s.asset_id AS source_id, t.asset_id AS target_id, transform_id, '{kind}' AS lineage_type,
     min(logic) AS logic, round(max(least(s.confidence, t.confidence)), 2) AS confidence
   FROM {pairs} JOIN resolved s ON s.ref = source_ref JOIN resolved t ON t.ref = target_ref
   WHERE s.asset_id <> t.asset_id {minus} GROUP BY 1, 2, 3)"""


_EDGES_SQL = f"""{_TABLES_SQL}, {_INDEX_SQL}, {_PAIRS_SQL}, {_RESOLVE_SQL}, {_edge_sql('edges', 'st', 'table')}"""


def stored_edges(spark, folder) -> DataFrame:
    return lineage.table_edges(statements(spark, folder), lineage.match_index(catalog(spark, folder)))


@_query("table_edges", f"WITH {_EDGES_SQL} SELECT * FROM edges WHERE transform_id <> 't3'")
def table_edges(spark, folder):
    rows, index = statements(spark, folder), lineage.match_index(catalog(spark, folder))
    stored = lineage.table_edges(rows.where("transform_id = 't3'"), index)
    return lineage.table_edges(rows, index, stored)


def column_refs(spark, folder) -> DataFrame:
    return statements(spark, folder).selectExpr(
        "transform_id", "logic", "sources[0] AS source_table", "'amount' AS source_column",
        "targets[0] AS target_table", "'amount' AS target_column",
    )


_COLUMN_PAIRS_SQL = f"""cst AS (
   SELECT 't' || (l_orderkey % 20) AS transform_id, 'etl/' || l_returnflag || '/job' || l_linenumber || '.sql' AS logic,
     {_SUPPLIER_REF.format('l_suppkey', 'varchar')} || '.amount' AS source_ref, {_PATH} || '.amount' AS target_ref
   FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@_query(
    "column_edges",
    f"""WITH {_COLUMNS_SQL}, {_INDEX_SQL}, {_COLUMN_PAIRS_SQL},
    refs AS (SELECT source_ref AS ref FROM cst UNION SELECT target_ref FROM cst), {_RESOLVE_SQL},
    {_edge_sql('edges', 'cst', 'column')} SELECT * FROM edges""",
)
def column_edges(spark, folder):
    return lineage.column_edges(
        column_refs(spark, folder), lineage.match_index(catalog(spark, folder, with_columns=True))
    )


@_query(
    "rebuild_lineage",
    f"""WITH {_COLUMNS_SQL}, {_INDEX_SQL}, {_COLUMN_PAIRS_SQL},
    {_PAIRS_SQL.replace('refs AS (', 'refs AS (SELECT source_ref AS ref FROM cst UNION SELECT target_ref FROM cst UNION ')},
    {_RESOLVE_SQL}, {_edge_sql('t_edges', 'st', 'table')}, {_edge_sql('c_edges', 'cst', 'column')},
    edges AS (SELECT * FROM t_edges UNION ALL SELECT * FROM c_edges)
    SELECT lineage_type, confidence, count(*)::BIGINT AS edges, count(DISTINCT transform_id)::BIGINT AS pipelines
    FROM edges GROUP BY 1, 2""",
)
def rebuild_lineage(spark, folder):
    edges = lineage.rebuild_lineage(
        catalog(spark, folder, with_columns=True), statements(spark, folder), column_refs(spark, folder)
    )
    return edges.groupBy("lineage_type", "confidence").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("transform_id").alias("pipelines")
    )


@_query(
    "lineage_graph",
    f"""WITH {_EDGES_SQL} SELECT id, name, asset_type, external_id, 'unclassified' AS sensitivity_level FROM assets
    WHERE id IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)""",
)
def lineage_graph(spark, folder):
    return lineage.graph_nodes(stored_edges(spark, folder), catalog(spark, folder))


@_query(
    "merge_edges",
    f"""WITH {_PAIRS_SQL}, d AS (SELECT DISTINCT source_ref AS source_id, target_ref AS target_id, string_split(logic, '/')[-1] AS transform FROM st)
    SELECT *, count(*) OVER (PARTITION BY source_id, target_id)::BIGINT AS n_transforms FROM d""",
)
def merge_edges(spark, folder):
    raw = statements(spark, folder).select(
        F.explode("sources").alias("source_id"), F.element_at("targets", 1).alias("target_id"), "logic"
    )
    return lineage.merge_edges(raw)


@_query(
    "lineage_graph_edges",
    f"WITH {_EDGES_SQL} SELECT source_id AS source, target_id AS target, logic AS transformation, confidence FROM edges",
)
def lineage_graph_edges(spark, folder):
    return lineage.graph_edges(stored_edges(spark, folder))


@_query(
    "rebuild_counts",
    f"""WITH {_EDGES_SQL} SELECT (SELECT count(DISTINCT transform_id) FROM st)::BIGINT AS assets_with_lineage,
      (SELECT count(*) FROM edges)::BIGINT AS edges_created""",
)
def rebuild_counts(spark, folder):
    return lineage.rebuild_counts(statements(spark, folder), stored_edges(spark, folder))


# One script per part, from text to edges: every fourth takes another form of naming its sources.
_FIRST, _SECOND = ("concat('Supplier#', lpad(cast({} AS string), 9, '0'))".format(x) for x in ("p_partkey % 9 + 1", "p_partkey % 7 + 1"))
_FROM_BOTH = """concat(' FROM supply."', first, '" JOIN supply."', second, '" ON a = b')"""


def _edge_scripts(spark, folder) -> DataFrame:
    named = spread(table(spark, folder, "part")).selectExpr(
        "p_partkey % 4 AS form", "concat('etl/e', p_partkey % 50, '.sql') AS path", f"{_FIRST} AS first", f"{_SECOND} AS second",
        """concat('"', p_brand, '"."', p_type, '"."', replace(p_name, ' ', '_'), '"') AS target""",
    )
    return named.selectExpr(
        "path",
        f"""CASE form
          WHEN 0 THEN concat('INSERT INTO ', target, ' SELECT ''; from a.b'' AS d, ''--'' AS e', {_FROM_BOTH}, ';')
          WHEN 1 THEN concat('WITH x AS (SELECT * FROM supply."', first, '"), y AS (SELECT 1) INSERT INTO ', target,
            ' SELECT * FROM x JOIN supply."', second, '" USING (id) JOIN y')
          WHEN 2 THEN concat('CREATE TABLE ', target, ' AS SELECT extract(year FROM o.ts), a IS DISTINCT FROM b', {_FROM_BOTH})
          ELSE concat('/* from z.z */ MERGE INTO ', target, ' t USING supply."', first, '" s ON t.a = s.a; INSERT INTO ', target,
            ' SELECT * FROM supply."', second, '" LEFT JOIN supply."', first, '" ON true') END AS content""",
    )


_EDGE_SCRIPTS_SQL = f"""st AS (
   SELECT 'etl/e' || (p_partkey % 50) || '.sql' AS transform_id, 'etl/e' || (p_partkey % 50) || '.sql' AS logic, unnest([
     'Supplier#' || lpad((p_partkey % 9 + 1)::VARCHAR, 9, '0'), 'Supplier#' || lpad((p_partkey % 7 + 1)::VARCHAR, 9, '0')]) AS source_ref,
     {_PATH} AS target_ref FROM part),
 refs AS (SELECT source_ref AS ref FROM st UNION SELECT target_ref FROM st)"""


@_query(
    "script_edges",
    f"""WITH {_TABLES_SQL}, {_INDEX_SQL}, {_EDGE_SCRIPTS_SQL}, {_RESOLVE_SQL}, {_edge_sql('edges', 'st', 'table')}
    SELECT source_id, target_id, transform_id, lineage_type, logic FROM edges""",
)
def script_edges(spark, folder):
    found = scripts.script_statements(_edge_scripts(spark, folder))
    rows = found.select(F.col("path").alias("transform_id"), F.col("path").alias("logic"), "sources", "targets")
    edges = lineage.table_edges(rows, lineage.match_index(catalog(spark, folder)))
    return edges.select("source_id", "target_id", "transform_id", "lineage_type", "logic")


def _column_scripts(spark, folder) -> DataFrame:
    """One script per part that fills two columns of a table: by alias, common table, derived table or set operation."""
    named = spread(table(spark, folder, "part")).selectExpr(
        "p_partkey % 4 AS form", "concat('etl/c', p_partkey % 50, '.sql') AS path",
        f"""concat('supply."', {_FIRST}, '"') AS first""", f"""concat('supply."', {_SECOND}, '"') AS second""",
        """concat('"', p_brand, '"."', p_type, '"."', replace(p_name, ' ', '_'), '"') AS target""",
    )
    return named.selectExpr(
        "path",
        """CASE form
          WHEN 0 THEN concat('INSERT INTO ', target, ' (amount, "rate") SELECT o.amount * coalesce(c.fee, (0)), c.amount FROM ', first,
            ' o JOIN ', second, ' AS c ON o.id = c.id; -- select x.y from x')
          WHEN 1 THEN concat('WITH x AS (SELECT amount, id FROM ', first, '), y (id, total) AS (SELECT id, max(amount) FROM ', second,
            ' GROUP BY id) INSERT INTO ', target, ' SELECT x.amount, y.total AS rate FROM x JOIN y USING (id)')
          WHEN 2 THEN concat('CREATE TABLE ', target, ' AS SELECT q.amount, q.rate, q.* FROM (SELECT a.amount, sum(b.amount) AS rate FROM ', first,
            ' a JOIN (SELECT id, amount FROM ', second, ') b ON a.id = b.id GROUP BY a.amount) q')
          ELSE concat('INSERT INTO ', target, ' SELECT amount, ''; insert into a.b select c from d'' AS rate FROM ', first,
            ' UNION ALL SELECT fee, amount FROM ', second) END AS content""",
    )


_SQL_FIRST, _SQL_SECOND = ("'Supplier#' || lpad((p_partkey % {} + 1)::VARCHAR, 9, '0')".format(n) for n in (9, 7))
_COLUMN_SCRIPTS_SQL = f"""cref AS (
   SELECT 'etl/c' || (p_partkey % 50) || '.sql' AS path, {_PATH} AS target_table, 'amount' AS target_column,
     'supply.' || {_SQL_FIRST} AS source_table, 'amount' AS source_column FROM part
   UNION SELECT 'etl/c' || (p_partkey % 50) || '.sql', {_PATH}, 'rate', 'supply.' || {_SQL_SECOND}, 'amount' FROM part
   UNION SELECT 'etl/c' || (p_partkey % 50) || '.sql', {_PATH}, 'amount', 'supply.' || {_SQL_SECOND}, 'fee' FROM part WHERE p_partkey % 4 IN (0, 3))"""


@_query("script_column_refs", f"WITH {_COLUMN_SCRIPTS_SQL} SELECT * FROM cref")
def script_column_refs(spark, folder):
    """What each column that a script fills is made of."""
    return text_columns.column_refs(_column_scripts(spark, folder)).distinct()


@_query(
    "script_column_edges",
    f"""WITH {_COLUMNS_SQL}, {_INDEX_SQL}, {_COLUMN_SCRIPTS_SQL},
    cst AS (SELECT path AS transform_id, path AS logic, source_table || '.' || source_column AS source_ref,
      target_table || '.' || target_column AS target_ref FROM cref),
    refs AS (SELECT source_ref AS ref FROM cst UNION SELECT target_ref FROM cst), {_RESOLVE_SQL},
    {_edge_sql('edges', 'cst', 'column')} SELECT * FROM edges""",
)
def script_column_edges(spark, folder):
    """From script text to edges between columns of the catalog."""
    found = text_columns.column_refs(_column_scripts(spark, folder))
    rows = found.selectExpr("path AS transform_id", "path AS logic", "source_table", "source_column", "target_table", "target_column")
    return lineage.column_edges(rows, lineage.match_index(catalog(spark, folder, with_columns=True)))


@_query(
    "column_parent_table",
    f"""WITH {_COLUMNS_SQL} SELECT id, CASE WHEN ends_with(external_id, '.' || name)
        THEN left(external_id, length(external_id) - length(name) - 1) ELSE external_id END AS table_key,
      string_split(CASE WHEN ends_with(external_id, '.' || name)
        THEN left(external_id, length(external_id) - length(name) - 1) ELSE external_id END, '.')[-1] AS table_name
    FROM assets""",
)
def column_parent_table(spark, folder):
    nodes = catalog(spark, folder, with_columns=True)
    return lineage.column_parent_table(nodes).select("id", "table_key", "table_name")


# ---- graph: region -> nation -> supplier -> part, with a cycle back to a region -------------------


def supply_edges(spark, folder) -> DataFrame:
    nation = table(spark, folder, "nation")
    return (
        nation.selectExpr("concat('r', n_regionkey) AS source_id", "concat('n', n_nationkey) AS target_id")
        .union(nation.where("n_nationkey % 12 = 0").selectExpr("concat('n', n_nationkey)", "'r1'"))
        .union(
            table(spark, folder, "supplier").selectExpr("concat('n', s_nationkey)", "concat('s', s_suppkey)")
        )
        .union(
            table(spark, folder, "lineitem").selectExpr("concat('s', l_suppkey)", "concat('p', l_partkey)")
        )
    )


_SUPPLY_SQL = """e AS (
   SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id FROM nation
   UNION SELECT 'n' || n_nationkey, 'r1' FROM nation WHERE n_nationkey % 12 = 0
   UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
   UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"""


@_query(
    "impact",
    f"""WITH RECURSIVE {_SUPPLY_SQL}, down AS (
      SELECT 'r0' AS id, 0 AS depth UNION SELECT target_id, depth + 1 FROM down JOIN e ON source_id = id WHERE depth < 8)
    SELECT id, min(depth)::INT AS depth FROM down WHERE id <> 'r0' GROUP BY id""",
)
def impact(spark, folder):
    return graph.impact(supply_edges(spark, folder), "r0")


@_query(
    "focus_lineage",
    f"""WITH RECURSIVE {_SUPPLY_SQL},
      down AS (SELECT 's1' AS id UNION SELECT target_id FROM down JOIN e ON source_id = id),
      up AS (SELECT 's1' AS id UNION SELECT source_id FROM up JOIN e ON target_id = id)
    SELECT id FROM down UNION SELECT id FROM up""",
)
def focus_lineage(spark, folder):
    return graph.focus_lineage(supply_edges(spark, folder), "s1")


@_query(
    "impact_of_all",
    f"""WITH RECURSIVE {_SUPPLY_SQL}, down AS (
      SELECT DISTINCT source_id AS start, source_id AS id, 0 AS depth FROM e
      UNION SELECT start, target_id, depth + 1 FROM down JOIN e ON source_id = id WHERE depth < 6),
    nearest AS (SELECT start, id, min(depth) AS depth FROM down GROUP BY 1, 2)
    SELECT start, (count(*) FILTER (WHERE depth > 0))::BIGINT AS reached, max(depth)::INT AS deepest FROM nearest GROUP BY 1""",
)
def impact_of_all(spark, folder):
    """The reach of every asset that has something downstream, in one walk."""
    return graph.impact_of_all(supply_edges(spark, folder))


@_query(
    "asset_neighbours",
    f"""WITH {_EDGES_SQL} SELECT id, name, asset_type, 'unclassified' AS sensitivity_level, id = 's3' AS is_center
    FROM assets WHERE id = 's3' OR id IN (SELECT target_id FROM edges WHERE source_id = 's3')
      OR id IN (SELECT source_id FROM edges WHERE target_id = 's3')""",
)
def asset_neighbours(spark, folder):
    return lineage.asset_neighbours(stored_edges(spark, folder), catalog(spark, folder), "s3")


# ---- runtime events, one per order ---------------------------------------------------------------


def raw_events(spark, folder) -> DataFrame:
    """JSON events in a ``value`` column."""
    account = "concat('crm.accounts_', o_custkey % 25)"
    supplier = f"concat('supply.', {_SUPPLIER_REF.format('o_custkey % 10', 'string')})"
    event = f"""named_struct(
      'eventType', if(o_orderstatus = 'F', 'COMPLETE', 'START'),
      'run', named_struct('runId', concat('r', o_orderkey)),
      'job', named_struct('namespace', if(o_custkey % 3 = 0, 'etl', ''), 'name', concat('load_', o_custkey % 40)),
      'inputs', array(named_struct('namespace', 'pg', 'name', {account}),
                      named_struct('namespace', 'pg', 'name', {supplier}),
                      named_struct('namespace', 'pg', 'name', cast(null AS string))),
      'outputs', array(named_struct('namespace', 'wh', 'name', concat('mart.daily_', lower(o_orderstatus)),
        'facets', named_struct('columnLineage', named_struct('fields', map(
          'revenue', named_struct('inputFields', array(named_struct('name', {account}, 'field', 'total'))),
          'rank', named_struct('inputFields', array(named_struct('name', {supplier}, 'field', 'weight')))))))))"""
    return table(spark, folder, "orders").selectExpr(f"to_json({event}) AS value")


_EVENT_SQL = f"""ev AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'etl' ELSE 'default' END AS job_namespace,
   'load_' || (o_custkey % 40) AS job_name, 'crm.accounts_' || (o_custkey % 25) AS account,
   'supply.' || {_SUPPLIER_REF.format('o_custkey % 10', 'varchar')} AS supplier,
   'mart.daily_' || lower(o_orderstatus) AS mart, o_orderstatus FROM orders)"""


@_query(
    "parse_openlineage",
    f"""WITH {_EVENT_SQL} SELECT job_namespace, job_name, 'r' || o_orderkey AS run_id,
      CASE WHEN o_orderstatus = 'F' THEN 'COMPLETE' ELSE 'START' END AS event_type,
      'pg:' || account || ',pg:' || supplier AS inputs, 'wh:' || mart AS outputs,
      array_to_string(list_sort([account || '.total>' || mart || '.revenue', supplier || '.weight>' || mart || '.rank']), ',') AS column_edges
    FROM ev""",
)
def parse_openlineage(spark, folder):
    parsed = openlineage.parse_openlineage(raw_events(spark, folder))

    def listed(name):
        return F.array_join(
            F.transform(name, lambda d: F.concat_ws(":", d["namespace"], d["name"])), ","
        ).alias(name)

    edges = F.transform(
        "column_edges",
        lambda e: F.concat(e["input_dataset"], F.lit("."), e["input_field"], F.lit(">"),
                           e["output_dataset"], F.lit("."), e["output_field"]),
    )
    return parsed.select(
        "job_namespace", "job_name", "run_id", "event_type", listed("inputs"), listed("outputs"),
        F.array_join(F.array_sort(edges), ",").alias("column_edges"),
    )


_ID = "sha256(chr(1) || chr(1) || {})"
_DATASET_ID = "sha256(chr(1) || 'dataset' || chr(1) || {})"
_SUPPLIER_ID = "'s' || CAST(right(supplier, 9) AS BIGINT)"


def _field_id(parent: str, field: str) -> str:
    return f"sha256(chr(1) || 'column' || chr(1) || {parent} || '.{field}')"


_ACCOUNT_ID, _MART_ID = _DATASET_ID.format("account"), _DATASET_ID.format("mart")
_JOB_PATH = "'openlineage://' || job_namespace || '/' || job_name"
_JOB_ID = _ID.format(_JOB_PATH)
_NODES_SQL = f"""{_EVENT_SQL}, nodes AS (
   SELECT DISTINCT {_ACCOUNT_ID} AS id, 'pg:' || account AS external_id, string_split(account, '.')[-1] AS name, 'dataset' AS asset_type FROM ev
   UNION SELECT {_MART_ID}, 'wh:' || mart, string_split(mart, '.')[-1], 'dataset' FROM ev
   UNION SELECT {_field_id(_ACCOUNT_ID, 'total')}, 'pg:' || account || '.total', 'total', 'column' FROM ev
   UNION SELECT {_field_id(_SUPPLIER_ID, 'weight')}, supplier || '.weight', 'weight', 'column' FROM ev
   UNION SELECT {_field_id(_MART_ID, 'revenue')}, 'wh:' || mart || '.revenue', 'revenue', 'column' FROM ev
   UNION SELECT {_field_id(_MART_ID, 'rank')}, 'wh:' || mart || '.rank', 'rank', 'column' FROM ev
   UNION SELECT {_JOB_ID}, {_JOB_PATH}, job_name, 'etl_pipeline' FROM ev)"""


def _event_catalog(spark, folder) -> DataFrame:
    return catalog(spark, folder)


@_query(
    "openlineage_placeholders",
    f"WITH {_NODES_SQL} SELECT id, external_id, name, asset_type FROM nodes",
)
def openlineage_placeholders(spark, folder):
    parsed = openlineage.parse_openlineage(raw_events(spark, folder))
    return openlineage.openlineage_placeholders(parsed, _event_catalog(spark, folder)).select(
        "id", "external_id", "name", "asset_type"
    )


@_query(
    "openlineage_edges",
    f"""WITH {_EVENT_SQL}, pairs AS (
      SELECT {_ACCOUNT_ID} AS source_id, {_MART_ID} AS target_id, 'table' AS lineage_type, {_JOB_ID} AS transform_id, job_name AS logic FROM ev
      UNION SELECT {_SUPPLIER_ID}, {_MART_ID}, 'table', {_JOB_ID}, job_name FROM ev
      UNION SELECT {_field_id(_ACCOUNT_ID, 'total')}, {_field_id(_MART_ID, 'revenue')}, 'column', {_JOB_ID}, job_name FROM ev
      UNION SELECT {_field_id(_SUPPLIER_ID, 'weight')}, {_field_id(_MART_ID, 'rank')}, 'column', {_JOB_ID}, job_name FROM ev)
    SELECT DISTINCT *, CAST(1.0 AS DOUBLE) AS confidence FROM pairs""",
)
def openlineage_edges(spark, folder):
    parsed = openlineage.parse_openlineage(raw_events(spark, folder))
    return openlineage.openlineage_edges(parsed, _event_catalog(spark, folder))


@_query(
    "read_lineage_events",
    f"""WITH {_EVENT_SQL} SELECT job_name, count(*)::BIGINT AS events, count(DISTINCT mart)::BIGINT AS outputs FROM ev GROUP BY 1""",
)
def read_lineage_events(spark, folder):
    """Orders written as JSON events and read back."""
    path = scratch_path(spark, "lineage-events")
    raw_events(spark, folder).write.text(path)
    events = files.read_lineage_events(spark, path)
    return events.groupBy(F.col("job.name").alias("job_name")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct(F.col("outputs")[0]["name"]).alias("outputs")
    )


@_query(
    "segments",
    f"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower({_PATH}), '[./]'), lambda x: x <> ''), '|')
        AS segments FROM part""",
)
def path_segments(spark, folder):
    """Segments of decorated references: scheme, quotes, white space and empty parts fall away."""
    refs = table(spark, folder, "part").selectExpr("p_partkey", f"concat('  `S3://', replace({_PATH}, '.', '//'), '` ') AS ref")
    return refs.select("p_partkey", F.array_join(segments(F.col("ref")), "|").alias("segments"))
