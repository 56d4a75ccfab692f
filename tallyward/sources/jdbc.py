"""Relational databases over JDBC: table rows in parallel and catalog discovery."""

from __future__ import annotations

import base64
import decimal
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# JDBC drivers and default ports per database kind.
DRIVERS = {
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}", 5439),
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "mssql": (
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        1433,
    ),
}
_SYSTEM_SCHEMAS = "('pg_catalog', 'information_schema', 'pg_toast')"


def quoted_table(kind: str, external_id: str) -> str:
    """Table name of a catalog id: ``db.schema.table``, or ``db.table`` for MySQL."""
    parts = external_id.split(".")
    needed = 2 if kind == "mysql" else 3
    if len(parts) < needed:
        raise ValueError(f"'{external_id}' does not name a table")
    if kind == "mysql":
        return "`" + parts[1].replace("`", "``") + "`"
    return ".".join('"' + p.replace('"', '""') + '"' for p in parts[1:3])


def connection_options(kind: str, config: Mapping[str, object]) -> dict[str, str]:
    driver, url, port = DRIVERS[kind]
    options = {
        "url": url.format(host=config["host"], port=config.get("port", port), database=config["database"]),
        "driver": driver,
        "user": str(config["username"]),
        "fetchsize": str(config.get("fetchsize", 10_000)),
    }
    if config.get("password") is not None:
        options["password"] = str(config["password"])
    return options


def scan_options(
    kind: str,
    config: Mapping[str, object],
    external_id: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 64,
) -> dict[str, str]:
    """Reader options of a table scan; with a partition column the scan runs in parallel ranges."""
    options = {**connection_options(kind, config), "dbtable": quoted_table(kind, external_id)}
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs its lower and upper bound")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def quoted_column(kind: str, column: str) -> str:
    mark = "`" if kind in ("mysql", "bigquery") else '"'
    return mark + column.replace(mark, mark * 2) + mark


def probe_query(kind: str, external_id: str, column: str, partitions: int) -> str:
    """The lower end of each of ``partitions`` parts of equal row counts, from the database's own ranking of a column.

    One row per part: (part, low). The database sorts the column once, or reads an index on it; nulls are left out.
    """
    name, table = quoted_column(kind, column), quoted_table(kind, external_id)
    ranked = f"SELECT {name} AS v, NTILE({int(partitions)}) OVER (ORDER BY {name}) AS part FROM {table} WHERE {name} IS NOT NULL"
    return f"SELECT part, MIN(v) AS low FROM ({ranked}) ranked GROUP BY part"


def _literal(value: object) -> str:
    if isinstance(value, bool):
        raise TypeError("a boolean column makes no ranges")
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def depth_predicates(kind: str, column: str, lows: Sequence[object]) -> list[str]:
    """Conditions that part a table at sorted lower ends: every row meets exactly one, those without a value the first.

    Ends that repeat (a value that fills several parts) are taken once, so a hot value is a part of its own.
    """
    name = quoted_column(kind, column)
    ends = list(dict.fromkeys(v for v in lows if v is not None))
    if len(ends) < 2:
        return ["1 = 1"]
    cuts = [_literal(v) for v in ends[1:]]
    inner = [f"{name} >= {low} AND {name} < {high}" for low, high in zip(cuts, cuts[1:], strict=False)]
    return [f"{name} < {cuts[0]} OR {name} IS NULL", *inner, f"{name} >= {cuts[-1]}"]


def planned_predicates(
    spark: SparkSession, kind: str, config: Mapping[str, object], external_id: str, column: str, partitions: int = 64
) -> list[str]:
    """Equi-depth parts of a table, planned by a probe of the source: one row per part comes to the driver."""
    rows = read_query(spark, kind, config, probe_query(kind, external_id, column, partitions)).collect()
    return depth_predicates(kind, column, [r[1] for r in sorted(rows, key=lambda r: r[0])])


def scan_jdbc(
    spark: SparkSession, kind: str, config: Mapping[str, object], external_id: str, planned_by: str | None = None,
    partitions: int = 64, **ranges
) -> DataFrame:
    """Rows of a table. ``planned_by`` names a column whose values part the scan into tasks of equal row counts, however
    skewed; with ``partition_column`` and ``bounds`` the parts are equal in width; without either it is one task.
    """
    if planned_by is None:
        return spark.read.format("jdbc").options(**scan_options(kind, config, external_id, partitions=partitions, **ranges)).load()
    options = connection_options(kind, config)
    parts = planned_predicates(spark, kind, config, external_id, planned_by, partitions)
    return spark.read.jdbc(options["url"], quoted_table(kind, external_id), predicates=parts, properties={k: v for k, v in options.items() if k != "url"})


def bigquery_options(config: Mapping[str, object], external_id: str, partitions: int = 64) -> dict[str, str]:
    """Options of the Spark connector for BigQuery, which reads a table in parallel streams: ``project.dataset.table``."""
    if len(external_id.split(".")) != 3:
        raise ValueError(f"'{external_id}' does not name a table")
    options = {"table": external_id, "parentProject": str(config["project_id"]), "maxParallelism": str(partitions)}
    if config.get("service_account_json"):
        options["credentials"] = base64.b64encode(str(config["service_account_json"]).encode()).decode()
    return options


def scan_bigquery(spark: SparkSession, config: Mapping[str, object], external_id: str, partitions: int = 64) -> DataFrame:
    """Rows of a BigQuery table; the connector has to be on the session's class path."""
    return spark.read.format("bigquery").options(**bigquery_options(config, external_id, partitions)).load()


def discovery_queries(kind: str, database: str) -> dict[str, str]:
    """information_schema queries for tables and columns."""
    if kind == "mysql":
        scope = "table_schema = '" + database.replace("'", "''") + "'"
        rows = "table_rows"
    else:
        scope, rows = f"table_schema NOT IN {_SYSTEM_SCHEMAS}", "CAST(NULL AS BIGINT)"
    if kind == "postgresql":  # the live-row estimate of the statistics collector
        rows = (
            "(SELECT s.n_live_tup FROM pg_stat_user_tables s "
            "WHERE s.schemaname = tables.table_schema AND s.relname = tables.table_name)"
        )
    return {
        "tables": f"SELECT table_schema, table_name, table_type, {rows} AS row_count "
        f"FROM information_schema.tables WHERE {scope}",
        "columns": "SELECT table_schema, table_name, column_name, data_type, is_nullable, column_default, "
        f"character_maximum_length, ordinal_position FROM information_schema.columns WHERE {scope}",
    }


def read_query(spark: SparkSession, kind: str, config: Mapping[str, object], query: str) -> DataFrame:
    return spark.read.format("jdbc").options(**connection_options(kind, config), query=query).load()
