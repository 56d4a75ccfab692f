"""Table references in SQL and Python scripts, found with pattern scans over whole file texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.names import base_name
from tallyward.functions.reshape import once, stack_rows

# The script patterns.
_PART = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|\w+)'
_NAME = rf"{_PART}(?:\s*\.\s*{_PART})*"
# Words that can follow a table name without being its alias.
_NO_ALIAS = (
    "anti|as|asof|cross|except|fetch|full|group|having|inner|intersect|join|lateral|left|limit|natural|offset|on|order|outer|pivot"
    "|qualify|returning|right|select|semi|set|tablesample|then|union|unpivot|using|values|when|where|window|with"
)
_ALIASED = rf"{_NAME}(?:\s+(?:as\s+)?(?!(?:{_NO_ALIAS})\b)\w+)?"
_LED = r"(?is)^\s*(?:with\b.*?\)\s*)?"  # a statement may define its common tables first
_TARGET = (
    rf"{_LED}(?:insert\s+(?:into\s+|overwrite\s+)?(?:table\s+)?"
    r"|create\s+(?:or\s+replace\s+)?(?:\w+\s+){0,2}?(?:table|view)\s+(?:if\s+not\s+exists\s+)?"
    rf"|merge\s+into\s+)({_NAME})"
)
_SOURCES = rf"(?is)\b(?:from|join|using)\s+({_ALIASED}(?:\s*,\s*{_ALIASED})*)"
_STATEMENT = rf"{_LED}(insert|create|merge)\b"
_COMMON_TABLE = r"(?is)(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)(\w+)\s*(?:\([^()]*\)\s*)?as\s*(?:(?:not\s+)?materialized\s*)?\("
# Quoted names stay (group 1); literals and comments go, whichever begins first.
_SILENT = r"""(?s)("[^"]*"|`[^`]*`|\[[^\]']*\])|'[^']*'|--[^\n]*|/\*.*?\*/"""
_NO_SOURCE = r"(?is)\b(?:is\s+(?:not\s+)?distinct\s+from\b|(?:extract|trim|substring|overlay)\s*\([^()]*?\bfrom\b)"
_DBT_REF = r"""ref\(\s*['"](\w+)['"]\s*\)"""
_DBT_SOURCE = r"""source\(\s*['"](\w+)['"]\s*,\s*['"](\w+)['"]\s*\)"""
_TRIPLE = '(?s)"""(.*?)"""' + "|'''(.*?)'''"
_ANY_STRING = _TRIPLE + '|"(.*?)"'
_CHAIN = r"(?s)\.(?:read|write)(?:Stream)?\b(?:[\s\\]*\.\w+\((?:[^()]|\([^()]*\))*\))+"
_CHAIN_FILE = r"""\.(?:parquet|csv|json|orc|text|load|save|table|saveAsTable|insertInto|toTable)\(\s*["']([^"']+)["']"""
_CHAIN_OPTION = r"""\.option\(\s*["']dbtable["']\s*,\s*["']([^"']+)["']"""
_CHAIN_JDBC = r"""\.jdbc\(\s*[^,()]+,\s*["']([^"']+)["']"""
_LOOSE_READ = r"""\bread_\w*\(\s*(?:[^()"',]*,\s*)*["']([^"']+)["']|\bspark\.table\(\s*["']([^"']+)["']"""
_LOOSE_WRITE = (
    r"""\b(?:write_|save_)\w*\(\s*(?:[^()"',]*,\s*)*["']([^"']+)["']"""
    r"""|\.(?:to_parquet|to_csv|to_json)\(\s*["']([^"']+)["']"""
)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def _names_models(content: Column) -> Column:
    return content.contains("ref(") | content.contains("source(")


def _names_dag(content: Column) -> Column:
    return content.contains("from airflow") | content.contains("DAG(")


def is_sql_script(path: Column, content: Column) -> Column:
    """Whether :func:`script_kind` says sql_script, without reading the text for the other kinds."""
    return (extension(path) == "sql") & ~F.coalesce(_names_models(content), F.lit(False))


def script_kind(path: Column, content: Column) -> Column:
    """dbt_model, sql_script, airflow_dag, spark_job, python_script or unknown."""
    ext = extension(path)
    return (
        F.when((ext == "sql") & _names_models(content), "dbt_model")
        .when(ext == "sql", "sql_script")
        .when((ext == "py") & _names_dag(content), "airflow_dag")
        .when((ext == "py") & (F.size(_literals(content, "write")) > 0), "spark_job")
        .when(ext == "py", "python_script")
        .otherwise("unknown")
    )


def dbt_refs(scripts: DataFrame) -> DataFrame:
    """One statement per dbt model: its refs and sources feed the model."""
    refs = _all(F.col("content"), _DBT_REF)
    schemas, tables = (_all(F.col("content"), _DBT_SOURCE, g) for g in (1, 2))
    sources = F.concat(refs, F.zip_with(schemas, tables, lambda a, b: F.concat_ws(".", a, b)))
    model = F.replace(base_name(F.col("path")), F.lit(".sql"), F.lit(""))
    return (
        scripts.where(script_kind(F.col("path"), F.col("content")) == "dbt_model")
        .select(
            "path",
            F.lit("dbt").alias("statement"),
            F.array_distinct(sources).alias("sources"),
            F.array(model).alias("targets"),
        )
        .where(F.size("sources") > 0)
    )


def _plain_name(name: Column) -> Column:
    """Table name as written, without quoting."""
    return F.regexp_replace(name, r'["`\[\]\s]', "")


def statements_in_sql(texts: DataFrame) -> DataFrame:
    """(path, statement, sources, targets) for each INSERT, CREATE or MERGE in (path, sql) rows.

    Text in literals and comments never counts, nor does the FROM of EXTRACT, TRIM, SUBSTRING, OVERLAY and IS
    DISTINCT FROM; tables that a statement defines itself are not sources.
    """
    clean = F.regexp_replace(F.regexp_replace("sql", _SILENT, "$1 "), _NO_SOURCE, " (")
    statements = texts.select("path", F.explode(F.split(clean, ";")).alias("text")).where(
        F.col("text").rlike(_STATEMENT)
    )
    listed = F.flatten(F.transform(_all(F.col("text"), _SOURCES), lambda item: F.split(item, ",")))
    named = F.transform(listed, lambda item: _plain_name(F.regexp_extract(item, rf"(?s)^\s*({_NAME})", 1)))
    common = F.transform(_all(F.col("text"), _COMMON_TABLE), lambda name: F.lower(name))

    def sources(known: Column, target: Column) -> Column:
        return F.array_distinct(
            F.array_remove(F.filter(named, lambda name: ~F.array_contains(known, F.lower(name)) & (name != target)), "")
        )

    # The generator computes the names once; the filter behind it would compute those of a projection again.
    found = F.struct(
        F.lower(F.regexp_extract("text", _STATEMENT, 1)).alias("statement"),
        once(_plain_name(F.regexp_extract("text", _TARGET, 1)), lambda target: F.struct(
            once(common, lambda known: sources(known, target)).alias("sources"), F.array_remove(F.array(target), "").alias("targets")
        )).alias("named"),
    )
    return statements.select("path", stack_rows([found])).select("path", "statement", "named.sources", "named.targets").where(
        (F.size("sources") > 0) | (F.size("targets") > 0)
    )


def sql_table_refs(scripts: DataFrame) -> DataFrame:
    """Statements of plain SQL scripts."""
    sql = scripts.where(is_sql_script(F.col("path"), F.col("content")))
    return statements_in_sql(sql.select("path", F.col("content").alias("sql")))


def embedded_sql(scripts: DataFrame) -> DataFrame:
    """Statements inside string literals of Python scripts."""
    content = F.col("content")
    strings = F.when(_names_dag(content), _all(content, _TRIPLE, 0)).otherwise(_all(content, _ANY_STRING, 0))
    inner = F.transform(strings, lambda s: F.btrim(s, F.lit("\"'")))
    return statements_in_sql(
        scripts.where(extension(F.col("path")) == "py").select("path", F.explode(inner).alias("sql"))
    )


def _literals(content: Column, direction: str, chains: Column | None = None) -> Column:
    """Dataset names that a Python script reads or writes; ``chains`` are its call chains where they are known."""
    chains = _all(content, _CHAIN, 0) if chains is None else chains
    chains = F.filter(chains, lambda chain: chain.startswith(f".{direction}"))
    from_chains = F.flatten(
        F.transform(
            chains,
            lambda chain: F.concat(
                _all(chain, _CHAIN_FILE), _all(chain, _CHAIN_OPTION), _all(chain, _CHAIN_JDBC)
            ),
        )
    )
    loose = _LOOSE_READ if direction == "read" else _LOOSE_WRITE
    named = F.concat(from_chains, _all(content, loose, 1), _all(content, loose, 2))
    return F.array_remove(F.array_distinct(named), "")


def script_dataset_literals(scripts: DataFrame) -> DataFrame:
    """(path, direction, dataset): inventory of what each Python script reads and writes."""
    content = F.col("content")
    found = once(
        _all(content, _CHAIN, 0),
        lambda chains: F.array(
            *[
                F.struct(F.lit(d).alias("direction"), _literals(content, d, chains).alias("datasets"))
                for d in ("read", "write")
            ]
        ),
    )
    return (
        scripts.where(extension(F.col("path")) == "py")
        .select("path", F.inline(found))
        .select("path", "direction", F.explode("datasets").alias("dataset"))
    )


def script_statements(scripts: DataFrame) -> DataFrame:
    """All statements of a script corpus."""
    return dbt_refs(scripts).unionByName(sql_table_refs(scripts)).unionByName(embedded_sql(scripts))
