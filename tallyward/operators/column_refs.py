"""Columns that feed columns in script text: what each projection of an INSERT or CREATE statement reads.

Brackets go first. The innermost ones are turned inside out, level by level, in one fold per statement: a bracketed
SELECT moves to a list of blocks and leaves its number behind, any other bracket becomes a plain mark. What is left are
flat blocks, whose projections and sources patterns can tell apart. A second fold then carries the references of the
outermost projections down through derived tables and common tables until they name stored tables. Everything stays
inside the row of the statement: no shuffle and no Python.

Not followed: quoted names with brackets, commas or semicolons in them, tables inside a bracketed join, and ``*`` on
its own (through a derived ``*`` over one source a named column is followed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.reshape import once, stack_rows
from tallyward.operators.scripts import extension, is_sql_script

# Marks in private characters: bracket, end of bracket, comma inside one, literal, block number and its end.
_OPEN, _CLOSE, _COMMA, _TEXT, _BLOCK, _END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"
_MARKS = _OPEN + _CLOSE + _COMMA + _TEXT + _BLOCK + _END

# The statement patterns.
_IDENT = r'(?:"[^"]++"|`[^`]++`|\[[^\]]++\]|[\w$]++)'
_NAME = rf"{_IDENT}(?:\s*+\.\s*+{_IDENT})*+"
_LITERALS = r"""(?s)("[^"]*"|`[^`]*`|\[[^\]']*\])|'(?:[^']|'')*'"""
_COMMENTS = r"""(?s)("[^"]*"|`[^`]*`|\[[^\]']*\]|'(?:[^']|'')*')|--[^\n]*|/\*.*?\*/"""
_DISTINCT_FROM = r"(?i)\bis\s+(?:not\s+)?distinct\s+from\b"
_FROM_INSIDE = r"(?is)\b(?:extract|trim|substring|overlay)\s*\(([^()]*?)\bfrom\b"
_SELECT_BLOCK = r"(?is)\(\s*(?:select|with)\b[^()]*\)"
_TARGET = (
    r"(?is)(?:^|\s)(?:insert\s+(?:into\s+|overwrite\s+)?(?:table\s+)?"
    r"|create\s+(?:or\s+replace\s+)?(?:\w+\s+){0,2}?(?:table|view)\s+(?:if\s+not\s+exists\s+)?)"
    rf"({_NAME})\s*(?:{_OPEN}([^{_CLOSE}]*){_CLOSE})?"
)
_IS_TARGET = rf"(?is)^\s*(?:with\b.*?{_END}\s*)?(?:insert|create)\b"
_COMMON = rf"(?is)\b([\w$]+)\s*(?:{_OPEN}([^{_CLOSE}]*){_CLOSE}\s*)?as\s*(?:(?:not\s+)?materialized\s*)?{_BLOCK}(\d+){_END}"
_SET_OPERATION = r"(?i)\b(?:union|except|intersect|minus)\b(?:\s+(?:all|distinct))?"
_PROJECTED = r"(?is)^.*?\bselect\s+(?:distinct\s+|all\s+)?(.*?)(?:\bfrom\b.*)?$"
_NO_ALIAS = (
    "anti|as|asof|cross|except|fetch|full|group|having|inner|intersect|join|lateral|left|limit|minus|natural|offset|on|order|outer"
    "|pivot|qualify|right|semi|set|tablesample|union|unpivot|using|values|when|where|window|with"
)
_ITEM = rf"(?:lateral\s+)?(?:{_BLOCK}\d+{_END}|{_NAME})(?:\s+(?:as\s+)?(?!(?:{_NO_ALIAS})\b){_IDENT})?"
_SOURCES = rf"(?is)\b(?:from|join)\s+({_ITEM}(?:\s*,\s*{_ITEM})*)"
_SOURCE_NAME = rf"(?is)^\s*(?:lateral\s+)?({_NAME})"
_SOURCE_BLOCK = rf"(?is)^\s*(?:lateral\s+)?{_BLOCK}(\d+){_END}"
_SOURCE_ALIAS = rf"(?is)^\s*(?:lateral\s+)?(?:{_BLOCK}\d+{_END}|{_NAME})\s+(?:as\s+)?({_IDENT})\s*$"
_BEFORE_OPERAND = "and|or|not|is|like|ilike|rlike|in|between|then|else|when|case|div|mod|escape|over|by|as|distinct|using"
_AS_ALIAS = rf"(?is)\bas\s+({_IDENT})\s*$"
_BARE_ALIAS = (
    rf'(?is)(?<=[\w"`\]{_CLOSE}{_END}{_TEXT}])(?<!\b(?:{_BEFORE_OPERAND}))\s+(?!(?:end|null|true|false|asc|desc|first|last)\b)({_IDENT})\s*$'
)
_COLUMN = rf"(?is)^\s*(?:{_IDENT}\s*\.\s*)*({_IDENT})\s*$"
_STAR = r"(?is)^\s*(?:[^\s]+\s*\.\s*)?\*\s*$"
_CAST_TYPE = rf"(?i)(?:\bas|::)\s*\w+(?:\s+(?:precision|varying|unsigned))?(?:\s*{_OPEN}[^{_CLOSE}]*{_CLOSE})?"
_TYPED_TEXT = rf"(?i)\b(?:date|time|timestamp|interval)\s*{_TEXT}"
_REFERENCE = rf"(?<![\w$.\"`\]]){_NAME}(?!\s*{_OPEN})(?!\s*\.)"
_INNER_BLOCK = rf"{_BLOCK}(\d+){_END}"
_WORDS = (
    "all|and|any|asc|between|both|by|case|century|cross|cube|current|current_date|current_timestamp|day|desc|distinct|div|else|end|escape"
    "|exists|false|filter|first|following|for|from|group|hour|ignore|ilike|in|interval|is|last|leading|like|minute|mod|month|not|null"
    "|nulls|or|order|over|partition|preceding|quarter|range|respect|rlike|row|rows|second|similar|some|then|to|trailing|true|unbounded"
    "|using|week|when|within|year"
)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _unless_empty(text: Column) -> Column:
    return once(text, lambda t: F.when(t != "", t))


def _plain(name: Column) -> Column:
    return F.regexp_replace(name, r'["`\[\]\s]', "")


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _depth(text: Column) -> Column:
    """How deeply brackets are nested; only the brackets themselves are looked at."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, bracket: Column) -> Column:
        now = F.greatest(F.when(bracket == "(", state["now"] + 1).otherwise(state["now"] - 1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(_all(text, "[()]", 0), start, step)["most"]


def _without_brackets(text: Column, depth: Column) -> Column:
    """(text, blocks): the statement without brackets and its bracketed SELECTs, the first numbered 1."""
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("blocks"))

    def step(state: Column, _: Column) -> Column:
        known = F.size(state["blocks"])
        around = F.split(state["text"], _SELECT_BLOCK, -1)
        numbered = F.transform(
            around, lambda part, n: F.when(n == 0, part).otherwise(F.concat(F.lit(_BLOCK), (known + n).cast("string"), F.lit(_END), part))
        )
        innermost = r"\([^()]*\)"

        def marked(left: Column) -> Column:
            inside = F.transform(_all(left, innermost, 0), lambda held: F.translate(held, "(,)", _OPEN + _COMMA + _CLOSE))
            return once(
                inside,
                lambda held: F.array_join(
                    F.transform(F.split(left, innermost, -1), lambda part, n: F.concat(F.coalesce(F.get(held, n - 1), F.lit("")), part)), ""
                ),
            )

        inner = F.transform(_all(state["text"], _SELECT_BLOCK, 0), lambda block: F.regexp_replace(block, r"^\(|\)$", ""))
        return F.struct(once(F.array_join(numbered, ""), marked).alias("text"), F.concat(state["blocks"], inner).alias("blocks"))

    return F.aggregate(F.sequence(F.lit(0), depth), start, step)


def _refs(projection: Column) -> Column:
    """(block, qualifier, name) of what a projection reads; a block stands for all that it gives."""
    bare = F.regexp_replace(F.regexp_replace(projection, _CAST_TYPE, " "), _TYPED_TEXT, " ")
    named = F.filter(_all(bare, _REFERENCE, 0), lambda r: ~F.lower(r).rlike(rf"^(?:{_WORDS})$") & ~r.rlike(r"^\s*\d"))
    own = F.transform(
        F.transform(named, _plain),
        lambda r: F.struct(F.lit(0).alias("block"), _unless_empty(F.regexp_extract(r, r"(?s)^(.*)\.[^.]*$", 1)).alias("qualifier"), _last(r).alias("name")),
    )
    unset = F.lit(None).cast("string")
    inner = F.transform(
        _all(projection, _INNER_BLOCK), lambda n: F.struct(n.cast("int").alias("block"), unset.alias("qualifier"), unset.alias("name"))
    )
    return F.array_distinct(F.concat(own, inner))


def _projection(text: Column) -> Column:
    out = _plain(F.coalesce(*[_unless_empty(F.regexp_extract(text, p, 1)) for p in (_AS_ALIAS, _BARE_ALIAS, _COLUMN)]))
    bare = F.regexp_replace(F.regexp_replace(text, _AS_ALIAS, ""), _BARE_ALIAS, "")
    nothing = F.array().cast("array<struct<block:int,qualifier:string,name:string>>")
    return once(
        text.rlike(_STAR),
        lambda star: F.struct(out.alias("out"), star.alias("star"), F.when(star, nothing).otherwise(once(bare, _refs)).alias("refs")),
    )


def _source(item: Column, common: Column) -> Column:
    """(alias, table, block) of one item of a FROM; a common table of the statement is its block."""

    def named(name: Column) -> Column:
        block = F.coalesce(
            _unless_empty(F.regexp_extract(item, _SOURCE_BLOCK, 1)).try_cast("int"),
            once(F.lower(name), lambda low: F.get(F.filter(common, lambda c: c["name"] == low)["block"], F.lit(0))),
        )
        alias = F.coalesce(_unless_empty(_plain(F.regexp_extract(item, _SOURCE_ALIAS, 1))), _last(name))
        return once(
            block, lambda at: F.struct(F.lower(alias).alias("alias"), F.when(at.isNull(), name).alias("table"), at.alias("block"))
        )

    return once(_unless_empty(_plain(F.regexp_extract(item, _SOURCE_NAME, 1))), named)


def _branches(block: Column, common: Column) -> Column:
    """The parts of a block that set operations join: projections and sources of each."""

    def branch(text: Column) -> Column:
        items = F.flatten(F.transform(_all(text, _SOURCES), lambda listed: F.split(listed, ",")))
        return F.struct(
            F.transform(F.split(F.regexp_extract(text, _PROJECTED, 1), ","), _projection).alias("projections"),
            F.transform(items, lambda item: _source(item, common)).alias("sources"),
        )

    return F.transform(F.filter(F.split(block, _SET_OPERATION), lambda t: t.rlike(r"(?i)\bselect\b")), branch)


_PENDING = "array<struct<target:string,block:int,branch:int,ref:struct<block:int,qualifier:string,name:string>>>"
_DONE = "array<struct<target:string,source_table:string,source_column:string>>"


def _step(state: Column, blocks: Column) -> Column:
    """One level down: what each open reference reads is either a stored table's column, or open again in a derived table."""

    def target_of(block: Column) -> Column:
        return F.get(blocks, block)

    def within(sub: Column, name: Column, target: Column) -> Column:
        """The references behind a column of a block, in each of its branches; all of its columns for no name."""
        branches = target_of(sub)["branches"]
        outs = F.transform(F.get(branches, F.lit(0))["projections"], lambda p, i: F.coalesce(F.get(target_of(sub)["names"], i), p["out"]))
        place = F.array_position(F.transform(outs, lambda o: F.coalesce(F.lower(o), F.lit(""))), F.lower(name)).cast("int") - 1

        def of_branch(branch: Column, n: Column, at: Column) -> Column:
            wanted = F.when(name.isNull(), F.flatten(F.transform(branch["projections"], lambda p: p["refs"]))).when(
                at >= 0, F.get(branch["projections"], at)["refs"]
            ).when(
                F.exists(branch["projections"], lambda p: p["star"]) & (F.size(branch["sources"]) == 1),
                F.array(F.struct(F.lit(0).alias("block"), F.lit(None).cast("string").alias("qualifier"), name.alias("name"))),
            )
            return F.transform(
                F.coalesce(wanted, F.array().cast("array<struct<block:int,qualifier:string,name:string>>")),
                lambda r: F.struct(target.alias("target"), sub.alias("block"), n.alias("branch"), r.alias("ref")),
            )

        below = once(place, lambda at: F.flatten(F.transform(branches, lambda branch, n: of_branch(branch, n, at))))
        return F.coalesce(below, F.array().cast(_PENDING))

    def source_of(p: Column) -> Column:
        """The source that an open reference names: the only one, or the one of that alias."""
        sources = F.get(target_of(p["block"])["branches"], p["branch"])["sources"]
        by_alias = F.filter(sources, lambda s: s["alias"] == F.lower(p["ref"]["qualifier"]))
        return F.when(p["ref"]["qualifier"].isNull(), F.when(F.size(sources) == 1, F.get(sources, F.lit(0)))).otherwise(F.get(by_alias, F.lit(0)))

    opened = F.transform(state["pending"], lambda p: F.struct(p.alias("p"), source_of(p).alias("s")))
    return once(opened, lambda told: _told(told, state["done"], within))


def _told(told: Column, done: Column, within: Callable[[Column, Column, Column], Column]) -> Column:
    """The state after a step, from the open references with their sources."""
    sub = lambda x: F.when(x["p"]["ref"]["block"] > 0, x["p"]["ref"]["block"]).otherwise(x["s"]["block"])
    deeper = F.flatten(F.transform(F.filter(told, lambda x: sub(x).isNotNull()), lambda x: within(sub(x), x["p"]["ref"]["name"], x["p"]["target"])))
    # A qualifier that is no alias is taken for a table; an unqualified column among several sources names none.
    ended = F.transform(
        F.filter(told, lambda x: sub(x).isNull() & x["p"]["ref"]["name"].isNotNull()),
        lambda x: F.struct(
            x["p"]["target"].alias("target"), F.coalesce(x["s"]["table"], x["p"]["ref"]["qualifier"]).alias("source_table"),
            x["p"]["ref"]["name"].alias("source_column"),
        ),
    )
    return F.struct(F.array_distinct(deeper).alias("pending"), F.array_union(done, F.filter(ended, lambda e: e["source_table"].isNotNull())).alias("done"))


def column_refs_in_sql(texts: DataFrame) -> DataFrame:
    """(path, target_table, target_column, source_table, source_column) of the statements in (path, sql) rows.

    For every projection of an INSERT or CREATE the columns of stored tables that it reads, through aliases, derived
    tables, common tables (recursive ones too), set operations and scalar subqueries. The target column is the one of
    the INSERT's column list at that place, else the alias, else the column's own name; projections without a name are
    left out, as is ``*``. Names are as written, without quotes. Null or empty text gives no rows.
    """
    clean = F.regexp_replace(F.translate("sql", _MARKS, ""), _COMMENTS, "$1 ")
    clean = F.regexp_replace(clean, _LITERALS, f"$1{_TEXT}")
    # What a quoted name matched stays in front of a mark that stands for no literal.
    clean = F.regexp_replace(clean, rf'(["`\]]){_TEXT}', "$1")
    clean = F.regexp_replace(F.regexp_replace(clean, _DISTINCT_FROM, "="), _FROM_INSIDE, "($1,")
    statements = texts.select("path", F.explode(F.split(clean, ";")).alias("text")).where(
        F.col("text").rlike(r"(?i)\b(?:insert|create)\b") & F.col("text").rlike(r"(?i)\bselect\b")
    )
    # Rows go through a generator after each costly step: what a filter or a later column refers to is then computed
    # once, where a plain projection would be computed again for each of them.
    flat = statements.select("path", stack_rows([_without_brackets(F.col("text"), _depth(F.col("text")))]))
    common = F.flatten(
        F.transform(
            F.concat(F.array("text"), "blocks"),
            lambda t: F.transform(
                F.when(t.contains(_BLOCK), F.arrays_zip(*[_all(t, _COMMON, group).alias(f"g{group}") for group in (1, 2, 3)])).otherwise(F.array()),
                lambda g: F.struct(F.lower(g["g1"]).alias("name"), g["g2"].alias("names"), g["g3"].cast("int").alias("block")),
            ),
        )
    )
    target = F.struct(
        F.col("text").alias("text"), F.col("blocks").alias("blocks"), common.alias("common"),
        _plain(F.regexp_extract("text", _TARGET, 1)).alias("target_table"), F.regexp_extract("text", _TARGET, 2).alias("listed"),
    )
    named = flat.where(F.col("text").rlike(_IS_TARGET)).select("path", stack_rows([target])).where("target_table <> ''")
    # The statement's own block: from its first SELECT outside brackets on, or the bracketed SELECT at its end.
    own = F.regexp_extract("text", r"(?is)\b(select\b.*)$", 1)
    ending = _unless_empty(F.regexp_extract("text", rf"{_BLOCK}(\d+){_END}[\s{_CLOSE}]*$", 1)).try_cast("int")
    whole = F.concat(F.array(F.when(own != "", own).otherwise(F.get("blocks", ending - 1))), "blocks")
    blocks = F.transform(
        whole,
        lambda text, n: F.struct(
            _branches(text, F.col("common")).alias("branches"),
            F.transform(
                F.split(F.get(F.filter("common", lambda c: (c["block"] == n) & (c["names"] != ""))["names"], F.lit(0)), _COMMA), _plain
            ).alias("names"),
        ),
    )
    head = F.transform(F.split("listed", _COMMA), lambda c: _plain(F.regexp_extract(c, rf"^\s*({_IDENT})", 1)))
    parsed = named.select(
        "path", "target_table", stack_rows([F.struct(F.filter(head, lambda c: c != "").alias("listed"), blocks.alias("tree"))])
    )

    tree, listed = F.col("tree"), F.col("listed")
    outer = F.get(tree, F.lit(0))["branches"]
    first = F.get(outer, F.lit(0))["projections"]
    opened = F.flatten(
        F.transform(
            outer,
            lambda branch, b: F.flatten(
                F.transform(
                    branch["projections"],
                    lambda p, i: F.transform(
                        p["refs"],
                        lambda r: F.struct(
                            F.coalesce(F.get(listed, i), F.get(first, i)["out"]).alias("target"), F.lit(0).alias("block"), b.alias("branch"), r.alias("ref")
                        ),
                    ),
                )
            ),
        )
    )
    opened = F.filter(opened, lambda p: F.coalesce(p["target"], F.lit("")) != "")
    start = F.struct(opened.cast(_PENDING).alias("pending"), F.array().cast(_DONE).alias("done"))
    # A reference goes down one block a step, so as many steps as blocks reach every table.
    followed = F.aggregate(F.sequence(F.lit(0), F.size(tree)), start, lambda state, _: _step(state, tree))
    return parsed.select("path", "target_table", F.explode(followed["done"]).alias("e")).select(
        "path", "target_table", F.col("e.target").alias("target_column"), "e.source_table", "e.source_column"
    )


def column_refs(scripts: DataFrame) -> DataFrame:
    """The column references of plain SQL scripts and of SQL inside the string literals of Python scripts."""
    content = F.col("content")
    sql = scripts.where(is_sql_script(F.col("path"), content)).select("path", content.alias("sql"))
    strings = F.regexp_extract_all(content, F.lit('(?s)"""(.*?)"""' + "|'''(.*?)'''" + '|"(.*?)"'), F.lit(0))
    inner = F.transform(strings, lambda s: F.btrim(s, F.lit("\"'")))
    embedded = scripts.where(extension(F.col("path")) == "py").select("path", F.explode(inner).alias("sql"))
    return column_refs_in_sql(sql.unionByName(embedded))
