"""Personal-data detection over whole column values with pattern recognizers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.constants import (
    ENTITIES,
    ENTITY_SCORE_THRESHOLD,
    UNSCANNED_CATEGORIES,
    VALUE_SCAN_CATEGORIES,
)
from tallyward.functions.digests import EMAIL_PATTERN, has_email, near_digits
from tallyward.functions.reshape import long_text, stack_rows
from tallyward.operators.classify import sensitivity_rank


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[ -]", "")


def _luhn(text: Column) -> Column:
    return F.call_function("luhn_check", _digits(text))


def _iban(text: Column) -> Column:
    """ISO 13616 check: move four characters to the end, letters count 10..35, remainder 1 mod 97."""
    moved = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.array_remove(F.split(moved, ""), ""), F.lit(0), step) == 1


_CHECKS = {"luhn": _luhn, "iban": _iban}


@dataclass(frozen=True)
class Recognizer:
    """A pattern with its confidence; ``check`` names a checksum that a match must also satisfy.

    ``near`` says that the pattern finds in the surroundings of the digits what it finds in the text (see
    :func:`tallyward.functions.digests.near_digits`); no match is shorter than ``least`` characters.
    """

    entity: str
    pattern: str
    score: float
    check: str | None = None
    near: bool = False
    least: int = 0

    def fires(self, text: Column, around: Column | None = None) -> Column:
        """Whether the text matches; ``around`` is its :func:`near_digits`, computed once for all recognizers."""
        if self.pattern == EMAIL_PATTERN and self.check is None:
            return has_email(text)
        scanned = (near_digits(text) if around is None else around) if self.near else text
        if self.check is None:
            found = scanned.rlike(self.pattern)
        else:
            found = F.exists(F.regexp_extract_all(scanned, F.lit(self.pattern), 0), _CHECKS[self.check])
        if self.least:
            found = (F.octet_length(scanned) >= self.least) & found
        return F.coalesce(found, F.lit(False)) if self.near else found  # no digits, no surroundings


# Default recognizers (entity, pattern, confidence, checksum, near digits).
DEFAULT_RECOGNIZERS = (
    Recognizer("EMAIL_ADDRESS", EMAIL_PATTERN, 1.0),
    Recognizer(  # a country code, or groups of three, three and four digits: a plain number is no phone
        "PHONE_NUMBER",
        r"(?:^|[^\w.])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})\b",
        0.4, near=True, least=7,
    ),
    Recognizer("US_SSN", r"\b\d{3}[- ]\d{2}[- ]\d{4}\b", 0.5, near=True, least=11),
    Recognizer(
        "IP_ADDRESS",
        r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
        0.6, near=True, least=7,
    ),
    Recognizer("CREDIT_CARD", r"\b\d(?:[ -]?\d){12,15}\b", 1.0, "luhn", near=True, least=13),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 1.0, "iban", least=15),
)


def pii_strategy(category: Column) -> Column:
    """How a source is scanned: by values, by column names, or not at all."""
    return (
        F.when(category.isin(*UNSCANNED_CATEGORIES), "skipped")
        .when(category.isin(*VALUE_SCAN_CATEGORIES), "values")
        .otherwise("column_names")
    )


def detect_pii_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    asset: str = "",
) -> DataFrame:
    """(asset, column, entity, score): best score per entity over all values of a column.

    One maximum per recognizer, combined before the shuffle: a task sends one row per column. What surrounds the
    digits of a text is found once and serves all recognizers of numbers.
    """
    columns = list(columns or df.columns)
    text, around = F.col("value"), F.col("around")
    best = (
        long_text(df, columns)
        .where(text != "")
        .withColumn("around", near_digits(text))
        .groupBy("column")
        .agg(*[F.max(F.when(r.fires(text, around), r.score)).alias(f"score_{i}") for i, r in enumerate(recognizers)])
    )
    rows = [
        F.struct(F.lit(r.entity).alias("entity"), F.col(f"score_{i}").alias("score"))
        for i, r in enumerate(recognizers)
    ]
    return (
        best.select("column", stack_rows(rows))
        .where(F.col("score").isNotNull())
        .groupBy("column", "entity")
        .agg(F.max("score").alias("score"))
        .select(F.lit(asset).alias("asset"), "column", "entity", "score")
    )


def detect_pii_names(
    columns: DataFrame, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS
) -> DataFrame:
    """The same over column names (underscores read as spaces), where values are out of reach."""
    text = F.replace(F.col("column"), F.lit("_"), F.lit(" "))
    hits = F.array_compact(
        F.array(
            *[
                F.when(r.fires(text), F.struct(F.lit(r.entity).alias("entity"), F.lit(r.score).alias("score")))
                for r in recognizers
            ]
        )
    )
    return columns.select("asset", "column", F.inline(hits))


def _lookup(entity: Column, position: int, kind: str) -> Column:
    pairs = [x for name, row in ENTITIES.items() for x in (F.lit(name), F.lit(row[position]).cast(kind))]
    return F.element_at(F.create_map(*pairs), entity)


def pick_entity(hits: DataFrame, threshold: float = ENTITY_SCORE_THRESHOLD) -> DataFrame:
    """The single best entity per column: weighted score first, then priority."""
    entity = F.col("entity")
    known = hits.where(entity.isin(*ENTITIES) & (F.col("score") >= threshold))
    order = F.struct(_lookup(entity, 2, "double") * F.col("score"), _lookup(entity, 3, "int"))
    return known.groupBy("asset", "column").agg(
        F.max_by(F.struct("entity", "score"), order).alias("best")
    ).select("asset", "column", "best.entity", "best.score")


def record_pii(picked: DataFrame) -> DataFrame:
    """Finding rows: category with entity, the entity's sensitivity, score to three decimals."""
    return picked.select(
        "asset",
        "column",
        F.concat_ws(":", _lookup(F.col("entity"), 0, "string"), "entity").alias("category"),
        _lookup(F.col("entity"), 1, "string").alias("sensitivity_level"),
        F.round("score", 3).alias("confidence"),
    )


def bump_sensitivity(current: Column, found: Column) -> Column:
    """Raise a level, never lower it; a public finding leaves an unclassified asset as it is."""
    return F.when(sensitivity_rank(found) > sensitivity_rank(current), found).otherwise(current)


def bump_assets(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Assets with their level raised to that of their finding."""
    found = findings.select("asset", "column", F.col("sensitivity_level").alias("found_level"))
    return (
        assets.join(found, ["asset", "column"], "left")
        .withColumn(
            "sensitivity_level",
            F.when(F.col("found_level").isNull(), F.col("sensitivity_level")).otherwise(
                bump_sensitivity(F.col("sensitivity_level"), F.col("found_level"))
            ),
        )
        .drop("found_level")
    )


def pii_scan_summary(columns: DataFrame, findings: DataFrame) -> DataFrame:
    """Columns scanned and findings (at most one per column) for each asset."""
    scanned = columns.groupBy("asset").agg(F.count(F.lit(1)).alias("columns_scanned"))
    found = findings.groupBy("asset").agg(F.count(F.lit(1)).alias("findings"))
    return scanned.join(found, "asset", "left").fillna(0, ["findings"])
