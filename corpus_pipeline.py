"""A training corpus from raw documents, in stages that each read what the stage before them wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; the last returns the packed pieces. Stages keep every clean document: the
classifier drops the documents it rejects, line dedup takes lines that many sites share out of texts, near-dedup
keeps one document of each group, and personal data is replaced by its kind in brackets.

A null text is kept as it is, with its length, until packing, where it counts as empty. Extra columns of ``documents``
are carried along whatever their names. Rows repeated under one doc_id are judged alike; near-dedup keeps one of those
that repeat in id and text. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import reshape
from tallyward.llm import line_spread, near_copies, packing, pii_spans, quality
from tallyward.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality model accepts; it is fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, quality.training_labels(labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that many sites share; lengths follow the texts."""
    cleaned = line_spread.without_spread_lines(docs, counts=False)
    if "n_chars" not in docs.columns:
        return cleaned
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return cleaned.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, and every document that has none.

    Null and empty texts are copies of nothing. Of rows that repeat in doc_id and text one stays, the same on every run.
    """
    judged = near_copies.near_copies(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)
    dropped = judged.where("not kept").select("doc_id").distinct()
    key, text = (f"c{docs.columns.index(name)}" for name in ("doc_id", "text"))
    plain = docs.toDF(*[f"c{n}" for n in range(len(docs.columns))])
    kept = plain.join(dropped, F.col(key) == F.col("doc_id"), "left_anti")
    again = written(plain.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")), "repeated-ids")
    if not again.isEmpty():
        same = F.col(key).eqNullSafe(F.col("again"))
        once = reshape.one_per_key(kept.join(again, same, "left_semi"), [key, text])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; a null text and its length stay as they are."""
    return pii_spans.mask(docs, pii_spans.fit(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents packed into sequences: one row per piece, repeated rows again; a null text is empty."""
    return packing.pack(packing.pieces(docs, packing.VOCABULARY))


def _carrying(stage: Callable) -> Callable:
    """A stage under which columns that it does not know travel by plain names and come back with their own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in COLUMNS else f"extra_{n}" for n, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return run


STAGES = [
    ("quality_classifier", _carrying(quality_classifier)),
    ("line_dedup", _carrying(line_dedup)),
    ("near_dedup", _carrying(near_dedup)),
    ("personal_data", _carrying(personal_data)),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but line dedup can be stated in SQL; tests hold the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each gives is written and read again as the input of the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
