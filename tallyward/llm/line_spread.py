"""Removal of lines that many sites share, by distinct-site spread.

Method: for every line hash a HyperLogLog sketch of the sites it stands on; sketches merge as aggregation goes, so
a hot line is one sketch per task. Estimates far from the threshold decide; lines whose estimate lies near it get
an exact distinct count of their sites, so the result is that of exact counts.

A line is compared without the white space around it; blank lines are kept and never counted. A widespread line
stays in one document, the smallest that has it, at its first place there, so no passage is lost to the corpus; it goes
everywhere else, however much of a document it makes up. Exact copies of that one document, told by a hash of their
whole sequence of lines, keep what it keeps: they stay copies of it, for near-duplicate removal to take out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.reshape import quoted
from tallyward.session import written

SITES = 8
MARGIN = 0.25
SKETCH_BITS = 10
BLANKS = " \t\r\f\x0b"

_ROW = ["r1", "r2"]
_LINE = ["h1", "h2"]
_COPY = ["s1", "s2"]


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _rows(documents: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(r1, r2, s1, s2, doc_id, site, lines). The first pair names a row by what it holds, so rows repeated in full
    answer alike; the second names its sequence of lines, which its copies share.

    A null text is an empty one; a null site is a site like any other.
    """
    doc, site, text = _parts(id_col, text_col, site_col)
    lines = F.split(text, "\n")
    sequence = F.filter(F.transform(lines, _trimmed), lambda line: line != "")
    return documents.select(
        *_row_keys(id_col, text_col, site_col), F.xxhash64(sequence).alias("s1"), F.xxhash64(F.lit(1), sequence).alias("s2"),
        doc.alias("doc_id"), site.alias("site"), lines.alias("lines"),
    )


def _parts(id_col: str, text_col: str, site_col: str) -> tuple[Column, Column, Column]:
    site = F.coalesce(F.concat(F.lit("s"), quoted(site_col).cast("string")), F.lit("-"))
    return quoted(id_col).cast("long"), site, F.coalesce(quoted(text_col).cast("string"), F.lit(""))


def _row_keys(id_col: str, text_col: str, site_col: str) -> tuple[Column, Column]:
    doc, site, text = _parts(id_col, text_col, site_col)
    return F.xxhash64(doc, site, text).alias("r1"), F.xxhash64(F.lit(1), text, site, doc).alias("r2")


def _placed_lines(rows: DataFrame) -> DataFrame:
    """(r1, r2, s1, s2, doc_id, site, pos, h1, h2) of every line that is not blank."""
    each = rows.select(*_ROW, *_COPY, "doc_id", "site", F.posexplode("lines").alias("pos", "line")).withColumn("line", _trimmed(F.col("line")))
    return each.where("line <> ''").select(
        *_ROW, *_COPY, "doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def widespread(lines: DataFrame, sites: int = SITES, margin: float = MARGIN, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(h1, h2, first) of the lines that stand on at least ``sites`` distinct sites; ``first`` names the line sequence
    of the smallest document that has the line, null where no row with it has an id.

    ``margin`` covers the sketch error many times over: 2**10 registers err by 3 % at one standard deviation.
    """
    per_line = lines.groupBy(*_LINE).agg(
        F.count("*").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *_COPY))).alias("first"),
        F.hll_sketch_agg("site", F.lit(sketch_bits)).alias("sketch"),
    )
    spread = written(
        per_line.where(F.col("n") >= sites)
        .select(*_LINE, F.struct("first.s1", "first.s2").alias("first"), F.hll_sketch_estimate("sketch").alias("spread"))
        .where(F.col("spread") >= sites * (1 - margin)),
        "spread",
    )
    names = [*_LINE, "first"]
    clear = spread.where(F.col("spread") > sites * (1 + margin)).select(*names)
    near = spread.where(F.col("spread") <= sites * (1 + margin)).select(*names)
    exact = (
        lines.select(*_LINE, "site").join(near, _LINE)
        .groupBy(*names, "site").agg(F.lit(1).alias("one"))
        .groupBy(*names).agg(F.count("*").alias("n"))
        .where(F.col("n") >= sites).select(*names)
    )
    return clear.unionByName(exact)


def removals(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """(r1, r2, removed): per row the places of its widespread lines, but for the kept ones."""
    keeps = F.coalesce((F.col("s1") == F.col("first.s1")) & (F.col("s2") == F.col("first.s2")), F.lit(False)).alias("keeps")
    shared = lines.join(spread, _LINE).select(*_ROW, F.struct(*_LINE, "pos", keeps).alias("place"))
    # A row's places by line and position, each once: rows repeated in full name the same ones.
    rows = shared.groupBy(*_ROW).agg(F.array_sort(F.collect_set("place")).alias("places"))

    def goes(place: Column, at: Column) -> Column:
        before = F.get("places", at - 1)
        again = (at > 0) & (before["h1"] == place["h1"]) & (before["h2"] == place["h2"])
        return ~place["keeps"] | again

    removed = F.transform(F.filter("places", goes), lambda place: place["pos"])
    return rows.select(*_ROW, removed.alias("removed"))


def without_spread_lines(
    documents: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = True
) -> DataFrame:
    """The rows with all their columns, widespread lines taken out of the text; with ``counts`` also ``n_lines`` and
    ``n_removed``, in place of columns of that name.

    A null text stays null, with one empty line; a text of widespread lines alone becomes empty. Rows without an id
    never decide where a line stays. Repeated rows answer alike. An empty table gives no rows.
    """
    lines = _placed_lines(_rows(documents, id_col, text_col, site_col))
    gone = removals(lines, widespread(lines, sites))
    names = [c for c in documents.columns if not counts or c not in ("n_lines", "n_removed")]
    kept = documents.select(*_row_keys(id_col, text_col, site_col), F.struct(*[quoted(c).alias(f"c{n}") for n, c in enumerate(names)]).alias("row"))
    joined = kept.join(gone, _ROW, "left")
    text = F.col(f"row.c{names.index(text_col)}")
    body = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    whole = F.col("removed").isNull() | (F.size("removed") == 0)
    left = F.array_join(F.filter(body, lambda _, pos: ~F.array_contains(F.col("removed"), pos)), "\n")
    out = [F.when(whole, text).otherwise(left).alias(c) if c == text_col else F.col(f"row.c{n}").alias(c) for n, c in enumerate(names)]
    if not counts:
        return joined.select(*out)
    return joined.select(
        *out, F.size(body).cast("long").alias("n_lines"), F.when(whole, F.lit(0)).otherwise(F.size("removed")).cast("long").alias("n_removed")
    )
