"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Method: the shingles of a text are hashed once; the leading bits of a hash name its bin, and each bin keeps its
smallest hash. An empty bin borrows from the first occupied bin on a probing order of its own, the same for every
text. Each bin stores its low-order bits, packed into 64-bit words; the share of agreeing bins is corrected for the
agreements that few bits give by chance.

Everything is DataFrame functions, per row, without a shuffle of shingles: hashes and one marker per bin (the
largest value the bin can hold) are sorted together, so the first value of each bin is its smallest, and a marker
where the bin is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.ordering import with_next

SHINGLE = 5
BIN_BITS = 8
LOW_BITS = 8
PROBES = 12

BINS = 1 << BIN_BITS
_PER_WORD = 64 // LOW_BITS
_SHIFT = 64 - BIN_BITS
# In the order of signed numbers: bins whose first bit is set come first.
_MARKERS = [(((b + BINS // 2) % BINS - (BINS if (b + BINS // 2) % BINS >= BINS // 2 else 0)) << _SHIFT) + (1 << _SHIFT) - 1 for b in range(BINS)]


def _numbers(values, kind: str = "L") -> Column:
    """A constant array, parsed in one piece."""
    return F.expr(f"array({', '.join(f'{int(v)}{kind}' for v in values)})")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """One 64-bit hash per run of ``size`` words, in lower case; fewer words are one shingle, none are none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        every = F.transform(h, lambda _, i: F.xxhash64(F.slice(h, i + 1, F.lit(size))))
        return F.slice(every, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1)))

    return _let(hashed, runs)


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of every bin, in a fixed order of bins; the bin's marker where it is empty."""

    def firsts(ordered: Column) -> Column:
        def opens(x: Column, i: Column) -> Column:
            return (i == 0) | (F.shiftrightunsigned(x, _SHIFT) != F.shiftrightunsigned(F.get(ordered, i - 1), _SHIFT))

        return F.filter(ordered, opens)

    return _let(F.sort_array(F.concat(hashes, _numbers(_MARKERS))), firsts)


def _probes() -> list[np.ndarray]:
    rng = np.random.default_rng(41)
    return [rng.integers(0, BINS, BINS) for _ in range(PROBES)]


def densified(minima: Column) -> Column:
    """The low-order bits of every bin. An empty bin tries a fixed row of bins of its own, and if all of those are
    empty too takes the occupied bin of lowest rank in a random order of its own: both are the same for every text,
    so texts that share their occupied bins borrow alike.
    """
    low = (1 << LOW_BITS) - 1
    markers = _numbers(_MARKERS)
    probes = [_numbers(p, "") for p in _probes()]

    def fill(m: Column) -> Column:
        taken = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda q: F.get(m, q) != F.get(markers, q))

        def with_taken(occupied: Column) -> Column:
            def lowest(p: Column) -> Column:
                ranked = F.transform(
                    occupied,
                    lambda q: F.shiftleft(F.shiftright(F.xxhash64(p, q), LOW_BITS), LOW_BITS).bitwiseOR(own(F.get(m, q), p).bitwiseAND(F.lit(low))),
                )
                return F.array_min(ranked)

            def own(value: Column, p: Column) -> Column:
                """A borrowed value as this bin stores it, so that two bins with one lender do not err together."""
                return F.xxhash64(value, p)

            def borrowed(p: Column) -> Column:
                tries = []
                for probe in probes:
                    q = F.get(probe, p)
                    tries.append(F.when(F.get(m, q) != F.get(markers, q), own(F.get(m, q), p)))
                return F.coalesce(*tries, lowest(p))

            return F.transform(m, lambda x, p: F.when(x != F.get(markers, p), x).otherwise(borrowed(p)).bitwiseAND(F.lit(low)))

        return _let(taken, with_taken)

    return _let(minima, fill)


def packed(bits: Column) -> Column:
    """Groups of low-order bits side by side in 64-bit words."""
    starts = F.sequence(F.lit(1), F.lit(BINS), F.lit(_PER_WORD))

    def words(b: Column) -> Column:
        def word(start: Column) -> Column:
            part = F.slice(b, start, F.lit(_PER_WORD))
            return F.aggregate(part, F.lit(0).cast("long"), lambda n, v: F.shiftleft(n, LOW_BITS).bitwiseOR(v))

        return F.transform(starts, word)

    return _let(bits, words)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, an array of 64-bit words; empty for a text without words."""

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(packed(densified(bin_minima(h))))

    return _let(shingle_hashes(text), of_hashes)


def as_text(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two texts' shingle sets, 0 to 1; two empty ones are alike, an empty one is unlike others."""
    ones = sum(1 << (LOW_BITS * k) for k in range(_PER_WORD))

    def differing(x: Column, y: Column) -> Column:
        z, step = x.bitwiseXOR(y), LOW_BITS // 2
        while step:  # gather every group's bits in its lowest one
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
            step //= 2
        return F.bit_count(z.bitwiseAND(F.lit(ones).cast("long")))

    agreeing = F.lit(float(BINS)) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, d: n + d)
    chance = 2.0**-LOW_BITS
    share = F.greatest(F.lit(0.0), (agreeing / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2): the pair of hashes names a row by what it holds."""
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("k1"), F.xxhash64(F.lit(1), text, doc).alias("k2"))


def successors(rows: DataFrame) -> DataFrame:
    """(k1, k2, n1, n2, n_chars): each row's key, the key of the next in order of doc_id, and its length.

    Rows repeated in full stand in one place, rows of equal id follow each other by their hashes, null ids come
    first, and the last row of all is followed by the first.
    """
    keys = rows.select("doc_id", "k1", "k2", F.length("text").alias("n_chars")).distinct()
    linked = with_next(keys, ["doc_id", "k1", "k2"], around=True)
    return linked.select("k1", "k2", F.col("next.k1").alias("n1"), F.col("next.k2").alias("n2"), "n_chars")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) per row, packed words. A null text counts as empty; rows are taken as they are."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string")).alias("fingerprint"))


def edited_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint, that of its edited text, and its likeness to the edited text and to the next row's.

    The last quarter of a text's characters is replaced by as many of the next row's first ones, or all it has. A
    null text is an empty one; an empty table gives no rows. Texts are shuffled once, by key: the same exchange
    gives a text its next one's head and gives away its own, so both of its readers ask for the same columns.
    """
    rows = _keyed(documents, id_col, text_col)
    links = successors(rows)
    wanted = links.select(
        F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"),
    )
    fp = fingerprint(F.col("text"))
    met = rows.join(wanted, ["k1", "k2"]).select("k1", "k2", "p1", "p2", "doc_id", F.expr("left(text, quarter)").alias("head"), fp.alias("fp"))
    own = F.struct("k1", "k2", "doc_id", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<long>").alias("next_fp"), "fp")
    given = F.struct(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(None).cast("long").alias("doc_id"), "head", F.col("fp").alias("next_fp"), F.lit(None).cast("array<long>").alias("fp")
    )
    parts = met.select(F.explode(F.array(own, given)).alias("part")).select("part.*")
    # Rows repeated in full are one neighbour.
    told = parts.groupBy("k1", "k2").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "head", "next_fp", "fp")))
    both = rows.join(told.withColumnRenamed("doc_id", "own_id"), ["k1", "k2"])
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.col("head"))
    told = both.select(F.coalesce("doc_id", "own_id").alias("doc_id"), n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    told = told.withColumn("edited_fp", fingerprint(F.col("edited")))
    return told.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
