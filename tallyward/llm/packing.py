"""Best-fit packing of tokenised documents into sequences of bounded length.

Method (exact-complement hashing): only the number of pieces of each length decides a packing, so the plan is
made on counts of at most ``capacity`` lengths. Single, pair and triple length sums are indexed by their
complement; combinations that fill a sequence exactly are consumed, each as often as the counts allow. What is
left is packed best-fit decreasing, again whole runs of equal sequences at a time. The plan is then applied on
Spark: every piece learns its rank among the pieces of its length and reads its place from the plan.

The plan holds a bounded number of runs (it depends on the number of lengths, not of pieces), so it may go to
every task. No group of pieces is ever gathered: ranks come from counts per (length, salt).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.llm.vocabulary import encoder
from tallyward.session import written

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
ROWS_PER_SALT = 100_000
LEAST_SALTS = 64

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

Run = tuple[int, tuple[int, ...]]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else a first piece of what full ones leave over."""
    first = n_ids % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n_ids, capacity))]


def pieces(
    documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise every document, append ``end_id`` and cut what is longer than ``capacity``.

    A null text counts as empty and gives one piece holding ``end_id`` alone; rows are taken as they are, so
    repeated rows give repeated pieces and a null id stays null.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added=True)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(out, (doc, k, start, length, crc), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tokenised, _PIECES)


def _exact_runs(left: np.ndarray, capacity: int, most: int) -> list[Run]:
    """Combinations of up to ``most`` (two to four) lengths that fill a sequence exactly, as often as counts allow.

    ``left[n]`` is the number of pieces of length n still to place; it is used up here. Sums of one, two and
    three lengths are looked up by what they lack.
    """
    runs: list[Run] = []

    def consume(lengths: tuple[int, ...]) -> None:
        need = np.bincount(lengths)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        if times:
            left[used] -= times * need[used]
            runs.append((times, lengths))

    if left[capacity]:
        consume((capacity,))
    for a in range(capacity - 1, 0, -1):  # a single length and its complement
        if left[a] and capacity - a <= a and left[capacity - a]:
            consume((a, capacity - a))
    for a in range(capacity - 2, 0, -1) if most >= 3 else ():  # a length whose complement is a pair sum
        for b in range(min(a, capacity - a - 1), 0, -1):
            c = capacity - a - b
            if c > b or not left[a]:
                break
            if left[b] and left[c]:
                consume((a, b, c))
    for a in range(capacity - 3, 0, -1) if most >= 4 else ():  # a length whose complement is a triple sum: pairs of pair sums
        for b in range(min(a, capacity - a - 2), 0, -1):
            if not left[a]:
                break
            if not left[b]:
                continue
            rest = capacity - a - b
            if rest > 2 * b:
                break
            for c in range(min(b, rest - 1), (rest - 1) // 2, -1):
                if left[c] and left[rest - c]:
                    consume((a, b, c, rest - c))
                if not (left[a] and left[b]):
                    break
    return runs


def _best_fit_runs(left: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing over what is left, equal sequences together.

    Open sequences are held as runs by their gap. The pieces of a length go first into the open gaps that fit
    them most tightly, then into new sequences, as many in one as fit.
    """
    gaps: list[int] = []
    open_runs: dict[int, list[list]] = {}

    def put_back(gap: int, times: int, lengths: tuple[int, ...]) -> None:
        if gap not in open_runs:
            insort(gaps, gap)
            open_runs[gap] = []
        open_runs[gap].append([times, lengths])

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        left[length] = 0
        at = bisect_left(gaps, length)
        while todo and at < len(gaps):
            gap = gaps[at]
            entry = open_runs[gap].pop()
            times, lengths = entry
            take = min(times, todo)
            if times > take:
                open_runs[gap].append([times - take, lengths])
            if not open_runs[gap]:
                del open_runs[gap]
                gaps.pop(at)
            todo -= take
            put_back(gap - length, take, (*lengths, length))
            at = bisect_left(gaps, length)
        each = capacity // length
        if todo >= each:
            put_back(capacity - each * length, todo // each, (length,) * each)
            todo %= each
        if todo:
            put_back(capacity - todo * length, 1, (length,) * todo)
    return [(times, lengths) for gap in gaps for times, lengths in open_runs[gap]]


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """(times, lengths) runs that hold every counted piece: exact fillings first, then best fit.

    Filling sequences exactly with many small pieces can leave large ones without fitting company, so the plan is
    made with exact fillings of up to four, three and two pieces, and the one of fewest sequences is taken.
    """
    plans = []
    for most in (4, 3, 2):
        left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            left[length] = n
        plans.append(_exact_runs(left, capacity, most) + _best_fit_runs(left, capacity))
    return min(plans, key=lambda runs: sum(times for times, _ in runs))


def places(runs: list[Run]) -> pd.DataFrame:
    """Where the pieces of each length go: those ranked from ``first`` on lie in sequence + (rank - first) at offset."""
    rows, sequence, seen = [], 0, {}
    for times, lengths in runs:
        offset = 0
        for length in lengths:
            first = seen.get(length, 0)
            rows.append((length, first, sequence, offset))
            seen[length] = first + times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"])


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a sequence and an offset there; sequences are filled without gaps from offset 0.

    Pieces of one length are alike for the packing, so which of them takes which place is free. An empty
    table gives no rows.
    """
    spark = cut_pieces.sparkSession
    stored = written(cut_pieces, "pieces")
    counts = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    total = sum(counts.values())
    salts = max(LEAST_SALTS, total // ROWS_PER_SALT)
    salted = stored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(within) - 1)
        .join(before, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    )
    plan = places(plan_runs(counts, capacity))
    columns = {name: plan[name].to_numpy(dtype=np.int64) for name in plan.columns}
    shared = spark.sparkContext.broadcast(columns)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        wide = np.int64(1) << 40  # ranks are far below it
        key = at["length"] * wide + at["first"]
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            spot = np.searchsorted(key, length * wide + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [batch.column(n) for n in names]
            arrays += [pa.array(at["sequence"][spot] + rank - at["first"][spot]), pa.array(at["offset"][spot])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, _PACKED)
