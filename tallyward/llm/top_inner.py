"""Exact top-k search by inner product over integer vectors.

Method: vectors are processed by descending length; queries and candidates are rotated by the right
singular vectors of the data, so that a short prefix of the components carries most of a product; what is
left is bounded by Cauchy-Schwarz on the residual lengths. Only survivors get their full integer product.

Candidates are dealt into blocks of bounded size, queries into blocks of bounded size, and each pair of
blocks is one group: a stated query set against all rows, in blocks. A lower bound for the k-th score of a
query comes from a fixed number of the longest vectors, so most blocks return few rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyward.session import written

CANDIDATES_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 4_096
SEEDS = 1_024
CHUNK = 2_048
QUERY_CHUNK = 256
HEAD_SHARE = 0.25

_FOUND = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, ints): every component as floor(scale * x), x as double.

    Rows whose id or vector is null, or whose vector is empty or holds null, NaN or infinite components,
    take no part. Rows repeated in full count once.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    usable = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall(
        "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    ints = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return rows.where(F.coalesce(usable, F.lit(False))).select("vec_id", ints.alias("ints")).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all rows, largest first: from the dims x dims sum of outer products."""

    def gram(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            if len(x):
                total += x.T @ x
        yield pa.RecordBatch.from_pydict(
            {"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "v": total.ravel()}
        )

    sums = vectors.select("ints").mapInArrow(gram, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    whole = np.zeros((dims, dims))
    for row in sums.collect():  # dims x dims numbers
        whole[row.i, row.j] = row.v
    return np.linalg.eigh(whole)[1][:, ::-1].copy()


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, of one query."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def search_block(
    q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one block that can still reach the query's floor."""
    head = max(1, math.ceil(turn.shape[0] * HEAD_SHARE))
    xr, qr = x @ turn, q @ turn
    order = np.argsort(-_lengths(xr), kind="stable")
    ids, x, xr = ids[order], x[order], xr[order]
    x_len, q_len = _lengths(xr), _lengths(qr)
    x_rest, q_rest = _lengths(xr[:, head:]), _lengths(qr[:, head:])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), QUERY_CHUNK):
        part = slice(lo, lo + QUERY_CHUNK)
        floor = floors[part].astype(np.float64)
        best_ids = [np.zeros(0, dtype=np.int64)] * len(floor)
        best_scores = [np.zeros(0, dtype=np.int64)] * len(floor)
        for at in range(0, len(x), CHUNK):
            # Rounding of the rotated sums is far below this slack; scores are whole numbers.
            slack = 0.5 + 1e-9 * q_len[part] * x_len[at]
            alive = np.flatnonzero(q_len[part] * x_len[at] + slack >= floor)
            if not len(alive):
                break  # all later vectors are shorter
            rows = slice(at, at + CHUNK)
            bound = qr[part][alive][:, :head] @ xr[rows, :head].T
            bound += np.outer(q_rest[part][alive], x_rest[rows])
            survives = bound + slack[alive][:, None] >= floor[alive][:, None]
            for n, i in enumerate(alive):
                take = np.flatnonzero(survives[n])
                take = take[ids[rows][take] != q_ids[lo + i]]
                if not len(take):
                    continue
                scores = x[rows][take] @ q[lo + i]
                reach = scores >= floor[i]
                all_ids = np.concatenate([best_ids[i], ids[rows][take][reach]])
                all_scores = np.concatenate([best_scores[i], scores[reach]])
                best = _best(all_scores, all_ids, k)
                best_ids[i], best_scores[i] = all_ids[best], all_scores[best]
                if len(best) == k:
                    floor[i] = max(floor[i], float(best_scores[i][-1]))
        for i in range(len(floor)):
            if len(best_ids[i]):
                found.append((np.full(len(best_ids[i]), q_ids[lo + i]), best_ids[i], best_scores[i]))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _of_length(df: DataFrame, dims: int) -> DataFrame:
    return df.where(F.size("ints") == dims)


def top_inner(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query among all other rows.

    ``vectors`` and ``queries`` come from :func:`integer_vectors`. A query never meets rows of its own id.
    Vectors of different dimension meet only their like. Ties go to the smaller vec_id; fewer candidates than
    k give fewer rows; empty tables give no rows. Two queries of one id answer together.
    """
    spark = vectors.sparkSession
    vectors, queries = written(vectors, "vectors"), written(queries, "queries")
    lengths = [r[0] for r in vectors.select(F.size("ints").alias("n")).distinct().orderBy("n").collect()]
    found = None
    for dims in lengths:  # one in practice: rows of other lengths are faults of the table
        part = _search(_of_length(vectors, dims), _of_length(queries, dims), dims, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    turn = rotation(vectors, dims)
    squares = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    longest = vectors.orderBy(F.desc(squares), "vec_id").limit(SEEDS).toArrow()  # SEEDS rows at most
    seed_ids, seeds = longest["vec_id"].to_numpy(), _matrix(longest["ints"])

    def with_floor(batches):
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1))
            floors = np.full(len(ids), np.iinfo(np.int64).min)
            for i in range(len(ids)):
                scores = (seeds @ q[i])[seed_ids != ids[i]]
                if len(scores) >= k:
                    floors[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors)], names=["vec_id", "ints", "floor"])

    asked = queries.mapInArrow(with_floor, "vec_id long, ints array<long>, floor long")
    x_blocks = max(1, math.ceil(vectors.count() / CANDIDATES_PER_BLOCK))
    q_blocks = max(1, math.ceil(queries.count() / QUERIES_PER_BLOCK))
    number = F.monotonically_increasing_id()
    left = asked.withColumn("q_block", F.pmod(number, F.lit(q_blocks))).withColumn(
        "x_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x_blocks - 1).cast("long")))
    )
    right = vectors.withColumn("x_block", F.pmod(number, F.lit(x_blocks))).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))
    )

    def meet(key, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            got = [np.zeros(0, dtype=np.int64)] * 3
        else:
            got = search_block(
                ours["vec_id"].to_numpy(), _matrix(ours["ints"]), ours["floor"].to_numpy(),
                theirs["vec_id"].to_numpy(), _matrix(theirs["ints"]), turn, k,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    keys = ["x_block", "q_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, _FOUND)
