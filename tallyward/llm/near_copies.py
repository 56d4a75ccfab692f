"""Near-duplicate documents by min-max hashing of word shingles, confirmed on whole shingle sets.

Method: under each random permutation of the shingle hashes both the smallest and the largest value are kept, so
half the hash evaluations give the signature; each of the two agrees between documents with probability equal to
their similarity, and together they vary less than two separate minima. Bands of the signature give candidates.

Equal sets are one class, named by its smallest id. Classes that share a band bucket are first compared with one
leader; where a bucket still holds several components afterwards, all its classes of different components are
compared, in pairs of blocks of bounded size. So links are lost only where no band agrees: with 28 bands of 4 at
similarity 0.8 that is one pair in three million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.components import components
from tallyward.llm.words import bytes_of, mixed, shingle_sets
from tallyward.session import written

PERMUTATIONS = 56
ROWS_PER_BAND = 4
BLOCK = 256

_RNG = np.random.default_rng(77)
_TIMES = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64)
_COLUMNS = 1 << 15


def min_max(hashes: np.ndarray, permutations: int) -> np.ndarray:
    """The smallest and the largest value of each permutation, side by side."""
    times, plus = _TIMES[:permutations, None], _PLUS[:permutations, None]
    low = np.full(permutations, np.iinfo(np.uint64).max)
    high = np.zeros(permutations, dtype=np.uint64)
    for at in range(0, len(hashes), _COLUMNS):
        values = hashes[None, at : at + _COLUMNS] * times + plus
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def signature_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Unbiased estimate of the similarity of two sets from their signatures."""
    return float(np.mean(a == b))


def _bands(signature: np.ndarray) -> np.ndarray:
    rows = signature[: len(signature) // ROWS_PER_BAND * ROWS_PER_BAND].reshape(-1, ROWS_PER_BAND)
    keys = np.zeros(len(rows), dtype=np.uint64)
    for k in range(ROWS_PER_BAND):
        keys = mixed(keys * np.uint64(31) + rows[:, k])
    return mixed(keys + np.arange(len(rows), dtype=np.uint64) * _PLUS[0])


def enough(common: int, left: int, right: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    return 100 * common >= percent * (left + right - common)


def _selected(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _fingerprints(rows: DataFrame, size: int, permutations: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            count, h1, h2, bands = [], [], [], []
            for hashes in shingle_sets(data, offsets, size):
                count.append(len(hashes))
                h1.append(int(np.sum(mixed(hashes ^ _PLUS[1]), dtype=np.uint64).view(np.int64)))
                h2.append(int(np.sum(mixed(hashes ^ _PLUS[2]), dtype=np.uint64).view(np.int64)))
                bands.append(_bands(min_max(hashes, permutations)).view(np.int64) if len(hashes) else None)
            arrays = [batch.column(0), pa.array(count, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            arrays.append(pa.array(bands, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            sets = [s.tobytes() for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return rows.mapInArrow(run, "id long, hashes binary")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, a_hashes, b_hashes) rows, the (a, b) whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (left, right))
                keep.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "a_hashes", "b_hashes").mapInArrow(run, "a long, b long")


def block_links(ids: np.ndarray, groups: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components in one pair of blocks, enough of them to join those components.

    Members are ordered by set size: sizes too far apart cannot reach the similarity. Components that a link
    has joined are not compared again.
    """
    parent = {g: g for g in set(groups.tolist())}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    order = np.argsort([len(s) for s in sets], kind="stable")
    links = []
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            if sides[i] == sides[j] and sides[i] >= 0:
                continue
            a, b = root(int(groups[i])), root(int(groups[j]))
            if a == b:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if enough(common, len(sets[i]), len(sets[j]), percent):
                parent[a] = b
                links.append((int(ids[i]), int(ids[j])))
    return links


def _cross_links(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that hold several components, by pairs of blocks of at most BLOCK classes."""
    named = members.join(labels, members.id == labels.node, "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component")
    )
    open_buckets = (
        named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
        .where("low <> high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    rows = named.join(open_buckets, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        rows.withColumn("other", other)
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component")
        .join(sets, "id")
    )

    def meet(table: pa.Table) -> pa.Table:
        same = table["i"][0].as_py() == table["j"][0].as_py()
        ids, groups = table["id"].to_numpy(), table["component"].to_numpy()
        sides = np.full(len(ids), -1) if same else table["block"].to_numpy()
        hashes = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table["hashes"]]
        links = block_links(ids, groups, sides, hashes, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(meet, "a long, b long")


def near_copies(
    documents: DataFrame, size: int = 4, percent: int = 80, permutations: int = PERMUTATIONS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row, linking texts whose shingle sets are ``percent`` alike.

    A null or empty text has no shingles and is linked with nothing. A text of fewer than ``size`` words is one
    shingle. Rows sharing a doc_id share its component, and link through each of their texts; rows without a
    doc_id keep a null component and are kept. An empty table gives no rows.
    """
    rows = _selected(documents, id_col, text_col)
    marks = written(_fingerprints(rows, size, permutations), "fingerprints")
    full = marks.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    # Copies wait for the components of their classes, so a hot group of them is no node's neighbourhood.
    copies = written(full.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id"), "copies")
    several = copies.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("high")).where("b <> high").drop("high")
    same = copies.join(several, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")

    spread = classes.select("id", F.explode("bands").alias("bucket"))
    leaders = spread.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last")
    members = written(spread.join(leaders.select("bucket", "leader"), "bucket").select("bucket", "id", "leader"), "buckets")
    involved = members.select("id").distinct()
    wanted = rows.join(involved, rows.doc_id == involved.id, "left_semi")
    sets = written(_sets(wanted, size).distinct(), "sets")

    first = members.where("id <> leader").groupBy("id").agg(F.min("leader").alias("leader"))
    pairs = (
        first.join(sets, "id").select(F.col("id").alias("a"), F.col("leader").alias("b"), F.col("hashes").alias("a_hashes"))
        .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("b_hashes")), "b")
    )
    links = written(_confirmed(pairs, percent).unionByName(same), "links")
    crossing = written(_cross_links(members.select("bucket", "id"), sets, components(links), percent), "links")
    labels = components(links.unionByName(crossing))
    joined = copies.join(labels, copies.id == labels.node, "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    named = marks.select("doc_id", "n_shingles").join(joined.distinct(), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
