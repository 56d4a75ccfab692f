"""Benchmark passages in documents: Wu-Manber search for many test strings at once, with words as its letters.

A test string is a window of consecutive words of a benchmark item. All windows of one length are searched together.
The shift table tells, for the block of two words that ends at the cursor, how far the cursor may jump because no
window can end before; where it may not jump, the hash of that block picks a bucket of windows, the window's own hash
one entry of the bucket, and the words themselves are compared before an occurrence counts. The cursors of many
stretches of text move in step, so that each jump is one numpy operation over all of them.

Bounds: a task holds one table of windows, of at most about ``TABLE_BYTES`` of item text, and one batch of documents.
A larger benchmark is dealt into several tables by a hash of its pieces, and the documents pass all of them one after
the other without a shuffle; every window of every item is in one of the tables. Nothing is dropped or capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.words import blocks, bytes_of, mixed, word_hashes
from tallyward.session import written

WINDOW = 10
TABLE_BYTES = 16 << 20
PIECE_WORDS = 2048
STRETCH = 256
TABLES_PER_STAGE = 8

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that part words: all of ASCII but digits and letters. Bytes of other characters belong to words.
_APART = np.ones(256, dtype=bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
_TIMES = np.random.default_rng(1994).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SMALL = bytes.maketrans(_UPPER.encode(), _LOWER.encode())

FOUND = "doc_id long, text string, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"


def _windows_hash(words: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words up to and with each of ``ends``."""
    total = np.full(len(ends), length, dtype=np.uint64)
    for k in range(length):
        total = (total ^ words[ends - k]) * _TIMES[k % 64] + (total >> np.uint64(29))
    return mixed(total)


def _blocks_hash(words: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    if size == 1:
        return mixed(words[ends] * _TIMES[0])
    return mixed(words[ends] * _TIMES[0] + words[ends - 1] * _TIMES[1])


class SameLength:
    """The tables for all windows of one length."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, owners: np.ndarray, length: int):
        self.length, self.block = length, min(2, length)
        keys = _windows_hash(words, ends, length)
        suffix = _blocks_hash(words, ends, self.block)
        # Buckets by suffix, inside a bucket by the hash of the window; one entry per window, with all its items.
        order = np.lexsort((owners, keys, suffix))
        keys, suffix, owners, ends = keys[order], suffix[order], owners[order], ends[order]
        head = np.ones(len(keys), dtype=bool)
        head[1:] = (keys[1:] != keys[:-1]) | (suffix[1:] != suffix[:-1])
        at = np.flatnonzero(head)
        self.owners, self.owned = owners, np.append(at, len(keys))
        self.example = ends[at]
        self.key = keys[at]
        self.suffix, first = np.unique(suffix[at], return_index=True)
        self.bucket = np.append(first, len(at))
        bits = max(12, math.ceil(math.log2(4 * len(at) * (length - self.block + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.int64)
        for back in range(length - self.block, -1, -1):  # nearer ends overwrite farther ones: the smallest jump stays
            self.shift[(_blocks_hash(words, self.example - back, self.block) & self.mask).astype(np.int64)] = back

    def stops(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places where a window may end: those that no jump passes over."""
        first, last = bounds[:-1] + self.length - 1, bounds[1:]
        fits = first < last
        first, last = first[fits], last[fits]
        parts = (last - first + STRETCH - 1) // STRETCH
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cursor = np.repeat(first, parts) + nth * STRETCH
        end = np.minimum(cursor + STRETCH, np.repeat(last, parts))
        found = []
        while len(cursor):
            jump = self.shift[(_blocks_hash(words, cursor, self.block) & self.mask).astype(np.int64)]
            found.append(cursor[jump == 0])
            cursor = cursor + np.maximum(jump, 1)
            inside = cursor < end
            cursor, end = cursor[inside], end[inside]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def entries(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, entry) of the stops whose bucket holds a window of that hash."""
        suffix = _blocks_hash(words, ends, self.block)
        nth = np.minimum(np.searchsorted(self.suffix, suffix), len(self.suffix) - 1)
        known = self.suffix[nth] == suffix
        ends, nth = ends[known], nth[known]
        keys = _windows_hash(words, ends, self.length)
        low, high = self.bucket[nth], self.bucket[nth + 1]
        top = high.copy()
        while (open_ := low < high).any():  # binary search inside each stop's own bucket
            middle = (low + high) // 2
            less = open_ & (self.key[np.minimum(middle, len(self.key) - 1)] < keys)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        low_in = np.minimum(low, len(self.key) - 1)
        hit = (low < top) & (self.key[low_in] == keys)
        return ends[hit], low_in[hit]


class Windows:
    """All windows of some pieces of items, by length."""

    def __init__(self, items: list[str], texts: list[str], window: int):
        data, offsets = bytes_of(pa.array(texts, pa.large_string()))
        self.items, self.low = items, data.tobytes().translate(_SMALL)
        words, bounds, self.first, self.last = word_hashes(data, offsets, spans=True, space=_APART)
        count = np.diff(bounds)
        self.classes: list[SameLength] = []
        for length in np.unique(np.minimum(count, window)).tolist():
            if not length:
                continue
            has = np.flatnonzero((count == length) | ((count > window) & (length == window)))
            each = count[has] - length + 1
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            ends = np.repeat(bounds[has], each) + within + length - 1
            self.classes.append(SameLength(words, ends, np.repeat(has, each), length))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """(words, word ranges that occurrences cover, items) of each text of a run of texts."""
        words, bounds, first, last = word_hashes(data, offsets, spans=True, space=_APART)
        low = data[int(offsets[0]) : int(offsets[-1])].tobytes().translate(_SMALL)
        covers: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for same in self.classes:
            ends, entries = same.entries(words, same.stops(words, bounds))
            texts = np.searchsorted(bounds, ends, side="right") - 1
            for end, entry, text in zip(ends.tolist(), entries.tolist(), texts.tolist(), strict=True):
                own = int(same.example[entry])
                if any(
                    low[first[end - k] : last[end - k]] != self.low[self.first[own - k] : self.last[own - k]] for k in range(same.length)
                ):
                    continue
                covers.setdefault(text, []).append((end - same.length + 1 - int(bounds[text]), end + 1 - int(bounds[text])))
                owners = same.owners[same.owned[entry] : same.owned[entry + 1]]
                items.setdefault(text, set()).update(self.items[i] for i in owners.tolist())
        for text in range(len(bounds) - 1):
            yield int(bounds[text + 1] - bounds[text]), covers.get(text, []), items.get(text, set())


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges put together, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def item_pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, piece): the words of an item joined by blanks, long items in overlapping pieces that keep every window."""
    words = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _words(F.col(text_col).cast("string")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WORDS))
    parts = words.where(F.size("words") > 0).select("item", "words", F.explode(starts).alias("at"))
    return parts.select("item", F.array_join(F.slice("words", F.col("at") + 1, PIECE_WORDS + window - 1), " ").alias("piece"))


def _searched(documents: DataFrame, rows: list, window: int, keep_text: bool) -> DataFrame:
    """One pass over the documents with one table of windows, added to what earlier passes found."""
    items, texts = [r.item for r in rows], [r.piece for r in rows]
    schema = FOUND if keep_text else FOUND.replace("text string, ", "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {
        "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string()),
        "n_words": pa.int64(), "n_hit": pa.int64(),
    }
    sent = documents.sparkSession.sparkContext.broadcast((items, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Windows(*sent.value, window)
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            count, hit, spans, owners = [], [], [], []
            for a, b in blocks(offsets):
                for (n, covers, ids), (old, had) in zip(table.search(data, offsets[a : b + 1]), before, strict=False):
                    ranges = joined(covers + [(s["start"], s["end"]) for s in old or ()])
                    count.append(n)
                    hit.append(sum(end - start for start, end in ranges))
                    spans.append([{"start": s, "end": e} for s, e in ranges])
                    owners.append(sorted(ids.union(had or ())))
            made = {"n_words": count, "n_hit": hit, "spans": spans, "items": owners}
            columns = [pa.array(made[n], kinds[n]) if n in made else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.mapInArrow(run, schema)


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) per row: its words, those inside an occurrence of a window of some item,
    the word ranges that occurrences cover (end exclusive), and the items with such windows, sorted as strings.

    A-Z count as a-z; words are runs of digits, letters and non-ASCII characters. An item of fewer words than
    ``window`` is one window, one without words none. A null or empty text has no words and no hits. Rows are judged
    one by one, so repeated rows give repeated results; rows of one item_id are one item, and a null item_id is the
    item of the empty name. Extra columns are not read. An empty benchmark gives no hits, no documents give no rows.
    """
    pieces = written(item_pieces(benchmark, window, item_col, item_text_col), "benchmark-pieces")
    total = pieces.agg(F.sum(F.length("piece") + F.length("item"))).first()[0] or 0
    tables = max(1, math.ceil(total / TABLE_BYTES))
    dealt = pieces.withColumn("t", F.pmod(F.xxhash64("item", "piece"), F.lit(tables)))
    found = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"),
    )
    for t in range(tables):
        if t and t % TABLES_PER_STAGE == 0:
            found = written(found, "benchmark-hits")
        found = _searched(found, dealt.where(F.col("t") == t).select("item", "piece").collect(), window, keep_text=t + 1 < tables)
    return found


def digest(found: DataFrame) -> DataFrame:
    """The hits of each document as counts and a hash of its items."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
