"""Byte-level BPE encoding and decoding of whole corpora by a global shuffle of distinct words.

Method: texts are cut into pre-tokens with their positions; every distinct pre-token of the corpus is encoded once,
its ids are joined back and documents are reassembled by position. Decoding joins the table of token bytes.

A corpus has far more pre-tokens than would be shuffled row by row, so they travel packed. Tasks cut texts into
blocks of bounded size. A block keeps its documents as positions in its own list of distinct words, and sends that
list out by hash bucket, one row per (block, bucket). A bucket meets each word once per block at most, however
often it occurs, encodes its distinct words and answers every block with one row. Blocks and answers are joined by
block. The table of token bytes is bounded by the vocabulary and is held by every task.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.vocabulary import encoding, ranks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 4_000_000
BUCKETS_PER_PARTITION = 2
DOCUMENTS = -1  # the bucket of a block's own row

_PACKED = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))]
)
_PACKED_SQL = "block long, bucket int, body binary, doc_ids array<long>, counts array<int>"
_PATTERN = regex.compile(public_tokenizers.PATTERN)
# Over these characters the classes of both engines agree, and the standard one is nearly twice as fast.
_COMMON = re.compile(r"[\t\n\r -~À-ÖØ-öø-ʯ]*")
_COMMON_PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")

_ANSWER_SQL = "block long, bucket int, body binary"
_CODES_SQL = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Small whole numbers in little room: those below 255 take a byte, the others one and then four bytes apart."""
    small = np.minimum(numbers, 255).astype(np.uint8)
    middle = numbers[(numbers >= 255)] - 255
    short = np.minimum(middle, 65535).astype("<u2")
    rest = (middle[middle >= 65535] - 65535).astype("<u4")
    head = np.array([len(small), len(short), len(rest)], dtype="<i8").tobytes()
    parts = [small.tobytes(), (short & 255).astype(np.uint8).tobytes(), (short >> 8).astype(np.uint8).tobytes(), rest.tobytes()]
    return _squeeze(head + b"".join(parts))


def unpacked_numbers(data: bytes) -> np.ndarray:
    raw = _expand(data)
    n, n_short, n_rest = np.frombuffer(raw, dtype="<i8", count=3)
    at = 24
    numbers = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    low = np.frombuffer(raw, np.uint8, n_short, at + n).astype(np.int64)
    high = np.frombuffer(raw, np.uint8, n_short, at + n + n_short).astype(np.int64)
    short = low | high << 8
    short[short == 65535] += np.frombuffer(raw, "<u4", n_rest, at + n + 2 * n_short)
    numbers[numbers == 255] += short
    return numbers


def _joined(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    sizes = packed_numbers(lengths)
    return len(sizes).to_bytes(4, "little") + sizes + _squeeze(b"".join(words))


def _split(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpacked_numbers(data[4 : 4 + size])).tolist()
    raw, out, start = _expand(data[4 + size :]), [], 0
    for end in ends:
        out.append(raw[start:end])
        start = end
    return out


def pre_tokens(text: str) -> list[str]:
    """All matches of the tokenizers' pattern, in order."""
    return (_COMMON_PATTERN if _COMMON.fullmatch(text) else _PATTERN).findall(text)


def block_rows(block: int, doc_ids: list, texts: list[str], buckets: int) -> list[tuple]:
    """The rows of one block: its documents as word places, and its distinct words by bucket, frequent ones first.

    The word at place p of bucket b has number p * buckets + b, so frequent words have small numbers.
    """
    words: list[str] = []
    counts = []
    for text in texts:
        found = pre_tokens(text)
        counts.append(len(found))
        words += found
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    codes = coded.indices.to_numpy()
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    often = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    number = np.zeros(len(distinct), dtype=np.int64)
    lists: list[list[bytes]] = [[] for _ in range(buckets)]
    for i in often.tolist():
        word = distinct[i]
        bucket = zlib.crc32(word) % buckets
        number[i] = len(lists[bucket]) * buckets + bucket
        lists[bucket].append(word)
    rows = [(block, DOCUMENTS, packed_numbers(number[codes]), doc_ids, counts)]
    return rows + [(block, b, _joined(ws), None, None) for b, ws in enumerate(lists) if ws]


def _cut(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        doc_ids, texts, chars = [], [], 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*block_rows(block, doc_ids, texts, buckets), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(doc.as_py())
                texts.append(text.as_py() or "")
                chars += len(texts[-1]) + 16
                if chars >= BLOCK_CHARS:
                    yield flush()
                    block, doc_ids, texts, chars = block + 1, [], [], 0
        if texts:
            yield flush()

    return rows.mapInArrow(run, _PACKED_SQL)


def _lists(packed: DataFrame) -> DataFrame:
    """The word lists among the packed rows. Not a filter: that would move below the shuffle and end its reuse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1, 2]).filter(pc.not_equal(batch.column(1), DOCUMENTS))

    return packed.mapInArrow(run, _ANSWER_SQL)


def _answers(lists: DataFrame, vocabulary: str) -> DataFrame:
    """(block, bucket, body): for each list of words their numbers of ids, and the ids."""

    def answer(table: pa.Table) -> pa.Table:
        core = encoding(vocabulary)
        known: dict[bytes, list[int]] = {}
        bodies = []
        for body in table["body"]:
            found = []
            for word in _split(body.as_py()):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = core.encode_ordinary(word.decode())
                found.append(ids)
            sizes = packed_numbers(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            flat = np.fromiter((i for ids in found for i in ids), dtype="<u4")
            bodies.append(len(sizes).to_bytes(4, "little") + sizes + packed_numbers(flat.astype(np.int64)))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "body": pa.array(bodies, pa.binary())})

    return lists.groupBy("bucket").applyInArrow(answer, _ANSWER_SQL)


def _read_answer(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(body[:4], "little")
    return unpacked_numbers(body[4 : 4 + size]), unpacked_numbers(body[4 + size :])


def _reassembled(blocks: DataFrame, answers: DataFrame, vocabulary: str, buckets: int, keep_ids: bool) -> DataFrame:
    def put_together(key, own: pa.Table, replies: pa.Table) -> pa.Table:
        table = token_bytes(vocabulary)
        said: dict[int, str] = {}
        meant: dict[int, bytes] = {}
        size: dict[int, int] = {}
        ids_of: dict[int, np.ndarray] = {}
        for bucket, body in zip(replies["bucket"].to_pylist(), replies["body"], strict=True):
            sizes, flat = _read_answer(body.as_py())
            ids, at, number = flat.tolist(), 0, bucket
            for n in sizes.tolist():
                part = ids[at : at + n]
                said[number] = ",".join(map(str, part))
                meant[number] = b"".join([table[i] for i in part])
                size[number] = n
                if keep_ids:
                    ids_of[number] = flat[at : at + n].astype("<u4").tobytes()
                at += n
                number += buckets
        out: list[list] = [[], [], [], [], []]
        for row in own.filter(pc.equal(own["bucket"], DOCUMENTS)).to_pylist():
            numbers, at = unpacked_numbers(row["body"]).tolist(), 0
            for doc, n in zip(row["doc_ids"], row["counts"], strict=True):
                part = numbers[at : at + n]
                at += n
                values = (
                    doc,
                    sum([size[p] for p in part]),
                    b"".join([ids_of[p] for p in part]) if keep_ids else None,
                    hashlib.sha256(",".join([said[p] for p in part]).encode()).hexdigest(),
                    hashlib.sha256(b"".join([meant[p] for p in part])).hexdigest(),
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
        names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, out, types, strict=True)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put_together, _CODES_SQL)


_TABLES: dict[str, list[bytes]] = {}


def token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of every token by id; ids without a token have none."""
    if vocabulary not in _TABLES:
        by_bytes = ranks(vocabulary)
        table = [b""] * (max(by_bytes.values()) + 1)
        for token, i in by_bytes.items():
            table[i] = token
        _TABLES[vocabulary] = table
    return _TABLES[vocabulary]


def encode(
    documents: DataFrame, vocabulary: str = VOCABULARY, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) per row.

    ``ids`` are unsigned 32-bit little-endian numbers (null without ``keep_ids``); the hashes are of the decimal ids
    joined by commas, and of the decoded bytes. A null text is an empty one: no ids. Rows are taken as they are,
    repeated rows and null ids too. An empty table gives no rows.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_PARTITION * parts
    # One shuffle by block feeds both readers: the buckets, and the documents that wait for their answers.
    packed = _cut(rows, buckets).repartition(parts, "block")
    return _reassembled(packed, _answers(_lists(packed), vocabulary), vocabulary, buckets, keep_ids)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) rows: ids are looked up in the table of token bytes, which every task holds.

    Bytes that are no UTF-8 become U+FFFD; null ids give a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                if ids.as_py() is None:
                    texts.append(None)
                    continue
                numbers = np.frombuffer(ids.as_py(), dtype="<u4").tolist()
                texts.append(b"".join([table[i] for i in numbers]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
