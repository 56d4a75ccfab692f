"""Words and word shingles of many texts at once, as 64-bit hashes computed on the UTF-8 bytes of Arrow columns.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count
as a-z. A word's hash is a polynomial of its bytes modulo 2**64, read off running sums, and mixed; no Python
object is made per word. Whole texts are hashed: work goes in blocks of texts, never in parts of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SEEDS = np.random.default_rng(20240501).integers(1, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    filled = 1
    while filled < n:  # out[i + filled] = out[i] * base**filled
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out


_UP = _powers(_BASE, BLOCK_BYTES * 2)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK_BYTES * 2)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_BYTES; a longer text is a block of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, spans: bool = False, space: np.ndarray = _SPACE) -> tuple[np.ndarray, ...]:
    """(hashes, bounds): hashes of all words in order; text i has those from bounds[i] to bounds[i + 1].

    With ``spans`` also where each word begins and ends, counted from the first text's first byte. ``space`` marks
    the bytes that part words.
    """
    start, stop = int(offsets[0]), int(offsets[-1])
    raw = data[start:stop]
    n = len(raw)
    edges = offsets - start
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return (np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64), *([none, none] if spans else []))
    inside = ~space[raw]
    begins = np.empty(n, dtype=bool)
    begins[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=begins[1:])
    heads = edges[:-1][edges[:-1] < n]
    begins[heads] = inside[heads]
    ends = np.empty(n, dtype=bool)
    ends[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=ends[:-1])
    tails = edges[1:][edges[1:] > 0] - 1
    ends[tails] = inside[tails]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = (_UP[:n], _DOWN) if n <= len(_UP) else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LOWER[raw] * up, out=sums[1:])
    hashes = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _SEEDS[0])
    return (hashes, np.searchsorted(first, edges), *([first, last] if spans else []))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle, none are none."""
    for a, b in blocks(offsets):
        words, bounds = word_hashes(data, offsets[a : b + 1])
        total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for k in range(size):
            total += words[k : k + len(total)] * _SEEDS[1 + k]
        total = mixed(total)
        for i in range(b - a):
            low, high = bounds[i], bounds[i + 1]
            n = high - low
            if n >= size:
                yield np.unique(total[low : high - size + 1])
            elif n:
                yield mixed(np.sum(words[low:high] * _SEEDS[1 : 1 + n], keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, dtype=np.uint64)
