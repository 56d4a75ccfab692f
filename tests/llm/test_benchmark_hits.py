import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401

from tallyward.llm import benchmark_hits
from tallyward.llm.words import bytes_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def brute(texts, items, window=10):
    """(n_words, n_hit, items) of each text, window by window."""
    wanted = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), window)
        for p in range(len(w) - k + 1 if k else 0):
            wanted.setdefault(tuple(w[p : p + k]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(t) for t in wanted}:
            for p in range(len(w) - k + 1):
                if (names := wanted.get(tuple(w[p : p + k]))) is not None:
                    hit.update(range(p, p + k))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


def digests(expected):
    return [(n, hit, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), hit > 0) for n, hit, i in expected]


def found(frame):
    return [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(benchmark_hits.digest(frame))]


@pytest.mark.parametrize("bytes_held", [16 << 20, 400])
def test_against_brute_force(spark, frame, rng, monkeypatch, bytes_held):
    monkeypatch.setattr(benchmark_hits, "TABLE_BYTES", bytes_held)
    monkeypatch.setattr(benchmark_hits, "PIECE_WORDS", 7)
    few = ["a", "b", "c", "é", "dd", "e9"]
    items = [(i, prose(rng, n, few)) for i, n in enumerate([0, 1, 3, 9, 9, 10, 11, 12, 40, 40, 200])] + [(None, prose(rng, 12, few)), (3, "b b b A.A")]
    texts = [prose(rng, n, few) for n in (0, 1, 2, 9, 10, 11, 300, 900, 2000)]
    texts += [f"{prose(rng, 30)} {items[k][1].upper()}, {prose(rng, 30)}" for k in (5, 7, 10)] + [None, " \n", "…—“ü"]
    got = sorted(found(benchmark_hits.benchmark_hits(frame([document(i, t) for i, t in enumerate(texts)]), table(spark, items))))
    assert got == sorted(digests(brute(texts, items)))


def test_jumps_skip_no_window(rng):
    """The shift table on windows of every length, at words of a large and of a tiny alphabet."""
    for alphabet, window in ((3, 2), (3, 10), (50, 4), (5000, 10)):
        pick = random.Random(alphabet * window)
        text = [str(pick.randrange(alphabet)) for _ in range(3000)]
        items = [" ".join(text[at : at + 25]) for at in range(100, 2900, 400)]
        table_ = benchmark_hits.Windows([str(n) for n in range(len(items))], items, window)
        data, offsets = bytes_of(pa.array([" ".join(text)]))
        [(n, covers, held)] = table_.search(data, offsets)
        [(_, hit, wanted)] = brute([" ".join(text)], list(enumerate(items)), window)
        assert n == 3000 and held == set(wanted)
        assert sum(e - s for s, e in benchmark_hits.joined(covers)) == hit
    large = benchmark_hits.Windows(["0"], [" ".join(f"w{n}" for n in range(500))], 10).classes[0]
    other = np.random.default_rng(1).integers(1, 1 << 63, 20_000, dtype=np.uint64)
    assert len(large.stops(other, np.array([0, 20_000]))) < 2_000  # most places are never looked at


def test_odd_rows(spark, frame, odd_rows):
    """Nulls, long texts and repeated rows are judged row by row; clashing extra columns are not read."""
    items = [(0, "one"), (1, None), (2, " . "), (3, "x" * 60_000), (4, "ß😀é ß😀é ß😀é"), (4, "one"), (5, odd_rows[5][1])]
    extra = frame(odd_rows)
    for name in ("n_words", "n_hit", "spans", "items", "item", "a.b"):
        extra = extra.selectExpr("*", f"'mine' as `{name}`")
    got = benchmark_hits.benchmark_hits(extra, table(spark, items).selectExpr("*", "1 as piece", "2 as words"))
    assert got.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    assert sorted(found(got)) == sorted(digests(brute([r[1] for r in odd_rows], items)))
    assert {r["doc_id"]: r["items"] for r in rows(got)}[4] == ["0", "4"]
    none = benchmark_hits.digest(benchmark_hits.benchmark_hits(frame(odd_rows).limit(0), table(spark, items)))
    assert none.count() == 0
    empty = found(benchmark_hits.benchmark_hits(frame(odd_rows), table(spark, items).limit(0)))
    assert sorted(empty) == sorted(digests(brute([r[1] for r in odd_rows], [])))


def test_long_repetition_stays_linear(spark):
    """A text of one repeated word, where every place is an occurrence."""
    took = []
    for n in (20_000, 80_000):
        data, offsets = bytes_of(pa.array(["a " * n]))
        start = time.perf_counter()
        [(count, covers, _)] = benchmark_hits.Windows(["0"], ["a " * 40], 10).search(data, offsets)
        took.append(time.perf_counter() - start)
        assert count == n and benchmark_hits.joined(covers) == [(0, n)]
    assert took[1] < 16 * took[0] + 0.5
