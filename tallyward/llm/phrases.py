"""Phrases whose words stand together more often than their counts explain, per language.

Counting goes by direct-address tiles. Words are numbered by falling frequency inside their language, so that the
number of a pair falls into a tile of ``TILE`` x ``TILE`` neighbouring ranks. A chunk of pairs counts each crowded
tile as one dense array (``numpy.bincount``) and all others as sorted coordinates with their run lengths. Frequent
pairs are ranked in turn, and (pair, next word) is counted in the same way; so on for longer phrases.

Spark adds up the chunks' counts by key with partial sums, so a hot pair is one row per task. Ranks only speed up
counting: rows leave a task under 63-bit hashes of (language, word), which are checked to be free of collisions over
the whole corpus (a collision leads to another hash). At most ``MOST_RANKED`` words, and as many phrases of each
length, have ranks and are sent to the tasks; what is beyond that is counted as sorted coordinates under its hashes.
Words and phrases below the least count are left out early only where it is certain that they are below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.words import blocks, bytes_of, mixed, word_hashes
from tallyward.session import written

LONGEST = 3
LEAST = 10
TOP = 2000
PERCENT = 50

BITS = 9
TILE = 1 << BITS
CROWDED = TILE * TILE // 8
CHUNK = 1 << 20
ROWS_OUT = 1 << 18
MOST_RANKED = 1 << 20
LONG_WORD = 64

DEAD, OPEN = -1, -2

_ENDS = np.zeros(256, dtype=np.int64)
_ENDS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 1
_APART = _ENDS > 0
_APART[[9, 32]] = True
_SMALL = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _keyed(value: bytes, key: int) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")


class Words:
    """The words of a run of texts: 63-bit hashes of (language, word), and a number per piece of text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], attempt: int):
        hashes, bounds, first, last = word_hashes(data, offsets, spans=True, space=_APART)
        raw = data[int(offsets[0]) : int(offsets[-1])]
        self.low, self.first, self.last = raw.tobytes().translate(_SMALL), first, last
        odd = np.flatnonzero(last - first > LONG_WORD) if not attempt else np.arange(len(first))
        for i in odd.tolist():  # the running hash is weak on long words; on a second attempt no word uses it
            hashes[i] = _keyed(self.low[first[i] : last[i]], attempt)
        names = {lang: _keyed(lang.encode(), attempt + 1) for lang in set(langs)}
        self.text = np.repeat(np.arange(len(langs)), np.diff(bounds))
        salt = np.array([names[lang] for lang in langs], dtype=np.uint64)
        self.hash = (mixed(hashes ^ salt[self.text]) >> np.uint64(1)).astype(np.int64)
        self.piece = np.cumsum(_ENDS[raw])[first] + self.text if len(first) else first

    def word(self, i: int) -> bytes:
        return self.low[self.first[i] : self.last[i]]


def _read(batches: Iterator[pa.RecordBatch], attempt: int) -> Iterator[tuple[Words, list[str]]]:
    for batch in batches:
        data, offsets = bytes_of(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for a, b in blocks(offsets):
            yield Words(data, offsets[a : b + 1], langs[a:b], attempt), langs[a:b]


def word_counts(documents: DataFrame, attempt: int = 0) -> DataFrame:
    """(lang, word, h, n) of every distinct word of (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _read(batches, attempt):
            h, at, n = np.unique(words.hash, return_index=True, return_counts=True)
            columns = [
                pa.array([langs[t] for t in words.text[at].tolist()], pa.string()),
                pa.array([words.word(i) for i in at.tolist()], pa.binary()).cast(pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])

    return documents.mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def tile_counts(left: np.ndarray, right: np.ndarray, crowded: int = CROWDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of the distinct pairs of two columns of small numbers."""
    if not len(left):
        return left, right, left
    across = int(right.max() >> BITS) + 1
    tile = (left >> BITS) * across + (right >> BITS)
    dense = np.flatnonzero(np.bincount(tile) >= crowded)
    spot = np.minimum(np.searchsorted(dense, tile), max(len(dense) - 1, 0))
    inside = dense[spot] == tile if len(dense) else np.zeros(len(tile), dtype=bool)
    out = []
    order = np.argsort(spot[inside].astype(np.uint16), kind="stable")
    cells = (((left[inside] & (TILE - 1)) << BITS) | (right[inside] & (TILE - 1)))[order]
    at = 0
    for t, size in zip(dense.tolist(), np.bincount(spot[inside], minlength=len(dense)).tolist(), strict=True):
        counts = np.bincount(cells[at : at + size], minlength=TILE * TILE)
        at += size
        cell = np.flatnonzero(counts)
        out.append(((t // across << BITS) + (cell >> BITS), (t % across << BITS) + (cell & (TILE - 1)), counts[cell]))
    keys = np.sort((left[~inside] << 32) | right[~inside])
    if len(keys):
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        out.append((keys[head] >> 32, keys[head] & 0xFFFFFFFF, np.diff(np.append(head, len(keys)))))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _run_lengths(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns and their counts, as sorted coordinates."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    head = np.flatnonzero(np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])))
    return [c[head] for c in columns], np.diff(np.append(head, len(order)))


class Ranks:
    """Numbers of the frequent words and phrases: per length, sorted keys with their numbers.

    Numbers fall with frequency inside a language, and a language begins at a multiple of ``TILE``, so no tile mixes
    languages. A key is the hash of a word, or for longer phrases the number of all but the last word and the number
    of that word. ``complete`` says whether every frequent phrase of that length has a number.
    """

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.complete: list[bool] = []
        self.hashes = np.zeros(0, dtype=np.int64)  # of the word with that number
        self.first: list[np.ndarray] = []  # per length: number of the phrase -> its key
        self.lang: list[np.ndarray] = []  # per length: number of the phrase -> its language

    def __getstate__(self) -> dict:
        """Tasks do not need the languages of numbers."""
        return self.__dict__ | {"lang": []}

    def add(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, complete: bool) -> None:
        order = np.lexsort((keys, -counts, langs))
        keys, langs = keys[order], langs[order]
        starts = np.flatnonzero(np.append(True, langs[1:] != langs[:-1])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        room = (sizes + TILE - 1) // TILE * TILE
        numbers = np.repeat(np.cumsum(room) - room - starts, sizes) + np.arange(len(keys))
        top = int(room.sum())
        by_number, lang = np.full(top, -1, dtype=np.int64), np.full(top, -1, dtype=np.int64)
        by_number[numbers], lang[numbers] = keys, langs
        if not self.keys:
            self.hashes = by_number
        by_key = np.argsort(keys, kind="stable")
        self.keys.append(keys[by_key])
        self.numbers.append(numbers[by_key])
        self.first.append(by_number)
        self.lang.append(lang)
        self.complete.append(complete)

    def find(self, length: int, keys: np.ndarray) -> np.ndarray:
        """The numbers of some keys; DEAD where a phrase is surely below the least count, else OPEN."""
        known, missing = self.keys[length - 1], DEAD if self.complete[length - 1] else OPEN
        if not len(known):
            return np.full(len(keys), missing, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, self.numbers[length - 1][at], missing)

    def spelled(self, length: int, numbers: np.ndarray) -> list[np.ndarray]:
        """The word hashes of numbered phrases, one column per word."""
        out: list[np.ndarray] = []
        for k in range(length, 1, -1):
            keys = self.first[k - 1][numbers]
            out.insert(0, self.hashes[keys & 0xFFFFFFFF])
            numbers = keys >> 32
        return [self.hashes[numbers], *out]

    def keyed(self, words: list[np.ndarray]) -> np.ndarray:
        """The keys of phrases given by their word hashes; DEAD or OPEN where their front or last word has no number."""
        front = self.find(1, words[0])
        for k in range(2, len(words)):
            front = self.follow(k, front, self.find(1, words[k - 1]))
        return _paired(front, self.find(1, words[-1]))

    def follow(self, length: int, front: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The numbers of the phrases of ``length`` made of a numbered front and a last word."""
        keys = _paired(front, last)
        return np.where(keys >= 0, self.find(length, keys), keys)


def _paired(front: np.ndarray, last: np.ndarray) -> np.ndarray:
    key = (front << 32) | last
    return np.where((front == DEAD) | (last == DEAD), DEAD, np.where((front < 0) | (last < 0), OPEN, key))


def phrase_counts(documents: DataFrame, ranks: Ranks, length: int, least: int, attempt: int = 0) -> DataFrame:
    """(h1 ... h<length>, n) of the phrases of ``length`` words that occur ``least`` times; ``ranks`` knows shorter ones."""
    names = [f"h{k + 1}" for k in range(length)]
    sent = documents.sparkSession.sparkContext.broadcast(ranks)

    def told(columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), ROWS_OUT):
            part = slice(at, at + ROWS_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c[part], pa.int64()) for c in [*columns, n]], names=[*names, "n"])

    def counted(tiled: list[tuple[np.ndarray, np.ndarray]], loose: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        if tiled:
            front, last, n = tile_counts(*(np.concatenate(c) for c in zip(*tiled, strict=True)))
            yield from told([*known.spelled(length - 1, front), known.hashes[last]], n)
        if loose:
            yield from told(*_run_lengths([np.concatenate(c) for c in zip(*loose, strict=True)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        tiled, loose, held = [], [], 0
        for words, _ in _read(batches, attempt):
            n = len(words.hash) - length + 1
            if n <= 0:
                continue
            word = known.find(1, words.hash)
            front = word
            for k in range(2, length):
                front = known.follow(k, front[:-1], word[k - 1 :])
            # A phrase cannot be frequent unless both its front and its rest are.
            alive = (words.piece[:n] == words.piece[length - 1 :]) & (front[:n] != DEAD) & (front[1 : n + 1] != DEAD) & (word[length - 1 :] != DEAD)
            numbered = alive & (front[:n] >= 0) & (word[length - 1 :] >= 0)
            if numbered.any():
                tiled.append((front[:n][numbered], word[length - 1 :][numbered]))
            unknown = np.flatnonzero(alive & ~numbered)
            if len(unknown):
                loose.append([words.hash[unknown + k] for k in range(length)])
            held += int(alive.sum())
            if held >= CHUNK:
                yield from counted(tiled, loose)
                tiled, loose, held = [], [], 0
        yield from counted(tiled, loose)

    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    return documents.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _head(frequent: DataFrame, columns: list[str], most: int) -> tuple[list[np.ndarray], bool]:
    """The most frequent rows, ``most`` at the most, and whether these are all of them.

    A histogram of rounded counts gives the count from which they fit, so no task sends rows that are not wanted.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = {r.s: r.c for r in frequent.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()}
    fits, low = 0, None
    for s in sorted(steps, reverse=True):
        if fits + steps[s] > most:
            break
        fits, low = fits + steps[s], s
    complete = fits == sum(steps.values())
    wanted = frequent if complete else frequent.where(step >= low) if low is not None else frequent.limit(0)
    table = wanted.select(*columns).toArrow()
    return [table[c].to_numpy() for c in columns], complete


def _scored(level: dict[int, DataFrame], vocabulary: DataFrame, length: int) -> DataFrame:
    """(h1 ..., lang, phrase, a, l, r, score) of the candidates of one length."""
    names = [f"h{k + 1}" for k in range(length)]
    rows = level[length].withColumnRenamed("n", "a")
    for k, name in enumerate(names):
        named = vocabulary.select(F.col("h").alias(name), F.col("word").alias(f"w{k}"), F.col("n").alias(f"f{k}"), *(["lang"] if not k else []))
        rows = rows.join(named, name)
    for size in range(2, length):
        for at in {0, length - size}:
            keys = names[at : at + size]
            part = level[size].select(*[F.col(f"h{k + 1}").alias(key) for k, key in enumerate(keys)], F.col("n").alias(f"n{at}_{size}"))
            rows = rows.join(part, keys)

    def seen(at: int, size: int) -> Column:
        return F.col(f"f{at}" if size == 1 else f"n{at}_{size}")

    def big(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    cuts = []
    for k in range(1, length):
        left, right = seen(0, k), seen(k, length - k)
        # Up to 10^16 occurrences of a phrase the product fits the 38 digits of a decimal.
        score = F.expr("CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * 1000000BD")
        rows = rows.withColumn(f"top{k}", score).withColumn(f"low{k}", big(left) * big(right))
        cuts.append(F.struct(F.expr(f"top{k} div low{k}").cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    best = F.array_min(F.array(*cuts))
    phrase = F.concat_ws(" ", *[f"w{k}" for k in range(length)])
    return rows.select(*names, "lang", phrase.alias("phrase"), "a", best.alias("cut")).select(
        *names, "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def _standing(scored: DataFrame, level: dict[int, DataFrame], length: int, longest: int, percent: int) -> DataFrame:
    """Candidates of one length that no longer candidate holds in at least ``percent`` of their occurrences."""
    names = [f"h{k + 1}" for k in range(length)]
    inside = [
        level[longer].select(*[F.col(f"h{at + k + 1}").alias(name) for k, name in enumerate(names)], "n")
        for longer in range(length + 1, longest + 1)
        for at in range(longer - length + 1)
    ]
    if not inside:
        return scored
    held = reduce(DataFrame.unionByName, inside).groupBy(*names).agg(F.max("n").alias("held"))
    kept = scored.join(held, names, "left").where(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("a")))
    return kept.drop("held")


def mined(
    documents: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, top: int = TOP,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to ``longest`` words.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all words of the language;
    ``score`` is floor(10^6 a^2 / (l r)). Phrases lie inside pieces of text parted by ``.,;:!?`` or line ends; A-Z
    count as a-z. A phrase occurs at least ``least`` times and is left out where a longer one of these holds at least
    ``percent`` of its occurrences. Ties go to more occurrences, then to the smaller phrase in UTF-8 order.

    A null text is empty, a null language ``und``. Every row counts, repeated ones again. Extra columns are not read.
    Without frequent phrases, or without rows, there are no rows.
    """
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("text is not null")
    attempt = 0
    while True:
        counts = written(word_counts(rows, attempt), "words")
        if counts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            break
        attempt += 1
    vocabulary = counts.where(F.col("n") >= least)
    (h, n, langs), complete = _head(vocabulary, ["h", "n", "lang"], MOST_RANKED)
    ranks = Ranks()
    ranks.add(h, np.unique(langs.astype(str), return_inverse=True)[1], n, complete)
    level: dict[int, DataFrame] = {}
    for length in range(2, longest + 1):
        names = [f"h{k + 1}" for k in range(length)]
        level[length] = written(phrase_counts(rows, ranks, length, least, attempt), f"phrases-{length}")
        if length < longest:
            (*parts, n), complete = _head(level[length], [*names, "n"], MOST_RANKED)
            keys = ranks.keyed(parts)
            has = keys >= 0
            ranks.add(keys[has], ranks.lang[0][keys[has] & 0xFFFFFFFF], n[has], complete and bool(has.all()))
    standing = [
        _standing(_scored(level, vocabulary, m), level, m, longest, percent).select("lang", "phrase", "a", "l", "r", "score")
        for m in range(2, longest + 1)
    ]
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = reduce(DataFrame.unionByName, standing).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
