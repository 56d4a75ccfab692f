import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401

from tallyward.llm import phrases
from tallyward.llm.words import bytes_of

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL))]


def brute(documents, longest=3, least=10, percent=50, top=2000):
    out = []
    for lang in {d[2] or "und" for d in documents}:
        f = Counter()
        for d in documents:
            if (d[2] or "und") == lang:
                for w in pieces(d[1]):
                    f.update(tuple(w[p : p + k]) for k in range(1, longest + 1) for p in range(len(w) - k + 1))
        n = sum(c for phrase, c in f.items() if len(phrase) == 1)
        good = [p for p, a in f.items() if len(p) > 1 and a >= least]
        held = Counter()
        for p in good:
            for size in range(2, len(p)):
                for at in range(len(p) - size + 1):
                    held[p[at : at + size]] = max(held[p[at : at + size]], f[p])
        best = []
        for p in good:
            a = f[p]
            if p in held and 100 * held[p] >= percent * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        best.sort()
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(best[:top])]
    return sorted(out)


def mined(docs, **options):
    got = phrases.mined(docs, **options)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows(got))


def corpus(rng, n):
    words = ["The", "of", "é", "new", "York", "x.y", "city,", "a", "\x00", "ß😀", "l" * 70, "l" * 71 + "."]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randrange(40)))
        texts.append(document(i, text + rng.choice([" New York city hall\tdoor", " a\nb\rc\x0bd", ""]), lang=rng.choice(["en", "en", "de", None])))
    return texts


@pytest.mark.parametrize(("longest", "ranked"), [(3, 1 << 20), (3, 6), (4, 14), (2, 0), (5, 1 << 20)])
def test_against_brute_force(spark, frame, rng, monkeypatch, longest, ranked):
    """Also where only some words and phrases, or none, have ranks."""
    monkeypatch.setattr(phrases, "MOST_RANKED", ranked)
    documents = corpus(rng, 150)
    assert mined(frame(documents), longest=longest) == brute(documents, longest)


def test_limits(frame, rng):
    documents = corpus(rng, 80)
    options = {"least": 3, "percent": 90, "top": 7}
    assert mined(frame(documents), **options) == brute(documents, **options)


def test_a_collision_leads_to_another_hash(frame, rng, monkeypatch):
    documents, plain = corpus(rng, 60), phrases.word_counts
    asked = []

    def colliding(rows_, attempt=0):
        asked.append(attempt)
        counts = plain(rows_, attempt)
        return counts if attempt else counts.withColumn("h", counts.h % 2)

    monkeypatch.setattr(phrases, "word_counts", colliding)
    assert mined(frame(documents)) == brute(documents)
    assert asked == [0, 1]


def test_tiles_count_exactly():
    gen = np.random.default_rng(3)
    left = np.minimum(gen.geometric(0.004, 60_000), 5000).astype(np.int64)
    right = np.minimum(gen.geometric(0.002, 60_000), 9000).astype(np.int64)
    wanted = Counter(zip(left.tolist(), right.tolist(), strict=True))
    for crowded in (1, 200, 10**9):  # every tile dense, some, none
        a, b, n = phrases.tile_counts(left, right, crowded)
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == wanted
    assert len(phrases.tile_counts(left[:0], right[:0])[0]) == 0


def test_ranks_fall_with_frequency_inside_a_language():
    ranks = phrases.Ranks()
    keys, langs, counts = np.arange(700) * 3, np.arange(700) % 2, np.arange(700) + 10
    ranks.add(keys, langs, counts, True)
    numbers = ranks.find(1, keys)
    for lang in (0, 1):
        own = numbers[langs == lang]
        assert own.tolist() == sorted(own, reverse=True)
    assert not set((numbers[langs == 0] // phrases.TILE).tolist()) & set((numbers[langs == 1] // phrases.TILE).tolist())
    assert ranks.find(1, np.array([1])).tolist() == [phrases.DEAD]
    pairs = [keys[:50], keys[2:52]]
    ranks.add(ranks.keyed(pairs), langs[:50], counts[:50], False)
    found = ranks.find(2, ranks.keyed(pairs))
    assert [c.tolist() for c in ranks.spelled(2, found)] == [c.tolist() for c in pairs]
    assert ranks.find(2, np.array([7 << 32])).tolist() == [phrases.OPEN]


def test_long_words_that_defeat_the_running_hash():
    """Two words whose polynomial hashes modulo 2**64 agree whatever the base."""
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word
    data, offsets = bytes_of(pa.array([f"{word} {other}"]))
    assert len(set(phrases.Words(data, offsets, ["en"], 0).hash.tolist())) == 2


def test_odd_rows(frame, odd_rows):
    """Nulls, blank and very long texts, repeated rows, clashing columns, no rows."""
    documents = odd_rows * 6
    extra = frame(documents)
    for name in ("phrase", "h", "n", "a", "h1", "a.b"):
        extra = extra.selectExpr("*", f"'mine' as `{name}`")
    assert mined(extra) == brute(documents)
    assert mined(frame(documents).limit(0)) == []
    assert mined(frame([document(1, None), document(2, "one two"), document(3, " ", None)])) == []
    rank = random.Random(2)
    ties = [document(i, f"{rank.choice('ab')} {rank.choice('cd')}") for i in range(60)]
    assert mined(frame(ties)) == brute(ties)
