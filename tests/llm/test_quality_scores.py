import zlib

import numpy as np
import pytest
from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401
from pyspark.sql import functions as F

from tallyward.llm import quality
from tallyward.llm import words as words_module


def sample(rng, n):
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(5, 80))]
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w + rng.choice(["###", "***"]) for w in words]
        docs.append(document(i, " ".join(words)))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark, frame, rng):
    docs, labels = sample(rng, 600)
    marked = quality.training_labels(spark.createDataFrame(labels, "doc_id long, quality int"))
    outside = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r["doc_id"] for r in rows(marked)} == outside
    scored = rows(quality.score(frame(docs), quality.fit(frame(docs), marked)))
    right = [(r["score"] >= 0.5) == bool(dict(labels)[r["doc_id"]]) for r in scored if r["doc_id"] not in outside]
    assert len(right) > 150 and sum(right) / len(right) > 0.98
    again = rows(quality.score(frame(docs, 5), quality.fit(frame(docs, 5), marked)))
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in scored}


def test_dual_coordinate_descent_reaches_the_optimum():
    """The multipliers' solution meets the primal value within a small gap."""
    gen = np.random.default_rng(2)
    places = [np.sort(gen.choice(40, 6, replace=False)) for _ in range(80)]
    values = [np.full(6, 6**-0.5) for _ in places]
    signs = np.where([p[0] < 4 for p in places], 1.0, -1.0)
    cost = np.full(80, 1.0)
    w, bias = quality.dual_coordinate_descent(places, values, signs, cost, 400)

    def value(w, bias):
        slack = [max(0.0, 1 - y * (w[p] @ x + bias)) for p, x, y in zip(places, values, signs, strict=True)]
        return (w @ w + bias * bias) / 2 + sum(slack)

    best = value(w, bias)
    for _ in range(300):
        step = np.zeros_like(w)
        step[:40] = gen.normal(scale=0.02, size=40)
        assert value(w + step, bias + gen.normal(scale=0.02)) >= best - 1e-3


def test_indicators_are_distinct_and_in_range(rng):
    import pyarrow as pa

    from tallyward.llm.words import bytes_of

    texts = ["", "a", "a a a a", prose(rng, 5000), "x" * 3_000_000, None, "b c"]
    found = list(quality.indicators(*bytes_of(pa.array(texts))))
    assert [len(f) for f in found][:2] == [0, 2] and len(found) == len(texts) and len(found[5]) == 0
    for f in found:
        assert len(set(f.tolist())) == len(f) and (not len(f) or (f.min() >= 0 and f.max() < 1 << quality.BITS))
    alone = [next(quality.indicators(*bytes_of(pa.array([t])))) for t in texts]
    assert all(a.tolist() == b.tolist() for a, b in zip(alone, found, strict=True))


@pytest.mark.parametrize(("labels", "low", "high"), [([], 0.5, 0.5), ([(5, 1), (6, 1), (8, 1)], 0.6, 1.0), ([(5, 0), (5, 1), (None, 1), (6, None), (7, 3)], 0.5, 0.5)])
def test_odd_rows(spark, frame, odd_rows, labels, low, high):
    source = frame(odd_rows).withColumn("label", F.lit("x")).withColumn("score", F.lit(1))
    marked = quality.training_labels(spark.createDataFrame(labels, "doc_id long, quality int"))
    model = quality.fit(source, marked)
    got = rows(quality.score(source, model))
    assert len(got) == len(odd_rows) and all(low <= r["score"] <= high for r in got)
    assert quality.accepted(source, model).count() == len(odd_rows) and quality.accepted(source, model).columns == source.columns
    assert quality.score(frame([]), quality.fit(frame([]), marked)).count() == 0


M = (1 << 64) - 1


def spread(h):
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & M
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & M
    return h ^ (h >> 33)


def plain_places(text):
    """The table places of a text's n-grams by their definition, word by word in whole numbers."""
    odd = [int(x) for x in quality._ODD]
    seed = int(words_module._SEEDS[0])

    def kind(b):
        return 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 8

    hashes, shapes = [], []
    for word in text.encode().split():
        value = sum((b + 32 if 65 <= b <= 90 else b) * pow(words_module._BASE, i, 1 << 64) + pow(words_module._BASE, i, 1 << 64) for i, b in enumerate(word))
        h = spread((value + len(word) * seed) & M)
        classes = 0
        for b in word:
            classes |= kind(b) & 7
        last, before = word[-1], word[-2] if len(word) > 1 else 0
        closing = last if kind(last) == 8 else 0
        second = before if len(word) > 1 and kind(last) == 8 and kind(before) == 8 else 0
        code = kind(word[0]) | classes << 4 | closing << 8 | second << 16 | min(len(word), 4) << 24
        again = int(bool(hashes) and hashes[-1] == h)
        hashes.append(h)
        shapes.append(spread(((code | again << 32) * odd[0] + 1) & M))
    grams = [h * odd[1] for h in hashes] + [a * odd[2] + b * odd[3] for a, b in zip(hashes, hashes[1:], strict=False)]
    grams += [s * odd[4] for s in shapes] + [a * odd[5] + b * odd[6] for a, b in zip(shapes, shapes[1:], strict=False)]
    grams += [a * odd[6] + b * odd[7] + c * odd[1] for a, b, c in zip(shapes, shapes[1:], shapes[2:], strict=False)]
    return sorted({spread(g & M) >> (64 - quality.BITS) for g in grams})


def test_scores_by_definition(spark, frame, rng):
    """Scales, margins and scores recomputed from texts, labels and the fitted weights by other code."""
    docs, labels = sample(rng, 240)
    docs += [document(900, ""), document(901, None), document(902, "Éa! a a A?! 12 x")]
    marked = quality.training_labels(spark.createDataFrame(labels, "doc_id long, quality int"))
    model = quality.fit(frame(docs), marked)
    text = {d[0]: d[1] or "" for d in docs}
    places = {i: plain_places(t) for i, t in text.items()}
    counts = {0: {}, 1: {}}
    for label in (0, 1):
        of_class = [i for i, mark in sorted(labels) if mark == label and zlib.crc32(str(i).encode()) % 3 != 1]
        for i in (i for n, i in enumerate(of_class) if n % 5 != 4):  # every fifth is kept for the line
            for p in places[i]:
                counts[label][p] = counts[label].get(p, 0) + 1
    size = 1 << quality.BITS
    total = {label: sum(c.values()) + size for label, c in counts.items()}

    def ratio(p):
        return np.log((counts[1].get(p, 0) + 1) / total[1]) - np.log((counts[0].get(p, 0) + 1) / total[0])

    for r in rows(quality.score(frame(docs, 4), model)):
        own = places[r["doc_id"]]
        length = sum(ratio(p) ** 2 for p in own) ** 0.5
        margin = (sum(float(model.weights[p]) for p in own) / length if length else 0.0) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-5)
