import random
import re

import numpy as np
from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401
from pyspark.sql import functions as F

from tallyward.llm import near_copies
from tallyward.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(docs, percent=80):
    sets = [(doc, shingles(text)) for doc, text in docs]
    parent = {doc: doc for doc, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {doc: (len(s), root(doc)) for doc, s in sets}


def copies(rng, count):
    words = [f"w{i}" for i in range(500)]
    docs = []
    while len(docs) < count:
        text = prose(rng, rng.choice([1, 3, 5, 20, 60, 200]), words).split()
        for _ in range(rng.choice([1, 1, 2, 12])):
            changed = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            docs.append((len(docs) * 3, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in changed)))
    return docs


def test_against_brute_force(frame):
    docs = copies(random.Random(4), 400)
    want = brute(docs)
    got = rows(near_copies.near_copies(frame([document(*d) for d in docs], 4)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_leaders_that_miss_and_blocks(frame, monkeypatch):
    """A chain of texts, each like its neighbours only: the leader of a bucket is unlike most of them."""
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    words = [f"v{i}" for i in range(700)]
    docs = [(n, " ".join(words[4 * n : 4 * n + 80])) for n in range(60)]
    random.Random(2).shuffle(docs)
    got = rows(near_copies.near_copies(frame([document(n, t) for n, t in docs])))
    assert {r["component_id"] for r in got} == {0} == {c for _, c in brute(docs).values()}


def test_signature_is_unbiased():
    gen = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(60):
            pool = gen.integers(0, 1 << 63, 300, dtype=np.uint64)
            common = int(300 * share)
            a = pool[: common + (300 - common) // 2]
            b = np.concatenate([pool[:common], pool[common + (300 - common) // 2 :]])
            estimate = near_copies.signature_likeness(near_copies.min_max(a, 56), near_copies.min_max(b, 56))
            errors.append(estimate - common / 300)
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.05


def test_components(spark):
    gen = random.Random(8)
    edges = [(gen.randrange(400), gen.randrange(400)) for _ in range(280)] + [(1000 + n, 1001 + n) for n in range(60)] + [(5000, 5000 + n) for n in range(1, 300)]
    label = {n: n for e in edges for n in e}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    loops = {n for n in label if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: c for n, c in label.items() if n not in loops}


def test_odd_rows(frame, odd_rows):
    source = frame(odd_rows).withColumn("id", F.lit(1)).withColumn("bucket", F.lit(2))
    got = rows(near_copies.near_copies(source))
    assert len(got) == len(odd_rows)
    named = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert named[6]["component_id"] == named[7]["component_id"] == named[5]["component_id"] == 5 and not named[6]["kept"]
    assert named[1]["n_shingles"] == 0 and named[1]["kept"] and named[3]["component_id"] == 3 and named[4]["n_shingles"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_copies.near_copies(frame([])).count() == 0
