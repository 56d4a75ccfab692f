import hashlib

from pyspark.sql import functions as F

from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401
from tallyward.llm import fingerprints


def shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(docs):
    ordered = sorted(docs)
    out = {}
    for n, (doc, text) in enumerate(ordered):
        after, quarter = ordered[(n + 1) % len(ordered)][1], len(text) // 4
        out[doc] = (text[: len(text) - quarter] + after[:quarter], after)
    return out


def test_edits_and_likeness(frame, rng):
    words = [f"w{i}" for i in range(4000)]
    docs = [(i, prose(rng, rng.choice([3, 12, 60, 300, 900]), words)) for i in range(0, 400, 2)]
    want = expected(docs)
    got = rows(fingerprints.edited_fingerprints(frame([document(*d) for d in docs], 5)), "doc_id")
    assert len(got) == len(docs)
    errors = []
    for r in got:
        text, (edited, after) = dict(docs)[r["doc_id"]], want[r["doc_id"]]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        errors += [r["near_edited"] - similarity(text, edited), r["near_next"] - similarity(text, after)]
    assert max(map(abs, errors)) < 0.17 and abs(sum(errors) / len(errors)) < 0.01


def test_densification_is_the_same_rule_everywhere(spark):
    """Texts sharing most shingles agree in about as many bins, borrowed ones too."""
    base = [f"u{i}" for i in range(24)]
    frame = spark.createDataFrame([(" ".join(base), " ".join([*base[:-1], "other"])), ("a b", "a b"), ("a b", "c d"), ("", "")], ["a", "b"])
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    near = [r[0] for r in frame.select(fingerprints.likeness(a, b)).collect()]
    assert abs(near[0] - 19 / 21) < 0.15 and near[1] == 1.0 and near[2] < 0.05 and near[3] == 1.0


def test_odd_rows(frame, odd_rows, spark):
    got = fingerprints.edited_fingerprints(frame(odd_rows).withColumn("fp", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("next", F.lit(3)))
    found = rows(got)
    assert len(found) == len(odd_rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"]}
    assert by_id[5]["fingerprint"] == by_id[6]["fingerprint"] == by_id[7]["fingerprint"] and by_id[1]["fingerprint"] == ""
    assert [r["n_chars"] for r in found if r["doc_id"] == 2] == [0]
    assert fingerprints.edited_fingerprints(frame([])).count() == 0
    alone = fingerprints.edited_fingerprints(frame([document(1, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_native_plan(frame):
    plan = fingerprints.edited_fingerprints(frame([document(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
