import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_help import document, frame, odd_rows, rng, rows  # noqa: F401
from tallyward.llm import pii_spans


def plain(text):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], pii_spans.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab12340.@+-() _x%٣é\n", max_size=60))
def test_base_patterns(text):
    assert pii_spans.base_spans(text) == plain(text)


@pytest.fixture(scope="module")
def model():
    return pii_spans.fit_examples([])


def seen(model, text):
    return [(text[a:b], kind) for a, b, kind, _ in pii_spans.all_spans(model, text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call (226) 555-1909 now", [("(226) 555-1909", "phone")]), ("call 226.555.1909", [("226.555.1909", "phone")]),
        ("bob (at) site (dot) org", [("bob (at) site (dot) org", "email")]), ("ann at mail dot com", [("ann at mail dot com", "email")]),
        ("x 4202.9658.2782.4311 y", [("4202.9658.2782.4311", "card")]), ("+1 (843) 555-7672 170.106.4.2", [("+1 (843) 555-7672", "phone"), ("170.106.4.2", "ip")]),
        ("look at site.com", []), ("on 2024-05-17 10:22:33", []), ("order 123456789012", []), ("isbn 978-3-16-148410-0", []), ("1,234,567.89", []),
        ("version 10.2.3.4567", []), ("0641917ea4e9feb9cda83477b57ac2654884f485", []), ("the end. At one. In two", []),
    ],
)
def test_added_spans(model, text, want):
    assert seen(model, text) == want


def test_held_out_variants(model):
    """Spans written by another seed than the fitted ones are found, look-alikes are not."""
    import random

    hits = wrong = gold = 0
    for text, _, spans in pii_spans.variants(random.Random(99), 60):
        got = {(a, b, k) for a, b, k, _ in pii_spans.all_spans(model, text)}
        hits, wrong, gold = hits + len(got & set(spans)), wrong + len(got - set(spans)), gold + len(spans)
    assert hits / gold > 0.97 and wrong / gold < 0.03


def test_base_spans_stay_and_masking(model):
    text = "a.b@c.org, 10.0.0.1 and +1 (886) 555-7964; 4202965827824311"
    spans = pii_spans.all_spans(model, text)
    assert [s[:3] for s in spans if s[3]] == plain(text)
    assert pii_spans.masked_text(text, spans) == "[EMAIL], [IP] and [PHONE]; [CARD]"


def test_long_lists_add_nothing_over_base_spans(model):
    """A list of numbers is one region with as many base spans as it has entries."""
    text = " ".join(f"10.20.{n}.7" for n in range(200))
    assert len(pii_spans.regions(text)) == 1
    spans = pii_spans.all_spans(model, text)
    assert [s[:3] for s in spans] == plain(text) and len(spans) == 200 and all(s[3] for s in spans)
    mixed = " ".join(f"10.20.{n}.7 226.555.1909" for n in range(100))
    kept = pii_spans.all_spans(model, mixed)
    base = [s for s in kept if s[3]]
    assert not any(a < d and c < b for a, b, _, own in kept if not own for c, d, _, _ in base)


def test_odd_rows(frame, odd_rows):
    docs = [*odd_rows, document(50, "9" * 100_000), document(51, "1 " * 30_000), document(52, "a@" * 20_000), document(53, "to me@x.y"), document(53, "to me@x.y")]
    source = frame(docs).withColumnRenamed("lang", "spans")
    model = pii_spans.fit(source)
    got = rows(pii_spans.digest(pii_spans.find_spans(source, model)))
    assert len(got) == len(docs) and [r["n_email"] for r in got if r["doc_id"] == 53] == [1, 1]
    assert [r["spans"] for r in got if r["doc_id"] == 53] == ["email:3:9"] * 2
    masked = pii_spans.mask(source, model)
    assert masked.columns == source.columns
    assert {r["text"] for r in rows(masked) if r["doc_id"] == 53} == {"to [EMAIL]"} and {r["n_chars"] for r in rows(masked) if r["doc_id"] == 53} == {10}
    assert pii_spans.find_spans(frame([]), pii_spans.fit(frame([]))).count() == 0
