import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401
from tokenizers import Tokenizer

from tallyward.llm import packing, vocabulary
from test_byte_bpe import EDGES


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_holds_every_piece(counts):
    runs = packing.plan_runs(counts, 64)
    placed: dict[int, int] = {}
    for times, lengths in runs:
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            placed[n] = placed.get(n, 0) + times
    assert placed == counts
    total = sum(n * k for n, k in counts.items())
    used = sum(times for times, _ in runs)
    assert -(-total // 64) <= used <= 2 * total / 64 + 1


@pytest.mark.parametrize(("counts", "best"), [({64: 5}, 5), ({40: 7, 24: 7}, 7), ({30: 4, 20: 4, 14: 4}, 4), ({25: 3, 17: 3, 12: 3, 10: 3}, 3), ({33: 10}, 10), ({}, 0)])
def test_exact_fillings(counts, best):
    assert sum(times for times, _ in packing.plan_runs(counts, 64)) == best


def test_ids_are_those_of_the_library(rng):
    reference = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    reference.encode_special_tokens = True
    encode = vocabulary.encoder(packing.VOCABULARY)
    for text in [*EDGES, *(prose(rng, 200) for _ in range(20))]:
        assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n y ", "<|endoftext", "  <|endoftext|>\t", "<|<|endoftext|>|>", "ab <|ENDOFTEXT|>"]


def test_added_tokens_have_their_own_ids(frame):
    """The library in its default setting: it matches added tokens in texts whatever add_special_tokens says."""
    reference = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [*EDGES, *MARKED]
    encode = vocabulary.encoder(packing.VOCABULARY, added=True)
    want = {}
    for n, text in enumerate(texts):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert encode(text).tolist() == ids
        want[n] = (len(ids) + 1, zlib.crc32(np.array([*ids, packing.END_ID], dtype="<u4").tobytes()))
    got = rows(packing.pack(packing.pieces(frame([document(n, t) for n, t in enumerate(texts)]), packing.VOCABULARY)))
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == want


def check(docs, got, capacity):
    encode = vocabulary.encoder(packing.VOCABULARY)
    places = {}
    want = []
    for doc, text in docs:
        ids = [*encode(text or "").tolist(), packing.END_ID]
        first = len(ids) % capacity or capacity
        for k, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[start : first if not start else start + capacity]
            want.append((str(doc), k, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_and_places(frame, rng):
    docs = [(n, prose(rng, rng.choice([1, 8, 30, 90, 400]))) for n in range(150)] + [(500 + n, "same text again") for n in range(90)]
    got = rows(packing.pack(packing.pieces(frame([document(*d) for d in docs], 5), packing.VOCABULARY, 128), 128))
    assert check(docs, got, 128) <= 1.03 * -(-sum(r["length"] for r in got) // 128) + 1


def test_odd_rows(frame, odd_rows):
    got = rows(packing.pack(packing.pieces(frame(odd_rows).withColumnRenamed("lang", "length"), packing.VOCABULARY)))
    check([(d[0], d[1]) for d in odd_rows], got, packing.CAPACITY)
    assert packing.pack(packing.pieces(frame([]), packing.VOCABULARY)).count() == 0
