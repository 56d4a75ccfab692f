import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_help import document, frame, odd_rows, prose, rng, rows  # noqa: F401
from tallyward.llm import byte_bpe, vocabulary

EDGES = ["", "  lead", "trail  ", "a\n\n b\t\tc ", "don't we'll I'd", "日本語 テスト", "²½ x1٣", "😀😀", "<|endoftext|>", "é́x y z", "\r\n\x0b"]


def direct(text):
    ids = vocabulary.encoding(byte_bpe.VOCABULARY).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_as_the_library_encodes(frame, rng, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 3_000)
    docs = [document(n, t) for n, t in enumerate(EDGES)] + [document(100 + n, prose(rng, 300)) for n in range(40)]
    encoded = byte_bpe.encode(frame(docs, 4)).cache()
    for r in rows(encoded):
        text = dict((d[0], d[1]) for d in docs)[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == direct(text)
    back = {r["doc_id"]: r["text"] for r in rows(byte_bpe.decode(encoded))}
    assert back == {d[0]: d[1] for d in docs}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ é'sdtrevml019_-.,!\n\r\t ²½×÷ªʯʰ日\x0b\x1c\xa0", max_size=30))
def test_both_patterns_agree(text):
    assert byte_bpe.pre_tokens(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_odd_rows(frame, odd_rows):
    got = rows(byte_bpe.encode(frame(odd_rows), keep_ids=False))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"]) for r in got) == sorted(
        (d[0] is None, d[0] or 0, *direct(d[1])[:2]) for d in odd_rows
    )
    assert byte_bpe.encode(frame([])).count() == 0


@pytest.mark.parametrize("numbers", [[], [0], [254, 255, 256, 65789, 65790, 65791, 4_000_000], list(range(0, 200_000, 37))])
def test_numbers_round_trip(numbers):
    packed = byte_bpe.packed_numbers(np.array(numbers, dtype=np.int64))
    assert byte_bpe.unpacked_numbers(packed).tolist() == numbers
