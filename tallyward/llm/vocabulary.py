"""Public tokenizer vocabularies inside tasks: each worker loads a file once.

A vocabulary file is given by its path, or by its bare name among the installed public files.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken


def located(name: str) -> str:
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies in JSON write each byte as one visible letter: printable Latin-1 as itself,
    the other bytes, in order, as the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level vocabulary, from ranks or from JSON (without its special tokens)."""
    with open(located(path), encoding="utf-8") as file:
        if not path.endswith(".json"):
            return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", ()) if t.get("special")}
    letters = _bytes_of_letters()
    return {bytes(letters[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary in JSON, text -> id; rank files have none."""
    if not path.endswith(".json"):
        return {}
    with open(located(path), encoding="utf-8") as file:
        data = json.load(file)
    tokens = data.get("added_tokens") or ()
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip")) or (tokens and data.get("normalizer")):
        raise ValueError(f"{path}: added tokens that take in white space, stand for whole words or meet a normalizer are not read")
    return {t["content"]: int(t["id"]) for t in tokens}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def encoder(path: str, added: bool = False) -> Callable[[str], np.ndarray]:
    """text -> ids as unsigned 32-bit numbers.

    For a byte-level vocabulary whose merges are ordered by id this gives the ids of the ``tokenizers``
    library several times faster; tests hold the two against each other. With ``added``, a text is split at the
    vocabulary's added tokens and these get their own ids, as the library does by default (``add_special_tokens=False``
    does not change that); without, their strings are ordinary text. Lone surrogates become U+FFFD.
    """
    core = encoding(path)
    own = added_tokens(path) if added else {}
    # Where several match at a place, the longest does.
    marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(own, key=len, reverse=True)) + ")") if own else None

    def ordinary(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        return core.encode_to_numpy(text, disallowed_special=())

    def encode(text: str) -> np.ndarray:
        if marks is None or not marks.search(text):
            return ordinary(text)
        parts = marks.split(text)
        return np.concatenate([np.array([own[p]], dtype=np.uint32) if n % 2 else ordinary(p) for n, p in enumerate(parts)])

    return encode
