"""Byte-level BPE vocabularies for tasks."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read once on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    """An encoder with the ids of the tokenizer in ``vocabulary``; its added tokens are one id wherever they stand.

    Byte-level vocabularies spell each byte as a printable character; undoing this gives
    the byte strings, whose ids are their merge ranks.
    """
    import public_tokenizers
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    model = json.loads(vocabulary)
    special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(vocabulary: bytes) -> Callable[[str], list[int]]:
    """Text to ids, as the tokenizer of the vocabulary file gives them without further special tokens."""
    found = encoding(vocabulary)
    return lambda text: found.encode(text, allowed_special="all")
