"""Vocabulary files of public tokenizers, read on the driver and shipped to the executors by value."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers


def path(name: str) -> str:
    return public_tokenizers.path(name)


PATTERN = public_tokenizers.PATTERN


@lru_cache(maxsize=1)
def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(moved)) for b in range(256))


def read_json(file: str) -> tuple[dict[str, int], list[tuple[str, str]], list[str]]:
    """Vocabulary, merges in order of rank, and the contents of added tokens of a tokenizers file."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return spec["model"]["vocab"], merges, [t["content"] for t in spec["added_tokens"]]


def read_ranks(file: str) -> list[bytes]:
    """Tokens of a rank file, the place in the list being the id."""
    with open(file, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens
