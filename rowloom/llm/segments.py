"""Cuts of a text at which byte-level BPE may be done piece by piece, and per-worker tokenizers.

The pre-token pattern lets a space begin a pre-token only, and a space before a character that isn't white space always
begins one. So a text can be cut before each such space, and what a piece gives doesn't depend on its neighbours.
Pieces repeat, so each is looked up in a bounded memory of pieces first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken

_IRREGULAR = re.compile(r" (?:\s|\Z)")
_BOUNDARY = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """The first piece, then the others without the space that each begins with."""
    return _BOUNDARY.split(text) if _IRREGULAR.search(text) else text.split(" ")


class Memory(dict):
    """piece -> make(piece). Twice `most` pieces at most: when full, those not used since it was last full are dropped. Long pieces are not kept."""

    def __init__(self, make: Callable, most: int = 100_000, longest: int = 32):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.before: dict = {}

    def __missing__(self, piece: str):
        value = self.before.pop(piece, None)
        if value is None:
            value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.before = self.copy()
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=4)
def pattern(source: str) -> Callable[[str], list[str]]:
    return regex.compile(source).findall


@lru_cache(maxsize=2)
def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def rank_encoding(path: str, source: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=source, mergeable_ranks=rank_table(path), special_tokens={})
