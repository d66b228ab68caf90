"""Readers of public vocabulary files and the per-worker caches built on them."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
CACHE_WORDS = 400_000
GROUP_CHARS = 1 << 21
_BLANKS = str.maketrans("\n\t\r", "   ")


def split_words(text: str | None) -> list[str]:
    """Runs between white space: places no word-BPE token ever crosses.

    Python counts four separators as white space that the tokenizer doesn't; texts with one of them are cut at plain blanks only.
    """
    if not text:
        return []
    if any(sign in text for sign in "\x1c\x1d\x1e\x1f"):
        return [w for w in text.translate(_BLANKS).split(" ") if w]
    return text.split()


class Numbers(dict):
    """Numbers its keys as they come, and lists those that came since the list was last emptied."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


def groups(texts: list[str | None], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for at, text in enumerate(texts):
        n = len(text or "")
        if at > start and size + n > limit:
            yield start, at
            start, size = at, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def trim(cache: dict) -> None:
    """Forget a full cache; it only saves time, so results never depend on it."""
    if len(cache) > CACHE_WORDS:
        cache.clear()


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def word_model(path: str) -> dict:
    with open(path, encoding="utf-8") as source:
        return json.load(source)


@lru_cache(maxsize=2)
def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as source:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def chunks(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """The text in parts that end at white space, so that word lists stay short whatever the text's length."""
    at = 0
    while at < len(text):
        end = min(len(text), at + limit)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
