"""Token counts by rank-synchronous array merging of word-BPE pre-tokens.

Distinct words of a batch are normalised and pre-tokenised by the vocabulary file's own components, then held
as one ragged numpy array of symbols. Each round finds every sequence's lowest-rank pair and contracts all of
that pair's places in all sequences at once; a sequence without a pair left retires and its symbols are counted.
Contracting all places of one pair equals contracting them one after another, because a merge list names a pair
only after both of its symbols exist, so no contraction can bring up a pair of a lower rank.

Null and empty texts count no token. Repeated rows give repeated results, an empty table an empty one, and
columns other than the key and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.vocab import WORD_BPE, groups, split_words, trim, vocabulary, word_model, word_tokenizer

_NONE = np.iinfo(np.int64).max


class Merger:
    """The merge table of a vocabulary file as sorted pair keys."""

    def __init__(self, path: str):
        spec = word_model(path)
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)[order]
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        tokenizer = word_tokenizer(path)
        self.normalise, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str

    def symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start symbols of pre-tokens one after another, and how many each has; characters outside the vocabulary have none."""
        chars = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array(list(map(len, pieces)), np.int64)
        known, place = np.unique(chars, return_inverse=True)
        inner, last = (np.array([self.vocab.get(chr(c) + end, -1) for c in known], np.int64)[place] for end in ("", self.suffix))
        stop = np.cumsum(size)[size > 0] - 1
        inner[stop] = last[stop]
        owner = np.repeat(np.arange(len(pieces)), size)[inner >= 0]
        return inner[inner >= 0], np.bincount(owner, minlength=len(pieces))

    def pre_tokens(self, word: str) -> tuple[int, list[str]]:
        """Number of special tokens in ``word`` and the pre-tokens of what lies between them."""
        parts = self.special.split(word) if self.special else [word]
        return len(parts) - 1, [p for part in parts if part for p, _ in self.cut(self.normalise(part))]

    def cut_words(self, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Special tokens in each word, and the pre-tokens of all words with the word each comes from.

        Plain words go through the normaliser and pre-tokeniser in one call with blanks between them, as no pre-token crosses a
        blank; words with special tokens or with other white space inside are cut one by one.
        """
        special, pieces, owner = np.zeros(len(words), np.int64), [], []
        plain = [at for at, w in enumerate(words) if w.split() == [w] and not (self.special and self.special.search(w))]
        row = self.normalise(" ".join([words[at] for at in plain])).split(" ") if plain else []
        if len(row) != len(plain):
            plain, row = [], []
        if row:
            start = np.cumsum([0, *(len(w) + 1 for w in row[:-1])])
            found = self.cut(" ".join(row))
            pieces = [p for p, _ in found]
            place = np.searchsorted(start, np.array([s for _, (s, _) in found], np.int64), "right") - 1
            owner = np.array(plain, np.int64)[place].tolist()
        whole = set(plain)
        for at, word in enumerate(words):
            if at not in whole:
                special[at], parts = self.pre_tokens(word)
                pieces += parts
                owner += [at] * len(parts)
        return special, pieces, np.array(owner, np.int64)

    def survivors(self, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of symbols left of each of the sequences of ``size`` symbols."""
        left, owner = size.copy(), np.repeat(np.arange(len(size)), size)
        while len(symbol) > 1:
            key = symbol[:-1] << 32 | symbol[1:]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = (self.key[place] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.rank[place], _NONE), _NONE)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(first, len(owner)))
            low = np.minimum.reduceat(rank, first)
            alive = low != _NONE
            hit = (rank == np.repeat(low, length)) & np.repeat(alive, length)
            spot = np.flatnonzero(hit)
            if not len(spot):
                break
            # Places of one pair overlap only in runs of one symbol: every second place of a run counts.
            fresh = np.append(True, np.diff(spot) > 1)
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - begin) % 2 == 0]
            symbol[spot] = self.made[place[spot]]
            keep = np.repeat(alive, length)
            keep[spot + 1] = False
            left -= np.bincount(owner[spot], minlength=len(left))
            symbol, owner = symbol[keep], owner[keep]
        return left

    def count(self, words: list[str]) -> list[int]:
        """Token counts of distinct words."""
        totals, pieces, owner = self.cut_words(words)
        np.add.at(totals, owner, self.survivors(*self.symbols(pieces)))
        return totals.tolist()


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(path)


def text_counts(texts: list[str | None], path: str, cache: dict) -> list[int]:
    """Token counts of whole texts; ``cache`` remembers words between calls."""
    out: list[int] = []
    for start, end in groups(texts):
        lists = [split_words(t) for t in texts[start:end]]
        new = list({w for words in lists for w in words if w not in cache})
        if new:
            cache.update(zip(new, _merger(path).count(new)))
        out += [sum(map(cache.__getitem__, words)) for words in lists]
        trim(cache)
    return out


def token_counts(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    path = path or vocabulary(WORD_BPE)
    source = df.select(F.col(key), F.col(text))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            n = pa.array(text_counts(column.to_pylist(), path, cache), pa.int64())
            size = pc.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, schema)
