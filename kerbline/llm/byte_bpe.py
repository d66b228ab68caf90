"""Byte-level BPE by recursive DuckDB queries inside each partition.

The distinct pre-tokens of a batch become (word, position, token) rows. A recursive query joins neighbouring rows
with the merge table and contracts each word's leftmost pair of minimum rank until no pair is left. Decoding joins
the ids with the vocabulary and aggregates the bytes in order. Both run over blocks of bounded size, whatever the texts.

The recursive query's work and rows grow with the square of a word's length: blocks are bounded by the sum of the squares, and
pre-tokens above ``LONG_BYTES`` bytes are contracted by the same rule with a heap in Python; the result is the same.

Null and empty texts give no ids. Repeated rows give repeated results, an empty table an empty one, and columns other
than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.vocab import BYTE_BPE, CACHE_WORDS, Numbers, byte_ranks, groups, vocabulary

#: Longest pre-token of the recursive query; its rows in a block; ids that are decoded at a time.
LONG_BYTES, BLOCK_ROWS, BLOCK_IDS = 200, 2_000_000, 1 << 20

_CONTRACT = """
WITH RECURSIVE state AS (
    SELECT word * 65536 + pos AS place, tok, 0 AS round FROM start
    UNION ALL
    SELECT place, CASE WHEN place = spot THEN made ELSE tok END, round + 1
    FROM (
        SELECT s.place, s.tok, s.round, s.before, b.word * 65536 + (b.best & 65535) AS spot, b.best >> 16 AS made
        FROM (SELECT *, lag(place) OVER (ORDER BY place) AS before FROM state) s
        JOIN (
            SELECT p.place >> 16 AS word, min(m.made * 65536 + (p.place & 65535)) AS best
            FROM (SELECT place, tok, lead(tok) OVER w AS following, lead(place) OVER w AS after FROM state WINDOW w AS (ORDER BY place)) p
            JOIN merges m ON m.pair = p.tok * 65536 + p.following
            WHERE (p.after >> 16) = (p.place >> 16)
            GROUP BY 1
        ) b ON b.word = (s.place >> 16)
    )
    WHERE before IS NULL OR before <> spot
)
SELECT place, tok FROM state
JOIN (SELECT place >> 16 AS word, max(round) AS round FROM state GROUP BY 1) l ON l.word = (place >> 16) AND l.round = state.round
ORDER BY place
"""
_DECODE = "SELECT doc, string_agg(v.hex, '' ORDER BY pos) AS hex FROM ids JOIN vocab v USING (tok) GROUP BY doc"


class ByteBpe:
    """Encoder and decoder over one DuckDB connection of a Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = byte_ranks(path), regex.compile(pattern)
        rows = [
            (self.ranks[t[:i]] * 65536 + self.ranks[t[i:]], made)
            for t, made in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.merges = pa.table(dict(zip(("pair", "made"), map(pa.array, np.array(rows, np.int64).T))))
        self.vocab = pa.table({"tok": pa.array(self.ranks.values(), pa.int64()), "hex": [t.hex() for t in self.ranks]})
        self._db = None
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        if self._db is None:
            self._db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
            self._arrow("merges", self.merges)
            self._arrow("vocab", self.vocab)
        return self._db

    def close(self) -> None:
        """Give back the database's memory; the next call opens another one."""
        if self._db is not None:
            self._db.close()
            self._db = None

    def _arrow(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _table(self, name: str, columns, names: tuple) -> None:
        self._arrow(name, pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}))

    def heap_contract(self, piece: bytes) -> tuple[int, ...]:
        """The leftmost minimum-rank contraction of one long pre-token."""
        n = len(piece)
        end = list(range(1, n + 1))
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
            for left in (before[i], i):
                if left >= 0 and end[left] < n:
                    far = end[end[left]]
                    if (r := self.ranks.get(piece[left:far])) is not None:
                        heapq.heappush(heap, (r, left, far))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _recursive(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word) of one block."""
        size = np.array(list(map(len, raws)))
        word = np.repeat(np.arange(len(raws)), size)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        self._table("start", (word, pos, np.array(self.single)[np.frombuffer(b"".join(raws), np.uint8)]), ("word", "pos", "tok"))
        found = self.db.sql(_CONTRACT).to_arrow_table()
        return found["tok"].to_numpy(), np.bincount(found["place"].to_numpy() >> 16, minlength=len(raws))

    def contract(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of distinct pre-tokens, one after another."""
        raws = [piece.encode("utf-8") for piece in pieces]
        whole = [self.ranks.get(raw, -1) for raw in raws]
        size, alone = np.ones(len(pieces), np.int64), np.array(whole, np.int64)
        short = np.flatnonzero((alone < 0) & (np.array(list(map(len, raws)), np.int64) <= LONG_BYTES))
        block = np.cumsum([len(raws[i]) ** 2 for i in short], dtype=np.int64) // BLOCK_ROWS
        edge = np.searchsorted(block, np.arange(int(block[-1]) + 2)) if len(block) else []
        groups = [(short[a:b], *self._recursive([raws[i] for i in short[a:b]])) for a, b in zip(edge[:-1], edge[1:]) if a < b]
        for i in np.flatnonzero(alone < 0):
            if len(raws[i]) > LONG_BYTES:
                ids = self.heap_contract(raws[i])
                groups.append((np.array([i]), np.array(ids), np.array([len(ids)])))
        for at, _, own in groups:
            size[at] = own
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[start[alone >= 0]] = alone[alone >= 0]
        for at, ids, own in groups:
            out[np.repeat(start[at] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return out, size

    def encode(self, texts: list[str | None], cache: dict) -> list[np.ndarray]:
        """Ids of whole texts as unsigned 32-bit arrays; ``cache`` keeps the pieces met, their ids and where these begin."""
        if not cache:
            cache.update(place=Numbers(), ids=np.zeros(0, np.uint32), bound=np.zeros(1, np.int64))
        place, lists = cache["place"], [self.pattern.findall(t) if t else [] for t in texts]
        n = np.array(list(map(len, lists)), np.int64)
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
        if place.fresh:
            ids, size = self.contract(place.fresh)
            cache["bound"] = np.append(cache["bound"], cache["bound"][-1] + np.cumsum(size))
            cache["ids"] = np.append(cache["ids"], ids)
            place.fresh = []
        first = cache["bound"][at]
        size = cache["bound"][at + 1] - first
        before = np.cumsum(size) - size
        flat = cache["ids"][np.repeat(first - before, size) + np.arange(int(size.sum()))]
        ends = np.append(0, np.cumsum(size))[np.cumsum(n)]
        if len(place) > CACHE_WORDS:
            cache.clear()
        return np.split(flat, ends[:-1])

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id array."""
        size = np.array([len(x) for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids)), size)
        tok = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        out: list[list[bytes]] = [[] for _ in ids]
        for a in range(0, len(tok), BLOCK_IDS):
            part = slice(a, a + BLOCK_IDS)
            self._table("ids", (doc[part], np.arange(len(tok[part])), tok[part]), ("doc", "pos", "tok"))
            for at, text in self.db.execute(_DECODE).fetchall():
                out[at].append(bytes.fromhex(text))
        return [b"".join(x) for x in out]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    return ByteBpe(path, pattern)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray], list[bytes]]]:
    """(keys, ids, decoded bytes) of runs of rows of (key, text)."""
    coder, cache = codec(path), {}
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for start, end in groups(texts):
            ids = coder.encode(texts[start:end], cache)
            yield batch.column(0).slice(start, end - start), ids, coder.decode(ids)
    coder.close()


def _lists(ids: list[np.ndarray]) -> pa.Array:
    size = np.append(0, np.cumsum([len(x) for x in ids]))
    return pa.LargeListArray.from_arrays(pa.array(size, pa.int64()), pa.array(np.concatenate(ids).view(np.int32))).cast(pa.list_(pa.int32()))


def encode_decode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded binary) of every row."""
    path = path or vocabulary(BYTE_BPE)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, data in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, _lists(ids), pa.array(data, pa.binary())], [key, "ids", "decoded"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")


def digests(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row's ids and decoded bytes, with the ids if asked for; in one pass."""
    path = path or vocabulary(BYTE_BPE)
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, data in _coded(batches, path):
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(np.ascontiguousarray(x, "<u4")).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x).hexdigest() for x in data]),
            ]
            yield pa.RecordBatch.from_arrays([keys, *([_lists(ids)] if keep_ids else []), *columns], names)

    ids = "ids array<int>, " if keep_ids else ""
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
