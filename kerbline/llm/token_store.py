"""Token-id shards with a minimal perfect hash index for keyed access.

Documents are dealt out by ranges of the key, encoded with the tokenizers library and packed into shards. A shard is
one binary value: a header, the hash index, the keys, then the raw little-endian 32-bit ids of its documents in key order. The
index is a cascade of bit arrays: each level keeps the keys that fall alone on a bit, the others go on to the next
level, and the number of set bits before a key's bit is its slot. A slot holds the key's fingerprint, its first document's number, how many
documents have the key (repeated keys lie side by side) and where the payload of the first begins. Set bits are counted per 64-bit word, so a
lookup reads a few places whatever the shard's size; a fingerprint that fits is confirmed by the stored key.

Shards are stored as Parquet rows, so writers commit through Spark and any store that Spark reaches will do. :func:`lookup` finds a key's shard
by an equi-join on buckets of the key's range.
Null texts are empty; each document ends with the end id. A null key is stored first, outside the index. An empty table
writes no shard. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm.common import mix
from kerbline.llm.vocab import WORD_BPE, Numbers, split_words, vocabulary, word_tokenizer

MAGIC = b"KTS2"
SHARD_IDS, PARTITION_BYTES, GROUP_BYTES, CACHE_WORDS, SHARDS_PER_FILE = 1 << 20, 1 << 25, 1 << 22, 500_000, 4
END_ID = 1
_SHARD = "part int, seq int, first_key bigint, last_key bigint, n_docs bigint, n_tokens bigint, start_in_part bigint, shard binary"


def _seeded(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys over bit arrays and counts that may lie in a shard's bytes."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, base = [], keys, 0
        while len(left):
            size = 2 * len(left)
            bit = (_seeded(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.zeros(-(-size // 64) * 64, np.uint8)
            alone[:size] = np.bincount(bit, minlength=size) == 1
            word = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(word).astype(np.int64)
            levels.append((size, word, (base + np.cumsum(ones) - ones).astype("<u4")))
            base += int(ones.sum())
            left = left[alone[bit] == 0]
        return cls(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; keys outside the set get -1 or any slot, hence the fingerprints."""
        out = np.full(len(keys), -1, np.int64)
        for level, (size, word, before) in enumerate(self.levels):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            bit = _seeded(keys[left], level) % np.uint64(size)
            at, place = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            here = word[at]
            found = (here >> place & np.uint64(1)) == 1
            rank = before[at].astype(np.int64) + np.bitwise_count(here & ((np.uint64(1) << place) - np.uint64(1)))
            out[left[found]] = rank[found]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_seeded(keys, 77) >> np.uint64(32)).astype(np.uint32)


def pack(keys: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """One shard of documents in ascending key order; document i has ``ids[bounds[i]:bounds[i+1]]``."""
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], np.int64)
    unique, first, repeats = np.unique(known, return_index=True, return_counts=True)
    index = PerfectHash.build(unique)
    slot = index.slot(unique)
    table, where = np.zeros((3, len(unique)), "<u4"), np.zeros(len(unique), "<u8")
    table[0, slot], table[1, slot], table[2, slot] = _fingerprint(unique), first + nulls, repeats
    where[slot] = bounds[first + nulls]
    head = np.array([len(keys), nulls, len(unique), len(index.levels), *(size for size, _, _ in index.levels)], "<u4")
    bits = [part.tobytes() for _, word, before in index.levels for part in (word, before)]
    return b"".join([MAGIC, head.tobytes(), *bits, table.tobytes(), where.tobytes(), known.astype("<i8").tobytes(), bounds.astype("<u8").tobytes(), ids.astype("<u4").tobytes()])


class Shard:
    """Reader of one packed shard; opening it reads the header only."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.nulls, self.n_keys, n_levels = np.frombuffer(data, "<u4", 4, 4).tolist()
        sizes = np.frombuffer(data, "<u4", n_levels, 20).tolist()
        at, levels = 20 + 4 * n_levels, []
        for size in sizes:
            n = -(-size // 64)
            levels.append((size, np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n)))
            at += 12 * n
        self.index = PerfectHash(levels)
        self.table = np.frombuffer(data, "<u4", 3 * self.n_keys, at).reshape(3, -1)
        self.where = np.frombuffer(data, "<u8", self.n_keys, at + 12 * self.n_keys)
        at += 20 * self.n_keys
        self.known = np.frombuffer(data, "<i8", self.n_docs - self.nulls, at)
        at += 8 * (self.n_docs - self.nulls)
        self.bounds = np.frombuffer(data, "<u8", self.n_docs + 1, at)
        self.payload = np.frombuffer(data, "<u4", offset=at + 8 * (self.n_docs + 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first document, number of documents, payload place) of each key; no documents for a key that isn't stored."""
        slot = self.index.slot(keys)
        held = slot >= 0
        first, repeats, where = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        s = slot[held]
        doc = self.table[1, s].astype(np.int64)
        right = (self.table[0, s] == _fingerprint(keys[held])) & (self.known[np.clip(doc - self.nulls, 0, max(0, len(self.known) - 1))] == keys[held])
        first[held], repeats[held], where[held] = doc, np.where(right, self.table[2, s], 0), self.where[s].astype(np.int64)
        return first, repeats, where

    def documents(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``keys``, payload begin, payload end) of every document of the keys, through the index."""
        first, repeats, where = self.find(keys)
        of = np.repeat(np.arange(len(keys)), repeats)
        doc = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        size = (self.bounds[doc + 1] - self.bounds[doc]).astype(np.int64)
        # A key's documents follow one another from the place that its slot names.
        gone = np.cumsum(size) - size
        head = np.cumsum(repeats) - repeats
        begin = where[of] + gone - gone[head[of]] if len(of) else gone
        return of, begin, begin + size


_PLAIN_END = ".,;:!?)\""
#: Words of Latin letters that stay as they are under composition and whose lower case is one letter each.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
_PROBE = ["street", "the", "\u00fcber", "ni\u00f1o", "eaue", "xqzwv", "internationalisation"]


@lru_cache(maxsize=2)
def _lean(path: str) -> Tokenizer | None:
    """The file's model behind a cut at blanks alone: what its tokenizer comes to for lower-case letter words; None where it doesn't."""
    with open(path, encoding="utf-8") as source:
        spec = json.load(source) | {"normalizer": None, "added_tokens": [], "post_processor": None}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}
    lean, full = Tokenizer.from_str(json.dumps(spec)), word_tokenizer(path)
    ids = lambda t, w: t.encode(w, add_special_tokens=False).ids
    alike = all(ids(lean, w) == ids(full, w) == ids(full, w.title()) for w in _PROBE) and ids(lean, " ".join(_PROBE)) == ids(full, " ".join(_PROBE))
    return lean if alike else None


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    """Whether each id ends a word."""
    ends = [n for t, n in word_tokenizer(path).get_vocab().items() if t.endswith("</w>")]
    out = np.zeros(max(ends, default=0) + 1, bool)
    out[ends] = True
    return out


class WordCache:
    """Ids of the words met so far; each distinct word goes to the library once."""

    def __init__(self, path: str):
        self.tokenizer, self.lean, self.last = word_tokenizer(path), _lean(path), _word_ends(path)
        self.clear()

    def clear(self) -> None:
        self.place, self.ids, self.bound = Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of lower-case letter words: rows of them are encoded together, as each ends with the only word end of its own."""
        flat = [np.zeros(0, np.uint32)]
        rows = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
        for at in range(0, len(rows), 200):
            flat += [np.array(e.ids, np.uint32) for e in (self.lean or self.tokenizer).encode_batch_fast(rows[at : at + 200], add_special_tokens=False)]
        ids = np.concatenate(flat)
        stop = np.flatnonzero(self.last[ids]) + 1
        # Should a vocabulary mark word ends otherwise, each word is encoded by itself.
        return (ids, np.diff(stop, prepend=0)) if len(stop) == len(words) else self._other(words)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = []
        for at in range(0, len(words), 5000):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + 5000], add_special_tokens=False)]
        size = np.array(list(map(len, lists)), np.int64)
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def learn(self, words: list[str]) -> None:
        """Add the ids of new distinct words. A word of letters with signs after it is encoded as the word and the signs."""
        array = pa.array(words, pa.large_string())
        core = pc.utf8_rtrim(array, characters=_PLAIN_END)
        plain = pc.match_substring_regex(core, _PLAIN).to_numpy(zero_copy_only=False)
        cut = pc.binary_length(core).to_numpy(), pc.binary_length(array).to_numpy()
        tailed = np.flatnonzero(plain & (cut[0] < cut[1]))
        letters = pc.utf8_lower(core.filter(pa.array(plain))).dictionary_encode()
        tails = pa.array([words[i][cut[0][i] - cut[1][i] :] for i in tailed], pa.large_string()).dictionary_encode()
        others = [words[i] for i in np.flatnonzero(~plain)]
        (a, na), (b, nb), (c, nc) = self._plain(letters.dictionary.to_pylist()), self._other(tails.dictionary.to_pylist()), self._other(others)
        flat, size = np.concatenate([a, b, c]), np.concatenate([na, nb, nc])
        start = np.cumsum(size) - size
        # Each word is a first and a second piece; the second is empty unless signs follow the letters.
        first, second = np.zeros((2, len(words)), np.int64), np.zeros((2, len(words)), np.int64)
        for rows, place, out in (
            (plain, letters.indices.to_numpy(), first), (~plain, len(na) + len(nb) + np.arange(len(others)), first), (tailed, len(na) + tails.indices.to_numpy(), second)
        ):
            out[0, rows], out[1, rows] = start[place], size[place]
        begin, parts = np.stack([first[0], second[0]], axis=1).ravel(), np.stack([first[1], second[1]], axis=1).ravel()
        ids = flat[np.repeat(begin - (np.cumsum(parts) - parts), parts) + np.arange(int(parts.sum()))]
        self.bound = np.append(self.bound, self.bound[-1] + np.cumsum(first[1] + second[1]))
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with an end id after each, number of ids of each text)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            lists = pa.array([split_words(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        found = lists.flatten().dictionary_encode()
        names = found.dictionary.to_pylist()
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        if self.place.fresh:
            self.learn(self.place.fresh)
            self.place.fresh = []
        at = at[found.indices.to_numpy()]
        # The end id is a word of its own after the last word of each text.
        stop = np.cumsum(n)
        at = np.insert(at, stop, len(self.bound) - 1)
        bound = np.append(self.bound, len(self.ids) + 1)
        size = np.diff(bound)[at]
        after = np.cumsum(size)
        # Places fit into 32 bits unless a group has more ids, which only a very long text does.
        kind = np.int32 if after[-1] < 1 << 31 else np.int64
        ids = np.append(self.ids, np.uint32(END_ID))[np.repeat((bound[at] - after + size).astype(kind), size) + np.arange(after[-1], dtype=kind)]
        ends = after[stop + np.arange(len(n))]
        return ids, np.diff(ends, prepend=0)


def write_tokens(df: DataFrame, target: str, path: str | None = None, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode ``df`` and write its shards below ``target`` in ascending order of the integer key.

    By default a partition gets about ``PARTITION_BYTES`` of the input: the fewer partitions, the fewer words are encoded twice.
    """
    path = path or vocabulary(WORD_BPE)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Spark's estimate is beyond all bounds where it knows nothing of an input.
    known = size // PARTITION_BYTES if size < 1 << 55 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = partitions or max(2 * df.sparkSession.sparkContext.defaultParallelism, known)
    dealt = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).repartitionByRange(partitions, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, cache = TaskContext.get().partitionId(), 0, 0, WordCache(path)
        keys: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, keys, held
            ids, sizes = (np.concatenate(x) for x in zip(*held))
            known = [k for k in keys if k is not None]
            row = [part, seq, known[0] if known else None, known[-1] if known else None, len(keys), len(ids), start, pack(keys, ids, np.append(0, np.cumsum(sizes)))]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            names = ["part", "seq", "first_key", "last_key", "n_docs", "n_tokens", "start_in_part", "shard"]
            seq, start, keys, held = seq + 1, start + len(ids), [], []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
            edge = np.append(np.searchsorted(size // GROUP_BYTES, np.unique(size // GROUP_BYTES)), len(names))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                keys += names[a:b]
                held.append(cache.encode(texts.slice(a, b - a)))
                if len(cache.place) > CACHE_WORDS:
                    cache.clear()
                if sum(len(x) for x, _ in held) >= SHARD_IDS:
                    yield flush()
        if keys:
            yield flush()
        del cache, held
        pa.default_memory_pool().release_unused()

    # Readers take a file's rows at once: few shards a file keep their memory small.
    dealt.mapInArrow(run, _SHARD).write.option("compression", "zstd").option("maxRecordsPerFile", SHARDS_PER_FILE).parquet(target)


def _based(spark: SparkSession, target: str) -> DataFrame:
    """Shards with the number of ids before each; one sum per writing partition reaches the driver."""
    shards = spark.read.schema(_SHARD).parquet(target)
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for row in sums:
        base[row["part"]], total = total, total + row["n"]
    table = spark.createDataFrame(list(base.items()), "part int, base bigint")
    return shards.join(F.broadcast(table), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_digests(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, each read from the place that the shard's index gives for its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0), batch.column(1)):
                shard = Shard(data.as_py())
                names = np.unique(shard.known)
                of, begin, end = shard.documents(names)
                if shard.nulls + len(of) != shard.n_docs:
                    raise ValueError("the shard's index doesn't lead to each of its documents")
                ends = shard.bounds[: shard.nulls + 1].astype(np.int64)
                begin, end = np.append(ends[:-1], begin), np.append(ends[1:], end)
                crc = [zlib.crc32(shard.payload[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
                keys = [None] * shard.nulls + names[of].tolist()
                columns = [pa.array(keys, pa.int64()), pa.array(first.as_py() + begin), pa.array(end - begin), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    based = _based(spark, target).select("start", "shard")
    return based.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, target: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids array<bigint>) of the wanted keys: a key's shard is found by its bucket of the key range, then asked through its index."""
    wanted = keys.select(F.col(key).cast("bigint").alias("key")).where("key is not null").distinct()
    shards = spark.read.schema(_SHARD).parquet(target)
    spans = shards.where("first_key is not null").select("part", "seq", "first_key", "last_key")
    low, high, n = spans.agg(F.min("first_key"), F.max("last_key"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], f"`{key}` bigint, ids array<bigint>")
    width = max(1, (high - low) // (4 * n))
    bucket = lambda c: F.floor((F.col(c) - F.lit(low)) / F.lit(width))
    covered = spans.withColumn("bucket", F.explode(F.sequence(bucket("first_key"), bucket("last_key"))))
    asked = wanted.where(F.col("key").between(low, high)).withColumn("bucket", bucket("key")).join(covered, "bucket").where("key between first_key and last_key")

    def run(names: pa.Table, held: pa.Table) -> pa.Table:
        found, ids = [], []
        for data in held["shard"]:
            shard, own = Shard(data.as_py()), names["key"].to_numpy()
            of, begin, end = shard.documents(own)
            found += own[of].tolist()
            ids += [shard.payload[a:b].tolist() for a, b in zip(begin.tolist(), end.tolist())]
        return pa.table([pa.array(found, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], [key, "ids"])

    right = shards.select("part", "seq", "shard").join(asked.select("part", "seq").distinct(), ["part", "seq"], "left_semi")
    return asked.select("part", "seq", "key").groupBy("part", "seq").cogroup(right.toDF("part", "seq", "shard").groupBy("part", "seq")).applyInArrow(run, f"`{key}` bigint, ids array<bigint>")
