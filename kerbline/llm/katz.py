"""Katz backoff bigram scores with Good-Turing discounts and exactly normalised backoff weights.

Words and the end token are 64-bit hashes; the first token's context is a start mark. Seen bigrams of count r up to ``MAX_DISCOUNT`` are
discounted by d_r; a discount outside (0, 1), as sparse counts of counts give, is replaced by (r - 0.5) / r. A context whose counts are all
above that limit, and any of ``RESERVE_FROM`` or more tokens, reserves one count, so that its backoff mass is never zero. The mass a context holds back is dealt out over the words it was
not seen with, in proportion to (c + 1) / (N + V + 1); the weight divides by exactly their total.

1. Documents become blocks of word numbers with a dictionary each, written down once.
2. The dictionaries are dealt out by word: words get global numbers, small ones for frequent words, and training counts, which go back
   to the blocks.
3. A block's distinct (context, word, document) triples are dealt out by context as packed arrays, with the words' counts. A context of more
   than ``PART_TOKENS`` / 2 tokens is dealt out by context and word, so no part has to hold it whole.
4. A part adds up its bigrams and evaluates each token: a seen bigram needs only its count, an unseen one goes on to the word's
   count. The n-grams, the hot contexts' sums and the documents' shares are written as one table, partitioned by kind. Discounts are not
   known yet, so a share holds how many tokens met a bigram of count 1, 2 and so on. A hot context's total is its word's count.
5. With the counts of counts, each share becomes a number; unseen bigrams of hot contexts are joined with their summed contexts.

Only the counts of counts and three totals reach the driver, and nothing is broadcast.

Null and empty texts are one end token. Each row is scored by itself, also where ids repeat. A null id is a training row.
An empty table gives an empty result; without training rows N and V are 0 and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import give_back, mix, remainder, words
from kerbline.runtime import materialise, release, scratch

MAX_DISCOUNT, BLOCK_TOKENS, PART_TOKENS, PARTS_PER_TASK, RESERVE_FROM = 5, 3 << 19, 5 << 18, 6, 1000
_START, _END = np.uint64(11400714819323198485), np.uint64(17004003032668640649)
_STEP = np.uint64(0xD6E8FEB86659FD93)
NGRAM, CONTEXT, SHARE, UNSEEN, FACT, COUNTED = "ngram", "context", "share", "unseen", "fact", "counted"
_TABLE = "kind string, uid bigint, doc_id bigint, held_out boolean, w1 bigint, w2 bigint, n bigint, c1 bigint, big bigint, p_seen double, fixed double, m array<bigint>, packed binary"
_ARROW = pa.schema(
    [("kind", pa.string()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64())]
    + [("c1", pa.int64()), ("big", pa.int64()), ("p_seen", pa.float64()), ("fixed", pa.float64()), ("m", pa.list_(pa.int64())), ("packed", pa.binary())]
)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in the fewest bytes that hold their largest one, and of doubles, compressed."""
    head, body = [], []
    for a in arrays.values():
        a = np.asarray(a)
        if a.dtype.kind != "f":
            a = a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)
        head += [len(a), a.itemsize if a.dtype.kind != "f" else 0]
        body.append(np.ascontiguousarray(a).tobytes())
    return zstandard.compress(b"".join([np.array(head, np.int64).tobytes(), *body]), 1)


def _unpack(data: bytes, *names: str) -> dict[str, np.ndarray]:
    """The arrays of :func:`_pack`, whole numbers as 64-bit ones."""
    raw, out = zstandard.decompress(data), {}
    at = 16 * len(names)
    for name, (n, size) in zip(names, np.frombuffer(raw, np.int64, 2 * len(names)).reshape(-1, 2).tolist()):
        kind = np.dtype(f"u{size}") if size else np.dtype(np.float64)
        a = np.frombuffer(raw, kind, n, at)
        at += a.nbytes
        out[name] = a.astype(np.int64) if 0 < size < 8 else a.view(np.int64) if size else a
    return out


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """(block, tokens, uids, ids, folds, packed, words) of at most about ``limit`` tokens each; a long document runs through several blocks.

    ``packed`` holds the tokens' places in the block's dictionary, the tokens of each document, and as marks the first token's context, the
    place of the end token and the size of the dictionary; ``words`` is the dictionary with its training counts.
    """
    uid, seq = TaskContext.get().partitionId() << 40, 0
    held: list[tuple] = []
    facts: dict[int, tuple] = {}

    def flush() -> Iterator[tuple]:
        nonlocal held, facts, seq
        if not held:
            return
        hashes, docs = (np.concatenate(x) for x in zip(*held))
        step = -(-len(hashes) // max(1, round(len(hashes) / limit)))
        for at in range(0, len(hashes), step):
            own = docs[at : at + step]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            run, names = np.diff(np.append(begin, len(own))), own[begin].tolist()
            goes_on = at > 0 and docs[at - 1] == docs[at]
            # Each block asks for the end token, whose count is that of the start mark too.
            known, place = np.unique(np.append(hashes[at : at + step], [hashes[at - 1] if goes_on else _END, _END]), return_inverse=True)
            first = place[-2] if goes_on else len(known)
            folds = [facts[d][1] for d in names]
            train = np.bincount(place[:-2], np.repeat(~np.array(folds, bool), run), minlength=len(known)).astype(np.int64)
            packed = _pack(token=place[:-2], run=run, marks=np.array([first, place[-1], len(known)]))
            yield uid + seq, len(own), names, [facts[d][0] for d in names], folds, packed, _pack(word=np.diff(known, prepend=np.uint64(0)), c=train)
            seq += 1
        held, facts = [], {}

    size = 0
    base = uid
    for batch in batches:
        ids, folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, end, hashes, first in words(batch.column(2)):
            n = np.diff(first)
            stop = np.cumsum(n + 1) - 1
            token = np.full(len(hashes) + len(n), _END)
            inside = np.ones(len(token), bool)
            inside[stop] = False
            token[inside] = hashes
            facts.update({base + r: (ids[r], folds[r]) for r in range(row, end)})
            held.append((token, base + np.repeat(np.arange(row, end), n + 1)))
            size += len(token)
            if size >= limit:
                yield from flush()
                size = 0
        base += batch.num_rows
    yield from flush()


def _source(df: DataFrame, folds: int, held: int) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "text")


_BLOCK = dict(block=pa.int64(), tokens=pa.int64(), uids=pa.list_(pa.int64()), ids=pa.list_(pa.int64()), folds=pa.list_(pa.bool_()), packed=pa.binary(), words=pa.binary())
_BLOCK_SQL = "block bigint, tokens bigint, uids array<bigint>, ids array<bigint>, folds array<boolean>, packed binary, words binary"
_NUMBERED = dict(block=pa.int64(), home=pa.int64(), packed=pa.binary(), n=pa.int64(), v=pa.int64())


def corpus_blocks(source: DataFrame, limit: int) -> DataFrame:
    """The corpus as blocks of word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, limit):
            yield _batch([block], **_BLOCK)
        give_back()

    return source.mapInArrow(run, _BLOCK_SQL)


def numbered_words(blocks: DataFrame, homes: int) -> DataFrame:
    """(block, home, packed, n, v): global numbers and training counts of each block's words that live in ``home``, in dictionary order.

    A home numbers its words by falling count, so that number = place * homes + home + 1 is small for frequent words. One row of each home
    has its number of training tokens and of distinct words in them.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                d = _unpack(data.as_py(), "word", "c")
                word = np.cumsum(d["word"].view(np.uint64))
                home = (mix(word) % np.uint64(homes)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                edge = np.searchsorted(home[order], np.arange(homes + 1))
                own = [(h, order[a:b]) for h, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if a < b]
                rows = [(block, h, _pack(word=np.diff(word[x], prepend=np.uint64(0)), at=np.diff(x, prepend=0), c=d["c"][x])) for h, x in own]
                yield _batch(rows, block=pa.int64(), home=pa.int64(), packed=pa.binary())

    def number(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), "word", "at", "c") for x in table["packed"]]
        known, at = np.unique(np.concatenate([np.cumsum(x["word"].view(np.uint64)) for x in parts]), return_inverse=True)
        count = np.bincount(at, np.concatenate([x["c"] for x in parts]), minlength=len(known)).astype(np.int64)
        home = table["home"][0].as_py()
        name = np.empty(len(known), np.int64)
        name[np.lexsort((known, -count))] = np.arange(len(known)) * homes + home + 1
        rows, start = [], 0
        for block, x in zip(table["block"].to_pylist(), parts):
            own = at[start : start + len(x["word"])]
            start += len(x["word"])
            first = not rows
            rows.append((block, home, _pack(at=x["at"], name=name[own], c=count[own]), int(count.sum()) if first else 0, int((count > 0).sum()) if first else 0))
        return pa.Table.from_batches([_batch(rows, **_NUMBERED)])

    asked = blocks.select("block", "words").mapInArrow(ask, "block bigint, home bigint, packed binary")
    return asked.groupBy("home").applyInArrow(number, "block bigint, home bigint, packed binary, n bigint, v bigint")


def _dealt(block: dict, parts: int, total: float, hot_from: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, first uid, packed triples) of a block, and a part below 0 with its documents' facts."""
    body = _unpack(block["packed"], "token", "run", "marks")
    token, run = body["token"], body["run"]
    first, end, size = body["marks"].tolist()
    # The start mark has number 0 and the place after the dictionary; there are as many as end tokens.
    size += 1
    name, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for part in block["told"]:
        x = _unpack(part, "at", "name", "c")
        own = np.cumsum(x["at"])
        name[own], count[own] = x["name"], x["c"]
    begin = np.cumsum(run) - run
    context = np.append(0, token[:-1])
    context[begin] = size - 1
    context[0] = first
    docs = np.array(block["uids"], np.int64)
    number = np.repeat(np.arange(len(docs)), run)
    held = np.array(block["folds"], bool)
    base = np.log10((count + 1) / total)
    yield -1 - block["block"], 0, _pack(
        uid=docs, doc_id=np.array([(i or 0) + (1 << 63) for i in block["ids"]], np.uint64), null=np.array([i is None for i in block["ids"]], np.uint8), held=held.astype(np.uint8),
        n_tokens=run, n_known=np.bincount(number, count[token] > 0, minlength=len(docs)).astype(np.int64), base=np.bincount(number, base[token], minlength=len(docs)),
    )
    context_size = count.copy()
    context_size[-1] = count[end]
    hot = context_size >= hot_from
    key = mix(name.astype(np.uint64))
    place = key[context]
    spread = hot[context]
    place[spread] = mix(place[spread] * _STEP + key[token[spread]])
    part = (place % np.uint64(parts)).astype(np.int64)
    # Words in the order of their numbers, so that the packed lists rise.
    rank = np.empty(size, np.int64)
    by_name = np.argsort(name)
    rank[by_name] = np.arange(size)
    outer, inner = part * size + rank[context], rank[token] * len(docs) + number
    del place, spread, part, context, token, number, body, base
    order = np.lexsort((inner, outer))
    outer, inner = outer[order], inner[order]
    del order
    new = np.flatnonzero(np.append(True, (outer[1:] != outer[:-1]) | (inner[1:] != inner[:-1])))
    n = np.diff(np.append(new, len(outer)))
    part, context = np.divmod(outer[new], size)
    token, number = np.divmod(inner[new], len(docs))
    low = int(docs[0])
    doc = (docs[number] - low) * 2 + held[number]
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist()):
        begin = np.flatnonzero(np.append(True, context[a + 1 : b] != context[a : b - 1])) + a
        w1 = by_name[context[begin]]
        known, place = np.unique(token[a:b], return_inverse=True)
        w2 = by_name[known]
        yield int(part[a]), low, _pack(
            w1=np.diff(name[w1], prepend=0), hot=np.where(hot[w1], context_size[w1], 0), run=np.diff(np.append(begin, b)),
            w2=np.diff(name[w2], prepend=0), c2=count[w2], token=place, doc=doc[a:b], n=n[a:b],
        )


_PART = ("w1", "hot", "run", "w2", "c2", "token", "doc", "n")
_FACT = ("uid", "doc_id", "null", "held", "n_tokens", "n_known", "base")


def _rows(kind: str, size: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array([kind] * size, pa.string()) if f.name == "kind" else columns.get(f.name, pa.nulls(size, f.type)) for f in _ARROW]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, _ARROW)], schema=_ARROW)


def _fives(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.astype(np.int64).ravel()), MAX_DISCOUNT).cast(pa.list_(pa.int64()))


def _narrow(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The record arrays of a piece as 32-bit numbers."""
    return arrays | {k: arrays[k].astype(np.int32) for k in ("run", "token", "doc", "n")}


class Shares:
    """The documents' shares of several parts, added up until they are many."""

    def __init__(self, most: int = 1 << 20):
        self.held, self.size, self.most = [], 0, most

    def add(self, docs: np.ndarray, fixed: np.ndarray, hist: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((docs, fixed, hist))
        self.size += len(docs)
        if self.size > 2 * self.most:
            self._merge()
            if self.size > self.most:
                yield from self.flush()

    def _merge(self) -> None:
        docs, at = np.unique(np.concatenate([d for d, _, _ in self.held]), return_inverse=True)
        fixed = np.bincount(at, np.concatenate([f for _, f, _ in self.held]), minlength=len(docs))
        hist = np.concatenate([h for _, _, h in self.held])
        self.held = [(docs, fixed, np.stack([np.bincount(at, hist[:, k], minlength=len(docs)) for k in range(MAX_DISCOUNT)], axis=1))]
        self.size = len(docs)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            docs, fixed, hist = self.held[0]
            yield _rows(SHARE, len(docs), uid=docs, fixed=fixed, m=_fives(hist))
            self.held, self.size = [], 0


def _facts(data: bytes) -> pa.RecordBatch:
    f = _unpack(data, *_FACT)
    ids = pa.array((f["doc_id"].view(np.uint64) - np.uint64(1 << 63)).view(np.int64), mask=f["null"].astype(bool))
    return _rows(FACT, len(f["uid"]), uid=f["uid"], doc_id=ids, held_out=f["held"].astype(bool), n=f["n_tokens"], c1=f["n_known"], fixed=f["base"])


def _evaluate(first: list[int], packed: list[bytes], n_words: float, reserve_from: int, shares: Shares) -> Iterator[pa.RecordBatch]:
    """N-grams, contexts and shares of one part. ``n_words`` is N + V + 1."""
    out = []
    pieces = [_narrow(_unpack(d, *_PART)) for d in packed]
    join = lambda f: np.concatenate([f(x, low) for x, low in zip(pieces, first)])
    w1, at1 = np.unique(join(lambda x, _: np.cumsum(x["w1"])), return_inverse=True)
    w2, at2 = np.unique(join(lambda x, _: np.cumsum(x["w2"])), return_inverse=True)
    c2, size = np.zeros(len(w2), np.int64), np.zeros(len(w1), np.int64)
    c2[at2], size[at1] = join(lambda x, _: x["c2"]), join(lambda x, _: x["hot"])
    hot = size > 0
    off2 = np.cumsum([0, *(len(x["w2"]) for x in pieces)])
    at1, at2 = at1.astype(np.int32), at2.astype(np.int32)
    context = np.repeat(at1, join(lambda x, _: x["run"]))
    word = np.concatenate([at2[x["token"] + o] for x, o in zip(pieces, off2)])
    docs = np.unique(np.concatenate([np.unique(x["doc"]) // 2 + np.int64(low) for x, low in zip(pieces, first)]))
    doc = np.concatenate([np.searchsorted(docs, x["doc"] // 2 + np.int64(low)).astype(np.int32) for x, low in zip(pieces, first)])
    trains = join(lambda x, _: x["doc"] % 2 == 0)
    n = join(lambda x, _: x["n"])
    del pieces, at1, at2
    key = context.astype(np.int64) * len(w2) + word
    order = np.argsort(key, kind="stable")
    start = key[order]
    start = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
    del key
    context, word, doc, trains, n = (x[order] for x in (context, word, doc, trains, n))
    del order
    r_all = r = np.add.reduceat(np.where(trains, n, 0), start, dtype=np.int64)
    runs = np.diff(np.append(start, len(context)))
    count = np.repeat(r.astype(np.int32), runs)
    # Contexts over the bigrams seen in training.
    seen = r > 0
    v, w, r = context[start][seen], word[start][seen], r[seen]
    p = (c2 + 1) / n_words
    some = r <= MAX_DISCOUNT
    per = lambda weight=None, pick=slice(None): np.bincount(v[pick], None if weight is None else weight[pick], minlength=len(w1))
    c1, big, p_seen = per(r).astype(np.int64), per(np.where(some, 0, r)).astype(np.int64), per(p[w])
    m = np.stack([per(pick=r == k) for k in range(1, MAX_DISCOUNT + 1)], axis=1)
    # A hot context is in several parts; its total is its word's count.
    whole = np.where(hot, size, c1)
    whole = whole + (hot | (whole >= reserve_from) | (big == c1))
    # The part's n-gram table: contexts, how many words each was seen with, the words and the counts.
    held, run = np.unique(v, return_counts=True)
    packed = _pack(w1=np.diff(w1[held], prepend=0), run=run, w2=w2[w], r=r)
    out.append(_rows(NGRAM, 1, n=np.array([len(r)]), packed=pa.array([packed], pa.binary())))
    held = held[hot[held]]
    out.append(_rows(CONTEXT, len(held), w1=w1[held], c1=c1[held], big=big[held], p_seen=p_seen[held], m=_fives(m[held])))
    counts = np.bincount(np.minimum(r, MAX_DISCOUNT + 2), minlength=MAX_DISCOUNT + 3)[1 : MAX_DISCOUNT + 2]
    out.append(_rows(COUNTED, MAX_DISCOUNT + 1, c1=np.arange(1, MAX_DISCOUNT + 2), n=counts))
    # Tokens: a seen bigram by its count, an unseen one by its word and its context's weight.
    met = count > 0
    of_count = np.log10(np.maximum(r_all, 1)) * (r_all > MAX_DISCOUNT)
    of_context = np.log10(np.maximum(whole, 1))
    fixed = np.log10(p)[word]
    fixed[met] = np.repeat(of_count, runs)[met] - of_context[context[met]]
    fixed *= n
    hist = np.stack([np.bincount(doc, np.where(count == k, n, 0), minlength=len(docs)) for k in range(1, MAX_DISCOUNT + 1)], axis=1)
    yield from shares.add(docs, np.bincount(doc, fixed, minlength=len(docs)), hist)
    pick = ~met & (hot[context] | (c1[context] > 0))
    pair, n_pair = np.unique(context[pick].astype(np.int64) * len(docs) + doc[pick], return_inverse=True)
    times = np.bincount(n_pair, n[pick], minlength=len(pair)).astype(np.int64)
    x, d = np.divmod(pair, max(1, len(docs)))
    there = pa.array(hot[x])
    own = dict(c1=c1[x], big=big[x], p_seen=p_seen[x], m=_fives(m[x]))
    masked = {k: pa.compute.if_else(there, pa.nulls(len(x), _ARROW.field(k).type), a if isinstance(a, pa.Array) else pa.array(a)) for k, a in own.items()}
    out.append(_rows(UNSEEN, len(x), uid=docs[d], w1=w1[x], n=times, **masked))
    yield from out


def discounts(counts: dict[int, int], limit: int = MAX_DISCOUNT) -> list[float]:
    """Good-Turing discounts of the counts 1 to ``limit`` from the counts of counts."""
    tail = (limit + 1) * counts.get(limit + 1, 0) / counts[1] if counts.get(1) else 1.0
    out = []
    for r in range(1, limit + 1):
        d = 0.0
        if counts.get(r) and tail < 1:
            d = ((r + 1) * counts.get(r + 1, 0) / (r * counts[r]) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def fit_and_share(df: DataFrame, target: str, folds: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS, reserve_from: int = RESERVE_FROM) -> tuple[int, int]:
    """Write the model's tables and the documents' shares below ``target``, by kind; returns N and V."""
    blocks = materialise(corpus_blocks(_source(df, folds, held), block_tokens), "katz-blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = max(df.sparkSession.sparkContext.defaultParallelism * 2, -(-tokens // part_tokens))
    numbered = materialise(numbered_words(blocks, parts), "katz-words")
    n, v = numbered.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    total = float(n + v + 1)
    told = numbered.groupBy("block").agg(F.collect_list("packed").alias("told"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                for dealt in _dealt(batch.slice(at, 1).to_pylist()[0], parts, total, max(part_tokens // 2, reserve_from)):
                    yield _batch([dealt], part=pa.int64(), first=pa.int64(), packed=pa.binary())
        give_back()

    packed = blocks.drop("tokens", "words").join(told, "block").mapInArrow(deal, "part bigint, first bigint, packed binary")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by part; one part is held at a time.
        shares, part, first, held = Shares(), -1, [], []
        for batch in batches:
            for p, low, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p < 0:
                    yield _facts(data.as_py())
                    continue
                if p != part and held:
                    yield from _evaluate(first, held, total, reserve_from, shares)
                    first, held = [], []
                part = p
                first.append(low)
                held.append(data.as_py())
        if held:
            yield from _evaluate(first, held, total, reserve_from, shares)
        yield from shares.flush()
        del first, held
        give_back()

    # A task goes through several parts and adds up its documents' shares over them.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-parts // PARTS_PER_TASK))
    found = packed.repartition(tasks, F.xxhash64("part")).sortWithinPartitions("part").mapInArrow(evaluate, _TABLE)
    found.write.option("compression", "zstd").partitionBy("kind").parquet(target)
    release(blocks, numbered)
    return n, v


def ngrams(spark: SparkSession, target: str) -> DataFrame:
    """(w1, w2, n): the stored bigrams by word numbers; 0 is the start mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = _unpack(data.as_py(), "w1", "run", "w2", "r")
                yield pa.RecordBatch.from_arrays([np.repeat(np.cumsum(x["w1"]), x["run"]), x["w2"], x["r"]], ["w1", "w2", "n"])

    table = spark.read.schema("packed binary, kind string").parquet(target).where(F.col("kind") == NGRAM)
    return table.select("packed").mapInArrow(run, "w1 bigint, w2 bigint, n bigint")


def scores(spark: SparkSession, target: str, reserve_from: int = RESERVE_FROM) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) from the tables below ``target``."""
    fields = _TABLE.removeprefix("kind string, ")
    table = spark.read.schema(f"{fields}, kind string").parquet(target)
    of = lambda kind: table.where(F.col("kind") == kind)
    counts = {r["c1"]: r["n"] for r in of(COUNTED).groupBy("c1").agg(F.sum("n").alias("n")).collect()}
    kept = [r * d for r, d in enumerate(discounts(counts), 1)]
    total = lambda values: sum((F.col("m")[k] * F.lit(float(x)) for k, x in enumerate(values)), F.lit(0.0))
    mass = F.col("big") + total(kept)
    whole = F.col("c1") + F.when((F.col("big") == F.col("c1")) | (F.col("c1") >= reserve_from), 1.0).otherwise(0.0)
    weight = F.log10((1 - mass / whole) / (1 - F.col("p_seen")))
    shares = of(SHARE).select("uid", (F.col("fixed") + total(np.log10(kept))).alias("score"))
    unseen = of(UNSEEN).where("c1 is not null").select("uid", (F.col("n") * weight).alias("score"))
    # Hot contexts lie in several parts: their sums are joined with what the documents need of them.
    hot = of(UNSEEN).where("c1 is null").select("uid", "w1", "n")
    sums = [F.sum(c).alias(c) for c in ("c1", "big", "p_seen")]
    each = F.array(*[F.sum(F.col("m")[k]) for k in range(MAX_DISCOUNT)]).alias("m")
    wanted = of(CONTEXT).join(hot.select("w1").distinct(), "w1", "left_semi").groupBy("w1").agg(*sums, each)
    told = hot.join(wanted.select("w1", weight.alias("weight")), "w1", "left").select("uid", F.coalesce(F.col("n") * F.col("weight"), F.lit(0.0)).alias("score"))
    score = shares.unionAll(unseen).unionAll(told).groupBy("uid").agg(F.sum("score").alias("score"))
    facts = of(FACT).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("c1").alias("n_known"), F.sum("fixed").alias("base_score")
    )
    return facts.join(score, "uid", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).drop("uid")


def katz_scores(df: DataFrame, folds: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS, reserve_from: int = RESERVE_FROM) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    target = scratch(df.sparkSession, "katz")
    n, _ = fit_and_share(df, target, folds, held, block_tokens, part_tokens, reserve_from)
    out = scores(df.sparkSession, target, reserve_from).withColumn("train_tokens", F.lit(n).cast("bigint"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
