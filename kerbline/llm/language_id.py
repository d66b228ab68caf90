"""Language identification by multinomial naive Bayes over hashed character n-grams.

Features are the 1-, 2- and 3-grams of the lower-cased code points, hashed to ``BUCKETS`` buckets. Training sums
bucket counts per language: at most buckets x languages numbers leave the executors. The log-probability matrix of
that bounded size is broadcast. A batch of texts is one sparse matrix in row form (the buckets of all n-grams, one entry each, and where each
text's begin), whose product with the matrix is summed text by text in numpy. A language's prior is
uniform, so that the source mix of the corpus doesn't sway short texts.

Texts are read in pieces that overlap by two code points, so n-grams are those of the whole text. A text that is null or has no letter is
``und`` with score 0. Without any training row every text is ``und``. Ties go to the
first language in sorted order. Rows whose ``lang`` is null teach nothing; rows with a null key are training rows. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import mix, remainder
from kerbline.llm.vocab import groups

BUCKETS = 1 << 15
PIECE = 1 << 20
UNKNOWN = "und"
_GAP = 32


def _buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each code point but the last two, which are only looked ahead to."""
    p = points.astype(np.uint64)
    gram = p[:-2] + np.uint64(1)
    yield (mix(gram) % np.uint64(BUCKETS)).astype(np.int64)
    for ahead in (p[1:-1], p[2:]):
        gram = gram << np.uint64(21) | ahead
        yield (mix(gram) % np.uint64(BUCKETS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer((text.lower() + chr(_GAP) * 2).encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of ``PIECE`` starts, each with the two code points after it."""
    for at in range(0, len(points) - 2, PIECE):
        yield points[at : at + PIECE + 2]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(df: DataFrame, rows: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and the (buckets, languages) matrix of log probabilities, from the ``rows`` of ``df``."""
    labelled = df.where(rows & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for points in _pieces(_points(value)):
                    for bucket in _buckets(points):
                        total += np.bincount(bucket, minlength=BUCKETS)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])], ["lang", "bucket", "n"])

    counted = labelled.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counted["lang"].unique())
    place = {n: i for i, n in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    counts[counted["bucket"].to_numpy(int), counted["lang"].map(place).to_numpy(int)] = counted["n"].to_numpy(float)
    return names, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))


def _scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """(texts, languages) sums of log probabilities: rows of the sparse matrix times ``weights``."""
    rows = [_points(t) for t in texts]
    size = np.array([len(r) - 2 for r in rows], np.int64)
    total = np.zeros((len(texts), weights.shape[1]))
    # Short texts go in runs of about a piece, each row after the other; a long one piece by piece.
    run = (np.cumsum(size) - size) // PIECE
    columns = [np.ascontiguousarray(weights[:, k]) for k in range(weights.shape[1])]
    for r in np.unique(run):
        own = np.flatnonzero((run == r) & (size > 0) & (size <= PIECE))
        if len(own):
            points = np.concatenate([rows[i] for i in own])
            # The two signs after a text start no n-gram.
            starts = np.cumsum(size[own] + 2) - size[own] - 2
            counts = np.ones(len(points) - 2, bool)
            ends = (starts + size[own])[:-1]
            counts[ends] = counts[ends + 1] = False
            place = np.cumsum(size[own]) - size[own]
            for bucket in _buckets(points):
                index = bucket[counts]
                for k, column in enumerate(columns):
                    total[own, k] += np.add.reduceat(column[index], place)
        for i in np.flatnonzero((run == r) & (size > PIECE)):
            for points in _pieces(rows[i]):
                for bucket in _buckets(points):
                    total[i] += np.bincount(bucket, minlength=BUCKETS) @ weights
    return total


def predict(df: DataFrame, names: list[str], weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of ``df`` with ``lang_pred`` and the posterior ``score`` of that language."""
    model = df.sparkSession.sparkContext.broadcast((names, weights))
    # A text that is kept isn't sent twice.
    source = df.select(*keep) if text in keep else df.select(*keep, text)
    place = source.columns.index(text)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix = model.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            langs, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in groups(texts):
                rows = [i for i in range(a, b) if labels and has_letter(texts[i])]
                if not rows:
                    continue
                total = _scores([texts[i] for i in rows], matrix)
                best = total.argmax(1)
                sure[rows] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i, k in zip(rows, best):
                    langs[i] = labels[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs), pa.array(sure)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def language_id(df: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """(key, held_out, lang_pred, score), learnt from the rows whose crc32(key) modulo ``folds`` isn't 0."""
    held = F.coalesce(remainder(key, folds) == 0, F.lit(False))
    names, weights = learn(df, ~held)
    return predict(df, names, weights, [key]).select(key, held.alias("held_out"), "lang_pred", "score")
