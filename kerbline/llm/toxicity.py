"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed lexicon and of a lexicon learnt from the training labels, their proximity to second-person
words, shares of capitals, punctuation, exclamation marks and obfuscated words, and the length. The learnt lexicon comes from
document counts per word and label, aggregated on the executors: words in at least ``LEAST_SHARE`` of the toxic training documents, which
bounds their number, that are ``ODDS`` times as frequent there. At most ``max_train`` labelled documents (first by hash
of the key) fit the trees; the rows that reach the driver are feature vectors only. Calibration uses out-of-fold scores of trees whose lexicon
is learnt without the fold, too.

Empty and null texts are scored like any other (all densities 0). Without labels of both kinds every score is the smoothed share of
toxic labels. Repeated rows are scored one by one; in training a key counts once, with its smallest text, as toxic if any of its labels is 1.
Rows with a null key are scored and never train. Extra columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import remainder
from kerbline.llm.vocab import chunks, trim
from kerbline.runtime import materialise, release

MAX_TRAIN = 20_000
LEAST_SHARE, ODDS, FOLDS = 0.03, 8.0, 5
CUT = 0.7
INSULTS = frozenset("idiot moron stupid dumb scum trash garbage loser pathetic worthless clown fool imbecile disgusting filth vermin creep jerk hate kill".split())
SECOND = frozenset("you your yours yourself du dich dir dein deine tu te toi ton tes vous votre usted tú ti vos".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = string.punctuation + "«»“”„…"
_NEAR = 6
#: Bits of a word's classes; the learnt lexicons take the bits from ``_LEARNT`` on.
_FIXED, _YOU, _OBSCURED, _LEARNT = 1, 2, 4, 8


def plain(word: str) -> tuple[str, bool]:
    """The word in lower case without edge punctuation, and whether it was spelt with other signs inside."""
    bare = word.strip(_EDGE).lower()
    if bare.isalpha():
        return bare, False
    core = word.lower().strip(".,;:?\"'()[]")
    letters = "".join(c for c in core.translate(_LEET) if c.isalpha())
    return (letters, True) if any(c.isalpha() for c in core) and letters != bare else (bare, False)


class Features:
    """Dense features of texts under one lexicon or several; word classes are remembered."""

    names = ("fixed", "learnt", "fixed_n", "learnt_n", "near", "you", "obscured", "capitals", "punctuation", "exclaim", "length")

    def __init__(self, *lexicons: frozenset[str]):
        self.lexicons, self.cache = lexicons, {}

    def code(self, word: str) -> int:
        got = self.cache.get(word)
        if got is None:
            base, odd = plain(word)
            got = _FIXED * (base in INSULTS) | _YOU * (base in SECOND) | _OBSCURED * odd
            for k, lexicon in enumerate(self.lexicons):
                got |= (_LEARNT << k) * (base in lexicon)
            self.cache[word] = got
        return got

    def of(self, text: str | None) -> list[float]:
        """The features under each lexicon, one after another."""
        text = text or ""
        codes = np.concatenate([np.zeros(0, np.uint16), *(np.fromiter(map(self.code, part.split()), np.uint16) for part in chunks(text))])
        trim(self.cache)
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        n, size = max(len(codes), 1), max(len(data), 1)
        fixed, you = np.count_nonzero(codes & _FIXED), np.flatnonzero(codes & _YOU)
        kind = np.bincount(data, minlength=256)
        marks = sum(int(kind[ord(c)]) for c in string.punctuation)
        rest = [len(you) / n, np.count_nonzero(codes & _OBSCURED) / n, int(kind[65:91].sum()) / size, marks / size, int(kind[33]) / size, np.log1p(n)]
        out = []
        for k in range(len(self.lexicons)):
            learnt, bad, near = np.count_nonzero(codes & (_LEARNT << k)), np.flatnonzero(codes & (_FIXED | _LEARNT << k)), 0
            if len(bad) and len(you):
                right = np.searchsorted(you, bad)
                gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - bad), np.abs(you[np.maximum(right - 1, 0)] - bad))
                near = np.count_nonzero(gap <= _NEAR)
            out += [fixed / n, learnt / n, fixed, learnt, near / n, *rest]
        return out


class Trees:
    """Boosted regression trees on binned features with logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def _grow(self, binned: np.ndarray, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, minlength=self.bins))[:-1] for w in (grad[rows], hess[rows], None))
                fit = (ns >= self.least) & (len(rows) - ns >= self.least)
                gain = np.where(fit, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            return self.rate * g / (h + 1)
        left = binned[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(binned, rows[left], grad, hess, depth - 1), self._grow(binned, rows[~left], grad, hess, depth - 1)

    def _apply(self, node, binned: np.ndarray) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(binned), node)
        return np.where(binned[:, node[0]] <= node[1], self._apply(node[2], binned), self._apply(node[3], binned))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        # Sparse counts: quantiles of the positive values, and zero as an edge of its own.
        self.edges = [np.unique(np.append(0.0, np.quantile(c[c > 0], steps)))[: self.bins - 1] if (c := x[:, f]).max(initial=0) > 0 else np.zeros(1) for f in range(x.shape[1])]
        binned, self.trees = self._bin(x), []
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.start = np.log(rate / (1 - rate))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, np.arange(len(y)), y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            score += self._apply(tree, binned)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.start + sum(self._apply(t, binned) for t in self.trees)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit as (positions, values) for interpolation."""
    x, where = np.unique(score, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, y) / weight
    blocks: list[list[float]] = []
    for at, m, w in zip(x, mean, weight):
        blocks.append([m, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, hi = blocks.pop()
            m1, w1, lo, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    pos = np.array([p for b in blocks for p in (b[2], b[3])])
    val = np.array([b[0] for b in blocks for _ in (0, 1)])
    return pos, val


class Model:
    """Lexicon, trees and calibration. ``x`` are the features under the full lexicon, ``x_out`` those under the lexicon without the row's fold's labels."""

    def __init__(self, lexicon: frozenset[str], x: np.ndarray, x_out: np.ndarray, fold: np.ndarray, y: np.ndarray):
        self.lexicon, self.rate = lexicon, (y.sum() + 0.5) / (len(y) + 1)
        self.trees = None
        if len(set(y.tolist())) < 2:
            return
        out = np.zeros(len(y))
        for k in np.unique(fold):
            rest = fold != k
            out[~rest] = Trees().fit(x_out[k, rest], y[rest]).score(x_out[k, ~rest])
        self.trees, self.curve = Trees().fit(x, y), isotonic(out, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.rate)
        return np.clip(np.interp(self.trees.score(x), *self.curve), 0, 1)


def choose(words: list[str], bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> frozenset[str]:
    """The words that are frequent in toxic documents and much rarer in others."""
    odds = ((bad + 0.1) / (n_bad + 0.2)) / ((good + 0.1) / (n_good + 0.2))
    return frozenset(w for w, keep in zip(words, (bad >= max(4, LEAST_SHARE * n_bad)) & (odds > ODDS)) if keep)


def learn(docs: DataFrame, labels: DataFrame, rows: Column, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled ``rows`` (a condition on doc_id)."""
    marks = labels.where(rows & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = materialise(texts.select("doc_id", F.col("toxic").cast("int").alias("toxic"), fold, "text"), "toxic-train")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = {b for part in chunks(text or "") for w in part.split() if len(b := plain(w)[0]) > 2}
                found.add("")
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([toxic] * len(found), pa.int32()), pa.array([k] * len(found), pa.int32())], ["word", "toxic", "fold"])

    seen = train.select("toxic", "fold", "text").mapInArrow(words, "word string, toxic int, fold int")
    of = lambda k, bad: F.count_if((F.col("fold") == k) & (F.col("toxic") == bad))
    table = seen.groupBy("word").agg(*(of(k, 1).alias(f"bad{k}") for k in range(FOLDS)), *(of(k, 0).alias(f"good{k}") for k in range(FOLDS)))
    bad_all = sum((F.col(f"bad{k}") for k in range(FOLDS)), F.lit(0))
    # Only words frequent enough under some fold's absence are looked at: a document has few words, so their number is bounded.
    least = train.agg(F.count_if(F.col("toxic") == 1)).first()[0]
    counted = table.where((F.col("word") == "") | (bad_all >= max(4, LEAST_SHARE * least * (1 - 2 / FOLDS)))).toPandas()
    bad, good = (counted[[f"{n}{k}" for k in range(FOLDS)]].to_numpy(float) for n in ("bad", "good"))
    names = counted["word"].tolist()
    empty = names.index("") if "" in names else None
    n_bad, n_good = (x[empty] if empty is not None else np.zeros(FOLDS) for x in (bad, good))
    inner = [i for i, n in enumerate(names) if n]
    listed = [names[i] for i in inner]
    without = lambda k: choose(listed, *(x[inner].sum(1) - (x[inner, k] if k is not None else 0) for x in (bad, good)), *(x.sum() - (x[k] if k is not None else 0) for x in (n_bad, n_good)))
    lexicon, others = without(None), [without(k) for k in range(FOLDS)]
    sample = featurise(train, [lexicon, *others], ["doc_id", "toxic", "fold"]).toPandas().sort_values("doc_id")
    release(train)
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), 1 + FOLDS, len(Features.names)).transpose(1, 0, 2)
    return Model(lexicon, x[0], x[1:], sample["fold"].to_numpy(int), sample["toxic"].to_numpy(float))


def featurise(df: DataFrame, lexicons: list[frozenset[str]], keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``x``: the features under each of the lexicons, one after another."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Features(*lexicons)
        for batch in batches:
            rows = [maker.of(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])

    return df.select(*keep, F.col("text")).mapInArrow(run, schema)


def predict(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    # A text that is kept isn't sent twice.
    source = df.select(*keep) if "text" in keep else df.select(*keep, "text")
    place = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        maker = Features(fitted.lexicon)
        for batch in batches:
            x = np.array([maker.of(t) for t in batch.column(place).to_pylist()], float).reshape(-1, len(Features.names))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fitted.score(x))], [*keep, "score"])

    scored = source.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from labels of rows whose crc32(doc_id) modulo ``folds`` isn't 1."""
    fitted = learn(docs, labels, remainder("doc_id", folds) != 1)
    return predict(docs, fitted, ["doc_id"]).select("doc_id", F.coalesce(remainder("doc_id", folds) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
