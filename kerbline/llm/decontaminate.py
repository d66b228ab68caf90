"""Benchmark decontamination by template canonicalisation.

Words become literals (lower-cased, without edge punctuation) or typed placeholders: numbers, units and names (capitalised words inside a
sentence). A capitalised word also has the reading as a literal, and one that opens a sentence that as a name, so each window has all
readings of its capitalised words. Windows of ``WINDOW`` template words are hashed and joined with the benchmark's; a benchmark window is matched
if one of its readings is. A matched window counts only if its slots are filled consistently, inside the window and over the whole match: a value of the item
stands for one value of the document and the other way round. Where windows disagree, the longest run of windows at one distance
decides, so two copies with other values don't spoil each other. Windows of fewer than ``MIN_LITERALS`` literals are matched on their exact words. A document is contaminated
by an item if consistent windows cover ``SHARE`` of the item's distinct windows, with or without the exact ones, or if ``RUN`` of them lie in the
document; so re-parameterised questions are caught and common phrases are not.

The benchmark's window hashes are broadcast as a filter only up to ``MAX_BROADCAST`` of them; beyond it all windows go through the join.
Null and empty texts have no windows and are clean; an item shorter than a window is one window,
and documents have windows of all widths that items have. Items without words match nothing.
Rows of one id are judged together; a row with a null id stays. Empty tables give clean or empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import hash_runs, mix
from kerbline.llm.vocab import CACHE_WORDS, Numbers, groups
from kerbline.runtime import materialise

WINDOW, SHARE, RUN, MAX_BROADCAST, MIN_LITERALS = 5, 0.8, 13, 2_000_000, 2
UNITS = frozenset("mm cm km ft mi mile miles g kg mg lb lbs oz ml sec seconds min minute minutes hour hours day days week weeks month months year years $ € £ usd eur dollar dollars euro euros cent cents percent %".split())
_EDGE = "\"'()[]{}.,;:!?«»“”„…*#&%$-–—_/\\|<>=+~`^"
_LITERAL, _NUMBER, _UNIT, _NAME = range(4)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_KINDS = mix(np.arange(1, 5, dtype=np.uint64) * _STEP)
_EXACT = np.uint64(0xA24BAED4963EE407)
_PLACES = mix(np.arange(11, 11 + WINDOW, dtype=np.uint64) * _STEP) | np.uint64(1)


def _codes(texts: list[str]) -> np.ndarray:
    """64-bit hashes of texts, by their bytes."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum(list(map(len, raw)))
    data, size = np.frombuffer(b"".join(raw), np.uint8), np.diff(ends, prepend=0)
    out = np.zeros(len(raw), np.uint64)
    full = np.flatnonzero(size)
    out[full] = hash_runs(data, ends[full] - size[full], ends[full])
    return out


def classify(word: str) -> tuple[int, str, bool, bool]:
    """(kind, text that tells its value, capitalised, ends a sentence) of a word; kind -1 for signs only."""
    if word.isalpha() and (low := word.lower()) not in UNITS:
        return _LITERAL, low, word[0].isupper() and not word.isupper(), False
    low, core = word.lower(), word.strip(_EDGE)
    ends = word.rstrip("\"')]»”")[-1:] in {".", "!", "?", ":"}
    inner = core.lower()
    if low in UNITS or inner in UNITS and len(core) > 1:
        return _UNIT, inner or low, False, ends
    if not core:
        return -1, "", False, ends
    if core[0].isdigit():
        return _NUMBER, inner, False, ends
    return _LITERAL, inner, core[0].isupper() and not core.isupper(), ends


class WordTable:
    """What :func:`classify` says of the words met so far, as arrays."""

    def __init__(self) -> None:
        self.place = Numbers()
        self.columns = [np.zeros(0, t) for t in (np.int8, np.uint64, bool, bool)]

    def look_up(self, words: list[str]) -> list[np.ndarray]:
        """(kind, value, capitalised, ends a sentence) of each word."""
        if len(self.place) > CACHE_WORDS:
            self.__init__()
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.fresh:
            kind, texts, capital, ends = zip(*map(classify, self.place.fresh))
            self.columns = [np.append(c, np.asarray(f, c.dtype)) for c, f in zip(self.columns, (kind, _codes(texts), capital, ends))]
            self.place.fresh = []
        return [c[at] for c in self.columns]


def _patterns(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Slot pattern of the windows in the rows of ``kind`` and ``value``: each slot names the first slot of the same value."""
    pattern = np.zeros(len(kind), np.int64)
    for k in range(kind.shape[1]):
        same = np.full(len(kind), k)
        for j in range(k - 1, -1, -1):
            same = np.where((kind[:, j] == kind[:, k]) & (value[:, j] == value[:, k]), j, same)
        pattern = pattern * 8 + np.where(kind[:, k] != _LITERAL, same + 1, 0)
    return pattern


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Bits of ``values`` from each place on, the first one lowest."""
    n = len(values) - width + 1
    out = np.zeros(n, np.uint8)
    for k in range(width):
        out |= values[k : n + k].astype(np.uint8) << np.uint8(k)
    return out


def windows(texts: list[str | None], table: WordTable, only: np.ndarray | None = None, widths: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """(text number, width, exact, window, template hash, slot pattern, place, slot values) of the readings of each text's windows.

    A reading takes some of the window's capitalised words as literals and the others as names. Windows are told apart by the
    reading that takes those that open a sentence as literals; ``exact`` is 1 where that has too few literals, and such windows
    are told apart by their words. ``only`` is a sorted array of the templates to keep. A text has windows of each of
    ``widths``, by default of ``WINDOW`` words or one of all its words.
    """
    words, size = [], np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        before = len(words)
        words += (text or "").split()
        size[at] = len(words) - before
    kind, value, capital, ends = table.look_up(words)
    doc = np.repeat(np.arange(len(texts)), size)
    opens = np.append(True, doc[1:] != doc[:-1])[: len(doc)] | np.append(True, ends[:-1])[: len(doc)]
    full = kind >= 0
    doc, value, kind, capital, opens = doc[full], value[full], kind[full], capital[full], opens[full]
    kind[capital] = _NAME
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    literal = mix(value)
    token = np.where(kind == _LITERAL, literal, _KINDS[kind])
    shift = literal - _KINDS[_NAME]
    out = []
    for width in np.unique(np.minimum(count, WINDOW)).tolist() if widths is None else widths:
        n = len(doc) - width + 1
        if not width or n < 1:
            continue
        start = np.flatnonzero(doc[:n] == doc[width - 1 :]) if width == WINDOW or widths is not None else first[count == width]
        base = np.zeros(n, np.uint64)
        for k in range(width):
            base += token[k : n + k] * _PLACES[k]
        base, names, opening = base[start], _rolled(capital, width)[start], _rolled(capital & opens, width)[start]
        literals = np.bitwise_count(_rolled(kind == _LITERAL, width)[start])
        least = min(MIN_LITERALS, width)
        counted = literals + np.bitwise_count(opening) >= least
        named = np.flatnonzero(names)
        bare = literals + np.bitwise_count(names) < least
        for reading in [*range(1 << width), None]:
            read = range(width) if reading is None else [k for k in range(width) if reading >> k & 1]
            if reading is None:
                # No reading has enough literals: the words themselves.
                at = np.flatnonzero(bare)
                template = np.full(len(at), _EXACT)
                for k in read:
                    template = template + literal[start[at] + k] * _PLACES[k]
            else:
                at = named[names[named] & reading == reading] if reading else np.arange(len(start))
                at = at[literals[at] + len(read) >= least]
                template = base[at]
                for k in read:
                    template = template + shift[start[at] + k] * _PLACES[k]
            template = template.view(np.int64)
            if only is not None:
                kept = only[np.minimum(np.searchsorted(only, template), len(only) - 1)] == template if len(only) else np.zeros(len(at), bool)
                at, template = at[kept], template[kept]
            if not len(at):
                continue
            spot = start[at][:, None] + np.arange(width)
            kinds, values = kind[spot], value[spot]
            exact = ~counted[at]
            usual = np.where((opening[at][:, None] >> np.arange(width)) & 1, _LITERAL, kinds)
            usual[exact] = _LITERAL
            window = np.where(usual == _LITERAL, literal[spot], _KINDS[usual]) * _PLACES[:width]
            window = mix(window.sum(axis=1, dtype=np.uint64) + _patterns(usual, values).view(np.uint64) * _STEP)
            kinds[:, read] = _LITERAL
            slots = np.zeros((WINDOW, len(at)), np.int64)
            slots[:width] = np.where(kinds == _LITERAL, 0, values.view(np.int64)).T
            place = start[at] - first[doc[start[at]]]
            out.append(np.stack([doc[start[at]], np.full(len(at), width), exact, window.view(np.int64), template, _patterns(kinds, values), place, *slots]))
    rows = np.concatenate(out, axis=1) if out else np.zeros((7 + WINDOW, 0), np.int64)
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))[: rows.shape[1]]
    return tuple(rows[:, new])


def _window_rows(df: DataFrame, key: str, only: np.ndarray | None = None, widths: list[int] | None = None) -> DataFrame:
    """(uid, key, width, exact, window, template, pattern, place, slots) of the readings of every row's windows."""
    shared = None if only is None else df.sparkSession.sparkContext.broadcast(only)
    names = ["uid", key, "width", "exact", "window", "template", "pattern", "place", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, table = TaskContext.get().partitionId() << 40, WordTable()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in groups(texts):
                at, *columns = windows(texts[start:end], table, None if shared is None else shared.value, widths)
                keys = batch.column(0).take(pa.array(start + at))
                slots = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(columns[6:], axis=1).ravel()), WINDOW).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(uid + start + at), keys, *map(pa.array, columns[:6]), slots], names)
            uid += batch.num_rows

    return df.select(F.col(key).cast("bigint").alias(key), "text").mapInArrow(run, ", ".join(f"{n} {'array<bigint>' if n == 'slots' else 'bigint'}" for n in names))


def _consistent(found: DataFrame) -> DataFrame:
    """Rows of matched windows whose slots agree with the match's values.

    ``found`` has (uid, item, shift, window, own, other): the distance between the places, and the slot values of item and document.
    """
    found = found.withColumn("n", F.size(F.filter("own", lambda x: x != 0)))
    runs = found.where("n > 0").groupBy("uid", "item", "shift").agg(F.count("*").alias("run"))
    rows = found.where("n > 0").join(runs, ["uid", "item", "shift"])
    pairs = rows.select("uid", "item", "shift", "window", "run", F.explode(F.arrays_zip("own", "other")).alias("p")).select("uid", "item", "shift", "window", "run", "p.own", "p.other").where("own != 0")
    # The longest run decides what a value stands for, in both directions.
    best = F.max(F.struct("run", (-F.col("shift")).alias("s"), "other"))["other"]
    back = F.max(F.struct("run", (-F.col("shift")).alias("s"), "own"))["own"]
    there = pairs.groupBy("uid", "item", "own").agg(best.alias("meant"))
    here = pairs.groupBy("uid", "item", "other").agg(back.alias("source"))
    told = pairs.join(there, ["uid", "item", "own"]).join(here, ["uid", "item", "other"])
    wrong = told.where("meant != other or source != own").select("uid", "item", "shift", "window").distinct()
    return found.join(wrong, ["uid", "item", "shift", "window"], "left_anti")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows) of documents and the items that contaminate them.

    Exact windows are left out of both numbers where the others alone reach ``SHARE``.
    """
    items = materialise(_window_rows(benchmark, "item_id").withColumnRenamed("uid", "item"), "leak-items")
    distinct = items.select("item", "item_id", "exact", "window").distinct()
    sizes = distinct.groupBy("item", "item_id").agg(F.count("*").alias("n_all"), F.count_if(F.col("exact") == 0).alias("n_loose"))
    grams = items.select("template").distinct()
    small = grams.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    only = np.sort(grams.toPandas()["template"].to_numpy(np.int64)) if small else None
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    sides = _window_rows(docs, "doc_id", only, widths).select("uid", "doc_id", "template", "pattern", "place", F.col("slots").alias("other"))
    named = items.select("item", "exact", "window", "template", "pattern", F.col("place").alias("at"), F.col("slots").alias("own"))
    found = sides.join(named, ["template", "pattern"]).withColumn("shift", F.col("place") - F.col("at"))
    found = materialise(found.select("uid", "doc_id", "item", "exact", "window", "shift", "own", "other").distinct(), "leak-windows")
    kept = _consistent(found).select("uid", "doc_id", "item", "exact", "window").distinct()
    per = kept.groupBy("uid", "doc_id", "item").agg(F.count("*").alias("all"), F.count_if(F.col("exact") == 0).alias("loose")).join(sizes, "item")
    by_loose = (F.col("n_loose") > 0) & (F.col("loose") >= F.lit(SHARE) * F.col("n_loose"))
    hit = per.where(by_loose | (F.col("all") >= F.lit(SHARE) * F.col("n_all")) | (F.col("all") >= RUN))
    return hit.select("doc_id", "item_id", F.when(by_loose, F.col("loose")).otherwise(F.col("all")).alias("n_matched"), F.when(by_loose, F.col("n_loose")).otherwise(F.col("n_all")).alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; null ids stay."""
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
