"""Near-duplicate classes by banded MinHash with odd-sketch verification and an exact check on full shingle sets.

Rows with equal shingle sets are one class. ``BANDS`` bands of ``ROWS`` MinHash samples propose pairs of classes. For the odd sketch the
shingle hashes fall into ``BINS`` bins by their leading bits; the smallest of each bin is a MinHash sample, and the samples are folded into
a parity bitmap. The population count of two bitmaps' XOR estimates how many samples differ, for small sets almost exactly. A pair
whose estimate is ``SPREADS`` standard deviations beyond what the similarity allows is dropped, the others are compared on full sets.

Work follows the links and not the pairs. First each class meets the smallest class of its buckets; the links found are joined into
components. Then only buckets that still hold several components are gone through, and there only pairs of different components that
the bucket's largest component doesn't hold both ends of. Such a bucket is cut into blocks; a task compares the bitmaps of two blocks as arrays and
writes one row per class with its candidates as a list, and the exact check reads each class of a block once, so pairs never become rows.

Misses: a pair of similarity s shares no bucket with a chance of (1 - s^ROWS)^BANDS, 6e-7 at 0.8; the bitmap drops one with a chance below
1e-4 at 0.8 and far less above. Equal classes and common shingles are decided on hashes of 128 and 64 bits.

Null and empty texts and texts without words have no shingles and link with nothing; with fewer words than a shingle the whole
sequence is the one shingle. Rows of one id are one document, also with different texts. Rows with a null id get a null component, are kept,
and join nothing. An empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import mix, words
from kerbline.operators.graph import connected_components
from kerbline.runtime import materialise, release

BANDS, ROWS, BINS, BITS, SPREADS = 36, 5, 1024, 1024, 4.0
#: Classes of a bucket's block, those that are compared with them, and shingles that meet in one group of the exact check.
BLOCK, PACK, GROUP_SHINGLES = 1024, 256, 1 << 20
_rng = np.random.default_rng(71)
_MUL = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SKETCH = "cid bigint, doc_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, odd array<bigint>"


def shingle_rows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and where each row's begin."""
    n = np.diff(first)
    kept = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    start = np.append(0, np.cumsum(kept))
    row = np.repeat(np.arange(len(n)), kept)
    at = np.arange(start[-1]) - start[row] + first[:-1][row]
    width = np.minimum(n, size)[row]
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        use = width > k
        value[use] = mix(value[use] * _STEP + hashes[at[use] + k])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def odd_sketch(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bitmap words of the sorted sets ``value[at[i]:at[i+1]]``: the first value of each bin is the bin's smallest."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    place = (row << 16) + (value >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    fresh = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
    row, sample = row[fresh], value[fresh]
    spot = row * BITS + (mix(sample * _STEP) % np.uint64(BITS)).astype(np.int64)
    parity = (np.bincount(spot, minlength=rows * BITS) & 1).astype(np.uint8).reshape(rows, BITS)
    return np.packbits(parity, axis=1).view(np.int64)


def most_differing(n_a, n_b, percent: int):
    """How many bits of two bitmaps may differ if sets of these sizes reach the similarity, ``SPREADS`` standard deviations allowed for."""
    s = percent / 100
    filled = lambda n: BINS * -np.expm1(-n / BINS)
    union = (n_a + n_b) / (1 + s)
    joint = filled(union)
    mean = np.maximum(filled(n_a) + filled(n_b) - 2 * s * joint, 0)
    sampled = 4 * joint * s * (1 - s) * np.maximum(1 - joint / np.maximum(union, 1e-9), 0)
    folded = np.maximum(BITS / 4 * np.expm1(np.minimum(4 * mean / BITS, 20)) - mean, 0)
    most = mean + SPREADS * np.sqrt(sampled + folded) + 3
    return BITS / 2 * -np.expm1(-2 * most / BITS)


def _close(odd_a, odd_b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether the sizes allow the similarity and the bitmaps make it likely; row by row, or one row against many."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    differing = np.bitwise_count(odd_a ^ odd_b).sum(axis=-1, dtype=np.int64)
    return sizes & (differing <= most_differing(n_a, n_b, percent))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of unsigned words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64).reshape(-1, width)


def _numbers(table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[n].to_numpy() for n in names]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(cid, doc_id, n, h1, h2, keys, odd) of every row; ``cid`` numbers the rows, ``keys`` are the bands' bucket names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, hashes, first in words(batch.column(1)):
                value, at = shingle_rows(hashes, first, size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys, sums = np.zeros((BANDS, len(n)), np.uint64), np.zeros((2, len(n)), np.uint64)
                keys += np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
                if len(full):
                    for k in range(BANDS * ROWS):
                        low = np.minimum.reduceat(value * _MUL[k] + _ADD[k], at[full])
                        keys[k // ROWS, full] = mix(keys[k // ROWS, full] * _STEP + low)
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(mix(value ^ _ADD[k]), at[full])
                odd = odd_sketch(value, at)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.int64())) for m in (keys.T.copy().view(np.int64), odd)]
                own = [pa.array(uid + np.arange(row, end)), batch.column(0).slice(row, end - row), pa.array(n.astype(np.int64))]
                columns = [*own, *(pa.array(s.view(np.int64)) for s in sums), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "doc_id", "n", "h1", "h2", "keys", "odd"])
            uid += batch.num_rows

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


def _shingles(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, shingles) of the wanted classes, whose documents are read again."""
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, hashes, first in words(batch.column(1)):
                value, at = shingle_rows(hashes, first, size)
                full = np.flatnonzero(np.diff(at))
                sums = np.zeros((2, end - row), np.uint64)
                if len(full):
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(mix(value ^ _ADD[k]), at[full])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                columns = [batch.column(0).slice(row, end - row), *(pa.array(s.view(np.int64)) for s in sums), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "shingles"])

    rows = texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, shingles array<bigint>")
    # An id's rows can hold several texts and one text several times: the class is told by its hashes, and one copy is enough.
    named = rows.join(wanted.select("doc_id", "h1", "h2", "cid"), ["doc_id", "h1", "h2"])
    return named.groupBy("cid").agg(F.first("shingles").alias("shingles"))


def _overlaps(x: np.ndarray, flat: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the sorted values ``x`` each of the sets ``at`` holds, in slices of about ``GROUP_SHINGLES`` values."""
    out, size = np.zeros(len(at), np.int64), bounds[at + 1] - bounds[at]
    part = (np.cumsum(size) - size) // GROUP_SHINGLES
    for k in np.unique(part):
        own = part == k
        n, first = size[own], bounds[at[own]]
        before = np.cumsum(n) - n
        y = flat[np.repeat(first - before, n) + np.arange(int(n.sum()))]
        hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
        out[own] = np.add.reduceat(hit.astype(np.int64), before)
    return out


def _links(centres: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): for each centre and each component among its others, one of them that the exact check confirms.

    ``members`` (unit, cid, comp, n) are the classes of a unit, ``centres`` (unit, cid, others) those compared with the others named, or with all
    of the unit's members where that is null. A unit's sets are fetched once, and units meet in groups of about ``GROUP_SHINGLES`` shingles.
    """
    volume = members.agg(F.sum("n")).first()[0] or 0
    groups = max(1, int(volume // GROUP_SHINGLES))
    group = F.pmod("unit", F.lit(groups)).alias("bin")
    left = members.join(sets, "cid").select(group, "unit", "cid", "comp", "shingles")
    right = centres.join(sets, "cid").select(group, "unit", "cid", "others", "shingles").toDF("bin", "unit", "cid", "others", "shingles")

    def check(block: pa.Table, pack: pa.Table) -> pa.Table:
        src, dst = [], []
        if block.num_rows and pack.num_rows:
            unit, cid, comp = _numbers(block, "unit", "cid", "comp")
            order = np.lexsort((cid, unit))
            unit, cid, comp = unit[order], cid[order], comp[order]
            lists = block["shingles"].combine_chunks().take(pa.array(order))
            bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
            for own, centre, others, shingles in zip(*_numbers(pack, "unit", "cid"), pack["others"], pack["shingles"]):
                a, b = np.searchsorted(unit, own), np.searchsorted(unit, own, "right")
                at = np.arange(a, b) if others.values is None else a + np.searchsorted(cid[a:b], np.sort(others.values.to_numpy()))
                x = shingles.values.to_numpy().view(np.uint64)
                both = _overlaps(x, flat, bounds, at)
                at = at[100 * both >= percent * (len(x) + bounds[at + 1] - bounds[at] - both)]
                at = at[np.unique(comp[at], return_index=True)[1]]
                src.append(np.full(len(at), centre))
                dst.append(cid[at])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, dst)]
        return pa.table(columns, ["src", "dst"])

    return left.groupBy("bin").cogroup(right.groupBy("bin")).applyInArrow(check, "src bigint, dst bigint")


def _first_units(members: DataFrame, drawn: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Centres and members: the smallest class of each bucket with the bucket's others, as far as sizes and bitmaps allow a link."""
    pivots = members.groupBy("key").agg(F.min("cid").alias("pivot"))
    pairs = members.join(pivots, "key").where("cid != pivot").select("cid", "pivot").distinct()
    facts = ["n", "odd"]
    a = drawn.select("cid", *(F.col(c).alias(f"{c}_a") for c in facts))
    b = drawn.select(F.col("cid").alias("pivot"), *(F.col(c).alias(f"{c}_b") for c in facts))
    told = pairs.join(a, "cid").join(b, "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [_matrix(batch.column(c), BITS // 64) for c in ("odd_a", "odd_b")]
            near = _close(*odd, *_numbers(batch, "n_a", "n_b"), percent)
            kept = batch.filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("cid", "pivot", "n_a")], ["cid", "pivot", "n"])

    close = materialise(told.mapInArrow(run, "cid bigint, pivot bigint, n bigint"), "near-stars")
    # A star of many members is dealt out over blocks.
    size = close.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("blocks"))
    unit = F.xxhash64("pivot", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    dealt = materialise(close.join(size, "pivot").select(unit.alias("unit"), "cid", "pivot", "n"), "near-units")
    release(close)
    centres = dealt.select("unit", F.col("pivot").alias("cid"), F.lit(None).cast("array<bigint>").alias("others")).distinct()
    return centres, dealt.select("unit", "cid", F.col("cid").alias("comp"), "n")


def _later_units(members: DataFrame, drawn: DataFrame, parts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Centres and members between different components of a bucket: every class outside the bucket's largest component with the others that may link."""
    named = members.join(parts.select(F.col("node").alias("cid"), "component"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    named = materialise(named, "near-named")
    shares = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    stats = shares.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).where("all > top.c")
    stats = stats.select("key", F.col("top.comp").alias("major"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("top.c")) / PACK).alias("packs"))
    facts = drawn.select("cid", "n", "keys", "odd")
    live = named.join(stats, "key")
    spread = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = live.select("key", "cid", "comp", spread("blocks", 1).alias("block"), every("packs").alias("pack"))
    right = live.where("comp != major").select("key", "cid", "comp", spread("packs", 2).alias("pack"), every("blocks").alias("block"))
    size = live.agg(F.count("*")).first()[0]
    groups = max(1, size // 1024)
    unit = F.xxhash64("key", "block", "pack")
    told = lambda side: side.join(facts, "cid").select(F.pmod(unit, F.lit(groups)).alias("bin"), unit.alias("unit"), "key", "cid", "comp", "n", "keys", "odd")

    def compare(block: pa.Table, pack: pa.Table) -> pa.Table:
        units, cids, comps, sizes, others = [], [], [], [], []
        if block.num_rows and pack.num_rows:
            unit_l, cid_l, comp_l, n_l = _numbers(block, "unit", "cid", "comp", "n")
            order = np.argsort(unit_l, kind="stable")
            marks = unit_l[order]
            keys_l, odd_l = _matrix(block["keys"], BANDS), _matrix(block["odd"], BITS // 64)
            keys_r, odd_r = _matrix(pack["keys"], BANDS), _matrix(pack["odd"], BITS // 64)
            met = np.zeros(len(unit_l), bool)
            for i, (own, key, cid, comp, n) in enumerate(zip(*_numbers(pack, "unit", "key", "cid", "comp", "n"))):
                mine = order[np.searchsorted(marks, own) : np.searchsorted(marks, own, "right")]
                mine = mine[comp_l[mine] != comp]
                mine = mine[_close(odd_l[mine], odd_r[i], n_l[mine], n, percent)]
                # A pair is looked at in the first bucket that it shares.
                same = keys_l[mine] == keys_r[i]
                mine = mine[keys_r[i][same.argmax(axis=1)].view(np.int64) == key]
                if len(mine):
                    met[mine] = True
                    units.append(own), cids.append(cid), comps.append(comp), sizes.append(n), others.append(cid_l[mine])
            held = np.flatnonzero(met)
            units += unit_l[held].tolist()
            cids += cid_l[held].tolist()
            comps += comp_l[held].tolist()
            sizes += n_l[held].tolist()
            others += [None] * len(held)
        columns = [pa.array(c, pa.int64()) for c in (units, cids, comps, sizes)]
        return pa.table([*columns, pa.array(others, pa.list_(pa.int64()))], ["unit", "cid", "comp", "n", "others"])

    block, pack = told(left), told(right)
    found = block.groupBy("bin").cogroup(pack.toDF(*pack.columns).groupBy("bin")).applyInArrow(compare, "unit bigint, cid bigint, comp bigint, n bigint, others array<bigint>")
    found = materialise(found, "near-units")
    release(named)
    return found.where("others is not null").select("unit", "cid", "others"), found.where("others is null").drop("others")


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: links are Jaccard similarities of ``percent`` or more."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = materialise(sketches(docs, size), "near-sketches")
    usable = every.where("doc_id is not null and n > 0")
    classes = materialise(usable.groupBy("h1", "h2", "n").agg(F.min("cid").alias("class")), "near-classes")
    joined = every.select("cid", "doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    own = materialise(joined.select("cid", "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")), "near-rows")
    drawn = materialise(usable.join(classes.select(F.col("class").alias("cid")), "cid", "left_semi"), "near-drawn")
    rows = drawn.select("cid", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = materialise(rows.join(shared, "key"), "near-members")
    involved = drawn.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "doc_id", "h1", "h2")
    sets = materialise(_shingles(docs, involved, size), "near-sets")
    # Rows of one id are one document: their classes are linked from the start.
    held = own.where("class is not null").groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high")
    known = own.join(held.select("doc_id", "low"), "doc_id").select(F.col("class").alias("src"), F.col("low").alias("dst"))
    edges = materialise(known.union(_links(*_first_units(members, drawn, percent), sets, percent)), "near-links")
    parts = connected_components(edges)
    more = _links(*_later_units(members, drawn, parts, percent), sets, percent)
    parts = materialise(connected_components(edges.union(more)), "near-parts")
    named = own.join(parts.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = materialise(named.select("doc_id", "n", "component"), "near-labels")
    # The result reads the labels alone.
    release(every, classes, own, drawn, members, sets, edges, parts)
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
