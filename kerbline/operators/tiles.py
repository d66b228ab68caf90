"""Kernels of the spatial joins: rows of one tile of the plane meet as numpy arrays.

Rows (cx, cy, side, …) are brought together by tile and sorted in it, and stream through Arrow. Pairs are formed and tested in blocks, so
memory follows the rows of the fullest tile and never the pairs. Formulas are those of :mod:`kerbline.functions.geo`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbline.runtime import ship

#: Pairs tested at once.
BLOCK = 1 << 18


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    pending, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cx, cy = numbers(batch, "cx"), numbers(batch, "cy")
        change = np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield pa.Table.from_batches([*pending, batch.slice(0, cut)])
            pending = []
        elif pending and last != (cx[0], cy[0]):
            yield pa.Table.from_batches(pending)
            pending = []
        pending.append(batch.slice(cut))
        last = (cx[-1], cy[-1])
    if pending:
        yield pa.Table.from_batches(pending)


def stream(rows: DataFrame, order: list[str], kernel: Callable[[pa.Table], Iterator[dict]], schema) -> DataFrame:
    """What ``kernel`` yields for tables of whole tiles of ``rows``, each sorted by ``order``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for table in _whole_tiles(batches):
                for out in kernel(table):
                    arrays = [a if isinstance(a, pa.Array) else a.combine_chunks() if isinstance(a, pa.ChunkedArray) else pa.array(a) for a in out.values()]
                    yield pa.RecordBatch.from_arrays(arrays, list(out))

    return rows.repartition("cx", "cy").sortWithinPartitions("cx", "cy", *order).mapInArrow(run, schema)


def numbers(table, column: str) -> np.ndarray:
    """A column as an array; a column of doubles with nulls has NaN for them."""
    got = table.column(column)
    return got.to_numpy() if isinstance(got, pa.ChunkedArray) else got.to_numpy(zero_copy_only=False)


class Lists:
    """A column of lists of points as flat x and y, with the first place and the number of each row's points."""

    def __init__(self, table: pa.Table, column: str):
        lists = table.column(column).combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        at = lists.offsets.to_numpy().astype(np.int64)
        self.at, self.n = at[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        self.x, self.y = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in "xy")


def spans(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of each row's tile."""
    cx, cy = numbers(table, "cx"), numbers(table, "cy")
    start = np.concatenate([[0], np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])) + 1])
    end = np.append(start[1:], len(cx))
    return np.repeat(start, end - start), np.repeat(end, end - start)


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of side 1, with the range of the rows of side 0 in their tile, which come first."""
    side = numbers(table, "side")
    low, _ = spans(table)
    before = np.concatenate([[0], np.cumsum(side == 0)])
    rows = np.flatnonzero(side == 1)
    return rows, low[rows], low[rows] + before[rows] - before[low[rows]]


def expand(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, … for n[0] places, then those of the next."""
    ends = np.cumsum(n)
    return np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def blocks(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row and a place of its range; pairs of one row stay in one block."""
    n = np.maximum(high - low, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        if ends[to - 1] > (ends[at - 1] if at else 0):
            yield np.repeat(rows[at:to], n[at:to]), expand(low[at:to], n[at:to])
        at = to


def boxes(lists: Lists) -> tuple[np.ndarray, ...]:
    """Smallest and largest x and y of each row's points; NaN without points."""
    out = []
    some = np.flatnonzero(lists.n > 0)
    flat = expand(lists.at[some], lists.n[some])
    first = np.cumsum(lists.n[some]) - lists.n[some]
    for values, f in ((lists.x, np.minimum), (lists.y, np.minimum), (lists.x, np.maximum), (lists.y, np.maximum)):
        box = np.full(len(lists.n), np.nan)
        if len(some):
            box[some] = f.reduceat(values[flat], first)
        out.append(box)
    return tuple(out)


def inside(px: np.ndarray, py: np.ndarray, rings: Lists, j: np.ndarray) -> np.ndarray:
    """Whether each point lies in its ring, by parity."""
    odd = np.zeros(len(j), dtype=bool)
    at, n = rings.at[j], rings.n[j]
    most = int(n.max()) if len(n) else 0
    part = slice(None)
    for k in range(most):
        if k and (n <= k).any():
            part = np.flatnonzero(n > k)
        a = at[part] + k
        b = np.where(k + 1 < n[part], a + 1, at[part])
        x1, y1, x2, y2 = rings.x[a], rings.y[a], rings.x[b], rings.y[b]
        odd[part] ^= ((y1 > py[part]) != (y2 > py[part])) & (px[part] < (x2 - x1) * (py[part] - y1) / (y2 - y1) + x1)
    return odd


def point_to_edge(px, py, e) -> np.ndarray:
    x1, y1, dx, dy, n = e
    t = ((px - x1) * dx + (py - y1) * dy) / n
    t = np.where(n > 0, np.maximum(0.0, np.minimum(1.0, t)), 0.0)
    gx, gy = px - x1 - t * dx, py - y1 - t * dy
    return np.sqrt(gx * gx + gy * gy)


def edge(x1, y1, x2, y2) -> tuple:
    dx, dy = x2 - x1, y2 - y1
    return x1, y1, dx, dy, dx * dx + dy * dy


def holding(outer: bool, points: list[str], rings: list[str], names: list[str]) -> Callable:
    """Kernel: each point (side 1) with each ring (side 0) that holds it; with ``outer`` also the points in no ring."""

    def kernel(table: pa.Table) -> Iterator[dict]:
        shape = Lists(table, "ring")
        x0, y0, x1, y1 = boxes(shape)
        px, py = numbers(table, "_x"), numbers(table, "_y")
        rows, low, high = sides(table)
        held = np.zeros(len(px), dtype=bool)
        left, right = table.select(points), table.select(rings)
        for i, j in blocks(rows, low, high):
            x, y = px[i], py[i]
            near = np.flatnonzero((x >= x0[j]) & (x <= x1[j]) & (y >= y0[j]) & (y <= y1[j]))
            i, j = i[near], j[near]
            near = inside(x[near], y[near], shape, j)
            i, j = i[near], j[near]
            if len(i):
                held[i] = True
                yield dict(zip(names, left.take(pa.array(i)).columns + right.take(pa.array(j)).columns))
        alone = rows[~held[rows]]
        if outer and len(alone):
            none = pa.nulls(len(alone), pa.int64())
            yield dict(zip(names, left.take(pa.array(alone)).columns + right.take(none).columns))

    return kernel


def nearest(reach: float, rest: bool = False) -> Callable:
    """Kernel: the lines (edges, side 0, sorted by line) at the least distance of each point (side 1) within ``reach``, and whether there are several.

    With ``rest`` also the points without any, with their place and a null distance.
    """

    def kernel(table: pa.Table) -> Iterator[dict]:
        px, py, x2, y2 = (numbers(table, c) for c in ("_x", "_y", "_x2", "_y2"))
        rows, low, high = sides(table)
        keys, lines = table.column("key"), table.column("line")
        alone = np.zeros(len(px), dtype=bool)
        alone[rows] = True
        for i, j in blocks(rows, low, high):
            dist = point_to_edge(px[i], py[i], edge(px[j], py[j], x2[j], y2[j]))
            near = np.flatnonzero(dist <= reach)
            if not len(near):
                continue
            i, j, dist = i[near], j[near], dist[near]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            n = np.diff(np.append(start, len(i)))
            best = np.flatnonzero(dist == np.repeat(np.minimum.reduceat(dist, start), n))
            i, j, dist = i[best], j[best], dist[best]
            several = np.concatenate([[False], i[1:] == i[:-1]])
            several |= np.append(several[1:], False)
            alone[i] = False
            place = pa.nulls(len(i), pa.float64())
            yield {"key": keys.take(pa.array(i)), "line": lines.take(pa.array(j)), "dist": dist, "several": several, "x": place, "y": place}
        i = np.flatnonzero(alone)
        if rest and len(i):
            none = pa.nulls(len(i), pa.float64())
            yield {"key": keys.take(pa.array(i)), "line": lines.take(pa.nulls(len(i), pa.int64())), "dist": none, "several": np.zeros(len(i), dtype=bool), "x": px[i], "y": py[i]}

    return kernel


class Units:
    """Rows of a tile as edges: those of row r lie at first[r], …"""

    def __init__(self, table: pa.Table):
        pts = Lists(table, "pts")
        self.box = boxes(pts)
        self.n = np.maximum(pts.n - 1, 0)
        self.first = np.cumsum(self.n) - self.n
        a = expand(pts.at, self.n)
        self.edges = np.stack(edge(pts.x[a], pts.y[a], pts.x[a + 1], pts.y[a + 1]) + (pts.x[a + 1], pts.y[a + 1]), 1)

    def near(self, i: np.ndarray, j: np.ndarray, most: float) -> np.ndarray:
        """Whether rows i and j are no farther apart than ``most``."""
        out = np.zeros(len(i), dtype=bool)
        if not len(i):
            return out
        for a in range(int(self.n[i].max())):
            for b in range(int(self.n[j].max())):
                rest = np.flatnonzero(~out & (self.n[i] > a) & (self.n[j] > b))
                if len(rest):
                    out[rest] = _close(self.edges[self.first[i[rest]] + a].T, self.edges[self.first[j[rest]] + b].T, most)
        return out


def _close(p: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Whether straight edges (x1, y1, dx, dy, n, x2, y2) are no farther apart than ``most``."""
    p, q = np.ascontiguousarray(p), np.ascontiguousarray(q)
    out = point_to_edge(p[0], p[1], q[:5]) <= most
    for one, other, x in ((p, q, 5), (q, p, 0), (q, p, 5)):
        rest = np.flatnonzero(~out)
        out[rest] = point_to_edge(one[x][rest], one[x + 1][rest], other[:5][:, rest]) <= most
    rest = np.flatnonzero(~out)
    p, q = p[:, rest], q[:, rest]
    side = lambda e, x, y: np.sign(e[2] * (y - e[1]) - e[3] * (x - e[0]))
    out[rest] = (side(p, q[0], q[1]) * side(p, q[5], q[6]) < 0) & (side(q, p[0], p[1]) * side(q, p[5], p[6]) < 0)
    return out


def touching(most: float) -> Callable:
    """Kernel: (src, dst, whole) of units no farther apart than ``most``, each pair of units in one tile only."""

    def kernel(table: pa.Table) -> Iterator[dict]:
        units = Units(table)
        key, whole = numbers(table, "key"), numbers(table, "whole").astype(bool)
        cx, cy, ux, uy = (numbers(table, c) for c in ("cx", "cy", "ux", "uy"))
        x0, y0, x1, y1 = units.box
        slack = most * (1 + 1e-9)
        _, end = spans(table)
        rows = np.arange(len(key))
        for i, j in blocks(rows, rows + 1, end):
            here = (np.maximum(ux[i], ux[j]) == cx[i]) & (np.maximum(uy[i], uy[j]) == cy[i]) & (key[i] != key[j])
            here = np.flatnonzero(here & (x0[i] - x1[j] <= slack) & (x0[j] - x1[i] <= slack) & (y0[i] - y1[j] <= slack) & (y0[j] - y1[i] <= slack))
            i, j = i[here], j[here]
            here = units.near(i, j, most)
            i, j = i[here], j[here]
            if len(i):
                yield {"src": np.minimum(key[i], key[j]), "dst": np.maximum(key[i], key[j]), "whole": whole[i] & whole[j]}

    return kernel


def forest(most: float, ahead: int = 8) -> Callable:
    """Kernel: (src, dst) of some of the pairs of :func:`touching`, which connect the units of a tile as all of them do."""

    def kernel(table: pa.Table) -> Iterator[dict]:
        units = Units(table)
        key = numbers(table, "key")
        x0, y0, x1, y1 = units.box
        slack = most * (1 + 1e-9)
        _, end = spans(table)
        rows = np.arange(len(key))
        label = rows.copy()
        # A unit's first few partners connect most of a tile; of the others only pairs between different parts are tested.
        for low, high in ((rows + 1, np.minimum(rows + 1 + ahead, end)), (rows + 1 + ahead, end)):
            for i, j in blocks(rows, low, high):
                here = np.flatnonzero(label[i] != label[j])
                i, j = i[here], j[here]
                here = np.flatnonzero((x0[i] - x1[j] <= slack) & (x0[j] - x1[i] <= slack) & (y0[i] - y1[j] <= slack) & (y0[j] - y1[i] <= slack))
                i, j = i[here], j[here]
                here = units.near(i, j, most)
                i, j = i[here], j[here]
                while len(i):
                    a, b = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
                    top, one = np.unique(a, return_index=True)
                    yield {"src": key[i[one]], "dst": key[j[one]]}
                    to = rows.copy()
                    to[top] = b[one]
                    while (to[to] != to).any():
                        to = to[to]
                    label = to[label]
                    here = label[i] != label[j]
                    i, j = i[here], j[here]

    return kernel


def overlap(table: pa.Table, ahead: int = 8) -> Iterator[dict]:
    """Kernel: of each line (side 1) the first ring (side 0, sorted by key) that holds most of its length, and that length.

    A line meets its tile's rings by key, a few and then twice as many each time, until one holds it whole: no later ring beats that.
    """
    rings, lines = Lists(table, "ring"), Lists(table, "pts")
    rb, lb = boxes(rings), boxes(lines)
    edges = np.maximum(lines.n - 1, 0)
    rows, low, high = sides(table)
    rows, low, high = (v[edges[rows] > 0] for v in (rows, low, high))
    a = expand(lines.at[rows], edges[rows])
    total = np.zeros(len(edges))
    total[rows] = np.add.reduceat(np.hypot(lines.x[a + 1] - lines.x[a], lines.y[a + 1] - lines.y[a]), np.cumsum(edges[rows]) - edges[rows]) if len(rows) else 0.0
    best, ring, whole = np.zeros(len(edges)), np.zeros(len(edges), dtype=np.int64), np.zeros(len(edges), dtype=bool)
    every = rows
    while len(rows):
        to = np.minimum(low + ahead, high)
        for i, j in blocks(rows, low, to):
            _meet(i, j, rings, lines, rb, lb, edges, total, best, ring, whole)
        left = ~whole[rows] & (to < high)
        rows, low, high = rows[left], to[left], high[left]
        ahead *= 2
    top = every[best[every] > 0]
    if len(top):
        yield {"line": table.column("line").take(pa.array(top)), "ring": table.column("key").take(pa.array(ring[top])), "overlap": best[top]}


def _meet(i, j, rings: Lists, lines: Lists, rb, lb, edges, total, best, ring, whole) -> None:
    """Compare lines i with rings j: where one holds more than ``best``, it goes there and to ``ring``; ``whole`` marks the lines that lie in a ring."""
    here = np.flatnonzero((lb[0][i] <= rb[2][j]) & (rb[0][j] <= lb[2][i]) & (lb[1][i] <= rb[3][j]) & (rb[1][j] <= lb[3][i]))
    i, j = i[here], j[here]
    if not len(i):
        return
    # Where no edge of the ring comes near the line, the line is inside or outside as a whole.
    crossed = np.zeros(len(i), dtype=bool)
    x0, y0, x1, y1 = (v[i] for v in lb)
    for k in range(int(rings.n[j].max())):
        has = rings.n[j] > k
        p = np.where(has, rings.at[j] + k, rings.at[j])
        q = np.where(k + 1 < rings.n[j], p + 1, rings.at[j])
        ax, ay, bx, by = rings.x[p], rings.y[p], rings.x[q], rings.y[q]
        crossed |= has & (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    first = lines.at[i]
    free = np.flatnonzero(~crossed)
    free = free[inside((lines.x[first[free]] + lines.x[first[free] + 1]) / 2, (lines.y[first[free]] + lines.y[first[free] + 1]) / 2, rings, j[free])]
    got = np.zeros(len(i))
    got[free] = total[i[free]]
    whole[i[free]] = True
    # A ring that holds the whole line is beaten by none, and equalled only by rings before it.
    full = np.full(len(edges), len(edges))
    np.minimum.at(full, i[free], j[free])
    rest = np.flatnonzero(crossed & (j < full[i]))
    if len(rest):
        n = edges[i[rest]]
        e = expand(lines.at[i[rest]], n)
        parts = _inside_length(lines.x[e], lines.y[e], lines.x[e + 1], lines.y[e + 1], rings, np.repeat(j[rest], n))
        got[rest] = np.add.reduceat(parts, np.cumsum(n) - n)
    start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    most = np.maximum.reduceat(got, start)
    top = np.flatnonzero((got == np.repeat(most, np.diff(np.append(start, len(i))))) & (got > 0))
    top = top[np.concatenate([[True], i[top][1:] != i[top][:-1]])] if len(top) else top
    top = top[got[top] > best[i[top]]]
    best[i[top]], ring[i[top]] = got[top], j[top]


def _inside_length(x1, y1, x2, y2, rings: Lists, j: np.ndarray) -> np.ndarray:
    """Length of the part of each edge that lies in its ring, cut at the ring's edges; pieces are tested at their middles."""
    out = np.zeros(len(j))
    at = 0
    while at < len(j):
        # Rings of many points take fewer edges at once.
        width = int(rings.n[j[at : at + 4096]].max())
        to = min(len(j), at + max(1, min(4096, BLOCK * 4 // (width + 1))))
        s, r = slice(at, to), j[at:to]
        dx, dy = x2[s] - x1[s], y2[s] - y1[s]
        ts = np.ones((to - at, width + 2))
        ts[:, 0] = 0.0
        for k in range(width):
            has = rings.n[r] > k
            p = np.where(has, rings.at[r] + k, rings.at[r])
            q = np.where(k + 1 < rings.n[r], p + 1, rings.at[r])
            ax, ay = rings.x[p], rings.y[p]
            rx, ry = rings.x[q] - ax, rings.y[q] - ay
            cross = dx * ry - dy * rx
            t = ((ax - x1[s]) * ry - (ay - y1[s]) * rx) / cross
            u = ((ax - x1[s]) * dy - (ay - y1[s]) * dx) / cross
            ts[:, k + 1] = np.where(has & (cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t, 1.0)
        ts.sort(axis=1)
        length = np.hypot(dx, dy)
        for k in range(width + 1):
            some = np.flatnonzero(ts[:, k + 1] > ts[:, k])
            middle = (ts[some, k] + ts[some, k + 1]) / 2
            held = inside(x1[s][some] + middle * dx[some], y1[s][some] + middle * dy[some], rings, r[some])
            out[at + some[held]] += (ts[some, k + 1] - ts[some, k])[held] * length[some[held]]
        at = to
    return out
