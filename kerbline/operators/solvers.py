"""Assignment of a plan date's bundles to its few workers, as plain Python over small matrices.

A :class:`Problem` holds distances in km; solvers return the worker of each bundle, -1 where a worker can't be had. Ties go to the lower place.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

import numpy as np

R_KM = 6371.0


def haversine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in km between rows of (lat, lon)."""
    a, b = np.radians(a)[:, None, :], np.radians(b)[None, :, :]
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * R_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


class Problem:
    """Workers at home, bundles at their centroids with the km to walk inside them."""

    def __init__(self, homes: np.ndarray, places: np.ndarray, inner: np.ndarray, alpha: float = 1.0, beta: float = 1.0, task: list[str] | None = None):
        self.homes, self.places, self.inner = np.asarray(homes, float).reshape(-1, 2), np.asarray(places, float).reshape(-1, 2), np.asarray(inner, float)
        self.home, self.between = haversine(self.homes, self.places), haversine(self.places, self.places)
        self.cost, self.task = alpha * self.home + beta * self.inner, task
        self.w, self.n = self.home.shape
        self.k = -(-self.n // self.w) if self.w else 0

    def loads(self, who: list[int]) -> np.ndarray:
        """Route km of each worker: open nearest-neighbour route from home plus the km inside."""
        return np.array([self.route(w, [j for j, x in enumerate(who) if x == w])[0] for w in range(self.w)])

    def route(self, w: int, held: list[int], closed: bool = False, exact: int = 7) -> tuple[float, list[int]]:
        """(km, order) of a route from home over ``held``: by all orders up to ``exact`` bundles (4 if closed), else nearest first."""
        if not held:
            return 0.0, []
        inner = float(self.inner[held].sum())
        if len(held) <= (min(exact, 4) if closed else exact):
            best = min((self._length(w, p, closed), p) for p in permutations(held))
            return best[0] + inner, list(best[1])
        left, order = set(held), []
        while left:
            from_ = self.home[w] if not order else self.between[order[-1]]
            order.append(min(left, key=lambda j: (from_[j], j)))
            left.discard(order[-1])
        return self._length(w, order, closed) + inner, order

    def _length(self, w: int, order, closed: bool) -> float:
        km = self.home[w, order[0]] + sum(self.between[a, b] for a, b in zip(order, order[1:]))
        return float(km + (self.home[w, order[-1]] if closed else 0.0))


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row of a cost matrix with no more rows than columns, at the least total cost (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, way, used = np.full(m + 1, math.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[col] - 1, free - 1] - u[match[col]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], col
            nxt = free[np.argmin(least[free])]
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
            if match[col] == 0:
                break
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = [-1] * n
    for col in range(1, m + 1):
        if match[col]:
            out[match[col] - 1] = col - 1
    return out


def round_robin(p: Problem) -> list[int]:
    """Bundles dealt out to the workers in turn."""
    return [j % p.w for j in range(p.n)]


def optimal(p: Problem) -> list[int]:
    """Least total of alpha * home + beta * inner km with every worker repeated for each of its places."""
    slots = np.repeat(np.arange(p.w), p.k)
    return [int(slots[c]) for c in hungarian(p.cost[slots].T)]


def minimax_greedy(p: Problem) -> list[int]:
    """The worker with the least load so far takes its cheapest bundle."""
    who, load, count = [-1] * p.n, np.zeros(p.w), np.zeros(p.w, int)
    for _ in range(p.n):
        w = min((w for w in range(p.w) if count[w] < p.k), key=lambda w: (load[w], w))
        j = min((j for j in range(p.n) if who[j] < 0), key=lambda j: (p.cost[w, j], j))
        who[j] = w
        count[w] += 1
        load[w] = p.route(w, [i for i, x in enumerate(who) if x == w])[0]
    return who


def swap_search(p: Problem, who: list[int], rounds: int = 50, same: Callable[[int, int], bool] | None = None) -> list[int]:
    """Swap pairs of bundles of two workers while that lowers the longest route; a swap is tried if it lowers the pair's own maximum."""
    who, load = list(who), p.loads(who)
    for _ in range(rounds):
        better = False
        for a in range(p.n):
            for b in range(a + 1, p.n):
                if who[a] == who[b] or same and not same(a, b):
                    continue
                trial = list(who)
                trial[a], trial[b] = who[b], who[a]
                new = {w: p.route(w, [j for j, x in enumerate(trial) if x == w])[0] for w in (who[a], who[b])}
                if max(new.values()) >= max(load[who[a]], load[who[b]]) - 1e-12:
                    continue
                after = load.copy()
                after[list(new)] = list(new.values())
                if after.max() < load.max() - 1e-12:
                    who, load, better = trial, after, True
        if not better:
            break
    return who


def minimax_swapped(p: Problem) -> list[int]:
    return swap_search(p, minimax_greedy(p))


def minimax_exact(p: Problem, limit: int = 200_000) -> list[int]:
    """Least maximum over workers of the sum of home and inner km, by branch and bound from the swapped greedy answer.

    After ``limit`` nodes the best answer so far is returned.
    """
    cost = p.home + p.inner
    sums = lambda who: max(sum(cost[w, j] for j, x in enumerate(who) if x == w) for w in range(p.w))
    start = min((swap_search(p, minimax_greedy(p)), optimal(p)), key=sums)
    order = sorted(range(p.n), key=lambda j: -cost[:, j].min())
    best, answer, nodes = sums(start), start, 0
    who, load, count = [-1] * p.n, [0.0] * p.w, [0] * p.w

    def place(at: int) -> None:
        nonlocal best, answer, nodes
        nodes += 1
        if nodes > limit:
            return
        if at == p.n:
            best, answer = max(load), list(who)
            return
        left = sum(cost[:, j].min() for j in order[at:])
        if (sum(load) + left) / p.w >= best - 1e-12:
            return
        j = order[at]
        for w in sorted(range(p.w), key=lambda w: load[w] + cost[w, j]):
            if count[w] < p.k and load[w] + cost[w, j] < best - 1e-12:
                who[j], load[w], count[w] = w, load[w] + cost[w, j], count[w] + 1
                place(at + 1)
                who[j], load[w], count[w] = -1, load[w] - cost[w, j], count[w] - 1

    place(0)
    return answer


def minimax_routed(p: Problem, limit: int = 2_000) -> list[int]:
    """Least longest route with the km between bundles: the exact answer of :func:`minimax_exact` improved by swaps on routed km."""
    return swap_search(p, minimax_exact(p, limit))


def nearest_then_refine(p: Problem) -> list[int]:
    """Each bundle to its nearest worker, overfull workers pass their bundles on at the least extra km, then swaps on the longest route."""
    who = [int(np.argmin(p.home[:, j])) for j in range(p.n)]
    while True:
        count = np.bincount(who, minlength=p.w)
        if count.max(initial=0) <= p.k:
            break
        moves = [(p.home[w, j] - p.home[who[j], j], j, w) for j in range(p.n) if count[who[j]] > p.k for w in range(p.w) if count[w] < p.k]
        _, j, w = min(moves)
        who[j] = w
    return swap_search(p, who)


def joint_tasks(p: Problem) -> list[int]:
    """One door-hanger and one survey bundle for each worker: nearest first for each task, then swaps within a task on the longest home-DH-D2DS way."""
    who = [-1] * p.n
    for task in ("DH", "D2DS"):
        held = [j for j in range(p.n) if p.task[j] == task]
        for _, j, w in sorted((p.home[w, j], j, w) for j in held for w in range(p.w)):
            if who[j] < 0 and all(who[i] != w for i in held):
                who[j] = w

    def way(w: int, own: list[int]) -> float:
        dh, d2 = ([j for j, x in enumerate(own) if x == w and p.task[j] == t] for t in ("DH", "D2DS"))
        if not dh:
            return float(p.home[w, d2[0]]) if d2 else 0.0
        return float(p.home[w, dh[0]] + (p.between[dh[0], d2[0]] if d2 else 0.0))

    better = True
    while better:
        better = False
        now = max(way(w, who) for w in range(p.w))
        for a in range(p.n):
            for b in range(a + 1, p.n):
                if p.task[a] == p.task[b] and who[a] != who[b] and min(who[a], who[b]) >= 0:
                    trial = list(who)
                    trial[a], trial[b] = who[b], who[a]
                    if (new := max(way(w, trial) for w in range(p.w))) < now - 1e-12:
                        who, now, better = trial, new, True
    return who


def _dealt(p: Problem, groups: list[list[int]]) -> list[int]:
    """Groups of bundles to workers at the least total of mean home km."""
    cost = np.array([[p.home[w, g].mean() if g else 0.0 for w in range(p.w)] for g in groups])
    who = [-1] * p.n
    for g, w in zip(groups, hungarian(cost)):
        for j in g:
            who[j] = w
    return who


def diameter(p: Problem, g: list[int]) -> float:
    """Largest distance within a group."""
    return float(p.between[np.ix_(g, g)].max()) if g else 0.0


def farthest_pair(p: Problem, g: list[int]) -> tuple[int, int]:
    return max(((a, b) for a in g for b in g if a < b), key=lambda x: (p.between[x], -x[0]))


def worst_outlier(p: Problem, g: list[int]) -> int:
    """The bundle with the largest mean distance from the others of its group."""
    return max(g, key=lambda j: (p.between[j, g].sum(), -j))


def far_seeds(p: Problem, n: int) -> list[int]:
    """Bundles far from each other, the first one nearest to the middle of all."""
    seeds = [int(np.argmin(p.between.sum(axis=1)))]
    while len(seeds) < min(n, p.n):
        seeds.append(int(np.argmax(p.between[seeds].min(axis=0))))
    return seeds


def _fill(p: Problem, seeds: list[int], rank: Callable[[list[int], int], float]) -> list[list[int]]:
    """Groups of at most k around the seeds; the pair of lowest rank is placed next."""
    groups = [[s] for s in seeds]
    left = set(range(p.n)) - set(seeds)
    while left:
        _, j, g = min((rank(groups[g], j), j, g) for j in left for g in range(len(groups)) if len(groups[g]) < p.k)
        groups[g].append(j)
        left.discard(j)
    return groups


def _exchange(p: Problem, groups: list[list[int]], rounds: int = 30) -> list[list[int]]:
    """Swap members of two groups while that lowers the sum of their diameters."""
    groups = [list(g) for g in groups]
    for _ in range(rounds):
        better = False
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                now = diameter(p, groups[a]) + diameter(p, groups[b])
                for x in list(groups[a]):
                    for y in list(groups[b]):
                        one, two = [y if j == x else j for j in groups[a]], [x if j == y else j for j in groups[b]]
                        if (new := diameter(p, one) + diameter(p, two)) < now - 1e-12:
                            groups[a], groups[b], now, better = one, two, new, True
                            break
                    else:
                        continue
                    break
        if not better:
            break
    return groups


def clustered(p: Problem, rounds: int = 50) -> list[int]:
    """K-means from far seeds with groups of at most k, dealt out to workers."""
    middle = p.places[far_seeds(p, p.w)]
    groups: list[list[int]] = []
    for _ in range(rounds):
        d = haversine(middle, p.places)
        new = [[] for _ in middle]
        for _, j, g in sorted((d[g, j], j, g) for g in range(len(middle)) for j in range(p.n)):
            if len(new[g]) < p.k and all(j not in x for x in new):
                new[g].append(j)
        if new == groups:
            break
        groups, middle = new, np.array([p.places[g].mean(axis=0) if g else m for g, m in zip(new, middle)])
    return _dealt(p, groups)


def compact_groups(p: Problem) -> list[int]:
    """Groups of at most k of small diameter: filled from far seeds by the diameter they would get, then exchanged."""
    return _dealt(p, _exchange(p, _fill(p, far_seeds(p, p.w), lambda g, j: diameter(p, [*g, j]))))


def bounded_groups(p: Problem, most_km: float = 15.0, rounds: int = 20) -> list[int]:
    """Clusters whose diameter should stay within ``most_km``: the worst outlier of a wide cluster changes places with a bundle that fits better."""
    who = clustered(p)
    groups = [[j for j, x in enumerate(who) if x == w] for w in range(p.w)]
    for _ in range(rounds):
        wide = [g for g in range(len(groups)) if diameter(p, groups[g]) > most_km]
        if not wide:
            break
        a = max(wide, key=lambda g: (diameter(p, groups[g]), -g))
        x = worst_outlier(p, groups[a])
        options = []
        for b in range(len(groups)):
            for y in groups[b] if b != a else []:
                one, two = [y if j == x else j for j in groups[a]], [x if j == y else j for j in groups[b]]
                options.append((max(diameter(p, one), diameter(p, two)), b, y, one, two))
        best = min(options, default=None)
        if best is None or best[0] >= max(diameter(p, groups[a]), diameter(p, groups[best[1]])) - 1e-12:
            break
        groups[a], groups[best[1]] = best[3], best[4]
    return _dealt(p, groups)


def edge_growth(p: Problem) -> list[int]:
    """Groups grown from dispersed seeds by the nearest bundle to any member."""
    return _dealt(p, _fill(p, far_seeds(p, p.w), lambda g, j: float(p.between[g, j].min())))


def greedy_compact(p: Problem, near_km: float = 8.0, relax_km: float = 2.0) -> list[int]:
    """Each worker in turn takes the nearest free bundle to home and then those within ``near_km`` of its group, a limit that is relaxed while the group isn't full."""
    who, left = [-1] * p.n, set(range(p.n))
    for w in sorted(range(p.w), key=lambda w: (float(p.home[w].min()), w)):
        held: list[int] = []
        limit = near_km
        while left and len(held) < p.k:
            rank = (lambda j: (p.home[w, j], j)) if not held else (lambda j: (float(p.between[held, j].max()), j))
            j = min(left, key=rank)
            if held and float(p.between[held, j].max()) > limit:
                limit += relax_km
                continue
            held.append(j)
            left.discard(j)
            who[j] = w
    return who


def greedy_insertion(p: Problem) -> list[int]:
    """Bundles from north to south, each to the worker whose route grows least; a full worker's growth counts twice."""
    who, count = [-1] * p.n, np.zeros(p.w, int)
    for j in sorted(range(p.n), key=lambda j: (-p.places[j, 0], j)):
        def growth(w: int) -> float:
            own = [i for i, x in enumerate(who) if x == w]
            g = p.route(w, [*own, j])[0] - p.route(w, own)[0]
            return g * (2 if count[w] >= p.k else 1)

        w = min(range(p.w), key=lambda w: (growth(w), w))
        who[j] = w
        count[w] += 1
    return who


def _bisect(p: Problem, held: list[int], homes: list[int], alpha: float) -> list[tuple[list[int], list[int]]]:
    """Cut bundles and places for workers in two along latitude or longitude, whichever leaves more compact halves; ``alpha`` below 1 weighs in how near they lie to homes."""
    if len(homes) <= 1:
        return [(held, homes)]
    half = len(homes) // 2
    options = []
    for axis in (0, 1):
        order = sorted(held, key=lambda j: (p.places[j, axis], j))
        cut = round(len(order) * half / len(homes))
        one, two = order[:cut], order[cut:]
        compact = diameter(p, one) + diameter(p, two)
        by_home = sorted(homes, key=lambda w: (p.homes[w, axis], w))
        near = sum(float(p.home[np.ix_(h, g)].mean()) if g else 0.0 for h, g in ((by_home[:half], one), (by_home[half:], two)))
        options.append((alpha * compact + (1 - alpha) * near, axis, one, two, by_home))
    _, _, one, two, by_home = min(options, key=lambda o: o[:2])
    return _bisect(p, one, by_home[:half], alpha) + _bisect(p, two, by_home[half:], alpha)


def bisection(p: Problem, alpha: float = 1.0) -> list[int]:
    """Groups by recursive cuts, dealt out to workers at the least total distance."""
    return _dealt(p, [g for g, _ in _bisect(p, list(range(p.n)), list(range(p.w)), alpha)])


def bisection_aware(p: Problem) -> list[int]:
    """Recursive cuts that weigh compactness and nearness to homes alike."""
    return bisection(p, 0.5)


def bisection_refined(p: Problem) -> list[int]:
    """Recursive cuts whose groups then exchange outliers."""
    return _dealt(p, _exchange(p, [g for g, _ in _bisect(p, list(range(p.n)), list(range(p.w)), 1.0)]))


def two_stage_routing(p: Problem) -> list[int]:
    """The optimal assignment; routes are closed tours (see :func:`kerbline.operators.assignment.assign`)."""
    return optimal(p)


def simplified_cost(p: Problem, who: list[int]) -> float:
    """Sum of alpha * home + beta * inner km."""
    return float(sum(p.cost[w, j] for j, w in enumerate(who) if w >= 0))


def routed_cost(p: Problem, who: list[int], closed: bool = False) -> float:
    """Sum of the workers' routes."""
    return float(sum(p.route(w, [j for j, x in enumerate(who) if x == w], closed)[0] for w in range(p.w)))


METHODS: dict[str, Callable[[Problem], list[int]]] = {
    f.__name__: f
    for f in (
        round_robin, optimal, minimax_greedy, minimax_swapped, minimax_exact, minimax_routed, nearest_then_refine, joint_tasks, clustered, compact_groups,
        bounded_groups, edge_growth, greedy_compact, greedy_insertion, bisection, bisection_aware, bisection_refined, two_stage_routing,
    )
}
