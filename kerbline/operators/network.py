"""Street networks of one connected component: bundle growth, repair and walks as plain Python over small groups.

A :class:`Network` holds one component's segments; the functions below change a list ``bundle`` of bundle numbers (None for unassigned). Order
is by segment id and a seed, never by hashing, so results repeat. :mod:`kerbline.operators.bundling` applies them per component with Spark.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict, deque
from collections.abc import Iterable

import numpy as np

Bundles = list[int | None]


class Network:
    """Segments with address counts, middles, snapped ends, lengths and neighbours (by position)."""

    def __init__(self, ids, counts, xy, ends, lengths, pairs):
        self.ids, self.counts = list(ids), [int(c) for c in counts]
        self.xy, self.ends, self.lengths = np.asarray(xy, float).reshape(-1, 2), list(ends), [float(x) for x in lengths]
        self.nbrs: list[list[int]] = [[] for _ in self.ids]
        for a, b in sorted(pairs):
            self.nbrs[a].append(b)
            self.nbrs[b].append(a)

    def __len__(self) -> int:
        return len(self.ids)


def seeded_order(keys: Iterable, seed: int) -> list[int]:
    """Positions of ``keys`` in a repeatable shuffled order."""
    mark = [hashlib.sha256(f"{seed}|{k}".encode()).hexdigest() for k in keys]
    return sorted(range(len(mark)), key=lambda i: mark[i])


def members(bundle: Bundles) -> dict[int, list[int]]:
    out = defaultdict(list)
    for i, b in enumerate(bundle):
        if b is not None:
            out[b].append(i)
    return dict(out)


def sizes(net: Network, bundle: Bundles) -> dict[int, int]:
    return {b: sum(net.counts[i] for i in held) for b, held in members(bundle).items()}


def centre(net: Network, held: list[int]) -> np.ndarray:
    return net.xy[held].mean(axis=0)


def fresh(bundle: Bundles) -> int:
    return max((b for b in bundle if b is not None), default=-1) + 1


def grow_greedy(net: Network, target: int, seed: int) -> Bundles:
    """From each unassigned segment in a seeded order, take neighbours of many addresses first until the target is reached.

    Neighbours that were waiting when the target was reached stay unassigned; :func:`attach_residuals` places them.
    """
    bundle: Bundles = [None] * len(net)
    free, number = set(range(len(net))), 0
    for start in seeded_order(net.ids, seed):
        if start not in free:
            continue
        free.discard(start)
        waiting, total = deque([start]), 0
        while waiting and total < target:
            at = waiting.popleft()
            bundle[at] = number
            total += net.counts[at]
            near = sorted((j for j in net.nbrs[at] if j in free), key=lambda j: (-net.counts[j], net.ids[j]))
            free.difference_update(near)
            waiting.extend(near)
        number += 1
    return bundle


def spread_seeds(net: Network, n: int, seed: int, exact: int = 100) -> list[int]:
    """``n`` segments far from each other: the first by the seeded order, up to ``exact`` farthest ones, and the rest in the seeded order."""
    order = seeded_order(net.ids, seed)
    chosen = [order[0]]
    gap = np.hypot(*(net.xy - net.xy[chosen[0]]).T)
    while len(chosen) < min(n, exact, len(net)):
        gap[chosen] = -1
        best = max(range(len(net)), key=lambda i: (gap[i], -order.index(i) if len(net) < 50 else -i))
        chosen.append(best)
        gap = np.minimum(gap, np.hypot(*(net.xy - net.xy[best]).T))
    held = set(chosen)
    chosen += [i for i in order if i not in held][: max(0, min(n, len(net)) - len(chosen))]
    return chosen


def grow_balanced(net: Network, target: int, seed: int) -> Bundles:
    """As many seeds as the component's addresses need; the smallest bundle grows first, by its neighbour of most addresses.

    A segment that several bundles touch so goes to the smallest of them. What no bundle touches goes to the nearest one.
    """
    n = max(1, -(-sum(net.counts) // max(1, target)))
    bundle: Bundles = [None] * len(net)
    queue, total = [], []
    for b, start in enumerate(spread_seeds(net, n, seed)):
        bundle[start] = b
        total.append(net.counts[start])
        heapq.heappush(queue, (total[b], b))
    while queue:
        size, b = heapq.heappop(queue)
        if size != total[b]:
            continue
        edge = {j for i, x in enumerate(bundle) if x == b for j in net.nbrs[i] if bundle[j] is None}
        if edge:
            best = min(edge, key=lambda j: (-net.counts[j], net.ids[j]))
            bundle[best] = b
            total[b] += net.counts[best]
            heapq.heappush(queue, (total[b], b))
    held = members(bundle)
    middles = {b: centre(net, own) for b, own in held.items()}
    for i, x in enumerate(bundle):
        if x is None:
            bundle[i] = min(middles, key=lambda b: (float(np.hypot(*(net.xy[i] - middles[b]))), b))
    return bundle


def touches(net: Network, bundle: Bundles, held: list[int]) -> set[int]:
    """Bundles that touch the segments ``held``."""
    own = {bundle[i] for i in held}
    return {bundle[j] for i in held for j in net.nbrs[i] if bundle[j] is not None} - own


def contiguous(net: Network, held: Iterable[int]) -> bool:
    held = set(held)
    if not held:
        return True
    seen, waiting = set(), [min(held)]
    while waiting:
        i = waiting.pop()
        if i not in seen:
            seen.add(i)
            waiting += [j for j in net.nbrs[i] if j in held and j not in seen]
    return len(seen) == len(held)


def rebalance(net: Network, bundle: Bundles, target: int, slack: float = 0.15, rounds: int = 10) -> Bundles:
    """Move border segments (at most two neighbours in their bundle) from bundles above the target to touching ones below it.

    A move keeps the giving bundle in one piece and doesn't empty it.
    """
    bundle, total = list(bundle), sizes(net, bundle)
    for _ in range(rounds):
        moved = False
        for b in sorted(total, key=lambda x: (-total[x], x)):
            if total[b] <= target * (1 + slack):
                continue
            for i in sorted((i for i, x in enumerate(bundle) if x == b), key=lambda i: net.ids[i]):
                inner = [j for j in net.nbrs[i] if bundle[j] == b]
                wanted = sorted({bundle[j] for j in net.nbrs[i]} - {b, None}, key=lambda x: (total[x], x))
                wanted = [x for x in wanted if total[x] < target * (1 - slack)]
                rest = [j for j, x in enumerate(bundle) if x == b and j != i]
                if len(inner) <= 2 and wanted and rest and contiguous(net, rest):
                    bundle[i] = wanted[0]
                    total[b] -= net.counts[i]
                    total[wanted[0]] += net.counts[i]
                    moved = True
                    if total[b] <= target * (1 + slack):
                        break
        if not moved:
            break
    return bundle


def merge_tiny(net: Network, bundle: Bundles, least: int, most: float | None = None, touching: bool = False, rounds: int = 10) -> Bundles:
    """Merge bundles of one segment or fewer than ``least`` addresses into the nearest other one, smallest bundles first.

    With ``most`` only where the sum stays within it, and with ``touching`` only into bundles that touch and aren't tiny themselves; what finds
    no place stays.
    """
    bundle = list(bundle)
    for _ in range(rounds):
        held, total = members(bundle), sizes(net, bundle)
        tiny = lambda b: len(held[b]) == 1 or total[b] < least
        moved = False
        for b in sorted(filter(tiny, list(held)), key=lambda x: (total[x], x)):
            if b not in held or not tiny(b):
                continue
            fits = touches(net, bundle, held[b]) if touching else set(held) - {b}
            fits = [x for x in fits if (most is None or total[x] + total[b] <= most) and not (touching and tiny(x))]
            if not fits:
                continue
            here = centre(net, held[b])
            size = (lambda x: total[x]) if touching else (lambda x: 0)
            best = min(fits, key=lambda x: (size(x), float(np.hypot(*(centre(net, held[x]) - here))), x))
            for i in held[b]:
                bundle[i] = best
            held[best] += held.pop(b)
            total[best] += total.pop(b)
            moved = True
        if not moved:
            break
    return bundle


def attach_residuals(net: Network, bundle: Bundles, target: int, slack: float = 1.1) -> Bundles:
    """Give each unassigned segment to a touching bundle: the nearest that stays within the slack, else the nearest; repeats while any is placed."""
    bundle = list(bundle)
    placed = True
    while placed:
        placed = False
        held, total = members(bundle), sizes(net, bundle)
        for i in sorted((i for i, x in enumerate(bundle) if x is None), key=lambda i: net.ids[i]):
            near = {bundle[j] for j in net.nbrs[i]} - {None}
            if near:
                best = min(near, key=lambda b: (total[b] + net.counts[i] > slack * target, float(np.hypot(*(centre(net, held[b]) - net.xy[i]))), b))
                bundle[i] = best
                held[best].append(i)
                total[best] += net.counts[i]
                placed = True
    return bundle


def pieces(net: Network, held: list[int]) -> list[list[int]]:
    """The parts of ``held`` that hang together at their snapped ends, largest first."""
    at = defaultdict(list)
    for i in held:
        for end in set(net.ends[i]):
            at[end].append(i)
    seen, out = set(), []
    for start in held:
        if start in seen:
            continue
        part, waiting = [], [start]
        seen.add(start)
        while waiting:
            i = waiting.pop()
            part.append(i)
            for end in net.ends[i]:
                for j in at[end]:
                    if j not in seen:
                        seen.add(j)
                        waiting.append(j)
        out.append(sorted(part))
    return sorted(out, key=lambda p: (-len(p), net.ids[p[0]]))


def split_pieces(net: Network, bundle: Bundles) -> Bundles:
    """Keep the largest piece of each bundle; the others become bundles of their own."""
    bundle, number = list(bundle), fresh(bundle)
    for _, held in sorted(members(bundle).items()):
        for part in pieces(net, held)[1:]:
            for i in part:
                bundle[i] = number
            number += 1
    return bundle


def split_oversized(net: Network, bundle: Bundles, target: int, threshold: float = 1.5) -> Bundles:
    """Cut bundles above ``target * threshold`` into chunks of about the target, walking outwards from a segment of few neighbours."""
    bundle, number, total = list(bundle), fresh(bundle), sizes(net, bundle)
    for b, held in sorted(members(bundle).items()):
        if total[b] <= target * threshold:
            continue
        free, first = set(held), True
        while free:
            degree = lambda i: sum(j in free for j in net.nbrs[i])
            waiting, seen, chunk, size = deque([min(free, key=lambda i: (degree(i), net.ids[i]))]), set(), [], 0
            while waiting and size < target:
                i = waiting.popleft()
                if i in seen or i not in free:
                    continue
                seen.add(i)
                chunk.append(i)
                size += net.counts[i]
                waiting += sorted((j for j in net.nbrs[i] if j in free and j not in seen), key=lambda j: net.ids[j])
            free.difference_update(chunk)
            if free and sum(net.counts[i] for i in free) < target / 2 and contiguous(net, list(free) + chunk):
                chunk += free
                free = set()
            for i in chunk:
                bundle[i] = b if first else number
            number += not first
            first = False
    return bundle


def regroup_invalid(net: Network, bundle: Bundles, target: int, multiplier: float, seed: int, rounds: int = 5) -> Bundles:
    """Dissolve bundles outside [0.9, multiplier] times the target and grow new ones; keep a round only if fewer bundles are invalid.

    Segments that form no valid bundle keep their old number.
    """
    low, high = 0.9 * target, multiplier * target
    wrong = lambda x: [b for b, s in sizes(net, x).items() if not low <= s <= high]
    bundle = list(bundle)
    for step in range(rounds):
        bad = set(wrong(bundle))
        if not bad:
            break
        trial, number = list(bundle), fresh(bundle)
        free = {i for i, b in enumerate(bundle) if b in bad}
        for start in [i for i in seeded_order(net.ids, seed + step) if i in free]:
            if start not in free:
                continue
            chunk, total, waiting, seen = [], 0, deque([start]), {start}
            while waiting and total < low:
                i = waiting.popleft()
                if total + net.counts[i] > high:
                    continue
                chunk.append(i)
                total += net.counts[i]
                for j in sorted(net.nbrs[i], key=lambda j: (-net.counts[j], net.ids[j])):
                    if j in free and j not in seen:
                        seen.add(j)
                        waiting.append(j)
            if low <= total <= high:
                for i in chunk:
                    trial[i] = number
                number += 1
                free.difference_update(chunk)
        if len(wrong(trial)) >= len(bad):
            break
        bundle = trial
    return bundle


def odd_nodes(net: Network, held: Iterable[int]) -> list:
    """Snapped nodes where an odd number of the segments' ends meet, in order."""
    degree = defaultdict(int)
    for i in held:
        for end in net.ends[i]:
            degree[end] += 1
    return sorted(n for n, d in degree.items() if d % 2)


def _paths(net: Network, held: list[int], start) -> tuple[dict, dict]:
    """Shortest distances from a node along the segments, and the segment that leads to each node."""
    out = defaultdict(list)
    for i in held:
        a, b = net.ends[i]
        out[a].append((b, i))
        out[b].append((a, i))
    dist, via, queue = {start: 0.0}, {}, [(0.0, start)]
    while queue:
        d, node = heapq.heappop(queue)
        if d > dist[node]:
            continue
        for far, i in out[node]:
            if d + net.lengths[i] < dist.get(far, np.inf):
                dist[far] = d + net.lengths[i]
                via[far] = (node, i)
                heapq.heappush(queue, (dist[far], far))
    return dist, via


def pair_odd_nodes(net: Network, held: list[int], exact: int = 14) -> tuple[float, list[int]]:
    """(length, segments walked twice): the odd nodes but two are paired by shortest paths along the segments.

    Up to ``exact`` odd nodes the pairing is the best one, by dynamic programming over sets of nodes; beyond it pairs are taken nearest first.
    """
    odd = odd_nodes(net, held)
    if len(odd) <= 2:
        return 0.0, []
    found = {n: _paths(net, held, n) for n in odd}
    cost = lambda i, j: found[odd[i]][0].get(odd[j], np.inf)
    n = len(odd)
    if n <= exact:
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        full = (1 << n) - 1
        answers = []
        for mask in sorted(range(1 << n), key=lambda m: m.bit_count()):
            if mask not in best:
                continue
            if n - mask.bit_count() == 2:
                answers.append(best[mask])
                continue
            free = [k for k in range(n) if not mask >> k & 1]
            for x, i in enumerate(free[: 3 if n - mask.bit_count() > 2 else 1]):
                for j in free[x + 1 :]:
                    new, c = mask | 1 << i | 1 << j, best[mask][0] + cost(i, j)
                    if new != full and c < best.get(new, (np.inf, ()))[0]:
                        best[new] = (c, best[mask][1] + ((i, j),))
        total, chosen = min(answers)
    else:
        order = sorted((cost(i, j), i, j) for i in range(n) for j in range(i + 1, n))
        used, chosen, total = set(), [], 0.0
        for c, i, j in order:
            if len(used) < n - 2 and not {i, j} & used:
                used |= {i, j}
                chosen.append((i, j))
                total += c
    again = []
    for i, j in chosen:
        node, via = odd[j], found[odd[i]][1]
        while node != odd[i]:
            node, k = via[node]
            again.append(k)
    return total, again


def walk(net: Network, held: list[int]) -> list[tuple[int, bool]]:
    """(segment, reversed) of a walk over all segments of a connected bundle, those of odd nodes' paths twice.

    Every duplicated segment is an edge of its own, so after pairing at most two odd nodes are left and a walk exists.
    """
    if not held:
        raise ValueError("a walk needs segments")
    if len(pieces(net, held)) > 1:
        raise ValueError("the bundle's segments do not hang together")
    _, again = pair_odd_nodes(net, held)
    edges = list(held) + again
    at = defaultdict(list)
    for e, i in enumerate(edges):
        for end in net.ends[i]:
            at[end].append(e)
    odd = sorted(n for n, es in at.items() if len(es) % 2)
    start = odd[0] if odd else net.ends[min(held, key=lambda i: net.ids[i])][0]
    for es in at.values():
        es.sort(key=lambda e: (net.ids[edges[e]], e), reverse=True)
    used, stack, out = set(), [(start, None, False)], []
    while stack:
        node, _, _ = stack[-1]
        while at[node] and at[node][-1] in used:
            at[node].pop()
        if not at[node]:
            out.append(stack.pop())
            continue
        e = at[node].pop()
        used.add(e)
        a, b = net.ends[edges[e]]
        stack.append((b if node == a else a, edges[e], node != a))
    return [(i, back) for _, i, back in reversed(out) if i is not None]


def walkable(net: Network, held: list[int], limit: float | None = None) -> tuple[bool, int, int]:
    """(can be walked, odd nodes before, odd nodes after pairing): connected, and with ``limit`` the repeated length stays within that share."""
    before = len(odd_nodes(net, held))
    if len(pieces(net, held)) != 1:
        return False, before, before
    extra, again = pair_odd_nodes(net, held)
    degree = defaultdict(int)
    for i in [*held, *again]:
        for end in net.ends[i]:
            degree[end] += 1
    after = sum(d % 2 for d in degree.values())
    return after in (0, 2) and (limit is None or extra <= limit * sum(net.lengths[i] for i in held)), before, after


def trim_unwalkable(net: Network, held: list[int], limit: float | None = None) -> tuple[list[int], list[int]]:
    """(kept, removed): border segments at nodes of three or more are removed, fewest addresses first, until the rest can be walked."""
    held, removed = list(held), []
    while len(held) > 1 and not walkable(net, held, limit)[0]:
        degree = defaultdict(int)
        for i in held:
            for end in net.ends[i]:
                degree[end] += 1
        border = [i for i in held if max(degree[e] for e in net.ends[i]) >= 3 and min(degree[e] for e in net.ends[i]) == 1]
        choice = border or [i for i in held if len(pieces(net, [j for j in held if j != i])) <= len(pieces(net, held))] or held
        gone = min(choice, key=lambda i: (net.counts[i], net.ids[i]))
        held.remove(gone)
        removed.append(gone)
    return held, removed


def regroup_unwalkable(net: Network, bundle: Bundles, target: int, limit: float | None = None) -> Bundles:
    """Dissolve bundles that can't be walked; give each of their segments to a touching bundle that stays walkable, else grow new ones."""
    bundle = list(bundle)
    bad = [b for b, held in sorted(members(bundle).items()) if not walkable(net, held, limit)[0]]
    free = [i for i, b in enumerate(bundle) if b in bad]
    for i in free:
        bundle[i] = None
    for i in sorted(free, key=lambda i: net.ids[i]):
        for b in sorted({bundle[j] for j in net.nbrs[i]} - {None}, key=lambda b: (sizes(net, bundle)[b], b)):
            held = members(bundle)[b] + [i]
            if sum(net.counts[j] for j in held) <= 1.1 * target and walkable(net, held, limit)[0]:
                bundle[i] = b
                break
    number = max(fresh(bundle), max(bad, default=-1) + 1)
    for i in sorted(free, key=lambda i: net.ids[i]):
        if bundle[i] is not None:
            continue
        held, waiting, seen = [], deque([i]), {i}
        while waiting and sum(net.counts[j] for j in held) < target:
            j = waiting.popleft()
            if walkable(net, [*held, j], limit)[0]:
                held.append(j)
                for k in sorted(net.nbrs[j], key=lambda k: net.ids[k]):
                    if bundle[k] is None and k not in seen:
                        seen.add(k)
                        waiting.append(k)
        for j in held:
            bundle[j] = number
        number += 1
    return bundle


def greedy_bundles(net: Network, target: int, seed: int, least: int | None = None) -> Bundles:
    """Grow, attach what is left, keep bundles in one piece, merge tiny ones, and keep in one piece again."""
    bundle = attach_residuals(net, grow_greedy(net, target, seed), target)
    bundle = merge_tiny(net, split_pieces(net, bundle), target // 4 if least is None else least)
    return split_pieces(net, bundle)


def balanced_bundles(net: Network, target: int, seed: int, multiplier: float = 1.2, least: int | None = None, limit: float | None = None) -> Bundles:
    """Balanced growth and rebalancing, then contiguity, size and walkability repairs; bundles stay within int(target * multiplier) where a repair decides."""
    least, most = target // 4 if least is None else least, int(target * multiplier)
    bundle = rebalance(net, grow_balanced(net, target, seed), target)
    bundle = split_pieces(net, attach_residuals(net, bundle, target))
    bundle = split_pieces(net, split_oversized(net, bundle, target, multiplier))
    bundle = merge_tiny(net, bundle, least, most, touching=True)
    bundle = merge_tiny(net, bundle, least, most)
    bundle = split_pieces(net, regroup_invalid(net, bundle, target, multiplier, seed))
    return regroup_unwalkable(net, bundle, target, limit)
