"""Properties of bundle growth, repairs and walks on grids and small graphs."""

import itertools
import random

import pytest

from kerbline.operators import network as nw


def grid(n: int, seed: int = 1) -> nw.Network:
    rng, ids, ends, xy = random.Random(seed), [], [], []
    for i in range(n):
        for j in range(n):
            for di, dj in ((1, 0), (0, 1)):
                if i + di < n and j + dj < n:
                    ids.append(len(ids))
                    ends.append((f"{i}:{j}", f"{i + di}:{j + dj}"))
                    xy.append((100 * i + 50 * di, 100 * j + 50 * dj))
    at = {}
    for s, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(s)
        at.setdefault(b, []).append(s)
    pairs = {(min(a, b), max(a, b)) for own in at.values() for a in own for b in own if a != b}
    return nw.Network(ids, [rng.randint(5, 24) for _ in ids], xy, ends, [100.0] * len(ids), pairs)


def graph(ends: list[tuple[str, str]], lengths=None) -> nw.Network:
    pairs = {(i, j) for i in range(len(ends)) for j in range(i + 1, len(ends)) if set(ends[i]) & set(ends[j])}
    return nw.Network(range(len(ends)), [10] * len(ends), [(i, 0) for i in range(len(ends))], ends, lengths or [1.0] * len(ends), pairs)


@pytest.mark.parametrize("method", [nw.greedy_bundles, nw.balanced_bundles])
def test_workflows_cover_and_hang_together(method):
    net = grid(9)
    bundle = method(net, 120, 42)
    assert None not in bundle and bundle == method(net, 120, 42)
    assert all(len(nw.pieces(net, held)) == 1 for held in nw.members(bundle).values())


def test_balanced_growth_is_more_even():
    net = grid(10)
    spread = lambda b: (lambda s: max(s) - min(s))(list(nw.sizes(net, b).values()))
    grown = nw.grow_balanced(net, 120, 3)
    assert None not in grown and len(set(grown)) == -(-sum(net.counts) // 120)
    after = nw.rebalance(net, grown, 120)
    assert spread(after) <= spread(grown) and sorted(set(after)) == sorted(set(grown))


def test_greedy_growth_leaves_waiting_segments_to_the_attachment():
    net = grid(6)
    grown = nw.grow_greedy(net, 60, 1)
    assert all(total < 60 + 24 for total in nw.sizes(net, grown).values())
    assert None not in nw.attach_residuals(net, grown, 60)


def test_seeds_are_distinct_and_far():
    net = grid(8)
    seeds = nw.spread_seeds(net, 9, 5)
    assert len(set(seeds)) == 9 and len(nw.spread_seeds(net, 10**6, 5)) == len(net)


def test_merges_respect_the_limit():
    net = grid(5)
    single = list(range(len(net)))
    merged = nw.merge_tiny(net, single, 30, 60)
    assert max(nw.sizes(net, merged).values()) <= 60 and len(set(merged)) < len(net)
    assert nw.merge_tiny(net, [0] * len(net), 30) == [0] * len(net)
    touching = nw.merge_tiny(net, nw.grow_balanced(net, 60, 2), 40, 80, touching=True)
    assert None not in touching


def test_splits():
    net = grid(6)
    whole = nw.split_oversized(net, [0] * len(net), 60, 1.5)
    assert max(nw.sizes(net, whole).values()) < 60 + 24 + 30 and None not in whole
    two = graph([("a", "b"), ("b", "c"), ("x", "y")])
    assert nw.split_pieces(two, [0, 0, 0]) == [0, 0, 1]


def test_regrouping_never_adds_invalid_bundles():
    net = grid(7)
    start = nw.grow_greedy(net, 60, 4)
    wrong = lambda b: sum(not 54 <= s <= 72 for s in nw.sizes(net, b).values())
    assert wrong(nw.regroup_invalid(net, start, 60, 1.2, 4)) <= wrong(start)


CASES = {
    "cycle": [("a", "b"), ("b", "c"), ("c", "a")], "path": [("a", "b"), ("b", "c")], "star": [("o", "a"), ("o", "b"), ("o", "c")],
    "loop": [("a", "a"), ("a", "b")], "parallel": [("a", "b"), ("a", "b"), ("b", "c")], "theta": [("a", "b"), ("a", "x"), ("x", "b"), ("a", "y"), ("y", "b"), ("b", "z")],
}


@pytest.mark.parametrize("name", CASES)
def test_walks_are_continuous_and_complete(name):
    net = graph(CASES[name])
    steps = nw.walk(net, list(range(len(net))))
    assert {i for i, _ in steps} == set(range(len(net)))
    ends = [net.ends[i][::-1] if back else net.ends[i] for i, back in steps]
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    ok, before, after = nw.walkable(net, list(range(len(net))))
    assert ok and after == min(before, 2)


def test_walks_of_grids():
    net = grid(5)
    steps = nw.walk(net, list(range(len(net))))
    ends = [net.ends[i][::-1] if back else net.ends[i] for i, back in steps]
    assert {i for i, _ in steps} == set(range(len(net))) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    extra, again = nw.pair_odd_nodes(net, list(range(len(net))))
    assert len(steps) == len(net) + len(again) and extra == sum(net.lengths[i] for i in again)


def test_pairing_is_the_shortest():
    net = graph([("a", "x"), ("b", "x"), ("x", "y"), ("y", "c"), ("y", "d"), ("d", "e"), ("d", "f")], [1.0, 1.5, 5.0, 3.0, 2.0, 0.5, 4.0])
    held = list(range(len(net)))
    odd = nw.odd_nodes(net, held)
    far = {n: nw._paths(net, held, n)[0] for n in odd}

    def best(left: tuple) -> float:
        return 0.0 if not left else min(far[left[0]][x] + best(tuple(n for n in left[1:] if n != x)) for x in left[1:])

    want = min(best(tuple(n for n in odd if n not in pair)) for pair in itertools.combinations(odd, 2))
    extra, again = nw.pair_odd_nodes(net, held)
    assert extra == pytest.approx(want) and extra == sum(net.lengths[i] for i in again)
    assert nw.pair_odd_nodes(net, held, exact=0)[0] >= want


def test_disconnected_and_empty_bundles():
    net = graph([("a", "b"), ("x", "y")])
    with pytest.raises(ValueError):
        nw.walk(net, [0, 1])
    with pytest.raises(ValueError):
        nw.walk(net, [])
    assert nw.walkable(net, [0, 1])[0] is False
    kept, removed = nw.trim_unwalkable(net, [0, 1])
    assert len(kept) == 1 and len(removed) == 1
    regrouped = nw.regroup_unwalkable(net, [0, 0], 20)
    assert None not in regrouped and regrouped[0] != regrouped[1]
