"""Assignment methods on random and hand-made problems."""

import itertools

import numpy as np
import pytest

from kerbline.operators import solvers as sv


def problem(seed: int, w: int = 3, k: int = 3, **more) -> sv.Problem:
    rng = np.random.default_rng(seed)
    spot = lambda n: np.column_stack([32.5 + rng.random(n) / 3, -117.3 + rng.random(n) / 3])
    return sv.Problem(spot(w), spot(w * k), rng.random(w * k), **more)


@pytest.mark.parametrize("method", sorted(set(sv.METHODS) - {"joint_tasks", "greedy_insertion"}))
@pytest.mark.parametrize("seed", [1, 2])
def test_every_bundle_has_a_worker_within_capacity(method, seed):
    p = problem(seed)
    who = sv.METHODS[method](p)
    assert sorted(np.bincount(who, minlength=p.w)) == [p.k] * p.w


def test_insertion_assigns_all():
    p = problem(4)
    assert set(sv.greedy_insertion(p)) <= set(range(p.w))


def test_hungarian_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        c = rng.random((5, 6))
        best = min(sum(c[i, j] for i, j in enumerate(x)) for x in itertools.permutations(range(6), 5))
        got = sv.hungarian(c)
        assert len(set(got)) == 5 and sum(c[i, j] for i, j in enumerate(got)) == pytest.approx(best)


def test_optimal_has_the_least_cost():
    p = problem(5, 2, 2)
    all_ = [list(x) for x in itertools.product(range(2), repeat=4) if sum(x) == 2]
    assert sv.simplified_cost(p, sv.optimal(p)) == pytest.approx(min(sv.simplified_cost(p, w) for w in all_))


def test_exact_minimax():
    p = problem(6, 2, 3)
    cost = p.home + p.inner
    most = lambda who: max(sum(cost[w, j] for j, x in enumerate(who) if x == w) for w in range(2))
    best = min(most(list(x)) for x in itertools.product(range(2), repeat=6) if sum(x) == 3)
    assert most(sv.minimax_exact(p)) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(4))
def test_refinement_never_lengthens_the_longest_route(seed):
    p = problem(seed, 3, 4)
    start = sv.minimax_greedy(p)
    assert p.loads(sv.swap_search(p, start)).max() <= p.loads(start).max() + 1e-9
    assert p.loads(sv.minimax_routed(p)).max() <= p.loads(sv.minimax_exact(p, 2_000)).max() + 1e-9


def test_exact_routes():
    p = problem(7, 1, 5)
    held = list(range(5))
    km, order = p.route(0, held)
    best = min(p.home[0, o[0]] + sum(p.between[a, b] for a, b in zip(o, o[1:])) for o in itertools.permutations(held))
    assert sorted(order) == held and km == pytest.approx(best + p.inner.sum())
    assert p.route(0, held[:3], closed=True)[0] >= p.route(0, held[:3])[0]
    assert p.route(0, []) == (0.0, [])


def test_joint_tasks_with_known_optimum():
    homes, places = [(0, 0), (0, 1)], [(0, 0.1), (0, 0.9), (0, 0.2), (0, 0.8)]
    p = sv.Problem(np.array(homes), np.array(places), np.zeros(4), task=["DH", "DH", "D2DS", "D2DS"])
    assert sv.joint_tasks(p) == [0, 1, 0, 1]


def test_spread_of_groups():
    p = problem(8)
    g = list(range(4))
    a, b = sv.farthest_pair(p, g)
    assert sv.diameter(p, g) == p.between[a, b] == p.between[np.ix_(g, g)].max()
    assert sv.worst_outlier(p, g) in g
