"""The small per-group helpers against brute force."""

import itertools
import random

import numpy as np
import pytest

from peakloom.config import CarbonSearch, FineRange, HsqcSearch, LibraryFilter, PackConfig, ScoreWindow
from peakloom.functions.text import parse_regions
from peakloom.operators import align, clusters, dept, packing, structure
from peakloom.operators.assignment import max_gain_matching


def brute_gain(rows, cols, gains):
    best = 0.0
    for size in range(len(rows) + 1):
        for pick in itertools.combinations(range(len(rows)), size):
            if len({rows[e] for e in pick}) == size and len({cols[e] for e in pick}) == size:
                best = max(best, sum(gains[e] for e in pick))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_optimal(seed):
    rng = random.Random(seed)
    pairs = rng.sample([(r, c) for r in range(4) for c in range(4)], rng.randint(1, 11))
    rows, cols = [p[0] for p in pairs], [p[1] for p in pairs]
    gains = [rng.choice([1.0, 2.0, 3.5, 5.0, 9.0, 9.5]) for _ in pairs]
    pick = max_gain_matching(rows, cols, gains)
    assert len({rows[e] for e in pick}) == len({cols[e] for e in pick}) == len(pick)
    assert sum(gains[e] for e in pick) == pytest.approx(brute_gain(rows, cols, gains))


@pytest.mark.parametrize("seed", range(40))
def test_nearest_assignment_is_optimal(seed):
    rng = random.Random(seed)
    short = np.array([rng.randint(0, 20) / 2 for _ in range(rng.randint(1, 4))])
    long = np.array([rng.randint(0, 20) / 2 for _ in range(len(short) + rng.randint(0, 3))])
    out = structure.nearest_positions(short, long)
    assert len(set(out)) == len(short)
    cost = sum(abs(short[i] - long[j]) for i, j in enumerate(out))
    best = min(sum(abs(short[i] - long[j]) for i, j in enumerate(p)) for p in itertools.permutations(range(len(long)), len(short)))
    assert cost == pytest.approx(best)


@pytest.mark.parametrize("seed", range(40))
def test_packing_matches_exhaustive_search(seed):
    rng = random.Random(seed)
    ids = [rng.sample(range(8), rng.randint(1, 3)) for _ in range(rng.randint(1, 9))]
    weights = sorted((round(rng.uniform(-0.5, 4), 3) for _ in ids), reverse=True)
    best = 0.0
    for size in range(len(ids) + 1):
        for pick in itertools.combinations(range(len(ids)), size):
            used = [p for i in pick for p in ids[i]]
            if len(used) == len(set(used)):
                best = max(best, sum(weights[i] for i in pick))
    exact, mode = packing.pack_component(weights, ids, PackConfig())
    assert mode == "exact"
    assert sum(weights[i] for i in exact) == pytest.approx(best)
    wide, mode = packing.pack_component(weights, ids, PackConfig(exact_limit=0, beam_width=5000))
    assert mode == "beam_large"
    assert sum(weights[i] for i in wide) == pytest.approx(best)


def test_node_limit_falls_back_to_beam():
    ids = [[i] for i in range(10)]
    pick, mode = packing.pack_component([1.0] * 10, ids, PackConfig(node_limit=3))
    assert mode == "beam_timeout" and len(pick) == 10


def test_shift_growth_follows_best_support():
    def pair(a, b, n, shift, residual):
        return {"order_a": a, "order_b": b, "n": n, "shift": shift, "residual": residual}

    pairs = [pair(0, 1, 5, 0.1, 0.0), pair(0, 2, 1, 0.9, 0.0), pair(1, 2, 4, 0.2, 0.01)]
    assert align.grow_shifts(pairs, 3) == pytest.approx([0.0, 0.1, 0.3])
    assert align.grow_shifts([pair(0, 1, 1, 0.4, 0.0)], 3) == [0.0, 0.0, 0.0]


def test_linkage_and_merging():
    x = np.array([[1.0, 0.0], [0.9, 0.1], [-1.0, 0.0], [-0.8, 0.1]])
    part = clusters.complete_linkage(x, 1.0)
    assert part[0] == part[1] and part[2] == part[3] and part[0] != part[2]
    assert len(set(clusters.merge_centroids([2, 1, 1], x[:3], 0.5))) == 2
    assert clusters.absorb_small(["a", "a", "b"], x[:3], 2) == ["a", "a", "a"]


def test_first_fit_lists():
    assert dept.first_fit_rest([10.0, 10.05, 50.0], [10.02]) == [10.05, 50.0]


def test_settings_are_checked():
    for bad in (
        lambda: ScoreWindow(2.0, 0.5),
        lambda: FineRange(5, 5, 0.5, 1),
        lambda: CarbonSearch(self_weight=0.9, env_weight=0.2),
        lambda: CarbonSearch(env_level=4),
        lambda: HsqcSearch(mode=4),
        lambda: HsqcSearch(c_tol=0),
        lambda: parse_regions("# nothing"),
        lambda: parse_regions("50-10:0.2"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert LibraryFilter().max_carbons(25) == 28
    assert [r.tol for r in parse_regions("0-50:0.20\n50 110 0.3")] == [0.2, 0.3]
