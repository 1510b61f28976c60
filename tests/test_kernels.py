"""Distance kernels against plain loops, and their properties."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from counterpane.errors import CounterpaneError
from counterpane.functions import kernels as K
from counterpane.operators.blocks import cross_block, top_k_block
from counterpane.operators.metrics import metric

RAMP = (np.arange(16) / 16).reshape(8, 2)
TWOS = np.full((8, 2), 2.0)
SHORT = np.arange(1.0, 7.0).reshape(3, 2)


def paths(t1, t2):
    """All warping paths through a small table."""
    def walk(i, j):
        if (i, j) == (t1 - 1, t2 - 1):
            yield [(i, j)]
            return
        for di, dj in ((1, 1), (1, 0), (0, 1)):
            if i + di < t1 and j + dj < t2:
                for rest in walk(i + di, j + dj):
                    yield [(i, j), *rest]
    return list(walk(0, 0))


def cost(x, y, i, j):
    return float(((x[i] - y[j]) ** 2).sum())


def one(kernel, x, y, **params):
    return float(kernel(x[None], y[None], **params)[0])


@pytest.fixture(params=[(3, 4, 1), (4, 4, 2), (1, 3, 2), (3, 1, 1), (5, 3, 3)])
def pair(request):
    t1, t2, c = request.param
    rng = np.random.default_rng(t1 * 100 + t2 * 10 + c)
    return rng.normal(size=(t1, c)), rng.normal(size=(t2, c))


def test_dtw_is_the_cheapest_path(pair):
    x, y = pair
    best = min(sum(cost(x, y, i, j) for i, j in p) for p in paths(len(x), len(y)))
    assert one(K.dtw, x, y) == pytest.approx(math.sqrt(best), abs=1e-12)


def test_soft_dtw_sums_over_all_paths(pair):
    x, y = pair
    for gamma in (0.1, 1.0, 10.0):
        totals = [-sum(cost(x, y, i, j) for i, j in p) / gamma for p in paths(len(x), len(y))]
        want = -gamma * (max(totals) + math.log(sum(math.exp(t - max(totals)) for t in totals)))
        assert one(K.soft_dtw, x, y, gamma=gamma) == pytest.approx(want, rel=1e-9)


def test_alignment_kernel_sums_products_over_all_paths(pair):
    x, y = pair
    for sigma in (0.5, 1.0, 2.0):
        def near(i, j):
            g = math.exp(-cost(x, y, i, j) / (2 * sigma ** 2))
            return g / (2 - g)
        want = sum(math.prod(near(i, j) for i, j in p) for p in paths(len(x), len(y)))
        assert one(K.gak_raw, x, y, sigma=sigma) == pytest.approx(want, rel=1e-9)


def test_normalised_kernel():
    assert one(K.gak, RAMP, RAMP) == pytest.approx(1.0)
    assert 0.0 <= one(K.gak, RAMP, TWOS) <= 1.0


def test_lock_step():
    assert one(K.euclidean, RAMP, TWOS) == pytest.approx(math.sqrt(((RAMP - TWOS) ** 2).sum()))
    assert one(K.manhattan, RAMP, TWOS) == pytest.approx(np.abs(RAMP - TWOS).sum())
    with pytest.raises(ValueError):
        metric("euclidean")(RAMP[None], SHORT[None])


def test_band():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 2)), rng.normal(size=(9, 2))
    free = one(K.dtw, x, y)
    previous = math.inf
    for radius in range(0, 9):
        banded = one(K.dtw, x, y, radius=radius)
        assert free - 1e-12 <= banded <= previous + 1e-12
        previous = banded
    assert previous == pytest.approx(free)
    assert one(K.dtw, x, y, radius=0) == pytest.approx(np.sqrt(((x - y) ** 2).sum()))
    assert np.array_equal(K.band(3, 5, 0), np.array([[1, 0, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 0, 1]], bool))
    assert K.band(1, 4, 1).tolist() == [[True, True, False, False]]


def test_path_ties_go_diagonal_then_up_then_left():
    flat = np.zeros((3, 1))
    dist, i, j = K.dtw_path(flat, flat)
    assert dist == 0 and i.tolist() == [0, 1, 2] and j.tolist() == [0, 1, 2]
    _, i, j = K.dtw_path(np.zeros((3, 1)), np.zeros((2, 1)))
    assert list(zip(i, j)) == [(0, 0), (1, 0), (2, 1)] or list(zip(i, j)) == [(0, 0), (1, 1), (2, 1)]
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.normal(size=(6, 2)), rng.normal(size=(4, 2))
        dist, i, j = K.dtw_path(x, y)
        assert dist == pytest.approx(one(K.dtw, x, y))
        assert math.sqrt(sum(cost(x, y, a, b) for a, b in zip(i, j))) == pytest.approx(dist)
        steps = set(zip(np.diff(i), np.diff(j)))
        assert steps <= {(1, 1), (1, 0), (0, 1)}


@pytest.mark.parametrize("name,params", [("euclidean", {}), ("manhattan", {}), ("dtw", {}), ("dtw", {"radius": 2}),
                                         ("softdtw", {"gamma": 0.7})])
@settings(max_examples=25, deadline=None)
@given(seed=st.integers(0, 10_000))
def test_box_bounds_never_exceed_the_distance(name, params, seed):
    rng = np.random.default_rng(seed)
    X, Y = rng.normal(size=(4, 6, 2)), rng.normal(size=(5, 6, 2)) + rng.normal() * 3
    bound = K.box_bound(name, X, Y.min(axis=0), Y.max(axis=0), params)
    kernel = K.METRICS[name][0]
    for x, b in zip(X, bound):
        assert (kernel(np.repeat(x[None], 5, axis=0), Y, **params) >= b - 1e-9).all()


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "dtw", "softdtw", "gak"])
def test_top_k_with_pruning_equals_sorting(name):
    rng = np.random.default_rng(11)
    X, Y = rng.normal(size=(7, 6, 2)), np.cumsum(rng.normal(size=(60, 6, 2)), axis=0)
    Y[30:35] = Y[3]
    allowed = rng.random((7, 60)) < 0.7
    m = metric(name)
    full = np.where(allowed, cross_block(m, X, Y), np.inf)
    for k in (1, 3):
        q, r, d = top_k_block(m, k, X, Y, allowed)
        want = [(i, j) for i in range(7) for j in np.argsort(full[i], kind="stable")[:k]]
        assert list(zip(q.tolist(), r.tolist())) == want
        assert np.allclose(d, [full[i, j] for i, j in want])


def test_registry():
    assert metric("DTW", window=3).params == {"radius": 3}
    assert metric("soft_dtw").name == metric("SoftDTW").name == "softdtw"
    with pytest.raises(CounterpaneError):
        metric("cosine")
    with pytest.raises(CounterpaneError):
        metric("dtw", window=-1)


def test_tiles_do_not_change_results(monkeypatch):
    rng = np.random.default_rng(4)
    X, Y = rng.normal(size=(50, 5, 2)), rng.normal(size=(50, 6, 2))
    whole = K.dtw(X, Y)
    monkeypatch.setattr(K, "TILE_BYTES", 500)
    assert np.array_equal(K.dtw(X, Y), whole)


def test_pairs_are_symmetric():
    for name, (x, y) in itertools.product(("dtw", "softdtw", "gak", "manhattan"), [(RAMP, TWOS)]):
        m = metric(name)
        assert m(x[None], y[None])[0] == pytest.approx(m(y[None], x[None])[0])
