"""Estimated tiles: never above the distance, few pairs measured, bounded copies of series between tasks."""

import numpy as np
import pytest
from conftest import panel_of

from counterpane.functions import kernels as K
from counterpane.operators import neighbours as N
from counterpane.operators.blocks import cross_block, top_k_block
from counterpane.operators.estimates import estimates
from counterpane.operators.metrics import metric

METRICS = [("euclidean", {}), ("manhattan", {}), ("dtw", {}), ("dtw", {"window": 1}), ("soft_dtw", {"gamma": 0.5}),
           ("gak", {"sigma": 2.0}), ("gak", {"sigma": 0.05}), ("gakraw", {"sigma": 2.0})]


@pytest.mark.parametrize("name,params", METRICS)
@pytest.mark.parametrize("offset,scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e-9), (-3.0, 1e12)])
def test_estimates_never_exceed_the_distance(name, params, offset, scale):
    rng = np.random.default_rng(5)
    X, Y = (offset + scale * rng.normal(size=(n, 5, 2)) for n in (40, 90))
    Y[:10] = X[:10]
    Y[10] *= 50
    m = metric(name, **params)
    dist, guess = cross_block(m, X, Y), estimates(m, X, [Y[:30], Y[30:]])
    rows = np.arange(len(X))
    for t, own in enumerate((dist[:, :30], dist[:, 30:])):
        assert not (guess.tile(rows, t) > guess.limit(own)).any()
        if guess.glances:
            limits = np.stack([guess.glance_limit(rows, d) for d in own.T], axis=1)
            assert not (guess.glance(rows, t) > limits).any()


@pytest.mark.parametrize("name,params", METRICS)
def test_tiles_glances_and_gaps_give_the_sorted_rows(monkeypatch, name, params):
    from counterpane.operators import blocks
    monkeypatch.setattr(blocks, "TILE_COLUMNS", 50)
    rng = np.random.default_rng(8)
    X, Y = rng.normal(size=(30, 4, 3)), rng.normal(size=(400, 4, 3))
    X[5:9], Y[100:140], Y[300, 0, 0], X[2, 1, 1] = X[4], Y[7], np.nan, np.nan
    own, theirs = rng.integers(0, 3, 30), rng.integers(0, 3, 400)
    m = metric(name, **params)
    full = cross_block(m, X, Y)
    full = np.where(np.isnan(full), np.inf, full)
    for allowed in (None, own[:, None] != theirs[None, :]):
        q, r, d = top_k_block(m, 3, X, Y, allowed)
        open_ = np.ones(full.shape, dtype=bool) if allowed is None else allowed
        want = [(i, j) for i in range(30) for j in [j for j in np.argsort(full[i], kind="stable") if open_[i, j]][:3]]
        assert list(zip(q.tolist(), r.tolist())) == want
        assert np.allclose(d, [full[i, j] for i, j in want])


@pytest.mark.parametrize("name", ["dtw", "soft_dtw", "gak", "gak_raw"])
def test_few_pairs_are_measured(monkeypatch, name):
    rng = np.random.default_rng(2)
    X, Y = (rng.gamma(2.0, size=(n, 5, 3)) for n in (100, 8000))
    m, seen = metric(name, sigma=4.0), []
    for kernel in ("dtw", "soft_dtw", "gak_raw"):
        plain = getattr(K, kernel)
        counted = lambda X, Y, plain=plain, **params: (seen.append(len(X)), plain(X, Y, **params))[1]
        monkeypatch.setattr(K, kernel, counted)
        monkeypatch.setitem(K.METRICS, kernel.replace("_", ""), (counted, K.METRICS[kernel.replace("_", "")][1]))
    top_k_block(m, 3, X, Y, None)
    assert 0 < sum(seen) < 0.1 * len(X) * len(Y)


@pytest.mark.parametrize("name,params", [("dtw", {}), ("soft_dtw", {"gamma": 0.5}), ("gak", {"sigma": 20.0})])
def test_a_glance_gives_the_first_limit(monkeypatch, name, params):
    from counterpane.operators.estimates import Steps
    asked, tile = [], Steps.tile
    monkeypatch.setattr(Steps, "tile", lambda self, rows, t: asked.append(len(rows)) or tile(self, rows, t))
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 5, 2)) * 3
    X, Y = (np.repeat(centres, n, axis=0) + rng.normal(size=(40 * n, 5, 2)) * 0.05 for n in (3, 40))
    m = metric(name, **params)
    q, r, dist = top_k_block(m, 2, X, Y, None)
    whole = cross_block(m, X, Y)
    order = np.argsort(whole, axis=1, kind="stable")[:, :2]
    assert (r.reshape(-1, 2) == order).all() and (q.reshape(-1, 2)[:, 0] == np.arange(len(X))).all()
    assert np.allclose(dist.reshape(-1, 2), np.take_along_axis(whole, order, axis=1))
    assert sum(asked) < len(X) / 4  # queries whose pairs were all estimated; before the change: every one


def test_series_are_copied_as_often_as_there_are_blocks(spark, rng):
    panel = panel_of(spark, list(rng.normal(size=(300, 4, 2))))
    columns = N._columns(panel, "query_id"), N._columns(panel, "ref_id")
    found = N._dealt(*columns, metric("euclidean"), 2, False, 0, None)
    blocks = int(np.ceil(np.sqrt(N.TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    assert found.count() <= 300 * 2 * blocks
    assert found.select("query_id").distinct().count() == 300


def test_copies_of_a_reference_leave_the_smallest_ids(spark, rng):
    series = rng.normal(size=(1, 4, 2))
    panel = panel_of(spark, [series[0]] * 50)
    kept = N._without_copies(N._columns(panel, "ref_id"), 3).collect()
    assert sorted(r.ref_id for r in kept) == [0, 1, 2]
    assert {(r.query_id, r.ref_id) for r in N.knn_join(panel, panel, 3).collect()} == {(q, r) for q in range(50) for r in range(3)}


def test_ranks_of_all_groups_equal_those_of_each(rng):
    from counterpane.operators.fronts import ranks
    from counterpane.operators.search import all_ranks
    for dims, top in ((2, 4), (3, 9), (3, 1 << 20)):
        values = rng.integers(0, top, size=(6, 70, dims)).astype(float)
        for enough in (1, 20, 70):
            want = np.stack([ranks(v, enough) for v in values])
            assert np.array_equal(all_ranks(values, enough), want)


def test_proximity_of_all_groups_is_one_call(monkeypatch, rng):
    from counterpane.operators import search
    from counterpane.operators.metrics import Metric
    from counterpane.operators.model import LogitModel
    calls, plain = [], Metric.__call__
    monkeypatch.setattr(Metric, "__call__", lambda self, X, Y: (calls.append(len(X)), plain(self, X, Y))[1])
    settings = search.SearchSettings(population_size=6, generations=2, proximity=metric("dtw"))
    groups = [search._Group(i, 3, 1, *rng.normal(size=(2, 5, 2)), label=i % 2) for i in range(7)]
    search._evolve(settings, LogitModel(), groups)
    assert calls == [7 * 6, 7 * 12, 7 * 12]


def test_the_model_sees_one_of_equal_masks(rng):
    """Few bits: most children are known, and the populations are those of a search that judges all of them."""
    from counterpane.operators import search
    from counterpane.operators.model import LogitModel
    rows = []

    class Watched(LogitModel):
        def predict(self, X):
            rows.append(X)
            return super().predict(X)

    settings = search.SearchSettings(population_size=20, generations=4, optimize_proximity=False)
    groups = [search._Group(i, 2, 1, *rng.normal(size=(2, 5, 2)), label=i % 2) for i in range(3)]
    search._evolve(settings, Watched(), groups)
    assert len(rows[0]) <= 3 * 16 and sum(map(len, rows)) < 3 * (20 + 4 * 40) / 2
    assert all(len(np.unique(X.reshape(len(X), -1), axis=0)) == len(X) for X in rows)
    for g in groups:
        proba = LogitModel().predict(g.edit(g.masks))[:, g.label]
        assert np.array_equal(g.f, np.stack([proba, g.masks.mean(axis=1)], axis=1))
        assert np.array_equal(g.g, settings.theta - proba)


def test_draws_below_a_limit_are_the_draws(rng):
    from counterpane.functions import draws
    state = np.concatenate([[0, 1, draws.MODULUS - 1], rng.integers(0, draws.MODULUS, 3000)])
    plain = [draws.finish(draws.absorb(int(x), 3)) for x in state]
    every = draws.finish(draws.absorb(state[:, None], np.arange(7)))
    assert np.array_equal(every[:, 3], plain)
    for limit in (0.0, 1 / 7, 0.5, float(every[5, 2]), 1.0):
        assert np.array_equal(draws.draws_below(state, 7, limit), every < limit)
    assert draws.draws_below(state[:0], 7, 0.5).shape == (0, 7)


def test_ranks_with_null_values_and_many_rows_of_one_group(rng, monkeypatch):
    from counterpane.operators import search
    values = rng.integers(0, 5, size=(4, 90, 3)).astype(float)
    for holes in (False, True):
        values[..., 1][rng.random((4, 90)) < 0.1 * holes] = np.nan
        want = []
        for v in values:  # the longest chain above each row
            beaten = (v[None] <= v[:, None]).all(axis=2) & ~(v[None] == v[:, None]).all(axis=2)
            rank = np.zeros(90, dtype=int)
            for _ in range(90):
                rank = np.where(beaten.any(axis=1), np.where(beaten, rank + 1, 0).max(axis=1), 0)
            want.append(rank)
        for pairs in (1 << 20, 900, 50):
            monkeypatch.setattr(search, "PAIRS", pairs)
            assert np.array_equal(search.all_ranks(values, 1 << 20), want)
