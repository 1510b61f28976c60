"""Distance joins and neighbour joins: every plan against brute force."""

import numpy as np
import pytest
from conftest import panel_of

from counterpane.errors import CounterpaneError
from counterpane.functions import kernels as K
from counterpane.operators import distance as D
from counterpane.operators import neighbours as N
from counterpane.operators.metrics import metric


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(21)
    left = rng.normal(size=(11, 6, 2))
    right = np.cumsum(rng.normal(size=(60, 6, 2)), axis=1)
    right[20:40] = right[7]  # a third of all references are copies of one series
    return left, right


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 7)


def brute(left, right, m, k, q_labels=None, r_labels=None):
    out = {}
    for i, x in enumerate(left):
        d = m(np.repeat(x[None], len(right), axis=0), right)
        ids = [j for j in np.lexsort((np.arange(len(right)), d)) if q_labels is None or q_labels[i] != r_labels[j]]
        out[i] = [(int(j), float(d[j])) for j in ids[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.ref_id, r.dist))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert [i for i, _ in a[key]] == [i for i, _ in b[key]]
        assert np.allclose([d for _, d in a[key]], [d for _, d in b[key]])


@pytest.mark.parametrize("name,params", [("euclidean", {}), ("dtw", {"window": 1}), ("softdtw", {"gamma": 0.5}),
                                         ("gak", {"sigma": 2.0}), ("manhattan", {})])
def test_distance_join_plans_agree(spark, data, small_blocks, name, params):
    left, right = data
    a, b = panel_of(spark, list(left)), panel_of(spark, list(right), first_id=100)
    m = metric(name, **params)
    for limit in (1 << 30, 0):
        rows = D.distance_join(a, b, name, broadcast_bytes=limit, **params).collect()
        assert len(rows) == len(left) * len(right)
        for r in rows:
            want = m(left[r.left_id][None], right[r.right_id - 100][None])[0]
            assert r.dist == pytest.approx(want, abs=1e-9)


def test_blocks_of_a_panel_and_its_own_means(spark, data, small_blocks):
    from counterpane.operators.model import class_means
    left, _ = data
    panel = panel_of(spark, list(left), label=[i % 2 for i in range(len(left))])
    plans = [D.distance_join(panel, class_means(panel), "manhattan", broadcast_bytes=limit) for limit in (1 << 30, 0)]
    one, two = [sorted((r.left_id, r.right_id, round(r.dist, 9)) for r in df.collect()) for df in plans]
    assert one == two and len(one) == 22
    same_panel = D.distance_join(panel, panel, "manhattan", broadcast_bytes=0)
    assert same_panel.count() == 121 and same_panel.where("left_id = right_id and dist <> 0").count() == 0


def test_series_of_different_lengths(spark, rng):
    a = [rng.normal(size=(t, 2)) for t in (3, 5, 3)]
    b = [rng.normal(size=(t, 2)) for t in (4, 6, 5, 4)]
    rows = D.distance_join(panel_of(spark, a), panel_of(spark, b), "dtw").collect()
    assert len(rows) == 12
    for r in rows:
        assert r.dist == pytest.approx(K.dtw_path(a[r.left_id], b[r.right_id])[0])


@pytest.mark.parametrize("name,params", [("euclidean", {}), ("manhattan", {}), ("dtw", {}), ("dtw", {"window": 1}),
                                         ("softdtw", {}), ("gak", {"sigma": 3.0})])
@pytest.mark.parametrize("k", [1, 4])
def test_knn_plans_agree_with_brute_force(spark, data, small_blocks, name, params, k):
    left, right = data
    q, r = panel_of(spark, list(left)), panel_of(spark, list(right))
    want = brute(left, right, metric(name, **params), k)
    same(found(N.knn_join(q, r, k, name, **params)), want)
    same(found(N.knn_join(q, r, k, name, broadcast_bytes=0, n_pivots=6, **params)), want)


def test_knn_with_fewer_references_than_k(spark, data):
    left, right = data
    q, r = panel_of(spark, list(left[:3])), panel_of(spark, list(right[:2]))
    for limit in (1 << 30, 0):
        assert N.knn_join(q, r, 5, broadcast_bytes=limit).count() == 6
    assert N.knn_join(q, r, 5, return_distance=False).columns == ["query_id", "rank", "ref_id"]
    for bad in (0, True, 1.5):
        with pytest.raises(CounterpaneError):
            N.knn_join(q, r, bad)


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("theta", [0.0, 0.6, 0.95])
def test_nearest_unlike(spark, data, small_blocks, k, theta):
    left, right = data
    rng = np.random.default_rng(3)
    q_lab = [int(v) for v in rng.integers(0, 3, len(left))]
    r_lab = [int(v) for v in rng.integers(0, 3, len(right))]
    conf = [float(v) for v in rng.random(len(right)) * 0.5 + 0.5]
    for j in range(20, 40):
        r_lab[j], conf[j] = r_lab[7], conf[7]
    q = panel_of(spark, list(left), pred_label=q_lab)
    r = panel_of(spark, list(right), pred_label=r_lab, confidence=conf)
    want = {}
    for i, hits in brute(left, right, metric("euclidean"), k, q_lab, r_lab).items():
        sure = [(j, d) for j, d in hits if conf[j] >= theta]
        if sure:
            want[i] = sure[0][0]
    for limit in (1 << 30, 0):
        rows = N.nun_join(q, r, n_neighbors=k, theta=theta, broadcast_bytes=limit, n_pivots=5).collect()
        assert {row.query_id: row.nun_id for row in rows} == want
        for row in rows:
            assert row.nun_label == r_lab[row.nun_id] != q_lab[row.query_id]
            assert row.nun_confidence == conf[row.nun_id] >= theta


def test_no_unlike_reference_gives_no_row(spark, data):
    left, right = data
    q = panel_of(spark, list(left), pred_label=[1] * len(left))
    r = panel_of(spark, list(right), pred_label=[1] * len(right), confidence=[0.9] * len(right))
    for limit in (1 << 30, 0):
        assert N.nun_join(q, r, broadcast_bytes=limit).count() == 0


def test_looked_up_columns(spark, data):
    left, right = data
    nuns = spark.createDataFrame([(i, 7) for i in range(50)] + [(90, 3)], "query_id bigint, nun_id bigint")
    rows = N.with_neighbour(nuns, panel_of(spark, list(right)), "x", salts=4).collect()
    assert len(rows) == 51
    for r in rows:
        assert r.nun_x == right[r.nun_id].ravel().tolist()


def test_paths_and_warped_pairs(spark, rng):
    x, y = rng.normal(size=(5, 2)), rng.normal(size=(4, 2))
    left, right = panel_of(spark, [x]), panel_of(spark, [y])
    pairs = spark.createDataFrame([(0, 0, 5, 4, 2, x.ravel().tolist(), y.ravel().tolist())],
                                  "left_id bigint, right_id bigint, t_len int, u_len int, n_ch int, "
                                  "x array<double>, y array<double>")
    path = D.dtw_path(pairs, y_len="u_len")
    rows = D.warp_pairs(path, left, right).orderBy("pos").collect()
    _, i, j = K.dtw_path(x, y)
    assert [(r.i, r.j) for r in rows] == list(zip(i, j))
    wx, wy = np.eye(5)[i], np.eye(4)[j]
    assert np.allclose([r.left_step for r in rows], wx @ x) and np.allclose([r.right_step for r in rows], wy @ y)
    cells = D.cost_cells(pairs, y_len="u_len").collect()
    assert len(cells) == 20
    for c in cells:
        assert c.cost == pytest.approx(((x[c.i] - y[c.j]) ** 2).sum())
    dist = D.pair_distance(pairs, "dtw", y_len="u_len").first().dist
    assert dist == pytest.approx(K.dtw_path(x, y)[0])


def test_self_kernel(spark, data):
    left, _ = data
    for r in D.self_kernel(panel_of(spark, list(left)), 2.0).collect():
        x = left[r.series_id][None]
        assert r.self_kernel == pytest.approx(K.gak_raw(x, x, sigma=2.0)[0])


def test_ragged_panels_agree_in_both_plans(spark, rng):
    shapes = [(8, 2), (10, 2), (5, 2), (8, 2), (10, 2), (7, 2), (12, 2), (8, 2)]
    panel = panel_of(spark, [rng.normal(size=s) for s in shapes])
    from counterpane.operators.neighbours import knn_join
    found = [sorted((r.query_id, r["rank"], r.ref_id, round(r.dist, 9)) for r in knn_join(panel, panel, 3, "dtw", **kw).collect())
             for kw in ({}, {"broadcast_bytes": 0, "n_pivots": 1}, {"broadcast_bytes": 0})]
    assert found[0] == found[1] == found[2] and len(found[0]) == 24


def test_query_blocks_do_not_follow_the_stride_of_the_ids():
    from counterpane.operators.neighbours import _scatter
    blocks = np.bincount(_scatter(np.arange(16_000) * 64) % 16, minlength=16)
    assert blocks.min() > 500
