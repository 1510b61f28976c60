"""Pareto fronts, ranks, niches and selection against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpane.operators import fronts as P
from counterpane.operators import niches as N


def brute_ranks(values):
    left, rank, level = set(range(len(values))), {}, 0
    while left:
        front = {i for i in left if not any((values[j] <= values[i]).all() and (values[j] < values[i]).any()
                                            for j in left)}
        for i in front:
            rank[i] = level
        left -= front
        level += 1
    return rank


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    sizes = {1: 90, 2: 8, 3: 1, 4: 25}  # one group holds most rows
    out, n = [], 0
    for g, size in sizes.items():
        for v in np.round(rng.random((size, 3)), 1):
            out.append((g, n, *[float(a) for a in v], float(rng.random() - 0.6)))
            n += 1
    return out


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "grp bigint, row_id bigint, a double, b double, c double, g double").repartition(5)


OBJ = ["a", "b", "c"]


def truth(rows, keep=lambda r: True):
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and keep(r)]
        if own:
            ranks = brute_ranks(np.array([r[2:5] for r in own]))
            out.update({own[i][1]: level for i, level in ranks.items()})
    return out


@pytest.mark.parametrize("block", [4096, 5])
def test_front_and_rank(df, rows, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    want = truth(rows)
    assert {r.row_id for r in P.pareto_front(df, ["grp"], OBJ, "row_id").collect()} == {i for i, k in want.items() if k == 0}
    got = {r.row_id: r["rank"] for r in P.pareto_rank(df, ["grp"], OBJ, "row_id", group_limit=block * 10).collect()}
    assert got == want


def test_large_group_on_a_grid(df, rows):
    got = {r.row_id: r["rank"] for r in P.pareto_rank(df, ["grp"], OBJ, "row_id", group_limit=40).collect()}
    assert got == truth(rows)


def test_feasible_front(df, rows):
    want = truth(rows, keep=lambda r: r[5] <= 0)
    got = {r.row_id for r in P.feasible_front(df, ["grp"], OBJ, "row_id").collect()}
    assert got == {i for i, k in want.items() if k == 0}
    assert P.feasible_front(df.withColumn("g", F.lit(1.0)), ["grp"], OBJ, "row_id").count() == 0


def test_one_group_without_keys(df, rows):
    values = np.array([r[2:5] for r in rows])
    ranks = brute_ranks(values)
    got = {r.row_id for r in P.pareto_front(df, [], OBJ, "row_id").collect()}
    assert got == {rows[i][1] for i, k in ranks.items() if k == 0}


def test_penalty(df, rows):
    got = {r.row_id: (r.a, r.b, r.c) for r in N.penalise(df, ["grp"], OBJ).collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        ok = [r for r in own if r[5] <= 0]
        worst = np.array([r[2:5] for r in (ok or own)]).max(axis=0)
        for r in own:
            assert got[r[1]] == pytest.approx(tuple(r[2:5]) if r[5] <= 0 else tuple(worst + r[5]))


def test_directions():
    assert N.direction_list(2, 2) == [[0.0, 1.0], [0.5, 0.5], [1.0, 0.0]]
    three = N.direction_list(3, 3)
    assert len(three) == 10 and three[0] == [0, 0, 1] and three[-1] == [1, 0, 0] and three == sorted(three)
    assert all(sum(d) == pytest.approx(1) for d in N.direction_list(4, 5)) and len(N.direction_list(4, 5)) == 56
    assert N.direction_list(1, 7) == [[1.0]] and N.direction_list(3, 0) == [[1 / 3] * 3]
    for bad in ((0, 3), (2, -1)):
        with pytest.raises(ValueError):
            N.direction_list(*bad)


def test_direction_table(spark):
    rows = N.reference_directions(spark, 2, 12).orderBy("dir_id").collect()
    assert [r.w for r in rows] == N.direction_list(2, 12)


def expected_nadir(front, ideal):
    m = front.shape[1]
    worst = front.max(axis=0)
    if len(front) < m:
        return worst
    points = []
    for j in range(m):
        w = np.full(m, 1e6)
        w[j] = 1
        points.append(front[int(np.argmin(((front - ideal) * w).max(axis=1)))] - ideal)
    if abs(np.linalg.det(points)) < 1e-15:
        return worst
    plane = np.linalg.solve(np.array(points), np.ones(m))
    return ideal + 1 / plane if (plane > 1e-14).all() else worst


@pytest.mark.parametrize("names", [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]])
def test_nadir_point(spark, rows, names):
    rng = np.random.default_rng(9)
    full = [(*r[:2], *[float(v) for v in rng.random(4)]) for r in rows]
    df = spark.createDataFrame(full, "grp bigint, row_id bigint, a double, b double, c double, d double")
    front = P.pareto_front(df, ["grp"], names, "row_id")
    ideal = N.ideal_point(df, ["grp"], names)
    got = {r.grp: r for r in N.nadir_point(front, ideal, ["grp"], names, "row_id").collect()}
    for g in {r[0] for r in full}:
        values = np.array([r[2:2 + len(names)] for r in full if r[0] == g])
        first = values[[i for i, k in brute_ranks(values).items() if k == 0]]
        assert got[g].ideal == pytest.approx(values.min(axis=0).tolist())
        assert got[g].nadir == pytest.approx(expected_nadir(first, values.min(axis=0)).tolist())


def test_singular_plane_falls_back(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0)], "grp bigint, row_id bigint, a double, b double")
    scales = N.nadir_point(df, N.ideal_point(df, ["grp"], ["a", "b"]), ["grp"], ["a", "b"], "row_id").first()
    assert scales.nadir == [0.0, 0.0]


def test_niche_rounds(spark):
    """Emptiest niches first; an empty niche gives its closest member first."""
    rows = [(1, i, i % 3, abs(i - 4) / 10) for i in range(12)]
    cands = spark.createDataFrame(rows, "grp bigint, row_id bigint, niche int, niche_dist double")
    counts = spark.createDataFrame([(1, 0, 2)], "grp bigint, niche int, members bigint")
    for n in range(1, 13):
        got = N.niche_select(cands, counts, n, ["grp"], "row_id").collect()
        assert len(got) == n
        members = {0: 2, 1: 0, 2: 0}
        for r in sorted(got, key=lambda r: r.level):
            assert r.level == members[r.niche]
            members[r.niche] += 1
        open_ = [m for k, m in members.items() if m - (2 if k == 0 else 0) < 4]
        assert not open_ or max(m for k, m in members.items() if (k, m) != (0, 2)) - min(open_) <= 1
        if n >= 2:
            assert {4, 5} <= {r.row_id for r in got}
    assert N.niche_select(cands, counts, 99, ["grp"], "row_id").count() == 12


def test_survivors(df, rows):
    kept = N.survive(df, ["grp"], OBJ, "row_id", 10).collect()
    by_group = {}
    for r in kept:
        by_group.setdefault(r.grp, []).append(r)
    assert {g: len(v) for g, v in by_group.items()} == {1: 10, 2: 8, 3: 1, 4: 10}
    for g, members in by_group.items():
        ranks = sorted(r["rank"] for r in members)
        own = {r[1] for r in rows if r[0] == g}
        assert {r.row_id for r in members} <= own and ranks[0] == 0


@pytest.mark.parametrize("groups", [["grp"], []])
def test_niche_operators_keep_null_groups_and_work_without_groups(spark, groups):
    from counterpane.operators.niches import assign_niche, ideal_point, nadir_point, penalise, survive
    rng = np.random.default_rng(4)
    rows = [(None if i % 2 else 1, i, float(rng.random()), float(rng.random()), float(rng.random() - 0.7)) for i in range(24)]
    df = spark.createDataFrame(rows, "grp int, row_id bigint, a double, b double, g double")
    objectives = ["a", "b"]
    assert penalise(df, groups, objectives).count() == 24
    ideal = ideal_point(df, groups, objectives)
    scales = nadir_point(df, ideal, groups, objectives, "row_id")
    assert assign_niche(df, scales, groups, objectives, 3).count() == 24
    kept = survive(df, groups, objectives, "row_id", 5).collect()
    assert len(kept) == (10 if groups else 5) and len({r.row_id for r in kept}) == len(kept)


def test_lumped_ranks():
    from counterpane.operators.fronts import ranks
    rng = np.random.default_rng(2)
    values = rng.integers(0, 6, (60, 3)).astype(float)
    whole = ranks(values)
    assert dict(enumerate(whole.tolist())) == {i: k for i, k in brute_ranks(values).items()}
    for enough in (1, 10, 40, 60):
        first = next(k for k in range(1, 61) if (whole < k).sum() >= enough)
        assert (ranks(values, enough) == np.minimum(whole, first)).all()


def wide_rows(spark, n, d, seed, digits):
    values = np.round(np.random.default_rng(seed).random((n, d)), digits)
    return values, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)],
                                         "row_id bigint, " + ", ".join(f"f{k} double" for k in range(d))).repartition(4)


@pytest.mark.parametrize("d, digits", [(1, 2), (2, 2), (3, 1), (4, 1)])
def test_ranks_on_the_grid_and_in_one_pass(spark, d, digits):
    values, rows = wide_rows(spark, 300, d, d, digits)
    want, names = brute_ranks(values), [f"f{k}" for k in range(d)]
    assert P.ranks(values).tolist() == [want[i] for i in range(len(values))]
    got = {r.row_id: r["rank"] for r in P.pareto_rank(rows, [], names, "row_id", group_limit=100).collect()}
    assert got == want
    assert (P.on_front(values) == np.array([want[i] == 0 for i in range(len(values))])).all()


def test_first_fronts_alone(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 50)
    values, rows = wide_rows(spark, 800, 2, 9, 3)
    want = brute_ranks(values)
    got = {r.row_id: r["rank"] for r in P.pareto_rank(rows, [], ["f0", "f1"], "row_id", enough=20).collect()}
    sizes = np.cumsum(np.bincount(list(want.values())))
    needed = int(np.searchsorted(sizes, 20))  # the front with which 20 rows are full
    assert len(got) < len(want) / 2
    assert all(got[i] == k for i, k in want.items() if k <= needed)
    assert all(k > needed for i, k in got.items() if want[i] > needed)


def test_only_blocks_with_fitting_corners_meet(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 20)
    monkeypatch.setattr(P, "STRONG", 5)
    values, _ = wide_rows(spark, 1000, 3, 4, 6)
    values = values / values.sum(axis=1, keepdims=True)  # nearly all of a plane is on the front
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "row_id bigint, f0 double, f1 double, f2 double")
    want = {i for i in range(len(values)) if not any((values[j] <= values[i]).all() and (values[j] < values[i]).any()
                                                     for j in range(len(values)))}
    names = ["f0", "f1", "f2"]
    assert {r.row_id for r in P.pareto_front(rows, [], names, "row_id").collect()} == want
    placed = P.corner_blocks(rows, [], names, "row_id", 1000)
    assert placed.groupBy("_block").count().agg(F.max("count")).first()[0] <= 20
    assert P.corner_pairs(placed, [], names).count() < 50 * 50 / 4


def test_running_sums_cross_parts(spark):
    from counterpane.operators.running import running_sums
    rows = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i, i * i) for i in range(400)], "g int, i int, v int").repartition(7)
    got = running_sums(rows, ["g"], ["i"], total=F.col("v"), place=F.lit(1)).collect()
    for r in got:
        before = [i for i in range(r.i + 1) if (None if i % 3 == 0 else i % 3) == r.g]
        assert (r.total, r.place) == (sum(i * i for i in before), len(before))


def test_cells_are_told_a_few_rows_for_each_rank(spark, monkeypatch, rng):
    from counterpane.operators import fronts
    sizes, plain = [], fronts.cut
    monkeypatch.setattr(fronts, "cut", lambda df: (sizes.append((df.columns, (kept := plain(df)).count())), kept)[1])
    values = rng.random(size=(3000, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "row_id bigint, a double, b double")
    got = {r.row_id: r["rank"] for r in fronts.pareto_rank(df, [], ["a", "b"], "row_id", group_limit=1000).collect()}
    assert got == dict(enumerate(fronts.ranks(values).tolist()))
    told = [n for columns, n in sizes if "rank" in columns]
    # every cell's own points once, and what it tells others: fewer rows than points
    assert sum(told) < 3000 * 1.5 and len(told) == 10


def test_repeated_points_of_a_large_group_need_no_grid(spark, monkeypatch, rng):
    """6,000 rows of 60 different points: a task holds them all, so no diagonals are walked."""
    from counterpane.operators import fronts
    points = np.round(rng.random(size=(60, 2)), 2)
    values = points[rng.integers(0, 60, 6000)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "row_id bigint, a double, b double")
    monkeypatch.setattr(fronts, "_grid_ranks", lambda *args: pytest.fail("a grid"))
    got = {r.row_id: r["rank"] for r in fronts.pareto_rank(df, [], ["a", "b"], "row_id", group_limit=100).collect()}
    assert got == dict(enumerate(fronts.ranks(values).tolist()))


def test_ranges_of_two_objectives_hold_more_than_a_whole_group(spark, monkeypatch, rng):
    """By default the ranges of the plane are cut by STRIP_LIMIT: 900 points, 2 ranges, 3 diagonals."""
    from counterpane.operators import fronts
    ranked, plain = [], fronts.cut
    monkeypatch.setattr(fronts, "cut", lambda df: (ranked.append("rank" in df.columns), plain(df))[1])
    monkeypatch.setattr(fronts, "RANK_LIMIT", 100)
    monkeypatch.setattr(fronts, "STRIP_LIMIT", 500)
    values = rng.normal(size=(900, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "row_id bigint, a double, b double")
    got = {r.row_id: r["rank"] for r in fronts.pareto_rank(df, [], ["a", "b"], "row_id").collect()}
    assert got == dict(enumerate(fronts.ranks(values).tolist())) and sum(ranked) == 2 * 3


def test_plane_with_ties_infinite_values_and_null_groups(spark, rng):
    from counterpane.operators import fronts
    values = np.stack([rng.integers(0, 40, 700).astype(float), np.round(rng.normal(size=700), 1)], axis=1)
    values[rng.random(700) < 0.03, 0], values[rng.random(700) < 0.03, 1] = np.inf, -np.inf
    values[:40, 1] = np.inf
    of = [None if i % 3 else 1 for i in range(700)]
    df = spark.createDataFrame([(g, i, *map(float, v)) for i, (g, v) in enumerate(zip(of, values))],
                               "grp int, row_id bigint, a double, b double")
    got = {r.row_id: r["rank"] for r in fronts.pareto_rank(df, ["grp"], ["a", "b"], "row_id", group_limit=90).collect()}
    for group in (None, 1):
        rows = [i for i in range(700) if of[i] == group]
        assert [got[i] for i in rows] == fronts.ranks(values[rows]).tolist()
