"""Sources, sinks, array functions and validation."""

import numpy as np
import pytest
from conftest import panel_of
from pyspark.sql import functions as F

from counterpane.errors import CounterpaneError
from counterpane.functions import arrays as A
from counterpane.operators.panel import changed_span, minmax_by_step, scale_to_channel, validate_panel
from counterpane.operators.windows import max_sum_window, window_starts
from counterpane.plans.explain import validate_params
from counterpane.sources import panels as P
from counterpane.sources import results as R


def first(df):
    return df.first()[0]


@pytest.fixture
def four(spark):
    data = np.arange(24.0).reshape(4, 3, 2)
    return panel_of(spark, list(data), label=[1, 0, 1, 0])


def test_csv_round_trip(spark, four, tmp_path):
    path = str(tmp_path / "panel.csv")
    P.write_panel(four, path, 2)
    back = P.read_panel(spark, path)
    assert back.schema["label"].dataType.simpleString() == "bigint"
    rows = {r.series_id: r for r in back.collect()}
    for r in four.collect():
        assert rows[r.series_id].x == r.x and rows[r.series_id].label == r.label
        assert (rows[r.series_id].t_len, rows[r.series_id].n_ch) == (3, 2)
    assert set(spark.read.option("header", True).csv(path).columns) == {"sample_id", "time_step", "feature_0", "feature_1"}


def test_single_file_csv_in_any_row_order(spark, tmp_path):
    lines = [f"{s},{t},{s * 10 + t},{s - t}" for s in range(3) for t in range(4)]
    (tmp_path / "d.csv").write_text("sample_id,time_step,feature_0,feature_1\n" + "\n".join(lines[::-1]) + "\n")
    (tmp_path / "d_labels.csv").write_text("sample_id,label\n0,a\n1,b\n2,a\n")
    rows = {r.series_id: r for r in P.read_panel(spark, str(tmp_path / "d.csv")).collect()}
    assert rows[2].x == [20.0, 2.0, 21.0, 1.0, 22.0, 0.0, 23.0, -1.0] and rows[1].label == "b"


def test_missing_labels_and_ragged_series(spark, tmp_path):
    (tmp_path / "d.csv").write_text("sample_id,time_step,feature_0\n0,0,1\n0,1,1\n1,0,1\n")
    with pytest.raises(FileNotFoundError):
        P.read_panel(spark, str(tmp_path / "d.csv"))
    (tmp_path / "d_labels.csv").write_text("sample_id,label\n0,1.5\n1,2\n")
    with pytest.raises(CounterpaneError):
        P.read_panel(spark, str(tmp_path / "d.csv"))
    ok = P.read_panel(spark, str(tmp_path / "d.csv"), check=False)
    assert ok.schema["label"].dataType.simpleString() == "double"


def test_text(spark):
    df = spark.createDataFrame([("[0. 1.5\n 2]  3 4 5",), ("",), ("1 2",), ("1 x 3 4 5 6",)], "s string")
    parsed = [r[0] for r in df.select(A.parse_array("s", 3, 2, strict=False)).collect()]
    assert parsed == [[0.0, 1.5, 2.0, 3.0, 4.0, 5.0], None, None, None]
    with pytest.raises(Exception, match="Found 0 elements"):
        df.where("s = ''").select(A.parse_array("s", 3, 2)).collect()
    with pytest.raises(Exception, match="no numbers"):
        df.where("s like '%x%'").select(A.parse_array("s", 3, 2)).collect()
    assert first(spark.range(1).select(A.format_array(F.array(F.lit(1.0), F.lit(2.5))))) == "1.0 2.5"


def test_shapes(spark):
    x = np.arange(12.0).reshape(4, 3)
    df = panel_of(spark, [x])
    assert first(df.select(A.select_channels("x", "n_ch", [2, 0]))) == x[:, [2, 0]].ravel().tolist()
    assert first(df.select(A.select_channels("x", "n_ch", None))) == x.ravel().tolist()
    assert first(df.select(A.channels_first("x", "n_ch"))) == x.T.ravel().tolist()
    assert first(df.select(A.as_series(A.nest_steps("x", "n_ch")))) == x.ravel().tolist()
    assert first(df.select(A.slice_window("x", "n_ch", 2, 5))) == x[2:7].ravel().tolist()
    with pytest.raises(Exception, match="out of range"):
        df.select(A.select_channels("x", "n_ch", [3])).collect()
    with pytest.raises(CounterpaneError):
        A.select_channels("x", "n_ch", [-1])
    with pytest.raises(Exception, match="exactly one"):
        df.select(A.single_series(F.array(A.nest_steps("x", "n_ch"), A.nest_steps("x", "n_ch")))).collect()


@pytest.mark.parametrize("start,length", [(0, 2), (1, 3), (2, 9), (0, 4), (3, 1)])
def test_splice_and_mask(spark, start, length):
    x, y = np.arange(12.0).reshape(4, 3), -np.arange(12.0).reshape(4, 3) - 1
    df = panel_of(spark, [x], y=[y.ravel().tolist()])
    want = x.copy()
    want[start:start + length] = y[start:start + length]
    assert first(df.select(A.splice_window("x", "y", "n_ch", start, length))) == want.ravel().tolist()
    bits = (np.arange(min(length, 4 - start) * 3) % 2 == 0)
    want = x.copy()
    part = want[start:start + length]
    part[bits.reshape(part.shape)] = y[start:start + length][bits.reshape(part.shape)]
    for mask in (F.array(*[F.lit(bool(b)) for b in bits]), F.array(*[F.lit(int(b)) for b in bits])):
        assert first(df.select(A.apply_mask("x", "y", mask, "n_ch", start))) == want.ravel().tolist()


@pytest.mark.parametrize("w,k,start", [([1, 2, 3, 4, 5], 2, 3), ([5, 4, 3], 3, 0), ([1, 3, 3, 1], 2, 1),
                                       ([1, 1, 1, 1], 2, 0), ([1, 2], 5, 0), ([0.1, 0.2, 0.3, 0.0, 0.3], 2, 1)])
def test_max_sum_window(spark, w, k, start):
    df = spark.createDataFrame([([float(v) for v in w],)], "weights array<double>")
    assert max_sum_window(df, k).first().start == start
    if k <= len(w):
        assert first(df.select(window_starts("weights")))[k - 1] == start


def test_scaling(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 2.0]), (2, [3.0, 5.0, 1.0])], "series_id bigint, weights array<double>")
    assert first(df.select(A.minmax_weights("weights"))) == [0.0, 1.0, 0.25]
    assert first(spark.range(1).select(A.minmax_weights(F.array(F.lit(2.0), F.lit(2.0))))) == [0.0, 0.0]
    by_step = {r.series_id: r.weights for r in minmax_by_step(df).collect()}
    assert by_step == {1: [0.0, 0.0, 1.0], 2: [1.0, 0.0, 0.0]}
    assert first(df.select(A.peak_step("weights"))) == 1
    series = panel_of(spark, [np.array([[0.0, 10], [2, 30], [4, 20]])], w=[[0.0, 0.5, 1.0]])
    scaled = {r.c: r.scaled for r in scale_to_channel(series, w="w").collect()}
    assert scaled == {0: [0.0, 2.0, 4.0], 1: [10.0, 20.0, 30.0]}


def test_changed_span(spark):
    x = np.random.default_rng(0).normal(size=(50, 2))
    y = x.copy()
    y[10:20] += 1
    z = x.copy()
    z[0, 1] += 1
    rows = changed_span(panel_of(spark, [x, x, x], cf=[v.ravel().tolist() for v in (y, x, z)])).collect()
    found = {(r.series_id, r.c): r for r in rows}
    assert set(found) == {(0, 0), (0, 1), (2, 1)}
    r = found[0, 1]
    assert (r.first_t, r.last_t, r.n_changed) == (10, 19, 10)
    assert r.before_value == x[9, 1] and r.after_value == x[20, 1] and r.first_value == y[10, 1]
    assert found[2, 1].before_value is None and found[2, 1].last_t == 0


def test_validation(spark):
    bad = spark.createDataFrame([(1, 2, 1, [1.0, float("nan")]), (2, 2, 1, [1.0]), (3, 3, 1, [1.0, 2.0, None]),
                                 (None, 2, 1, [0.0, float("inf")])],
                                "series_id bigint, t_len int, n_ch int, x array<double>")
    found = {r.rule: r.n_bad for r in validate_panel(bad).collect()}
    assert found == {"null_id": 1, "shape_mismatch": 1, "null_value": 1, "not_finite": 2, "mixed_shapes": 1}
    good = panel_of(spark, [np.zeros((3, 1))], w=[[1.0, 2.0]])
    assert validate_panel(good).count() == 0
    assert [r.rule for r in validate_panel(good, "w").collect()] == ["importance_length"]


def test_parameters():
    validate_params(alpha=1, theta=0.6, dtw_window=None, population_size=4)
    for wrong in ({"alpha": "x"}, {"population_size": True}, {"theta": None}, {"optimize_sparsity": 1},
                  {"dtw_window": 1.5}):
        with pytest.raises(CounterpaneError):
            validate_params(**wrong)
    with pytest.raises(CounterpaneError):
        validate_params(nothing=1)


def test_rows_to_panel_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).alias("k"),
                                    (F.col("id") % 4).alias("day"),
                                    F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z")),
                                                 (F.col("id") % 3 + 1).cast("int")).alias("kind"),
                                    F.lit(1.0).alias("v"))
    got = {r.series_id: np.array(r.x).reshape(4, 2)
           for r in P.panel_from_rows(rows, "k", F.col("day"), "kind", "v", 4, ["a", "b"], outside="drop").collect()}
    data = rows.toPandas()
    for key, x in got.items():
        for t in range(4):
            for c, kind in enumerate(["a", "b"]):
                assert x[t, c] == ((data.k == key) & (data.day == t) & (data.kind == kind)).sum()


def test_results(spark, tmp_path):
    zero, five = [0.0] * 6, [5.0] * 6
    ramp = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(1, ramp, 1), (1, [9.0] * 6, 0), (1, ramp, 1), (2, zero, 1)]
    cands = (spark.createDataFrame(rows, "series_id bigint, cf array<double>, label int")
             .withColumn("x", F.lit(zero)).withColumn("original_label", F.lit(0)).withColumn("nun_x", F.lit(five))
             .withColumn("nun_weights", F.lit([0.1, 0.2, 0.3])))
    best = spark.createDataFrame(rows[:1], "series_id bigint, cf array<double>, label int")
    flagged = R.flag_best(cands, best)
    table = R.results_table(flagged)
    assert sorted(r.is_best for r in table.collect()) == [False, False, True, True]
    assert set(table.columns) == {"instance_id", "counterfactual", "is_best", "label", "original_instance",
                                  "original_label", "nearest_unlike_neighbour", "feature_importance"}
    assert R.result_count(table).first().n_sets == 2 and R.result_for(table, 1).count() == 3
    R.write_results(flagged, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 4 and "0.1 0.2 0.3" in {r.feature_importance for r in back.collect()}
    assert R.text_table(table, importance=False).schema["feature_importance"].dataType.typeName() == "array"
    with pytest.raises(CounterpaneError):
        R.write_results(flagged.limit(0), str(tmp_path / "none"))
    with pytest.raises(CounterpaneError):
        R.write_results(flagged, str(tmp_path / "none"), fmt="xml")


def _events(spark, rows):
    return spark.createDataFrame(rows, "k bigint, t int, ch string, v double")


def test_rows_outside_the_grid_are_refused_or_dropped(spark):
    rows = _events(spark, [(1, 0, "a", 1.0), (1, 5, "a", 2.0), (2, 1, "z", 3.0)])
    build = lambda **kw: P.panel_from_rows(rows, "k", F.col("t"), "ch", "v", **kw)
    with pytest.raises(Exception, match="outside the steps and channels"):
        build(steps=2, channels=["a"]).collect()
    assert [r.x for r in build(steps=2, channels=["a"], outside="drop").collect()] == [[1.0, 0.0]]
    whole = {r.series_id: (r.t_len, r.n_ch, sum(r.x)) for r in build().collect()}
    assert whole == {1: (6, 2, 3.0), 2: (6, 2, 3.0)}


def test_incomplete_long_tables_are_refused(spark):
    cells = [(7, t, c, float(t * 2 + c)) for t in range(3) for c in range(2)]
    kind = "series_id bigint, t int, c int, value double"
    assert P.from_long(spark.createDataFrame(cells, kind)).first().x == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    for broken in (cells[:2] + cells[3:], cells + cells[:1], cells[2:]):
        with pytest.raises(Exception, match="missing or repeated cells in series: 7"):
            P.from_long(spark.createDataFrame(broken, kind)).collect()


def test_csv_with_gaps_or_without_labels_is_refused(spark, tmp_path):
    def save(name, steps, labelled):
        (tmp_path / f"{name}.csv").write_text("sample_id,time_step,feature_0\n" + "".join(
            f"{s},{t},{s + t}.0\n" for s in (1, 2) for t in steps))
        (tmp_path / f"{name}_labels.csv").write_text("sample_id,label\n" + "".join(f"{s},0\n" for s in labelled))
        return P.read_panel(spark, str(tmp_path / f"{name}.csv"))

    assert save("good", (0, 1), (1, 2)).count() == 2
    for name, steps in (("gap", (0, 5)), ("twice", (0, 0))):
        with pytest.raises(Exception, match="missing or repeated steps in sample"):
            save(name, steps, (1, 2)).collect()
    with pytest.raises(Exception, match="no label for sample: 2"):
        save("unlabelled", (0, 1), (1,)).collect()


@pytest.mark.parametrize("labels, message", [([(0, 1), (0, 0), (1, 1)], "more than one label"), ([(0, 1)], "no label for sample"),
                                             ([(0, 1), (1, 0), (2, 1)], "no sample for label")])
def test_labels_must_match_samples(spark, tmp_path, labels, message):
    panel = panel_of(spark, [np.ones((2, 2)), np.zeros((2, 2))])
    P.write_panel(panel, str(tmp_path / "p.csv"), 2, label=None)
    spark.createDataFrame(labels, "sample_id bigint, label bigint").write.option("header", True).csv(str(tmp_path / "p_labels.csv"))
    with pytest.raises(Exception, match=message):
        P.read_panel(spark, str(tmp_path / "p.csv")).collect()
    assert P.read_panel(spark, str(tmp_path / "p.csv"), check=False).count() == 2
