"""Scoring, model binding and activation maps."""

import numpy as np
import pytest
from conftest import panel_of

from counterpane.errors import CounterpaneError
from counterpane.operators import model as M


@pytest.fixture
def panel(spark, rng):
    return panel_of(spark, list(rng.normal(size=(12, 20, 3))), label=[i % 3 for i in range(12)])


def conv(filters=8, classes=2):
    rng = np.random.default_rng(1)
    return M.ConvModel(rng.normal(size=(3, 3, filters)), rng.normal(size=filters), rng.normal(size=(filters, classes)),
                       rng.normal(size=classes))


def test_logit_fixture():
    p = M.LogitModel(1.0).predict(np.stack([np.full((8, 2), 2.0), (np.arange(16) / 16).reshape(8, 2)]))
    assert p[0, 1] == pytest.approx(1 / (1 + np.exp(-2))) and p[1].argmax() == 0
    assert np.allclose(p.sum(axis=1), 1)


def test_score_adds_columns_and_keeps_rows(panel):
    out = M.score_panel(panel, M.fit_centroids(panel, beta=0.1))
    assert out.columns == [*panel.columns, "proba", "pred_label", "confidence"]
    for r in out.collect():
        assert len(r.proba) == 3 and sum(r.proba) == pytest.approx(1)
        assert r.pred_label == int(np.argmax(r.proba)) and r.confidence == max(r.proba)


def test_ties_take_the_first_class(panel):
    class Half:
        def predict(self, X):
            return np.full((len(X), 2), 0.5)
    assert {r.pred_label for r in M.score_panel(panel, Half()).collect()} == {0}


def test_any_classifier(panel):
    class Classifier:
        def predict(self, X):
            return np.zeros(len(X))

        def predict_proba(self, X):
            return np.tile([0.2, 0.8], (len(X), 1))
    assert {r.pred_label for r in M.score_panel(panel, Classifier()).collect()} == {1}
    assert {r.pred_label for r in M.score_panel(panel, lambda X: np.tile([0.9, 0.1], (len(X), 1))).collect()} == {0}
    assert M.score_panel(panel, M.CallableModel(loader=Classifier)).count() == 12
    with pytest.raises(CounterpaneError):
        M.score_panel(panel, 3)
    with pytest.raises(CounterpaneError):
        M.CallableModel()


def test_mixed_lengths_are_scored_per_shape(spark, rng):
    both = panel_of(spark, [rng.normal(size=(t, 2)) for t in (3, 5, 3, 4)])
    rows = M.score_panel(both, M.LogitModel(0.0)).orderBy("series_id").collect()
    for r in rows:
        assert r.proba == pytest.approx(M.LogitModel(0.0).predict(np.array(r.x).reshape(1, r.t_len, 2))[0].tolist())


def test_spark_ml_pipeline(spark, rng, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    data = np.concatenate([rng.normal(size=(20, 2, 2)), rng.normal(size=(20, 2, 2)) + 3])
    panel = panel_of(spark, list(data), label=[0] * 20 + [1] * 20)
    fitted = Pipeline(stages=[LogisticRegression()]).fit(panel.withColumn("features", array_to_vector("x")))
    fitted.save(str(tmp_path / "model"))
    out = M.score_with_pipeline(panel, str(tmp_path / "model"))
    assert isinstance(fitted, PipelineModel)
    assert out.where("pred_label = label").count() == 40 and len(out.first().proba) == 2


def test_activation_map(panel):
    model = conv()
    got = {r.series_id: r for r in M.cam_weights(panel, model).collect()}
    for r in panel.collect():
        x = np.array(r.x).reshape(20, 3)
        padded = np.vstack([np.zeros((1, 3)), x, np.zeros((1, 3))])
        act = np.array([sum(padded[t + o] @ model.kernel[o] for o in range(3)) + model.bias for t in range(20)])
        label = int((act.mean(axis=0) @ model.dense + model.dense_bias).argmax())
        assert got[r.series_id].pred_label == label
        assert got[r.series_id].weights == pytest.approx((act @ model.dense[:, label]).tolist())


def test_activation_map_needs_matching_layers(panel):
    model = conv()
    with pytest.raises(CounterpaneError, match="filters"):
        M.cam_weights(panel, M.ConvModel(model.kernel, model.bias, np.zeros((5, 2)), np.zeros(2)))
    with pytest.raises(CounterpaneError):
        M.cam_weights(panel, M.LogitModel())


def test_model_size_is_checked(panel, monkeypatch):
    monkeypatch.setattr(M, "MAX_PARAMETERS", 10)
    with pytest.raises(CounterpaneError, match="too many"):
        M.fit_centroids(panel)
    monkeypatch.setattr(M, "MAX_CLASSES", 2)
    with pytest.raises(CounterpaneError, match="more than 2 classes"):
        M.fit_centroids(panel)


def test_centroids_are_class_means(panel):
    model = M.fit_centroids(panel, beta=0.5)
    data = {r.series_id: (r.label, np.array(r.x)) for r in panel.collect()}
    for k in range(3):
        assert np.allclose(model.centroids[k], np.mean([x for label, x in data.values() if label == k], axis=0))


def test_centroids_of_mixed_shapes_are_refused(spark):
    from counterpane.errors import CounterpaneError
    from counterpane.operators.model import fit_centroids
    panel = panel_of(spark, [np.ones((2, 1)), np.ones((3, 1))], label=[0, 0])
    with pytest.raises(CounterpaneError, match="one shape"):
        fit_centroids(panel)
