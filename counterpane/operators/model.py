"""Models and batch scoring.

A model is any picklable object whose `predict` maps `(n, T, C)` doubles to `(n, K)` class probabilities.
Three small parametric models are provided, fitted by Spark aggregations; their parameters are as large as
a handful of series and their size is checked before they leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import bad_data, bad_parameter
from ..functions import arrays as A
from .batches import cubes, list_array

MAX_PARAMETERS = 16_000_000  # doubles a model may hold when it is fitted from data
BLOCK = 16384  # cells compared with a centroid at a time, so that they stay in the cache
MAX_CLASSES = 10_000  # checked while the centroids are collected: more is an error, never a cut


@dataclass(frozen=True)
class CentroidModel:
    """Softmax over squared distances to one centroid per class."""

    centroids: np.ndarray  # (K, T * C)
    beta: float = 1.0

    def predict(self, X: np.ndarray) -> np.ndarray:
        flat = X.reshape(len(X), -1)
        square = np.empty((len(flat), len(self.centroids)))
        step = max(1, BLOCK // max(1, flat.shape[1]))
        for a in range(0, len(flat), step):
            part = flat[a:a + step]
            diff = np.empty_like(part, dtype=np.result_type(part, self.centroids))
            for k, c in enumerate(self.centroids):
                np.subtract(part, c, out=diff)
                diff *= diff
                square[a:a + step, k] = diff.sum(axis=1)
        mass = np.exp(-self.beta * (square - square.min(axis=1, keepdims=True)))
        return mass / mass.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LogitModel:
    """Two classes from the mean of a series: `p1 = clip(1 / (1 + exp(-slope * (mean - m0))))`."""

    m0: float = 1.0
    slope: float = 2.0
    low: float = 0.01
    high: float = 0.99

    def predict(self, X: np.ndarray) -> np.ndarray:
        mean = X.reshape(len(X), -1).mean(axis=1)
        one = np.clip(1.0 / (1.0 + np.exp(np.clip(-self.slope * (mean - self.m0), -700, 700))), self.low, self.high)
        return np.stack([1.0 - one, one], axis=1)


@dataclass(frozen=True)
class ConvModel:
    """One convolution (same padding), mean over time, dense softmax.

    `kernel (width, C, filters)`, `bias (filters,)`, `dense (filters, K)`, `dense_bias (K,)`.
    """

    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def activation(self, X: np.ndarray) -> np.ndarray:
        """Output of the convolution: `(n, T, filters)`."""
        width = len(self.kernel)
        left = (width - 1) // 2
        padded = np.pad(X, ((0, 0), (left, width - 1 - left), (0, 0)))
        steps = X.shape[1]
        return sum(padded[:, o:o + steps, :] @ self.kernel[o] for o in range(width)) + self.bias

    def predict(self, X: np.ndarray) -> np.ndarray:
        logit = self.activation(X).mean(axis=1) @ self.dense + self.dense_bias
        mass = np.exp(logit - logit.max(axis=1, keepdims=True))
        return mass / mass.sum(axis=1, keepdims=True)


class CallableModel:
    """Any fitted classifier: `predict_proba` if it has one, else `predict`, else the object itself.

    `loader` builds the object on the worker at first use, for models that do not pickle.
    """

    def __init__(self, target: Any = None, loader: Any = None) -> None:
        if (target is None) == (loader is None):
            raise bad_parameter("give either a model or a loader", name="target")
        self.target, self.loader = target, loader

    def predict(self, X: np.ndarray) -> np.ndarray:
        if self.target is None:
            self.target = self.loader()
        call = getattr(self.target, "predict_proba", None) or getattr(self.target, "predict", None) or self.target
        return np.asarray(call(X), dtype=np.float64)


def model_source(model: Any) -> Any:
    """Accept anything usable as a model; reject the rest with a typed error."""
    if isinstance(model, CallableModel) or callable(getattr(model, "predict", None)) \
            and not callable(getattr(model, "predict_proba", None)):
        return model
    if callable(getattr(model, "predict_proba", None)) or callable(model):
        return CallableModel(model)
    raise bad_parameter("a model needs a predict method", got=type(model).__name__, name="model",
                             advice="wrap functions or classifiers in CallableModel")


def _bounded(rows: int, width: int, what: str) -> None:
    if rows * width > MAX_PARAMETERS:
        raise bad_parameter(f"{what}: {rows} x {width} parameters are too many for a broadcast model",
                                 name="model", advice=f"at most {MAX_PARAMETERS} doubles")


def class_means(panel: DataFrame, label: str = "label") -> DataFrame:
    """The mean series of every class, as a panel keyed by the label.

    Cells are averaged map-side first, so a class with a third of all rows is no hot task.
    """
    return (panel.select(label, "t_len", "n_ch", F.posexplode("x").alias("i", "v"))
            .groupBy(label, "t_len", "n_ch", "i").agg(F.avg("v").alias("v"))
            .groupBy(F.col(label).cast("bigint").alias("series_id"), "t_len", "n_ch")
            .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells"))
            .select("series_id", "t_len", "n_ch", F.col("cells.v").alias("x")))


def fit_centroids(panel: DataFrame, label: str = "label", beta: float = 1.0) -> CentroidModel:
    """Centroid model from labelled series of one shape; class `k` is the k-th label in order."""
    rows = class_means(panel, label).orderBy("series_id").select("x", "t_len", "n_ch").limit(MAX_CLASSES + 1).toArrow()
    shapes = set(zip(rows.column("t_len").to_pylist(), rows.column("n_ch").to_pylist()))
    if len(shapes) > 1:
        raise bad_data("centroids need series of one shape", got=sorted(shapes))
    if rows.num_rows > MAX_CLASSES:
        raise bad_parameter(f"more than {MAX_CLASSES} classes are too many for a broadcast model", name="label")
    _bounded(rows.num_rows, max((len(x) for x in rows.column("x")), default=0), "centroids")
    return CentroidModel(np.array(rows.column("x").to_pylist()), float(beta))


def fit_logit(panel: DataFrame, slope: float = 2.0) -> LogitModel:
    """Logit model around the mean of all cells of the panel."""
    mean = panel.select((A.total(F.col("x"))).alias("s"), F.size("x").alias("n")).agg(F.sum("s") / F.sum("n")).first()
    return LogitModel(float(mean[0]), slope)


def score_panel(panel: DataFrame, model: Any) -> DataFrame:
    """Add `proba`, `pred_label` and `confidence`; all other columns pass through.

    The model travels once per Python worker with the task's closure; rows stream through in Arrow batches
    and stay in their partition.
    """
    model = model_source(model)
    schema = T.StructType(panel.schema.fields + [T.StructField("proba", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            proba: list = [None] * batch.num_rows
            parts = list(cubes(batch))
            for where, X in parts:
                p = np.asarray(model.predict(X), dtype=np.float64)
                if len(parts) == 1:
                    proba = list_array(p)
                else:
                    for i, row in zip(where, p):
                        proba[i] = row
            column = proba if isinstance(proba, pa.Array) else pa.array(proba, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "proba"])

    return (panel.mapInArrow(score, schema)
            .withColumn("pred_label", A.pred_label("proba")).withColumn("confidence", A.confidence("proba")))


def score_with_pipeline(panel: DataFrame, pipeline: Any) -> DataFrame:
    """Score with a fitted Spark ML pipeline (or the path of one) over the vector column `features`."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector, vector_to_array
    if isinstance(pipeline, str):
        pipeline = PipelineModel.load(pipeline)
    scored = pipeline.transform(panel.withColumn("features", array_to_vector("x")))
    return (scored.withColumn("proba", vector_to_array("probability"))
            .select(*panel.columns, "proba", A.pred_label("proba").alias("pred_label"),
                    A.confidence("proba").alias("confidence")))


def cam_weights(panel: DataFrame, model: ConvModel) -> DataFrame:
    """Class-activation map: per step the sum of the filters' activations, weighted for the predicted class."""
    if not isinstance(model, ConvModel):
        raise bad_parameter("activation maps need a convolutional model", got=type(model).__name__,
                                 name="model")
    if model.kernel.shape[2] != model.dense.shape[0]:
        raise bad_parameter(
            f"the convolution has {model.kernel.shape[2]} filters but the dense layer takes {model.dense.shape[0]}",
            name="model")
    schema = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("pred_label", T.IntegerType()),
                           T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, X in cubes(batch):
                act = model.activation(X)
                logit = act.mean(axis=1) @ model.dense + model.dense_bias
                best = logit.argmax(axis=1)
                w = np.einsum("ntf,nf->nt", act, model.dense[:, best].T)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("series_id").take(pa.array(where)), pa.array(best.astype(np.int32)), list_array(w)],
                    names=["series_id", "pred_label", "weights"])

    return panel.select("series_id", "t_len", "n_ch", "x").mapInArrow(maps, schema)


def deviation_weights(panel: DataFrame, digits: int = 6) -> DataFrame:
    """Importance without a network: per step the summed absolute deviation from the panel's mean series."""
    means = (panel.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
             .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
             .select(F.col("cells.m").alias("means"), F.lit(1).alias("one")))
    n_ch = F.col("n_ch")
    steps = F.transform(F.sequence(F.lit(0), F.col("t_len") - 1), lambda t: F.round(F.aggregate(
        F.sequence(t * n_ch, t * n_ch + n_ch - 1), F.lit(0.0),
        lambda s, i: s + F.abs(F.get("x", i) - F.get("means", i))), digits))
    return (panel.withColumn("one", F.lit(1)).join(F.broadcast(means), "one")
            .select("series_id", steps.alias("weights")))
