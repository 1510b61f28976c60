"""Metric names and their parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..errors import bad_parameter
from ..functions import kernels

LOCK_STEP = ("euclidean", "manhattan")


@dataclass(frozen=True)
class Metric:
    """A metric with its parameters; calling it measures pairs of equally shaped batches."""

    name: str
    params: dict = field(default_factory=dict)

    def __call__(self, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
        if self.name in LOCK_STEP and X.shape[1:] != Y.shape[1:]:
            raise ValueError(f"{self.name} needs series of equal shape, got {X.shape[1:]} and {Y.shape[1:]}")
        if X.shape[2] != Y.shape[2]:
            raise ValueError(f"{self.name} needs equal channel counts, got {X.shape[2]} and {Y.shape[2]}")
        return kernels.METRICS[self.name][0](X, Y, **self.params)

    def bound(self, X: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return kernels.box_bound(self.name, X, low, high, self.params)


def metric(name: str | Metric, window: int | None = None, gamma: float = 1.0, sigma: float = 1.0) -> Metric:
    """Look a metric up by its name, in any case and with or without underscores."""
    if isinstance(name, Metric):
        return name
    key = name.lower().replace("_", "").replace("-", "")
    if key not in kernels.METRICS:
        raise bad_parameter(f"unknown distance metric '{name}'", got=name, name="metric",
                                 advice="use one of " + ", ".join(sorted(kernels.METRICS)))
    if window is not None and (isinstance(window, bool) or not isinstance(window, int) or window < 0):
        raise bad_parameter("the band radius must be a non-negative integer", got=window, name="window")
    given = {"radius": window, "gamma": float(gamma), "sigma": float(sigma)}
    return Metric(key, {p: given[p] for p in kernels.METRICS[key][1]})
