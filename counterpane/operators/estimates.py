"""Cheap estimates of whole tiles of distances, never above what the metric gives.

Squared distances of steps come from one matrix product in single precision; each is lowered (for kernels: raised) by the
error that the product may have, so a warping table filled with them bounds the exact one. Before that a `glance`, one
product a tile, is enough for most pairs: the first and the last step always meet; and a kernel, the sum of all paths'
weights, is no less than their number times their geometric mean, whose logarithm is linear in the squared distances once
the weight of a step is replaced by a tangent. A tile of the manhattan metric is summed over whole levels of two bytes.
The limits tell what an estimate, or a glance, may be at most where the distance is `dist`.
"""

from __future__ import annotations

import numpy as np

from ..functions import kernels
from .metrics import LOCK_STEP, Metric

UNIT = 2.0 ** -24
TINY = 1e-30
TABLE_CELLS = 1 << 18  # estimates of steps that are worked on at a time
SPREAD = 4.0      # levels cover so many standard deviations to both sides, values beyond are clipped
LEAST_LEVELS = 8  # with fewer levels (series of thousands of cells) an estimate says little


def _measure_of(Y: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean of every channel and a scale that brings values near one."""
    flat = np.where(np.isfinite(Y), Y, 0.0).reshape(-1, Y.shape[2])
    centre = flat.mean(axis=0) if len(flat) else np.zeros(Y.shape[2])
    largest = np.abs(flat - centre).max(initial=0.0)
    return centre, float(largest) if 0 < largest < np.inf else 1.0


class Steps:
    """Warping tables over steps; a lock-step distance is a table of one step with all cells."""

    def __init__(self, metric: Metric, X: np.ndarray, tiles: list[np.ndarray]) -> None:
        self.metric, self.kernel = metric, metric.name in ("gak", "gakraw")
        first = tiles[0]
        self.shape = X.shape[1], first.shape[1]
        self.allowed = kernels.band(*self.shape, metric.params.get("radius"))
        if metric.name in LOCK_STEP:
            X, tiles, self.allowed = (X.reshape(len(X), 1, -1), [Y.reshape(len(Y), 1, -1) for Y in tiles], None)
            self.shape = 1, 1
        n_ch = X.shape[2]
        self.centre, self.scale = _measure_of(np.concatenate(tiles))
        self.kind = np.float32
        if self.kernel:  # single precision only where its least numbers suffice for a whole path
            self.sharp = self.scale ** 2 / (2.0 * metric.params["sigma"] ** 2)
            farthest = max((np.abs(self._moved(Z)).max(initial=0.0) for Z in (X, *tiles)), default=0.0)
            self.kind = np.float32 if sum(self.shape) * 4 * n_ch * farthest ** 2 * self.sharp < 60 else np.float64
            self.self_x = kernels.gak_raw(X, X, **metric.params) if metric.name == "gak" else np.ones(len(X))
            self.self_y = [kernels.gak_raw(Y, Y, **metric.params) if metric.name == "gak" else np.ones(len(Y))
                           for Y in tiles]
        self.share = 1.0 + (1 if self.kernel else -1) * 2.0 * (n_ch + 16) * UNIT
        x = self._moved(X)
        square = (x ** 2).sum(axis=2, keepdims=True) * self.share
        self.left = np.concatenate([-2.0 * x, square, np.ones_like(square)], axis=2).transpose(1, 0, 2).astype(self.kind)
        self.right, self.room = [], np.empty(0, self.kind)
        for Y in tiles:
            y = self._moved(Y)
            square = (y ** 2).sum(axis=2, keepdims=True) * self.share
            block = np.concatenate([y, np.ones_like(square), square], axis=2).transpose(2, 1, 0)
            self.right.append(np.ascontiguousarray(block, dtype=self.kind).reshape(n_ch + 2, -1))
        steps = sum(self.shape)
        self.slack = 1.0 + (64.0 if self.kernel else 4.0) * (steps + 2) * UNIT
        self._prepare_glance(x, [self._moved(Y) for Y in tiles])
        self.below = metric.params["gamma"] * kernels.delannoy_log(*self.shape) if metric.name == "softdtw" else 0.0

    def _moved(self, Z: np.ndarray) -> np.ndarray:
        return (Z - self.centre) / self.scale

    def _prepare_glance(self, x: np.ndarray, ys: list[np.ndarray]) -> None:
        self.glances = sum(self.shape) > 2
        if not self.glances:
            return
        log_paths, visits = kernels.path_shares(*self.shape)
        if not self.kernel:  # only the two cells that every path visits
            visits = np.zeros(self.shape)
            visits[0, 0] = visits[-1, -1] = 1.0
        share = 1.0 + (1 if self.kernel else -1) * 2.0 * (x.shape[2] * self.shape[1] + 16) * UNIT
        ours, theirs = visits.sum(axis=1), visits.sum(axis=0)

        def squares(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
            return np.einsum("ntc,ntc,t->n", z, z, weight) * share

        met = -2.0 * np.einsum("ntc,tj->njc", x, visits)
        used = theirs > 0
        left = np.concatenate([met[:, used].reshape(len(x), -1), squares(x, ours)[:, None], np.ones((len(x), 1))], axis=1)
        right = [np.concatenate([y[:, used].reshape(len(y), -1), np.ones((len(y), 1)), squares(y, theirs)[:, None]], axis=1)
                 for y in ys]
        if self.kernel:
            # the tangent touches where the farthest pairs of a sample lie: least kernels come first
            at = np.nan_to_num((left[:64] @ right[0][:1024].T).max(initial=0.0) * self.sharp / visits.sum(), posinf=1.0)
            at = float(np.clip(at, 1e-3, 20.0))
            slope = np.exp(-at) / (2.0 - np.exp(-at))
            self.base = log_paths - (np.log(2.0 - np.exp(-at)) - slope * at) * visits.sum()
            left *= -(1.0 + slope) * self.sharp
            left[:, -1] = 1.0
            right = [np.concatenate([y[:, :-1], y[:, -1:] * -(1.0 + slope) * self.sharp - 0.5 * np.log(own)[:, None]], axis=1)
                     for y, own in zip(right, self.self_y)]
        self.glance_left = left.astype(np.float32)
        self.glance_right = [np.ascontiguousarray(y.T, dtype=np.float32) for y in right]

    def glance(self, rows: np.ndarray, t: int) -> np.ndarray:
        return self.glance_left[rows] @ self.glance_right[t]

    def glance_limit(self, rows: np.ndarray, dist: np.ndarray) -> np.ndarray:
        if not self.kernel:
            return self.limit(dist)
        value = np.log(np.maximum(dist, 1e-300)) + 0.5 * np.log(self.self_x[rows]) - self.base
        return value + (np.abs(value) + 10.0) * 1e-5

    def tile(self, rows: np.ndarray, t: int) -> np.ndarray:
        step = max(1, TABLE_CELLS * (self.right[t].shape[0]) // self.right[t].size)
        out = np.empty((len(rows), self.right[t].shape[1] // self.shape[1]), np.float64 if self.kernel else self.kind)
        for a in range(0, len(rows), step):
            self._tables(rows[a:a + step], t, out[a:a + step])
        return out

    def _tables(self, rows: np.ndarray, t: int, out: np.ndarray) -> None:
        right, (t1, t2), join = self.right[t], self.shape, np.add if self.kernel else np.minimum
        if t1 == t2 == 1 and not self.kernel:
            np.matmul(self.left[0, rows], right, out=out)
            return
        cells = len(rows) * right.shape[1]
        if len(self.room) < 2 * cells + out.size:  # fresh memory costs more than the sums in it
            self.room = np.empty(2 * cells + out.size, self.kind)
        cost, prev = self.room[:2 * cells].reshape(2, len(rows), t2, -1)
        met = self.room[2 * cells:2 * cells + out.size].reshape(out.shape)
        for i in range(t1):
            np.matmul(self.left[i, rows], right, out=cost.reshape(len(rows), -1))
            if self.kernel:
                cost *= -self.sharp
                np.exp(cost, out=cost)
                cost /= 2.0 - cost
            for j in range(t2):
                at = cost[:, j]
                if self.allowed is not None and not self.allowed[i, j]:
                    at[:] = np.inf
                    continue
                before = ([prev[:, j]] if i else []) + ([prev[:, j - 1]] if i and j else []) + ([cost[:, j - 1]] if j else [])
                if before:
                    best = before[0]
                    for other in before[1:]:
                        best = join(best, other, out=met)
                    if self.kernel:
                        at *= best
                    else:
                        at += best
            cost, prev = prev, cost
        out[:] = prev[:, t2 - 1]
        if self.kernel:
            out /= np.sqrt(self.self_x[rows][:, None] * self.self_y[t][None, :])

    def limit(self, dist: np.ndarray) -> np.ndarray:
        if self.kernel:
            return dist * self.slack + TINY
        if self.metric.name == "softdtw":  # what is added again may be much larger than what is left
            value = (dist + self.below + 1e-9 * (np.abs(dist) + self.below)) / self.scale ** 2
        else:
            value = (dist / self.scale) ** 2
        return value + np.abs(value) * (self.slack - 1.0) + TINY


class Levels:
    """Manhattan distances in whole levels, each cell off by one at most; clipping only brings values nearer."""

    glances = False

    def __init__(self, X: np.ndarray, tiles: list[np.ndarray]) -> None:
        self.cells = X.shape[1] * X.shape[2]
        self.levels = np.iinfo(np.int16).max // max(1, self.cells)
        known = np.concatenate(tiles).reshape(-1, self.cells)
        known = np.where(np.isfinite(known), known, 0.0)
        centre, apart = known.mean(axis=0), float(known.std(axis=0).max(initial=0.0))
        apart = apart if 0 < apart < np.inf else 1.0
        self.low, self.step = centre - SPREAD * apart, 2 * SPREAD * apart / self.levels
        self.left = self._level(X)
        self.right = [np.ascontiguousarray(self._level(Y).T) for Y in tiles]
        # what is no number meets everything
        self.open_rows = ~np.isfinite(X.reshape(len(X), -1)).all(axis=1)
        self.open_refs = [~np.isfinite(Y.reshape(len(Y), -1)).all(axis=1) for Y in tiles]

    def _level(self, Z: np.ndarray) -> np.ndarray:
        level = np.rint((Z.reshape(len(Z), -1) - self.low) / self.step)
        return np.clip(np.nan_to_num(level), 0, self.levels).astype(np.int16)

    def tile(self, rows: np.ndarray, t: int) -> np.ndarray:
        right = self.right[t]
        out, gap = np.empty((len(rows), right.shape[1]), np.float32), np.empty_like(right)
        for line, q in zip(out, rows):
            np.subtract(right, self.left[q][:, None], out=gap)
            np.abs(gap, out=gap)
            line[:] = gap.sum(axis=0, dtype=np.int16)
        out[self.open_rows[rows]] = 0.0
        out[:, self.open_refs[t]] = 0.0
        return out

    def limit(self, dist: np.ndarray) -> np.ndarray:
        return dist / self.step * (1.0 + 1e-9) + self.cells + 1.0


def estimates(metric: Metric, X: np.ndarray, tiles: list[np.ndarray]) -> Steps | Levels | None:
    """Estimates of all rows of X against every tile of references of one shape; none if the metric has no cheap one."""
    if metric.name == "manhattan":
        cells = X.shape[1] * X.shape[2]
        return Levels(X, tiles) if cells and np.iinfo(np.int16).max // cells >= LEAST_LEVELS else None
    return Steps(metric, X, tiles)
