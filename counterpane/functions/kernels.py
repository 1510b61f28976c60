"""Distances of many series pairs at once: numpy inside one Arrow batch.

All kernels take `X (n, T1, C)` and `Y (n, T2, C)` and return `n` values; the dynamic programs walk over
cells while every operation covers all pairs. `TILE_BYTES` bounds the working memory of a call.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

TILE_BYTES = 1 << 20
DIAGONAL_BYTES = 8 << 20  # costs of all cells of a tile that are held at once


def band(t1: int, t2: int, radius: int | None) -> np.ndarray | None:
    """Which cells a Sakoe-Chiba band allows (`None` = all)."""
    if radius is None:
        return None
    centre = np.arange(t1)[:, None] * (t2 - 1) / max(t1 - 1, 1)
    return np.abs(np.arange(t2)[None, :] - centre) <= radius


def _repeats(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """Which pairs equal the one before them in every value."""
    out = np.zeros(len(X), dtype=bool)
    if len(X) != len(Y):
        return out
    out[1:] = (X[1:] == X[:-1]).all(axis=(1, 2))
    if out.any():
        out[1:] &= (Y[1:] == Y[:-1]).all(axis=(1, 2))
    return out


def _tiles(kernel: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    """Run a kernel over slices of the pairs that fit the working memory, steps first; a run of equal pairs is one."""
    def run(X: np.ndarray, Y: np.ndarray, **params) -> np.ndarray:
        tile = max(1, int(TILE_BYTES // (8 * max(1, Y.shape[1] * Y.shape[2]))))
        again = _repeats(X, Y)
        heads = np.flatnonzero(~again)
        some = len(heads) < len(X)
        out = np.empty(len(heads))
        for a in range(0, len(heads), tile):
            at = heads[a:a + tile] if some else slice(a, a + tile)
            xs = np.ascontiguousarray(np.moveaxis(X[at], 0, 2))
            ys = np.ascontiguousarray(np.moveaxis(Y[at], 0, 2))
            out[a:a + tile] = kernel(xs, ys, **params)
        return out[np.cumsum(~again) - 1] if some else out
    return run


def _costs(x_step: np.ndarray, ys: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of one step to every step of the other side: `(T2, n)`."""
    diff = ys - x_step
    return np.einsum("tcn,tcn->tn", diff, diff, out=out)


def _skewed_costs(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Costs of all cells by diagonal: `(T1 + T2 - 1, T1, n)`, the cell `i, j` at `[i + j, i]`.

    Steps that recur from pair to pair (an edit leaves most as they are) are compared once with the same other side.
    """
    t1, t2, n = len(xs), len(ys), xs.shape[2]
    out = np.empty((t1 + t2 - 1, t1, n))
    fresh = np.ones((t1, n), dtype=bool)
    fresh[:, 1:] = (xs[:, :, 1:] != xs[:, :, :-1]).any(axis=1)
    fresh[:, 1:] |= (ys[:, :, 1:] != ys[:, :, :-1]).any(axis=(0, 1))
    for i in range(t1):
        heads = np.flatnonzero(fresh[i])
        if 2 * len(heads) <= n:
            cost = _costs(np.take(xs[i], heads, axis=1), np.take(ys, heads, axis=2))
            np.take(cost, fresh[i].cumsum() - 1, axis=1, out=out[i:i + t2, i], mode="clip")
        else:
            _costs(xs[i], ys, out=out[i:i + t2, i])
    return out


def _dtw_by_diagonals(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The same minima and sums as by rows, but all cells of a diagonal at once."""
    t1, t2, n = len(xs), len(ys), xs.shape[2]
    cost = _skewed_costs(xs, ys)
    last, before, least = np.full((t1 + 1, n), np.inf), np.full((t1 + 1, n), np.inf), np.empty((t1, n))
    before[0] = 0.0
    for d in range(t1 + t2 - 1):
        low, high = max(0, d - t2 + 1), min(t1, d + 1)
        part = least[:high - low]
        np.minimum(last[low:high], last[low + 1:high + 1], out=part)
        np.minimum(part, before[low:high], out=part)
        before[low] = np.inf  # no cell of this diagonal
        np.add(part, cost[d, low:high], out=before[low + 1:high + 1])
        last, before = before, last
    return np.sqrt(last[t1])


@_tiles
def dtw(xs: np.ndarray, ys: np.ndarray, radius: int | None = None) -> np.ndarray:
    t1, t2, n = len(xs), len(ys), xs.shape[2]
    allowed = band(t1, t2, radius)
    if allowed is None and t1 and t2 and 8 * (t1 + t2 - 1) * t1 * n <= DIAGONAL_BYTES:
        return _dtw_by_diagonals(xs, ys)
    prev = np.full((t2 + 1, n), np.inf)
    prev[0] = 0.0
    for i in range(t1):
        cost = _costs(xs[i], ys)
        above = np.minimum(prev[1:], prev[:-1])
        cur = np.full((t2 + 1, n), np.inf)
        for j in range(t2) if allowed is None else np.flatnonzero(allowed[i]):
            np.minimum(above[j], cur[j], out=cur[j + 1])
            cur[j + 1] += cost[j]
        prev = cur
    return np.sqrt(prev[t2])


@_tiles
def soft_dtw(xs: np.ndarray, ys: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    t1, t2, n = len(xs), len(ys), xs.shape[2]
    prev = np.full((t2 + 1, n), np.inf)
    prev[0] = 0.0
    for i in range(t1):
        cost = _costs(xs[i], ys)
        above = np.minimum(prev[1:], prev[:-1])
        cur = np.full((t2 + 1, n), np.inf)
        for j in range(t2):
            low = np.minimum(above[j], cur[j])
            mass = (np.exp((low - prev[j + 1]) / gamma) + np.exp((low - prev[j]) / gamma)
                    + np.exp((low - cur[j]) / gamma))
            cur[j + 1] = cost[j] + low - gamma * np.log(mass)
        prev = cur
    return prev[t2]


@_tiles
def gak_raw(xs: np.ndarray, ys: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    t1, t2, n = len(xs), len(ys), xs.shape[2]
    prev = np.zeros((t2 + 1, n))
    prev[0] = 1.0
    for i in range(t1):
        near = np.exp(-_costs(xs[i], ys) / (2.0 * sigma * sigma))
        weight = near / (2.0 - near)
        above = prev[1:] + prev[:-1]
        cur = np.zeros((t2 + 1, n))
        for j in range(t2):
            cur[j + 1] = (above[j] + cur[j]) * weight[j]
        prev = cur
    return prev[t2]


def gak(X: np.ndarray, Y: np.ndarray, sigma: float = 1.0, self_x: np.ndarray | None = None,
        self_y: np.ndarray | None = None) -> np.ndarray:
    """Normalised kernel; the self terms may be handed in so that they are computed once per series."""
    self_x = gak_raw(X, X, sigma=sigma) if self_x is None else self_x
    self_y = gak_raw(Y, Y, sigma=sigma) if self_y is None else self_y
    return gak_raw(X, Y, sigma=sigma) / np.sqrt(self_x * self_y)


def euclidean(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    diff = (X - Y).reshape(len(X), -1)
    return np.sqrt(np.einsum("nd,nd->n", diff, diff))


def manhattan(X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    return np.abs(X - Y).reshape(len(X), -1).sum(axis=1)


def dtw_path(x: np.ndarray, y: np.ndarray, radius: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Distance and warping path of one pair; on ties diagonal, then up, then left."""
    t1, t2 = len(x), len(y)
    cost = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    allowed = band(t1, t2, radius)
    if allowed is not None:
        cost = np.where(allowed, cost, np.inf)
    inf = float("inf")
    table = [[0.0] + [inf] * t2]
    for row in cost.tolist():
        last, left = table[-1], inf
        new = [inf]
        for j, c in enumerate(row):
            left = c + min(last[j], last[j + 1], left)
            new.append(left)
        table.append(new)
    steps, i, j = [], t1, t2
    while i and j:
        steps.append((i - 1, j - 1))
        diagonal, up, left = table[i - 1][j - 1], table[i - 1][j], table[i][j - 1]
        if diagonal <= up and diagonal <= left:
            i, j = i - 1, j - 1
        elif up <= left:
            i -= 1
        else:
            j -= 1
    path = np.array(steps[::-1], dtype=np.int64).reshape(-1, 2)
    return float(np.sqrt(table[t1][t2])), path[:, 0], path[:, 1]


# --- lower bounds of a series against the box [low, high] around a block of series ---

@lru_cache(maxsize=1024)
def delannoy_log(t1: int, t2: int) -> float:
    """Log of the number of warping paths through a `t1 x t2` table."""
    row = np.zeros(t2)
    for _ in range(1, t1):
        nxt = np.zeros(t2)
        for j in range(1, t2):
            nxt[j] = np.logaddexp(np.logaddexp(row[j], row[j - 1]), nxt[j - 1])
        row = nxt
    return float(row[-1])


@lru_cache(maxsize=64)
def path_shares(t1: int, t2: int) -> tuple[float, np.ndarray]:
    """Log of the number of warping paths, and the share of them that visits each cell `(t1, t2)`."""
    logs = np.zeros((t1, t2))  # paths from the first cell to each
    for i in range(1, t1):
        for j in range(1, t2):
            logs[i, j] = np.logaddexp(np.logaddexp(logs[i - 1, j], logs[i, j - 1]), logs[i - 1, j - 1])
    return float(logs[-1, -1]), np.exp(logs + logs[::-1, ::-1] - logs[-1, -1])


def _gap(X: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far every value lies outside a box: `(n, T, C)`."""
    return np.maximum(np.maximum(low - X, X - high), 0.0)


def box_bound(metric: str, X: np.ndarray, low: np.ndarray, high: np.ndarray, params: dict) -> np.ndarray:
    """A value no larger than the distance of each series to any series inside the box.

    Lock-step metrics use the box itself. Warping metrics widen it over the steps the band allows, since
    every step is aligned with at least one of them; soft-DTW is the hard value (squared) less `gamma`
    times the log of the number of paths at most. Metrics without a bound get minus infinity.
    """
    if metric in ("euclidean", "manhattan"):
        gap = _gap(X, low, high)
        return gap.sum(axis=(1, 2)) if metric == "manhattan" else np.sqrt((gap ** 2).sum(axis=(1, 2)))
    if metric in ("dtw", "softdtw"):
        allowed = band(X.shape[1], len(low), params.get("radius"))
        if allowed is None:
            wide_low, wide_high = low.min(axis=0)[None], high.max(axis=0)[None]
        else:
            wide_low = np.where(allowed[:, :, None], low[None], np.inf).min(axis=1)
            wide_high = np.where(allowed[:, :, None], high[None], -np.inf).max(axis=1)
        square = (_gap(X, wide_low, wide_high) ** 2).sum(axis=(1, 2))
        if metric == "dtw":
            return np.sqrt(square)
        return square - params.get("gamma", 1.0) * delannoy_log(X.shape[1], len(low))
    return np.full(len(X), -np.inf)


# name -> (kernel over pairs, its parameters)
METRICS: dict[str, tuple[Callable[..., np.ndarray], tuple[str, ...]]] = {
    "euclidean": (euclidean, ()),
    "manhattan": (manhattan, ()),
    "dtw": (dtw, ("radius",)),
    "softdtw": (soft_dtw, ("gamma",)),
    "gakraw": (gak_raw, ("sigma",)),
    "gak": (gak, ("sigma",)),
}
