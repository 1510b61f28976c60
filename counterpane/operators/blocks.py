"""Comparing blocks of series: the numpy work of one task."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np

from ..functions import kernels
from .estimates import estimates
from .metrics import LOCK_STEP, Metric

PAIRS_AT_ONCE = 1 << 16
TILE_PAIRS, TILE_COLUMNS = 1 << 18, 4096  # estimates that are worked on at a time
MANY = 1 / 16  # pairs that a glance may leave before the tile is estimated whole
MOST_PIVOTS = 256
FIRST = 8  # times k pairs are measured for a first limit, where only a glance tells which
Allowed = np.ndarray | Callable[[np.ndarray, np.ndarray], np.ndarray] | None


def cross_block(metric: Metric, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    """All distances between two blocks: `(len(X), len(Y))`."""
    out = np.empty((len(X), len(Y)))
    if metric.name in LOCK_STEP and X.shape[1:] == Y.shape[1:]:
        flat = Y.reshape(len(Y), -1)
        for row, x in zip(out, X.reshape(len(X), -1)):
            gap = flat - x
            row[:] = np.abs(gap).sum(axis=1) if metric.name == "manhattan" else np.sqrt(np.einsum("nd,nd->n", gap, gap))
        return out
    if metric.name == "gak":  # the self terms once per series, not once per pair
        sigma = metric.params["sigma"]
        self_x, self_y = kernels.gak_raw(X, X, sigma=sigma), kernels.gak_raw(Y, Y, sigma=sigma)
        return cross_block(Metric("gakraw", metric.params), X, Y) / np.sqrt(self_x[:, None] * self_y[None, :])
    step = max(1, PAIRS_AT_ONCE // max(1, len(Y)))
    for a in range(0, len(X), step):
        part = X[a:a + step]
        out[a:a + step] = metric(np.repeat(part, len(Y), axis=0), np.tile(Y, (len(part), 1, 1))).reshape(len(part), -1)
    return out


def _measure(metric: Metric, X: np.ndarray, Y: np.ndarray, self_terms: tuple) -> np.ndarray:
    """Distances of pairs, without a number as far as can be; self terms of the kernel come once per series."""
    out = np.empty(len(X))
    for a in range(0, len(X), PAIRS_AT_ONCE):
        part = slice(a, a + PAIRS_AT_ONCE)
        if self_terms:
            out[part] = kernels.gak(X[part], Y[part], **metric.params, self_x=self_terms[0][part], self_y=self_terms[1][part])
        else:
            out[part] = metric(X[part], Y[part])
    return np.where(np.isnan(out), np.inf, out)


def slack(values: np.ndarray) -> np.ndarray:
    """A little more than a threshold, so that rounding in a bound never loses a pair or a tie."""
    return values + 1e-9 * (1.0 + np.abs(values))


def scatter(ids: np.ndarray) -> np.ndarray:
    """Non-negative hashes of ids, even whatever stride the ids have."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def grouped(Z: np.ndarray, pivots: int) -> np.ndarray:
    """Positions in an order that puts series beside others that are near the same pivot."""
    flat = Z.reshape(len(Z), -1)
    chosen = flat[np.argsort(scatter(np.arange(len(flat))), kind="stable")[:max(1, pivots)]]
    half = np.einsum("nd,nd->n", chosen, chosen) / 2
    nearest = np.empty(len(flat), np.int64)
    for a in range(0, len(flat), PAIRS_AT_ONCE // 8):
        part = flat[a:a + PAIRS_AT_ONCE // 8]
        nearest[a:a + len(part)] = (half - part @ chosen.T).argmin(axis=1)
    return np.argsort(nearest, kind="stable")


def _merge(near: np.ndarray, refs: np.ndarray, rows: np.ndarray, found: np.ndarray, dist: np.ndarray) -> None:
    """Put measured pairs into the rows' k nearest, in place; ties to the earlier reference."""
    n, k = near.shape
    row = np.concatenate([np.repeat(np.arange(n), k), rows])
    ref, d = np.concatenate([refs.ravel(), found]), np.concatenate([near.ravel(), dist])
    order = np.lexsort((ref, d, row))
    row = row[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    near[:], refs[:] = d[order].reshape(n, k), ref[order].reshape(n, k)


def top_k_block(metric: Metric, k: int, X: np.ndarray, Y: np.ndarray, allowed: Allowed,
                pivots: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest allowed rows of Y for every row of X, ties to the earlier row of Y.

    Returns query positions, reference positions, distances. `allowed` is a matrix, a function of query and reference
    positions that gives one, or nothing. References near each other form tiles; a tile is left out for queries whose
    k-th distance lies below the bound of its box. Of the rest every pair is estimated, and only pairs whose estimate
    does not exceed the k-th distance so far are measured: estimates never exceed distances, so the result is exact.
    """
    permitted = allowed if callable(allowed) or allowed is None else lambda q, r: allowed[np.ix_(q, r)]
    if metric.name in LOCK_STEP and X.shape[1:] != Y.shape[1:] or X.shape[2] != Y.shape[2]:
        metric(X[:1], Y[:1])  # says what does not fit
    if not (len(X) and len(Y)):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    at_once = max(1, TILE_PAIRS // min(TILE_COLUMNS, len(Y)))
    by_pivot = grouped(Y, min(MOST_PIVOTS, pivots or isqrt(len(Y))))
    tiles = [np.sort(by_pivot[a:a + TILE_COLUMNS]) for a in range(0, len(Y), TILE_COLUMNS)]
    boxes = [(Y[t].min(axis=0), Y[t].max(axis=0)) for t in tiles]
    guess = estimates(metric, X, [Y[t] for t in tiles])
    own = ((kernels.gak_raw(X, X, **metric.params), kernels.gak_raw(Y, Y, **metric.params)) if metric.name == "gak" else ())
    queries = grouped(X, min(MOST_PIVOTS, isqrt(len(X))))
    picks = []
    for a in range(0, len(X), at_once):
        q = queries[a:a + at_once]
        near, refs = np.full((len(q), k), np.inf), np.full((len(q), k), len(Y))

        def take(rows: np.ndarray, found: np.ndarray) -> None:
            for b in range(0, len(rows), PAIRS_AT_ONCE):
                row, ref = rows[b:b + PAIRS_AT_ONCE], found[b:b + PAIRS_AT_ONCE]
                terms = (own[0][q[row]], own[1][ref]) if own else ()
                _merge(near, refs, row, ref, _measure(metric, X[q[row]], Y[ref], terms))

        bounds = np.stack([metric.bound(X[q], low, high) for low, high in boxes], axis=1)
        for t in np.argsort(bounds.min(axis=0), kind="stable"):
            rows = np.flatnonzero(~(bounds[:, t] > slack(near[:, -1])))
            if not len(rows):
                continue
            open_ = None if permitted is None else permitted(q[rows], tiles[t])
            likely = np.ones((len(rows), len(tiles[t])), dtype=bool) if open_ is None else open_.copy()
            new = refs[rows, -1] == len(Y)

            def begin(among: np.ndarray, value: np.ndarray, n: int) -> None:
                """Give queries that came without k references a first limit: their n likeliest pairs are measured."""
                fresh = np.flatnonzero(new[among])
                if len(fresh) and value.shape[1] > n:
                    first = np.argpartition(np.where(likely[among[fresh]], value[fresh], np.inf), n - 1, axis=1)[:, :n]
                    row, at = np.repeat(among[fresh], n), first.ravel()
                    real = likely[row, at]
                    row, at = row[real], at[real]
                    take(rows[row], tiles[t][at])
                    likely[row, at] = False

            whole = np.arange(len(rows))  # queries whose pairs are all estimated
            if guess and guess.glances:
                value = guess.glance(q[rows], t)
                begin(whole, value, FIRST * k)
                likely &= ~(value > guess.glance_limit(q[rows], near[rows, -1])[:, None])
                whole = np.flatnonzero(np.count_nonzero(likely, axis=1) > MANY * likely.shape[1])
            if len(whole):
                value = guess.tile(q[rows[whole]], t) if guess else cross_block(metric, X[q[rows[whole]]], Y[tiles[t]])
                begin(whole, value, k)
                limit = near[rows[whole], -1]
                likely[whole] &= ~(value > (guess.limit(limit) if guess else slack(limit))[:, None])
            row, at = np.divmod(np.flatnonzero(likely), likely.shape[1])
            if len(row):
                take(rows[row], tiles[t][at])
        row, at = np.nonzero(refs < len(Y))
        picks.append((q[row], refs[row, at], near[row, at]))
    where, ref, dist = (np.concatenate(part) for part in zip(*picks))
    order = np.argsort(where, kind="stable")
    return where[order], ref[order], dist[order]
