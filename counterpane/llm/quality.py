"""Text quality by a sparse ensemble of rules.

Statistics of a text are Spark columns. Shallow trees are boosted on a bounded labelled sample (`MAX_ROWS` rows of each
label, of at most `MAX_CHARS` characters); every path from a root to a node is a conjunctive rule; a lasso logistic
regression over the rules keeps few of them; and the rules that are left, with their weights, are compiled into one
Spark column expression. Scoring runs no Python.

Defined results: null and empty texts have the statistics of an empty text (all 0) and the score these give; without
labels, or with one label alone, every score is the share of that label (0 without any); null ids are held out; repeated
rows repeat; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frame, held_out, labelled_sample

MAX_ROWS, MAX_CHARS = 2500, 20_000
TREES, DEPTH, CUTS, SHRINK, LEAST, SEED = 30, 3, 32, 0.3, 8, 11
PENALTY, STEPS = 0.002, 600

STATISTICS = ("chars", "words", "word_length", "distinct_words", "lines", "distinct_lines", "letters", "capitals",
              "digits", "signs", "marks", "shouts")


def _length_without(pattern: str) -> Column:
    return F.length(F.regexp_replace("text", pattern, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """The statistics beside the columns of `docs`, whose `text` must not be null. Shares are of characters or words."""
    cut = docs.withColumn("_w", F.split(F.trim("text"), r"\s+")).withColumn("_l", F.split("text", "\n"))
    counted = cut.select(
        *docs.columns, F.length("text").cast("double").alias("chars"),
        F.when(F.col("text") == "", 0).otherwise(F.size("_w")).cast("double").alias("words"),
        F.size(F.array_distinct("_w")).alias("_dw"), F.size("_l").cast("double").alias("lines"),
        F.size(F.array_distinct("_l")).alias("_dl"), _length_without(r"[^\p{L}]+").alias("_letters"),
        _length_without(r"[^\p{Lu}]+").alias("_capitals"), _length_without(r"[^\p{N}]+").alias("_digits"),
        _length_without(r"[\p{L}\p{N}\s.,;:'\-]+").alias("_signs"), _length_without(r"[^.,;:]+").alias("_marks"),
        F.size(F.filter("_w", lambda w: F.length(w) > 3)).alias("_long"),
        F.size(F.filter("_w", lambda w: (F.length(w) > 3) & (w == F.upper(w)) & (w != F.lower(w)))).alias("_loud"))
    chars, words = F.greatest(F.col("chars"), F.lit(1.0)), F.greatest(F.col("words"), F.lit(1.0))
    return counted.select(
        *docs.columns, "chars", "words", (F.col("chars") / words).alias("word_length"),
        (F.col("_dw") / words).alias("distinct_words"), "lines",
        (F.col("_dl") / F.greatest("lines", F.lit(1.0))).alias("distinct_lines"),
        (F.col("_letters") / chars).alias("letters"), (F.col("_capitals") / chars).alias("capitals"),
        (F.col("_digits") / chars).alias("digits"), (F.col("_signs") / chars).alias("signs"),
        (F.col("_marks") / words).alias("marks"),
        (F.col("_loud") / F.greatest(F.col("_long"), F.lit(1))).cast("double").alias("shouts"))


Condition = tuple[int, bool, float]  # statistic, whether above, bound


@dataclass(frozen=True)
class Rules:
    """Conjunctions of conditions with weights, and the intercept."""

    conjunctions: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(float(self.intercept))
        for conditions, weight in zip(self.conjunctions, self.weights):
            holds = None
            for which, above, bound in conditions:
                one = F.col(STATISTICS[which]) > bound if above else F.col(STATISTICS[which]) <= bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def values(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + matrix(self.conjunctions, x) @ np.array(self.weights))))


def matrix(conjunctions, x: np.ndarray) -> np.ndarray:
    """Which rows meet which conjunctions, as 0 and 1."""
    out = np.ones((len(x), len(conjunctions)))
    for r, conditions in enumerate(conjunctions):
        for which, above, bound in conditions:
            out[:, r] *= (x[:, which] > bound) if above else (x[:, which] <= bound)
    return out


def tree_paths(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rows: np.ndarray,
               path: tuple[Condition, ...] = ()) -> list[tuple[tuple[Condition, ...], np.ndarray]]:
    """Paths and rows of the nodes below, grown by the weighted squared error of `target`."""
    if len(path) == DEPTH or len(rows) < 2 * LEAST:
        return []
    best = (1e-9, None)
    w, t = weight[rows], target[rows]
    sum_w, sum_t = w.sum(), (w * t).sum()
    for which, bounds in enumerate(cuts):
        bins = np.searchsorted(bounds, x[rows, which], "left")
        left_n = np.cumsum(np.bincount(bins, minlength=len(bounds) + 1))[:-1]
        left_w = np.cumsum(np.bincount(bins, w, len(bounds) + 1))[:-1]
        left_t = np.cumsum(np.bincount(bins, w * t, len(bounds) + 1))[:-1]
        fits = (left_n >= LEAST) & (len(rows) - left_n >= LEAST)
        if fits.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, left_t ** 2 / left_w + (sum_t - left_t) ** 2 / (sum_w - left_w), -np.inf)
            at = int(gain.argmax())
            if gain[at] - sum_t ** 2 / sum_w > best[0]:
                best = (gain[at] - sum_t ** 2 / sum_w, (which, float(bounds[at])))
    if best[1] is None:
        return []
    which, bound = best[1]
    above = x[rows, which] > bound
    out = []
    for side, part in ((False, rows[~above]), (True, rows[above])):
        here = (*path, (which, side, bound))
        below = tree_paths(x, cuts, target, weight, part, here)
        out += [(here, part), *below]
    return out


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Rules:
    """Rules from boosted trees and their lasso weights."""
    if not len(y) or len(np.unique(y)) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.0
        return Rules((), (), math.log(share / (1 - share)) if share else -60.0)
    weight = weight * len(y) / weight.sum()
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    rng = np.random.default_rng(SEED)
    base = (weight * y).sum() / weight.sum()
    margin = np.full(len(y), math.log(base / (1 - base)))
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        paths = tree_paths(x, cuts, y - p, weight, rows)
        if not paths:
            break
        prefixes = {path[:-1] for path, _ in paths}
        for path, part in paths:
            found[tuple(sorted(path))] = None
            if path not in prefixes:  # a leaf moves the margin of all its rows by a Newton step
                everywhere = matrix((path,), x)[:, 0] > 0
                g = (weight * (y - p))[part].sum()
                h = (weight * p * (1 - p))[part].sum() + 1.0
                margin[everywhere] += SHRINK * g / h
    conjunctions = tuple(found)
    z = matrix(conjunctions, x)
    beta, b0 = np.zeros(z.shape[1]), math.log(base / (1 - base))
    last, b_last, t = beta.copy(), b0, 1.0
    scale = np.linalg.norm(z, 2) ** 2 / 4 / len(y) * weight.max() + 0.25 * weight.max()
    for _ in range(STEPS):  # accelerated proximal gradient
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        at, b_at = beta + (t - 1) / t_next * (beta - last), b0 + (t - 1) / t_next * (b0 - b_last)
        error = weight * (1 / (1 + np.exp(-np.clip(z @ at + b_at, -40, 40))) - y) / len(y)
        last, b_last = beta, b0
        moved = at - z.T @ error / scale
        beta = np.sign(moved) * np.maximum(np.abs(moved) - PENALTY / scale, 0)
        b0, t = b_at - error.sum() / scale, t_next
    kept = np.flatnonzero(beta)
    return Rules(tuple(conjunctions[i] for i in kept), tuple(beta[kept].tolist()), float(b0))


def learn_from(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0) -> Rules:
    """Rules from the bounded labelled sample outside the held-out fold; the statistics are computed by Spark."""
    sample = labelled_sample(docs, labels, label, folds, held, MAX_ROWS, MAX_CHARS)
    rows = statistics(sample).select("doc_id", "y", "weight", *STATISTICS).orderBy("doc_id").toArrow()
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], 1).astype(float)
    return learn(x, (rows.column("y").to_numpy() > 0).astype(float), rows.column("weight").to_numpy().astype(float))


def score_quality(docs: DataFrame, rules: Rules, threshold: float = 0.3, folds: int = 5, held: int = 0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, score, predicted` of every whole text."""
    rows = frame(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return statistics(rows).select(
        "doc_id", held_out(F.col("doc_id"), folds, held).alias("held_out"), rules.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
