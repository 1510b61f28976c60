"""Language identification with a byte convolutional network, trained in numpy.

A text is lower-cased, cut into windows of `WINDOW` bytes, and every window is scored: filters of several widths run
over its bytes, the largest value of each filter over the window goes through a rectifier into a softmax. The answer for
a text is the mean of its windows' log-probabilities, weighted by their bytes. As the input is one-hot bytes, a filter is
a table of 256 rows for each of its places; pairs of places are merged into tables of 65,536 rows for prediction.

It learns from a bounded sample: at most `ROWS` documents of each language outside the held-out fold (the first in hash
order), `WINDOWS` windows of each, spread over the text.

Defined results: null texts and texts without a letter are `und` with score 0; null languages are not learned; with no
language to learn from everything is `und`; a single language is always predicted with score 1; null ids are held out;
repeated rows repeat; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_rows, frame, held_out, map_texts

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 12
ROWS, WINDOWS, MAX_LANGUAGES = 400, 8, 256
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.01, 5


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, `(n, WINDOW)` bytes; the last one is padded with zeros."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = data
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    """Filter tables (one `(width, 256, FILTERS)` array per width), biases, and the dense layer."""

    languages: list[str]
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def hidden(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified largest filter values and where they stand."""
        values, places = [], []
        for table, bias in zip(self.tables, self.biases):
            width = len(table)
            span = windows.shape[1] - width + 1
            total = table[0][windows[:, :span]]
            for j in range(1, width):
                total = total + table[j][windows[:, j:j + span]]
            at = total.argmax(axis=1)
            values.append(np.take_along_axis(total, at[:, None], 1)[:, 0] + bias)
            places.append(at)
        return np.maximum(np.concatenate(values, 1), 0), places

    def log_probabilities(self, hidden: np.ndarray) -> np.ndarray:
        logits = hidden @ self.dense + self.offset
        logits = logits - logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str]) -> Network:
    """Adam on the cross-entropy; languages weigh alike whatever their number of windows."""
    rng = np.random.default_rng(SEED)
    k = len(languages)
    tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Network(languages, tables, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)).astype(np.float32), np.zeros(k, np.float32))
    weight = len(labels) / np.maximum(1, np.bincount(labels, minlength=k)) / k
    params = [*net.tables, *net.biases, net.dense, net.offset]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at:at + BATCH]
            x, y = windows[some], labels[some]
            hidden, places = net.hidden(x)
            delta = np.exp(net.log_probabilities(hidden))
            delta[np.arange(len(y)), y] -= 1
            delta *= (weight[y] / len(y))[:, None]
            back = (delta @ net.dense.T) * (hidden > 0)
            grads: list[np.ndarray] = []
            parts = np.split(back, len(WIDTHS), axis=1)
            for table, where, part in zip(net.tables, places, parts):
                grad = np.zeros_like(table)
                for j in range(len(table)):
                    byte = x[np.arange(len(y))[:, None], where + j]
                    np.add.at(grad[j], (byte, np.arange(FILTERS)[None, :]), part)
                grads.append(grad)
            grads += [part.sum(axis=0) for part in parts]
            grads += [hidden.T @ delta, delta.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


class Predictor:
    """The network with its tables merged for pairs of bytes."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.plans = []
        for table, bias in zip(net.tables, net.biases):
            steps, j = [], 0
            while j < len(table):
                if j + 1 < len(table):
                    pair = (table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, -1)
                    steps.append((j, 2, np.ascontiguousarray(pair)))
                    j += 2
                else:
                    steps.append((j, 1, table[j]))
                    j += 1
            self.plans.append((len(table), steps, bias))

    def window_scores(self, windows: np.ndarray) -> np.ndarray:
        """Log-probabilities `(n, languages)`."""
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        values = []
        for width, steps, bias in self.plans:
            span = windows.shape[1] - width + 1
            total = None
            for j, kind, table in steps:
                part = np.take(table, pairs[:, j:j + span] if kind == 2 else windows[:, j:j + span], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            values.append(total.max(axis=1) + bias)
        return self.net.log_probabilities(np.maximum(np.concatenate(values, 1), 0))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.net.languages:
            return [("und", 0.0)] * len(texts)
        each = [windows_of(t) for t in texts]
        sizes = np.array([len(w) for w in each])
        stacked = np.concatenate(each) if sizes.sum() else np.zeros((0, WINDOW), np.uint8)
        scores = np.concatenate([np.zeros((0, len(self.net.languages)), np.float32)]
                                + [self.window_scores(stacked[i:i + 256]) for i in range(0, len(stacked), 256)])
        filled = (stacked > 0).sum(axis=1, keepdims=True)
        out, at = [], 0
        for text, n in zip(texts, sizes.tolist()):
            weight = filled[at:at + n]
            if not n or not weight.sum() or not any(map(str.isalpha, text)):
                out.append(("und", 0.0))
            else:
                mean = (scores[at:at + n].astype(np.float64) * weight).sum(axis=0) / weight.sum()
                p = np.exp(mean - mean.max())
                best = int(p.argmax())
                out.append((self.net.languages[best], float(p[best] / p.sum())))
            at += n
        return out


def learn_from(docs: DataFrame, folds: int = 4, held: int = 2, lang_col: str = "lang") -> Network:
    """A network from the bounded sample outside the held-out fold."""
    ids = (docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs[lang_col].cast("string").alias("lang"))
           .where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds, held)))
    chosen = first_rows(ids, "lang", ROWS).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    sample = frame(docs).join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "lang", "text")

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        def work(texts: list[str]) -> Iterable[tuple]:
            for text in texts:
                parts = windows_of(text)
                yield (parts[np.linspace(0, len(parts) - 1, min(WINDOWS, len(parts))).astype(int)].tobytes()
                       if len(parts) else b"",)
        return work

    rows = map_texts(sample, make, "windows binary").orderBy("doc_id").toArrow()
    names, blobs = rows.column("lang").to_pylist(), rows.column("windows").to_pylist()
    languages = sorted({n for n, b in zip(names, blobs) if b})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages are more than MAX_LANGUAGES")
    number = {n: i for i, n in enumerate(languages)}
    windows = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, WINDOW)
    labels = np.repeat([number[n] for n, b in zip(names, blobs) if b],
                       [len(b) // WINDOW for b in blobs if b]).astype(np.int64)
    return train(windows, labels, languages)


def predict_language(docs: DataFrame, net: Network, folds: int = 4, held: int = 2, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        return Predictor(sent.value).predict

    scored = map_texts(frame(docs, id_col, text_col), make, "lang_pred string, score double", 1 << 20)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, held).alias("held_out"), "lang_pred", "score")
