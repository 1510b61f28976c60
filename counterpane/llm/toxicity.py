"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lowers case, maps look-alike letters of other scripts and digit substitutions to one letter each and drops
invisible characters. Entries are whole words of folded text; an occurrence inside an exception phrase does not count.
The weights of the occurrences, over the words of the text, give a density, and a logistic curve gives the score.

Lexicon, exceptions and curve are learned from a bounded sample of labelled rows (`MAX_ROWS` rows of each label, of at
most `MAX_CHARS` characters): an entry needs `MIN_CONTEXTS` different words before and after it in toxic rows (copies of
one text count once) and a log-odds of `MIN_LOG_ODDS` after one and a half standard errors; a phrase of two words is an
exception if clean rows hold it in `MIN_CLEAN` contexts and toxic rows never do.

Defined results: null and empty texts have no match and the score of density 0; without labels every score is 0;
null ids are held out; repeated rows repeat; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, frame, held_out, labelled_sample, map_texts

MAX_ROWS, MAX_CHARS = 2500, 20_000
MIN_CONTEXTS, MIN_LOG_ODDS, MIN_CLEAN, MAX_ENTRIES = 4, 0.9, 3, 20_000

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ɩ": "i", "ⅼ": "l",
}
# Digits that stand for letters. 1, l and i fall together, so that either reading matches.
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "|": "i"}
# Characters without a width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _table() -> dict[int, str | None]:
    base = LOOKALIKES | {k.upper(): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1 and not k.upper().isascii()}
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        base[chr(c)] = chr(c - 0xFEE0).lower()
    for c in range(0x1D400, 0x1D800):  # mathematical letters and digits
        if len(plain := unicodedata.normalize("NFKC", chr(c)).lower()) == 1 and plain.isascii():
            base[chr(c)] = plain
    folded = {k: SUBSTITUTES.get(v, v) for k, v in base.items()}
    return {ord(k): v for k, v in (folded | SUBSTITUTES).items()} | {ord(c): None for c in INVISIBLE}


FOLD = _table()
_SIGNS = re.compile(r"(?<=\w)[@$](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded text; offsets may differ from the source's where invisible characters are dropped."""
    text = text.lower().translate(FOLD)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text


@dataclass(frozen=True)
class Lexicon:
    """Folded entries and weights, exception phrases, and the curve from density to score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    intercept: float = -math.inf
    slope: float = 0.0


def automaton(lexicon: Lexicon):
    """Entries and exception phrases in one automaton; a value is (length, weight or None for a phrase)."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for entry, weight in lexicon.weights.items():
        built.add_word(entry, (len(entry), weight))
    for phrase in lexicon.exceptions:
        built.add_word(phrase, (len(phrase), None))
    if len(built):
        built.make_automaton()
    return built


def find(folded: str, built) -> list[tuple[int, int, float]]:
    """Start, end and weight of whole-word entries outside exception phrases."""
    if not len(built):
        return []
    hits, spared = [], []
    for last, (size, weight) in built.iter(folded):
        start, end = last - size + 1, last + 1
        if (start and folded[start - 1].isalnum()) or (end < len(folded) and folded[end].isalnum()):
            continue
        (spared if weight is None else hits).append((start, end, weight))
    if spared:
        cover, at = sorted((s, e) for s, e, _ in spared), 0
        left, reach = [], -1
        for hit in sorted(hits):
            while at < len(cover) and cover[at][0] <= hit[0]:
                reach, at = max(reach, cover[at][1]), at + 1
            if hit[1] > reach:
                left.append(hit)
        return left
    return hits


def density(weight: float, words: int) -> float:
    """Weight per hundred words; twenty words are added so that one hit in a short text is not everything."""
    return 100 * weight / (words + 20)


def score_of(lexicon: Lexicon, value: float) -> float:
    """The curve over the logarithm of the density."""
    if lexicon.intercept == -math.inf:
        return 0.0
    x = lexicon.intercept + lexicon.slope * math.log1p(value)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def learn(rows: list[tuple[str, int, float]], seed: dict[str, float] | None = None) -> Lexicon:
    """A lexicon from (text, label, weight) rows; `seed` entries are kept with the weights given."""
    before, behind, clean, words_of = defaultdict(set), defaultdict(set), Counter(), Counter()
    for text, label, _ in rows:
        if label:
            words = _WORD.findall(fold(text))
            words_of[1] += len(words)
            for a, word, b in zip(["", *words], words, [*words[1:], ""]):
                before[word].add(a)
                behind[word].add(b)
    often = {w for w, seen in before.items() if len(w) > 2 and min(len(seen), len(behind[w])) >= MIN_CONTEXTS}
    toxic = {w: max(len(before[w]), len(behind[w])) for w in often}
    for text, label, _ in rows:
        if not label:
            words = _WORD.findall(fold(text))
            words_of[0] += len(words)
            clean.update(word for word in words if word in often)
    weights = {fold(k): v for k, v in (seed or {}).items()}
    for word, n in toxic.items():
        odds = math.log((n + 0.5) / (words_of[1] + 1)) - math.log((clean[word] + 0.5) / (words_of[0] + 1))
        odds -= 1.5 * math.sqrt(1 / (n + 0.5) + 1 / (clean[word] + 0.5))
        if odds >= MIN_LOG_ODDS:
            weights.setdefault(word, odds)
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES])
    phrases: tuple[dict, dict] = (defaultdict(set), defaultdict(set))
    for text, label, _ in rows:
        words = _WORD.findall(fold(text))
        for i, (a, b) in enumerate(zip(words, words[1:])):
            if a in weights or b in weights:
                phrases[min(label, 1)][f"{a} {b}"].add((words[i - 1] if i else "", *words[i + 2:i + 3]))
    exceptions = tuple(sorted(p for p, seen in phrases[0].items() if len(seen) >= MIN_CLEAN and p not in phrases[1]))
    bare = Lexicon(weights, exceptions)
    built = automaton(bare)
    values, labels, counts = [], [], []
    for text, label, weight in rows:
        folded = fold(text)
        values.append(math.log1p(density(sum(w for *_, w in find(folded, built)), len(folded.split()))))
        labels.append(label)
        counts.append(weight)
    if len(set(labels)) < 2:
        return bare if not labels else Lexicon(weights, exceptions, 60.0 if labels[0] else -60.0, 0.0)
    x, y, w = np.array(values), np.array(labels, float), np.array(counts, float)
    w *= len(w) / w.sum()
    design = np.stack([np.ones_like(x), x], 1)
    ridge = np.array([1e-3, 0.1])

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (ridge * beta ** 2).sum() / 2)

    beta = np.zeros(2)
    for _ in range(100):  # Newton's method with a small ridge and halved steps
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (w * (p - y)) + ridge * beta
        step = np.linalg.solve((design.T * (w * p * (1 - p))) @ design + np.diag(ridge), gradient)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return Lexicon(weights, exceptions, float(beta[0]), float(beta[1]))


def learn_from(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
               seed: dict[str, float] | None = None) -> Lexicon:
    """A lexicon from the bounded labelled sample outside the held-out fold."""
    rows = labelled_sample(docs, labels, label, folds, held, MAX_ROWS, MAX_CHARS).orderBy("doc_id").toArrow()
    return learn(list(zip(*(rows.column(c).to_pylist() for c in ("text", "y", "weight")))), seed)


def scorer(lexicon: Lexicon) -> Callable[[list[str]], Iterable[tuple[int, float]]]:
    """Number of occurrences and score of each text."""
    built = automaton(lexicon)

    def work(texts: list[str]) -> Iterable[tuple[int, float]]:
        for text in texts:
            folded = fold(text)
            hits = find(folded, built)
            yield len(hits), score_of(lexicon, density(sum(w for *_, w in hits), len(folded.split())))
    return work


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, folds: int = 5, held: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, score, predicted, n_hits` of every whole text."""
    scored = map_texts(frame(docs, id_col, text_col), lambda: scorer(lexicon), "n_hits bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold."""

    def make() -> Callable[[list[str]], list[bool]]:
        work = scorer(lexicon)
        return lambda texts: [score < threshold for _, score in work(texts)]

    return filter_texts(docs, text_col, make)
