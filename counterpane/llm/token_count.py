"""Token counts by a map-side two-tier lookup.

The first tier is a compact table of frequent pre-tokens and their numbers of tokens: the vocabulary of the tokenizer
itself, whose entries are the pieces that were frequent where it was made. It has as many entries as the vocabulary
(the bound of the broadcast), packed as one string and one byte array. What it lacks is encoded once per task by the
library and kept in a bounded memory. No pre-token is ever shuffled.

Defined results: null and empty texts have 0 bytes and 0 tokens; null ids stay null; repeated rows repeat; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMORY_CHARS, units
from .common import frame, map_texts

MAX_TABLE = 1 << 20


def frequent_lengths(tokenizer) -> tuple[str, bytes]:
    """The vocabulary's pre-tokens, joined by blanks (which no byte-level piece holds), and their token counts."""
    pieces = sorted(tokenizer.get_vocab(with_added_tokens=False))
    if len(pieces) > MAX_TABLE:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces is beyond the bound {MAX_TABLE} of the broadcast table")
    counts = [min(255, len(tokenizer.model.tokenize(piece))) for piece in pieces]
    keep = [(p, n) for p, n in zip(pieces, counts) if n < 255 and " " not in p]
    return " ".join(p for p, _ in keep), np.array([n for _, n in keep], np.uint8).tobytes()


class Counter:
    """Token counts of texts, as the library's `encode` gives them without added tokens."""

    def __init__(self, definition: str, table: tuple[str, bytes]) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.pre_tokenize = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent = dict(zip(table[0].split(" "), table[1]))
        self.rare: dict[str, int] = {}
        self.first, self.later = _Memory(self, ""), _Memory(self, " ")

    def piece(self, piece: str) -> int:
        n = self.frequent.get(piece) or self.rare.get(piece)
        if n is None:
            n = self.rare[piece] = len(self.tokenizer.model.tokenize(piece))
        return n

    def unit(self, unit: str) -> int:
        return sum([self.piece(p) for p, _ in self.pre_tokenize(unit)])

    def count(self, text: str) -> int:
        for special in self.special:
            if special in text:  # the library takes these strings as one token each
                parts = text.split(special)
                return len(parts) - 1 + sum([self.count(p) for p in parts])
        if not text:
            return 0
        parts = units(text)
        return self.first[parts[0]] + sum(map(self.later.__getitem__, parts[1:]))

    def forget(self) -> None:
        if self.first.chars + self.later.chars > MEMORY_CHARS:
            for memory in (self.first, self.later):
                memory.clear()
                memory.chars = 0
            self.rare.clear()


class _Memory(dict):
    """Counts of units of text, computed when first asked for."""

    def __init__(self, counter: Counter, lead: str) -> None:
        super().__init__()
        self.counter, self.lead, self.chars = counter, lead, 0

    def __missing__(self, unit: str) -> int:
        self.chars += len(unit)
        n = self[unit] = self.counter.unit(self.lead + unit)
        return n


_COUNTERS: dict[str, Counter] = {}


def counter_for(path: str, made: tuple[str, tuple[str, bytes]]) -> Counter:
    """The worker process's counter of a tokenizer: its memory serves all tasks that the process runs."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(*made)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of every whole text, for a byte-level tokenizer file (.json).

    The driver reads the file; tasks get its text by broadcast.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    shape = tokenizer.pre_tokenizer.__class__.__name__
    if shape != "ByteLevel" or tokenizer.normalizer is not None:
        raise ValueError("a byte-level tokenizer without normaliser is needed: units are cut before blanks")
    made = docs.sparkSession.sparkContext.broadcast((tokenizer.to_str(), frequent_lengths(tokenizer)))

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        counter = counter_for(path, made.value)

        def work(texts: list[str]) -> Iterable[tuple]:
            counter.forget()
            return [(len(t.encode()), counter.count(t)) for t in texts]
        return work

    counted = map_texts(frame(docs, id_col, text_col), make, "n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
