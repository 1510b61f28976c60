"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes the words (matches of the pre-token pattern) of a slice of documents that it has not met yet, lays them
out as one sequence of token positions and keeps an inverted index from merge rank to the positions whose pair has that
rank. Ranks are replayed in ascending order over all words at once; a merge touches its two neighbours only. Nothing is
shuffled: words repeat far more often within a task than between tasks, so each task keeps a bounded memory of words.

Defined results: a null or empty text has no tokens, an empty id string and empty bytes; null ids stay null; repeated
rows give repeated results; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import frame, map_texts

#: Characters of remembered words after which a task starts its memory anew.
MEMORY_CHARS = 12_000_000
#: Characters whose words are replayed together.
REPLAY_CHARS = 8 << 20
_MARKS = frozenset(".,;:!?")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Ids of many distinct words at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way in which a token falls into two tokens: all pairs that can ever merge
        found = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() if len(t) > 1
                       for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs = np.array([p for p, _ in found] or [-1], np.int64)
        self.merged = np.array([r for _, r in found] or [-1], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined bytes of each pair, -1 for none; ids below 0 belong to no pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word. A separator (-1) stands between words; -2 marks a place whose token is gone."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes
        n = int(ends[-1]) + 1
        token = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[np.r_[0, ends]] = False
        token[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words) + 1), np.r_[1, sizes + 1])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank_at = np.r_[self.pair_rank(token[:-1], token[1:]), -1]
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(places: np.ndarray, ranks: np.ndarray) -> None:
            """Enter places into the inverted index under the ranks of their pairs."""
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for rank, a, b in zip(ranks[begins].tolist(), begins, [*begins[1:], len(ranks)]):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(queue, rank)

        if (some := np.flatnonzero(rank_at >= 0)).size:
            note(some, rank_at[some])
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank_at[at] == rank]
            if not at.size:
                continue
            # one merge per word, the leftmost: what it creates may come before the word's next pair of this rank
            again = np.r_[False, word[at[1:]] == word[at[:-1]]]
            if again.any():
                index[rank] = [at[again]]
                heapq.heappush(queue, rank)
                at = at[~again]
            right, prior = after[at], before[at]
            end = after[right]
            token[at], token[right], rank_at[right] = rank, -2, -1
            after[at], before[end] = end, at
            places = np.concatenate([prior, at])
            mine = np.full(len(at), rank)
            fresh = self.pair_rank(np.concatenate([token[prior], mine]), np.concatenate([mine, token[end]]))
            rank_at[places] = fresh
            if (some := fresh >= 0).any():
                note(places[some], fresh[some])
        held = token >= 0
        upto = np.r_[0, np.cumsum(held)]
        ids = token[held].tolist()
        return [ids[a:b] for a, b in zip(upto[starts].tolist(), upto[starts + sizes].tolist())]


#: A blank before a non-blank always begins a pre-token, so texts are looked up in units cut there.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")


def units(text: str) -> list[str]:
    """Parts of a text between the blanks that begin a word; each but the first lacks its leading blank."""
    return text.split(" ") if _ODD.search(text) is None else _CUT.split(text)


class Encoder:
    """Ids of texts as decimal numbers joined by one blank, with a bounded memory of units and words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.replay, self.pattern = MergeReplay(ranks), regex.compile(pattern)
        self.first: dict[str, str] = {}
        self.later: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.chars = 0

    def split(self, unit: str) -> list[str]:
        """Words of a unit that follows a blank; letters, and letters with one mark, need no pattern."""
        if unit.isalpha():
            return [" " + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return self.pattern.findall(" " + unit)

    def learn(self, memory: dict[str, str], fresh: set[str], split: Callable[[str], list[str]]) -> None:
        """Replay the merges over the words of `fresh` units that are new."""
        known = self.words
        gc.disable()  # half a million short lists, none in a cycle
        parts = list(map(split, fresh))
        words = list({word for each in parts for word in each if word not in known})
        for word, ids in zip(words, self.replay.encode([w.encode() for w in words])):
            known[word] = " ".join(map(str, ids))
        for unit, each in zip(fresh, parts):
            memory[unit] = known[each[0]] if len(each) == 1 else " ".join([known[word] for word in each])
        gc.enable()
        self.chars += sum(map(len, fresh)) + sum(map(len, words))

    def encode(self, texts: list[str]) -> Iterator[str]:
        if self.chars > MEMORY_CHARS:
            for memory in (self.first, self.later, self.words):
                memory.clear()
            self.chars = 0
        parts = list(map(units, texts))
        later: set[str] = set()
        for each in parts:
            later.update(each[1:])
        self.learn(self.first, {each[0] for each in parts} - self.first.keys(), self.pattern.findall)
        self.learn(self.later, later - self.later.keys(), self.split)
        look = self.later.__getitem__
        for each in parts:
            yield " ".join([*filter(None, (self.first[each[0]],)), *map(look, each[1:])])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker process's encoder for a vocabulary: its memory serves all tasks that the process runs."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, pattern] = Encoder(ranks, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, ids` with the token ids of every whole text; the file at `path` is read by the driver alone."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        own = encoder(path, ranks.value, pattern)
        return lambda texts: (([int(x) for x in ids.split()],) for ids in own.encode(texts))

    return map_texts(frame(docs, id_col, text_col), make, "ids array<int>", REPLAY_CHARS)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`doc_id, bytes` of token ids; null ids give empty bytes, unknown ids raise."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token = {rank: word for word, rank in ranks.value.items()}
        for batch in batches:
            out = [b"".join([token[i] for i in ids or []]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", ids_col).mapInArrow(run, "doc_id bigint, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: `doc_id, n_tokens, ids_sha256, decoded_sha256`."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        own = encoder(path, ranks.value, pattern)
        token = {str(rank): word for word, rank in ranks.value.items()}.__getitem__

        def work(texts: list[str]) -> Iterable[tuple]:
            for ids in own.encode(texts):
                each = ids.split()
                yield (len(each), hashlib.sha256(ids.encode()).hexdigest(),
                       hashlib.sha256(b"".join(map(token, each))).hexdigest())
        return work

    return map_texts(frame(docs, id_col, text_col), make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                     REPLAY_CHARS)
