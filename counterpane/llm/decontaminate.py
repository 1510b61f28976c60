"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (lower case, every run of blanks and ASCII marks one blank, as bytes). Items
are cut into overlapping windows of `WINDOW` bytes (a shorter item is one window). A window that occurs in a text with
at most k edits shares at least `length + 1 - (k + 1) * Q` of its q-grams with it, on diagonals no more than 2k apart.
So hits are counted in overlapping diagonal bands, bands below the bound are dropped, and the rest is aligned within
the band. A text is contaminated if some window aligns within its budget of `EDITS` edits per byte.

Items below `MIN_BYTES` bytes have no edits to spend: they accuse a text that holds them verbatim, from word border to
word border. There the lemma would ask for every q-gram on one diagonal, which are the bytes themselves, so stretches
between word borders are looked up by hash and compared.

Hits are expanded to windows in parts of at most `ENTRIES`, cut by diagonals and by windows, and each part is aligned
before the next: items that share a frequent stem cost time, never memory.

The benchmark travels to the tasks as text, in blocks of about half of `BLOCK_BYTES` (one pass over the documents for
each block), and a worker builds the index of a block once. The driver holds one block at a time; the result of a pass,
the accused rows alone, is written before the next one begins.

Defined results: null and empty texts are clean; items that are empty after normalising accuse nobody (null ones and
those with a null id neither); repeated items count once, under their smallest id; null ids stay null and repeated rows
repeat; other columns are ignored; an empty table or benchmark gives no contamination.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, frame, keep, map_texts

Q, WINDOW, STRIDE, EDITS, MIN_BYTES = 8, 80, 40, 0.1, 32
BLOCK_BYTES = 8 << 20
#: Bytes of text that a task searches at once.
SLICE = 1 << 20
#: Pairs of a hit and a window that are looked at together.
ENTRIES = 1 << 19
_BITS = 22
_BASE = 0x9E3779B97F4A7C15
_MARKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def normalise(text: str) -> bytes:
    """Lower case, runs of blanks and ASCII marks as one blank."""
    return b" ".join(text.lower().encode().translate(_MARKS).split())


def grams(data: np.ndarray) -> np.ndarray:
    """All q-grams of a byte array as 64-bit numbers (Q is 8)."""
    return np.ndarray((len(data) - Q + 1,), np.dtype("<u8"), data.tobytes(), strides=(1,)).copy()


@dataclass(frozen=True)
class Windows:
    """Windows of the items of a block: texts, item ids, the sorted q-grams and where they stand.

    `code` numbers the pairs of a distinct q-gram and a window that holds it, in order; `exact` holds the items too short
    for windows, `hashes` their hashes by length.
    """

    texts: list[bytes]
    items: np.ndarray
    sizes: np.ndarray
    gram: np.ndarray
    code: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    exact: dict[bytes, int]
    hashes: dict[int, np.ndarray]

    @staticmethod
    def of(items: Iterable[tuple[int, str]]) -> Windows:
        texts, ids, seen, exact = [], [], set(), {}
        for item, text in sorted(items):
            body = normalise(text)
            if not body or body in seen:
                continue
            seen.add(body)
            if len(body) < MIN_BYTES:
                exact[body] = item
                continue
            last = max(0, len(body) - WINDOW)
            for start in [*range(0, last, STRIDE), last]:
                texts.append(body[start:start + WINDOW])
                ids.append(item)
        each = [grams(np.frombuffer(t, np.uint8)) for t in texts]
        gram = np.concatenate(each) if each else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(each)), [len(g) for g in each])
        place = np.concatenate([np.arange(len(g)) for g in each]) if each else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[_slot(gram)] = True
        distinct, number = np.unique(gram[order], return_inverse=True)
        hashes = {n: np.unique(np.concatenate([stretches(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), n)
                                               for t in exact if len(t) == n])) for n in {len(t) for t in exact}}
        return Windows(texts, np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64), distinct,
                       number * len(each) + owner[order], owner[order], place[order], bitmap, exact, hashes)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of bytes times powers, and the inverse powers, modulo 2^64."""
    powers = np.cumprod(np.full(len(data), _BASE, np.uint64))
    inverse = np.cumprod(np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64))
    return np.r_[np.zeros(1, np.uint64), np.cumsum(data * powers, dtype=np.uint64)], inverse


def stretches(data: np.ndarray, at: np.ndarray, size: int,
              sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of the `size` bytes from each of the places `at`."""
    total, inverse = sums or _sums(data)
    return (total[at + size] - total[at]) * inverse[at]


def _slot(gram: np.ndarray) -> np.ndarray:
    return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def budget(sizes: np.ndarray) -> np.ndarray:
    return (sizes * EDITS).astype(np.int64)


def bound(sizes: np.ndarray) -> np.ndarray:
    """Shared q-grams that the lemma asks for (at least one)."""
    return np.maximum(1, sizes + 1 - (budget(sizes) + 1) * Q)


#: Diagonals fall into bands of this width that begin at every half of it: a drift of 2k is inside one band.
_BAND = 4 * int(WINDOW * EDITS)


def regions(data: np.ndarray, windows: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window numbers and first diagonals of the bands that meet the bound in one long byte array, part by part."""
    if len(data) < Q or not len(windows.gram):
        return
    gram = grams(data)
    at = np.flatnonzero(windows.bitmap[_slot(gram)])
    found = np.minimum(np.searchsorted(windows.gram, gram[at]), len(windows.gram) - 1)
    same = windows.gram[found] == gram[at]
    at, found = at[same], found[same] * len(windows.texts)
    half = _BAND // 2
    # diagonals are moved up so that none is negative
    span = (len(data) + 3 * WINDOW) // half + 2
    pending = [(0, len(windows.texts), 0, span)]
    while pending:
        low, high, first, last = pending.pop()
        # a band holds two steps, so hits of the step after the last one belong here as well
        a, b = np.searchsorted(at, [first * half - 2 * WINDOW, (last + 1) * half - WINDOW])
        begin = np.searchsorted(windows.code, found[a:b] + low)
        counts = np.searchsorted(windows.code, found[a:b] + high) - begin
        total = int(counts.sum())
        if not total:
            continue
        if total > ENTRIES and last - first > (64 if high - low > 1 else 1):
            middle = (first + last) // 2
            pending += [(low, high, first, middle), (low, high, middle, last)]
            continue
        if total > ENTRIES and high - low > 1:
            middle = (low + high) // 2
            pending += [(low, middle, first, last), (middle, high, first, last)]
            continue
        entry = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)
        step = (np.repeat(at[a:b], counts) - windows.place[entry] + 2 * WINDOW) // half
        key = windows.owner[entry] * span + step
        key, hits = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        owner, step = key // span, key % span
        good = (hits >= bound(windows.sizes)[owner]) & (step >= first) & (step < last)
        if good.any():
            yield owner[good], step[good] * half - 2 * WINDOW


def verbatim(data: np.ndarray, windows: Windows) -> Iterator[tuple[int, int]]:
    """Places and ids of the short items that stand in the text from word border to word border."""
    if not windows.exact:
        return
    border = (data == 32) | (data == 0)
    begins = np.flatnonzero(border[:-1] & ~border[1:]) + 1
    sums = _sums(data)
    for size, known in windows.hashes.items():
        at = begins[begins + size < len(data)]
        at = at[border[at + size]]
        for place in at[np.isin(stretches(data, at, size, sums), known)].tolist():
            item = windows.exact.get(data[place:place + size].tobytes())
            if item is not None:
                yield place, item


def aligned(data: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, start: np.ndarray,
            windows: Windows) -> np.ndarray:
    """Least edits of each window within its band, if its budget allows them; text outside [low, high) matches nothing."""
    out = np.full(len(owner), np.iinfo(np.int64).max)
    sizes = windows.sizes[owner]
    for size in np.unique(sizes):
        k = int(size * EDITS)
        width = _BAND + 2 * k + 1
        some = np.flatnonzero(sizes == size)
        for part in np.array_split(some, len(some) // 2048 + 1):
            pattern = np.stack([np.frombuffer(windows.texts[w], np.uint8) for w in owner[part]])
            where = (start[part] - k)[:, None] + np.arange(size + width)
            inside = (where >= low[part][:, None]) & (where < high[part][:, None])
            text = np.where(inside, data[np.clip(where, 0, len(data) - 1)], 0)
            column = np.arange(width)
            cost = np.zeros((len(part), width), np.int64)
            for i in range(int(size)):
                step = cost + (text[:, i:i + width] != pattern[:, i:i + 1])
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(step - column, axis=1) + column
                if i % 16 == 15:  # edits never become fewer
                    open_ = cost.min(axis=1) <= k
                    part, pattern, text, cost = part[open_], pattern[open_], text[open_], cost[open_]
            out[part] = cost.min(axis=1)
    return out


def contaminated(texts: list[str], windows: Windows) -> list[dict[int, float]]:
    """For each text the items that some window of theirs accuses, with the best share of bytes unedited."""
    bodies = [normalise(t) for t in texts]
    data = np.frombuffer(b"\0".join([b"", *bodies, b""]), np.uint8)
    low = np.cumsum([1, *(len(b) + 1 for b in bodies)])
    out: list[dict[int, float]] = [{} for _ in texts]
    for place, item in verbatim(data, windows):
        out[int(np.searchsorted(low, place, "right")) - 1][item] = 1.0
    for owner, start in regions(data, windows):
        # a band may touch neighbouring texts: it is aligned in each
        doc = np.clip(np.searchsorted(low, np.clip(start, 0, None), "right") - 1, 0, len(texts) - 1)
        until = np.searchsorted(low, start + _BAND + windows.sizes[owner], "right") - 1
        tries = np.minimum(until, len(texts) - 1) - doc + 1
        entry = np.repeat(np.arange(len(owner)), tries)
        doc = doc[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(tries) - tries, tries)
        owner, start = owner[entry], start[entry]
        edits = aligned(data, low[doc], low[doc + 1] - 1, owner, start, windows)
        for i in np.flatnonzero(edits <= budget(windows.sizes[owner])):
            item, share = int(windows.items[owner[i]]), 1 - float(edits[i]) / float(windows.sizes[owner[i]])
            out[doc[i]][item] = max(share, out[doc[i]].get(item, 0.0))
    return out


class Block:
    """Items of one block as they travel; the index is built where it is used, once in a worker."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items

    @cached_property
    def windows(self) -> Windows:
        return Windows.of(self.items)


def blocks_of(benchmark: DataFrame, item_col: str, item_text: str) -> tuple[int, Iterator[Block]]:
    """The number of blocks of the benchmark, and the blocks one by one."""
    items = frame(benchmark, item_col, item_text).where("text is not null and doc_id is not null").groupBy("text").agg(
        F.min("doc_id").alias("doc_id"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(size // (BLOCK_BYTES // 2)) + 1
    if count > 1:
        # items that are equal after normalising meet in one block; in order of blocks, each is read from its own files
        signs = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
        items = keep(items.withColumn("block", F.pmod(F.xxhash64(signs), F.lit(count))).repartitionByRange("block"),
                     "benchmark-items")

    def each() -> Iterator[Block]:
        for block in range(count):
            own = items.where(F.col("block") == block) if count > 1 else items
            yield Block([(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()])

    return count, each()


def search(source: DataFrame, block: Block) -> DataFrame:
    """The columns of `source` without its last one, `text`, and `items, similarity` of each text: a narrow pass."""
    sent = source.sparkSession.sparkContext.broadcast(block)

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        def work(texts: list[str]) -> Iterable[tuple]:
            for found in contaminated(texts, sent.value.windows):
                yield sorted(found), max(found.values(), default=0.0)
        return work

    return map_texts(source, make, "items array<bigint>, similarity double", SLICE)


def accused(source: DataFrame, blocks: Iterator[Block], row: str) -> DataFrame:
    """`row, items, similarity` of the rows of a table `row, text` that some block accuses; each pass is written."""
    parts = [keep(search(source, block).where(F.size("items") > 0), "accused") for block in blocks]
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    return found.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                  F.max("similarity").alias("similarity"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`doc_id, n_items, items, similarity, kept` of every row; `kept` is false for contaminated texts."""
    count, blocks = blocks_of(benchmark, item_col, item_text)
    source = frame(docs, id_col, text_col)
    if count == 1:
        found = search(source, next(blocks))
    else:  # every pass must see the same rows, so they are numbered once
        rows = keep(source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "decontaminate")
        found = rows.select("rid", "doc_id").join(accused(rows.select("rid", "text"), blocks, "rid").hint("merge"), "rid", "left")
        found = found.select("doc_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
                             F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return found.select("doc_id", F.size("items").cast("bigint").alias("n_items"), "items", "similarity",
                        (F.size("items") == 0).alias("kept"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text holds no passage of the benchmark."""
    count, blocks = blocks_of(benchmark, item_col, item_text)
    if count == 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(blocks))
        return filter_texts(docs, text_col, lambda: lambda texts: [
            not found for found in contaminated(texts, sent.value.windows)], SLICE)
    row = "row_" + "_".join(docs.columns)  # longer than any name of the table
    rows = keep(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    bad = accused(rows.select(row, F.col(text_col).alias("text")), blocks, row)
    return rows.join(bad.hint("merge"), row, "left_anti").select(docs.columns)
