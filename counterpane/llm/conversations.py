"""Conversation structure repair: a generalised LR parse that may delete, rerole and insert turns.

The role grammar is `Talk -> Body | nothing`, `Body -> Head u a`, `Head -> s | nothing | Body`: an optional system turn,
then user and assistant in turn. Its parse stacks are few (`STACKS`), so the graph-structured stack holds one top per
stack and equal tops merge by the least (cost, audit). Audits of two tops hold as many edits of rows and end with one, so
neither begins with the other: their order never changes by what follows, and a rank per top stands for the whole text
of its audit. What a row adds to a top is one number, so a conversation of any length costs four bytes a row.

A conversation's rows reach one task in order, as a stream: first narrow rows without texts, which decide all edits, then
the rows with their texts, to which the edits are applied on the fly. One shuffle and one external sort serve both, and
nothing of a conversation is gathered but the edits themselves. Repeats are found by an aggregation beforehand
(first turn of each role and text, combined before the shuffle) whose rows are merged into the stream.

Defined results: a null role, text or id counts as one space, a null turn comes first; rows of one turn are taken in the
order of the digest of role and text, so rows that are alike in all columns follow one another and order does not depend
on files; equal roles and texts are recognised by SHA-256. A null `conv_id` is one conversation. A conversation without
rows gives zeros, an empty audit and the hash of an empty text; an empty table gives an empty table; other columns are
ignored. A turn after any number of earlier ones, very long texts and empty roles are rows like others: a role that
begins with none of s, u, a can only be deleted or given another role.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The role grammar and what edits cost: fixed values.
RULES = [("Head", ("s",)), ("Head", ("Body",)), ("Body", ("Head", "u", "a"))]  # and Head -> nothing, before a first u
ACCEPTED = ((), ("Body",))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
SPACES = " \t\n\x0b\x0c\r"

INITIALS = "sua?"
FAULT_NONE, FAULT_BLANK, FAULT_TRUNCATED = 0, 1, 2
_CONV, _NARROW, _TEXT = 0, 1, 2


def shift(stack: tuple[str, ...], role: str) -> tuple[str, ...] | None:
    """The stack after one more role: reductions that it calls for, the shift, then those that need no further look."""
    if role == "u" and stack == ():
        stack = ("Head",)
    elif role == "u" and stack == ("Body",):
        stack = ("Head",)
    elif not any(right[:len(stack) + 1] == (*stack, role) for _, right in RULES):
        return None
    stack = (*stack, role)
    if not any(right[:len(stack)] == stack for _, right in RULES):
        return None
    whole = [left for left, right in RULES if right == stack]
    return (whole[0],) if whole else stack


def _all_stacks() -> list[tuple[str, ...]]:
    found = [()]
    for stack in found:
        found += [s for s in (shift(stack, r) for r in "sua") if s is not None and s not in found]
    return found


STACKS = _all_stacks()
_NUMBER = {s: i for i, s in enumerate(STACKS)}


def _inserted(stack: tuple[str, ...]) -> Iterator[tuple[int, tuple[str, ...]]]:
    """Stacks that inserted turns lead to, with their number; more of them than there are stacks never pay."""
    for n in range(len(STACKS)):
        yield n, stack
        stack = next(s for s in (shift(stack, r) for r in "ua") if s is not None)


def _moves(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, str, int]]:
    """The cheapest ways of each top over one row: (top before, top after, letters, cost)."""
    extra = TRUNCATED if truncated else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STACKS:
        for n, stack in _inserted(start):
            ways = [("D", stack, DELETE)]
            if not must_go:
                kept = shift(stack, initial)
                ways += [("K", kept, extra)] if kept is not None else []
                ways += [("R", s, REROLE + extra) for s in (shift(stack, r) for r in "ua") if s is not None]
            for letter, after, cost in ways:
                key, value = (_NUMBER[start], _NUMBER[after]), (n * INSERT + cost, "I" * n + letter)
                best[key] = min(best.get(key, value), value)
    return [(a, b, letters, cost) for (a, b), (cost, letters) in sorted(best.items())]


#: Moves by row kind: 8 * initial + 2 * truncated + must go. The number of a move in its list is what a row records.
MOVES = [_moves(INITIALS[k // 4], bool(k % 2), bool(k // 2 % 2)) for k in range(16)]


class Talk:
    """The parse of one conversation, row by row."""

    def __init__(self) -> None:
        self.tops: dict[int, tuple[int, int]] = {0: (0, 0)}  # stack number -> (cost, rank of its audit)
        self.kinds = bytearray()
        self.back = bytearray()  # per row and stack the number of the move that led there

    def read(self, kind: int) -> None:
        best: dict[int, tuple] = {}
        for number, (a, b, letters, cost) in enumerate(MOVES[kind]):
            top = self.tops.get(a)
            if top is not None:
                value = (top[0] + cost, top[1], letters, number)
                if b not in best or value < best[b]:
                    best[b] = value
        order = sorted({(v[1], v[2]) for v in best.values()})
        ranks = {pair: i for i, pair in enumerate(order)}
        self.tops = {b: (v[0], ranks[v[1], v[2]]) for b, v in best.items()}
        self.kinds.append(kind)
        self.back += bytes(best[b][3] if b in best else 255 for b in range(len(STACKS)))

    def finish(self) -> tuple[int, str]:
        """Cost and audit of the best repair."""
        ends = []
        for number, (cost, rank) in self.tops.items():
            ends += [(cost + n * INSERT, rank, "I" * n, number) for n, stack in _inserted(STACKS[number])
                     if stack in ACCEPTED]
        cost, _, tail, top = min(ends)
        parts, width = [tail], len(STACKS)
        for row in range(len(self.kinds) - 1, -1, -1):
            top, _, letters, _ = MOVES[self.kinds[row]][self.back[row * width + top]]
            parts.append(letters)
        return cost, "".join(reversed(parts))


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Fault injection for tests and measurements: rows are dropped, emptied, cut short, doubled or given to the user.

    What happens to a row is the crc32 of `conv_id:turn` modulo 20 (0 to 4, others stay). Returns `conv_id, turn, role, text`.
    """
    fault = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                _spaced("role").alias("role"), _spaced("text").alias("text"), fault.alias("fault"))
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.where(F.col("fault") != 0).withColumn("copy", F.explode(copies))
            .select("conv_id", "turn", role.alias("role"), text.alias("text")))


def _digest() -> Column:
    """SHA-256 of role and text; the length of the role keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _stream(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Everything about a conversation in one partition and in order: itself, its narrow rows, its texts.

    A narrow row that is the first of its role and text is preceded by a mark (`kind` is null).
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (F.when(body == "", F.lit(FAULT_BLANK))
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), F.lit(FAULT_TRUNCATED)).otherwise(F.lit(FAULT_NONE)))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS[:3]))
    initial = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3)
    named = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        _spaced("role").alias("role"), _spaced("text").alias("text")).withColumn("digest", _digest())
    none = [F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("text", "string"))]
    narrow = named.select("conv_id", F.lit(_NARROW).alias("part"), "turn", "digest",
                          (4 * initial + fault).cast("int").alias("kind"), *none)
    firsts = (named.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"))
              .select("conv_id", F.lit(_NARROW).alias("part"), "first.turn", "digest",
                      F.lit(None).cast("int").alias("kind"), *none))
    texts = named.select("conv_id", F.lit(_TEXT).alias("part"), "turn", "digest", F.lit(0).alias("kind"), "role", "text")
    whole = originals.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().select(
        "conv_id", F.lit(_CONV).alias("part"), F.lit(None).cast("bigint").alias("turn"),
        F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"), *none)
    order = ["conv_id", "part", "turn", "digest", "kind"]
    return (whole.unionByName(narrow).unionByName(firsts).unionByName(texts)
            .repartition("conv_id").sortWithinPartitions(*order).select(*order, "role", "text"))


class _Case:
    """What is known of the conversation whose rows are passing."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.talk = conv_id, Talk()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.mark = self.before = None
        self.audit: str | None = None
        self.cost = self.at = self.position = 0
        self.stack: tuple[str, ...] = ()

    def narrow(self, turn: int | None, digest: bytes, kind: int | None) -> None:
        if kind is None:
            self.mark = digest
            return
        fresh, self.mark = self.mark == digest, None
        initial, fault = divmod(kind, 4)
        must_go = truncated = False
        if fault == FAULT_BLANK:
            self.blank, must_go = self.blank + 1, True
        elif not fresh:
            self.duplicate, must_go = self.duplicate + 1, True
        elif fault == FAULT_TRUNCATED:
            self.truncated, truncated = self.truncated + 1, True
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        now = INITIALS[initial]
        self.illegal += self.before is not None and (self.before, now) not in LEGAL
        self.before = now
        self.talk.read(4 * initial + 2 * truncated + must_go)

    def decide(self) -> None:
        if self.audit is None:
            (self.cost, self.audit), self.talk = self.talk.finish(), None

    def _put(self, role: str, text: str, edit: str) -> tuple:
        self.stack = shift(self.stack, role[:1])
        self.position += 1
        return self.conv_id, self.position - 1, edit, role, text

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put(self._forced(), "", "I")

    def _forced(self) -> str:
        return ROLES["a" if shift(self.stack, "a") is not None else "u"]

    def row(self, role: str, text: str) -> Iterator[tuple]:
        """The repaired turns up to and with this row; a deleted one gives none."""
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self._put(role if edit == "K" else self._forced(), text, edit)

    def summary(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Case, list[tuple], bool]]:
    """The conversations of a sorted partition with their repaired turns as these come up; last of all, its end."""
    case = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few texts are Python objects at a time
            columns = [c.to_pylist() for c in batch.slice(at, 256).columns]
            for conv_id, part, turn, digest, kind, role, text in zip(*columns):
                if part == _CONV or case is None:
                    if case is not None:
                        case.decide()
                        yield case, list(case.inserts()), True
                    case = _Case(conv_id)
                elif part == _NARROW:
                    case.narrow(turn, digest, kind)
                else:
                    case.decide()
                    yield case, list(case.row(role, text)), False
    if case is not None:
        case.decide()
        yield case, list(case.inserts()), True


SUMMARY = [("conv_id", "bigint"), ("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"),
           ("illegal", "bigint"), ("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string")]
TURNS = [("conv_id", "bigint"), ("position", "bigint"), ("edit", "string"), ("role", "string"), ("text", "string")]
_BATCH = 512
_ARROW = {"bigint": pa.int64(), "string": pa.string()}


def _as_batches(rows: Iterator[tuple], fields: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*held), fields)],
                                          names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= _BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _schema(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns of all repaired conversations: `conv_id, position, edit` (K, R or I), `role, text`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _as_batches((turn for _, turns, _ in _cases(batches) for turn in turns), TURNS)

    return _stream(rows, rows).mapInArrow(run, _schema(TURNS))


def repair_report(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, what the cheapest repair costs, its edits and the digest of its result.

    `originals` names conversations that must appear even where no row of theirs is left.
    """
    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        digest, first = hashlib.sha256(), True
        for case, turns, last in _cases(batches):
            for _, _, _, role, text in turns:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if last:
                yield *case.summary(), digest.hexdigest()
                digest, first = hashlib.sha256(), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _as_batches(reports(batches), SUMMARY)

    return _stream(rows, rows if originals is None else originals).mapInArrow(run, _schema(SUMMARY))
