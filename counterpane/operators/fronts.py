"""Pareto fronts and ranks per group, all objectives minimised."""

from __future__ import annotations

import logging
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, join_on, scratch_path
from .batches import column
from .running import running_sums

log = logging.getLogger("counterpane")
BLOCK = 4096  # rows of one group compared in one task at a time
POOL = 1 << 16  # rows a task holds while it looks for local fronts
STRONG = 256  # rows of least sums that a large group is sifted with
RANK_LIMIT = 1 << 18  # rows of one group that a task ranks
STRIP_LIMIT = 1 << 21  # different points in a range of one of two objectives: the most that a cell can hold
OWN, COLUMN, ROW, BELOW = range(4)  # where a point of a cell's input comes from


def dominates(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Which rows of A dominate which rows of B: no objective worse, one better."""
    no_worse = np.ones((len(A), len(B)), dtype=bool)
    better = np.zeros((len(A), len(B)), dtype=bool)
    for a, b in zip(A.T, B.T):
        no_worse &= a[:, None] <= b[None, :]
        better |= a[:, None] < b[None, :]
    return no_worse & better


def beaten(targets: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Which targets some rival dominates, in slices of bounded memory."""
    out = np.zeros(len(targets), dtype=bool)
    step = max(1, (1 << 22) // max(1, len(rivals)))
    for a in range(0, len(targets), step):
        out[a:a + step] = dominates(rivals, targets[a:a + step]).any(axis=0)
    return out


def on_front(values: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates: those of the least sums drop most others, one layer settles the rest."""
    good = np.ones(len(values), dtype=bool)
    if len(values) > 512:
        good = ~beaten(values, values[np.argsort(values.sum(axis=1), kind="stable")[:64]])
    rest = np.flatnonzero(good)
    if values.shape[1] > 3:
        good[rest] = ~beaten(values[rest], values[rest])
        return good
    points, place = np.unique(values[rest], axis=0, return_inverse=True)
    layer, free = Layers(values.shape[1] - 1), []
    for point in points[:, 1:].tolist():
        free.append(not layer.beats(0, point))
        if free[-1]:
            layer.add(0, point)
    good[rest] = np.array(free, dtype=bool)[place.ravel()]
    return good


def fronts_in_groups(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which rows are on the front of their group.

    Small groups are compared all at once as one list of pairs, large ones one by one.
    """
    order = np.argsort(groups, kind="stable")
    sorted_groups, columns = groups[order], np.asfortranarray(values[order])
    low = np.searchsorted(sorted_groups, groups, side="left")
    count = np.searchsorted(sorted_groups, groups, side="right") - low
    out = np.ones(len(values), dtype=bool)
    large = count > 256
    for group in np.unique(groups[large]):
        rows = np.flatnonzero(groups == group)
        out[rows] = on_front(values[rows])
    targets = np.asfortranarray(values)
    rows = np.flatnonzero(~large)
    for part in np.array_split(rows, max(1, int(count[rows].sum()) >> 20)):
        n = count[part]
        t = np.repeat(part, n)
        r = np.repeat(low[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        for theirs, mine in zip(columns.T, targets.T):  # fewer pairs are left after every objective
            near = theirs[r] <= mine[t]
            r, t = r[near], t[near]
        out[t[(columns[r] < targets[t]).any(axis=1)]] = False
    return out


class Layers:
    """What has been ranked so far, by rank, as far as it can still decide: `dims` objectives are left open.

    Of one open objective a rank keeps the least value, of two the staircase of its points; more are kept as they are.
    """

    def __init__(self, dims: int) -> None:
        self.dims, self.held = dims, []

    def add(self, rank: int, point: Sequence[float]) -> None:
        while len(self.held) <= rank:
            self.held.append([] if self.dims != 2 else ([], []))
        layer = self.held[rank]
        if self.dims == 0:
            layer[:] = [True]
        elif self.dims == 1:
            layer[:] = [min(layer[0], point[0])] if layer else [point[0]]
        elif self.dims > 2:
            layer.append(point)
        else:
            xs, ys = layer
            x, y = point
            at = bisect_right(xs, x)
            if at and ys[at - 1] <= y:
                return
            first = at - 1 if at and xs[at - 1] == x else at
            end = at
            while end < len(ys) and ys[end] >= y:
                end += 1
            xs[first:end], ys[first:end] = [x], [y]

    def beats(self, rank: int, point: Sequence[float]) -> bool:
        if rank >= len(self.held):
            return False
        layer = self.held[rank]
        if self.dims == 2:
            at = bisect_right(layer[0], point[0])
            return at > 0 and layer[1][at - 1] <= point[1]
        if not layer:
            return False
        if self.dims <= 1:
            return self.dims == 0 or layer[0] <= point[0]
        return any(all(a <= b for a, b in zip(held, point)) for held in layer)

    def __len__(self) -> int:
        return len(self.held)


def place_in_layers(points: Sequence[Sequence[float]], sources: Sequence[tuple[Layers, Sequence[int]]],
                    own: Layers, used: Sequence[int]) -> list[int]:
    """Ranks of different points in lexicographic order, given layers of rows ranked before.

    Whatever has a rank is beaten by rows of all lower ranks, so the first rank that beats a point no more is found by
    bisection. Each source is asked with the objectives that it leaves open.
    """
    every, out = [*sources, (own, used)], []
    for p in points:
        asked = [(layers, [p[k] for k in open_]) for layers, open_ in every if len(layers)]
        low, high = 0, max((len(layers) for layers, _ in asked), default=0)
        while low < high:
            middle = (low + high) // 2
            if any(layers.beats(middle, point) for layers, point in asked):
                low = middle + 1
            else:
                high = middle
        own.add(low, [p[k] for k in used])
        out.append(low)
    return out


def ranks(values: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Front number of every row: the length of the longest chain of rows that beat one another above it.

    In lexicographic order every row comes after all that beat it, so one pass settles each row for good. With
    `enough`, rows behind the first fronts that hold so many rows share one number.
    """
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    rows, open_ = [tuple(v) for v in values.tolist()], range(1, values.shape[1])
    points = sorted(set(rows))
    placed = dict(zip(points, place_in_layers(points, [], Layers(len(open_)), open_)))
    rank = np.array([placed[p] for p in rows], dtype=np.int64)
    if enough is not None:
        behind = int(np.searchsorted(np.cumsum(np.bincount(rank)), enough)) + 1
        rank = np.minimum(rank, behind)
    return rank


def chain_ranks(values: np.ndarray, order: Sequence[int], base: np.ndarray) -> np.ndarray:
    """Front numbers of different points of two objectives, none below its `base` (what rows ranked before make of it).

    In lexicographic order by `order` the least second value of each rank decides. From its base upwards only the own points
    can beat a point, and if one of a rank does, so does one of every rank between; so a bisection finds the first that does not.
    """
    rank = np.empty(len(values), dtype=np.int64)
    if not len(values):
        return rank
    first, second = (values[:, k] for k in order)
    rows = np.lexsort([second, first])
    code = np.unique(second, return_inverse=True)[1].ravel()
    least = [len(values)] * (int(base.max()) + 1)  # of every rank; greater than all codes where there is no point yet
    for part in _parts(rows):
        out = []
        for value, low in zip(code[part].tolist(), base[part].tolist()):
            at = bisect_right(least, value, low)
            if at == len(least):
                least.append(value)
            else:
                least[at] = value
            out.append(at)
        rank[part] = out
    return rank


def _above(known: np.ndarray, ranks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least rank that rows with a `known` value, and otherwise less, leave to points with these values."""
    order = np.argsort(known, kind="stable")
    best = np.concatenate([[0], np.maximum.accumulate(ranks[order] + 1)])
    return best[np.searchsorted(known[order], values, side="right")]


def _group_codes(table: pa.Table | pa.RecordBatch, groups: Sequence[str]) -> np.ndarray:
    """A number per distinct group of a table."""
    code = np.zeros(table.num_rows, dtype=np.int64)
    for name in groups:
        values = table.column(name)
        coded = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.unify_dictionaries().combine_chunks()
        code = code * (len(coded.dictionary) + 1) + coded.indices.fill_null(len(coded.dictionary)).to_numpy(
            zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def _slices(code: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(code, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ()


def _values(table: pa.Table | pa.RecordBatch, objectives: Sequence[str]) -> np.ndarray:
    return np.stack([column(table, name).astype(np.float64) for name in objectives], axis=1)


def _local_fronts(df: DataFrame, groups: Sequence[str], objectives: Sequence[str]) -> DataFrame:
    """Drop what is dominated inside the own task, before anything is shuffled.

    A task compares a bounded pool of rows and carries the survivors along while they are few.
    """
    def front(table: pa.Table) -> pa.Table:
        values, code = _values(table, objectives), _group_codes(table, groups)
        return table.filter(pa.array(fronts_in_groups(values, code)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= POOL:
                table = front(pa.Table.from_batches(held))
                held = table.to_batches()
                if table.num_rows > POOL // 2:
                    yield from held
                    held = []
        if held:
            yield from front(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(keep, df.schema)


def _bucket_count(rows: int) -> int:
    return max(1, ceil(rows / BLOCK))


@dataclass
class _Split:
    """Rows of groups up to a limit and their number, rows of larger groups, the number of rows of the largest one."""

    small: DataFrame | None
    small_rows: int
    large: DataFrame | None
    most: int


def _split(rows: DataFrame, groups: Sequence[str], limit: int) -> _Split:
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_rows"))
    found = sizes.agg(F.max("_rows").alias("most"),
                      F.sum(F.when(F.col("_rows") <= limit, F.col("_rows"))).alias("small")).first()
    most, small = found["most"] or 0, found["small"] or 0
    if most <= limit:
        return _Split(rows, small, None, most)
    if not groups:
        return _Split(None, 0, rows, most)
    sized = join_on(rows, sizes, groups)
    return _Split(sized.where(F.col("_rows") <= limit).drop("_rows"), small,
                  sized.where(F.col("_rows") > limit).drop("_rows"), most)


def _in_buckets(part: _Split, groups: Sequence[str], work: Callable[[pa.Table], pa.Table], schema: T.StructType) -> list[DataFrame]:
    """The small groups, whole and many of them per task; nothing if there are none."""
    if part.small is None:
        return []
    rows, n = part.small, _bucket_count(part.small_rows)
    bucket = F.pmod(F.xxhash64(*groups), F.lit(n)) if groups else F.lit(0)
    return [rows.withColumn("_bucket", bucket).groupBy("_bucket").applyInArrow(work, schema)]


def _sift(rows: DataFrame, groups: Sequence[str], objectives: Sequence[str], row_id: str, strong: int, times: int) -> DataFrame:
    """Leave out rows that at least `times` of their group's `strong` rows with the least sums dominate.

    A group's rows are compared in blocks, each of which gets the strong rows, so that nothing grows with the group.
    """
    order = Window.partitionBy(*groups).orderBy(sum(F.col(f) for f in objectives), *objectives, row_id)
    best = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= strong).drop("_n")
    sizes = rows.groupBy(*groups).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    placed = (join_on(rows, sizes, groups).withColumn("_block", F.pmod(F.xxhash64(row_id), F.col("_blocks")).cast("int"))
              .drop("_blocks"))
    rivals = (join_on(best, sizes, groups).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
              .drop("_blocks"))
    rivals = rivals.select(*[F.col(c).alias(f"r_{c}") for c in rivals.columns])
    kept, keys = list(rows.columns), [*groups, "_block"]

    def left(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.select(kept)
        if not a.num_rows or not b.num_rows:
            return a
        mine, theirs = _values(a, objectives), _values(b, [f"r_{f}" for f in objectives])
        hits = np.concatenate([dominates(theirs, part).sum(axis=0) for part in np.array_split(mine, max(1, len(mine) >> 10))])
        return a.filter(pa.array(hits < times))

    return (placed.groupBy(*keys).cogroup(rivals.groupBy(*[f"r_{k}" for k in keys])).applyInArrow(left, rows.schema))


def corner_blocks(rows: DataFrame, groups: Sequence[str], objectives: Sequence[str], row_id: str, most: int) -> DataFrame:
    """Add `_place` and `_block`: blocks of at most BLOCK rows that are compact in the first two objectives.

    Strips by the first objective, blocks by the second inside a strip, both from running numbers over range partitions.
    """
    wide = BLOCK * max(1, round((most / BLOCK) ** 0.5))
    order = [*objectives, row_id]
    strips = running_sums(rows, groups, order, _place=F.lit(1))
    strips = strips.withColumn("_strip", F.floor((F.col("_place") - 1) / wide)).drop("_place")
    placed = running_sums(strips, groups, ["_strip", *order[1:], order[0]], _place=F.lit(1))
    return placed.withColumn("_block", F.floor((F.col("_place") - 1) / BLOCK).cast("int")).drop("_strip")


def corner_pairs(placed: DataFrame, groups: Sequence[str], objectives: Sequence[str]) -> DataFrame:
    """Pairs of blocks `groups, target, rival` in which some rival row may dominate a target row.

    The least corner of the rival's block must not exceed the largest corner of the target's. One row per block takes part.
    """
    corners = placed.groupBy(*groups, "_block").agg(
        *[F.min(f).alias(f"_low{k}") for k, f in enumerate(objectives)],
        *[F.max(f).alias(f"_high{k}") for k, f in enumerate(objectives)])
    a, b = corners.alias("a"), corners.alias("b")
    may = F.lit(True)
    for k in range(len(objectives)):
        may = may & (F.col(f"a._low{k}") <= F.col(f"b._high{k}"))
    for g in groups:
        may = may & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return a.join(b, may).select(*[F.col(f"b.{g}").alias(g) for g in groups], F.col("b._block").alias("target"),
                                 F.col("a._block").alias("rival"))


def _large_fronts(rows: DataFrame, groups: Sequence[str], objectives: Sequence[str], row_id: str, most: int) -> DataFrame:
    """Fronts of groups that fit no task: compact blocks, compared where their corners allow it."""
    placed = cut(corner_blocks(rows, groups, objectives, row_id, most))
    pairs = cut(corner_pairs(placed, groups, objectives))
    log.info("front: %d block pairs met of %d blocks", pairs.count(), placed.select(*groups, "_block").distinct().count())
    targets = join_on(placed, pairs.withColumnRenamed("target", "_block"), [*groups, "_block"]).withColumnRenamed("rival", "_rival")
    rivals = (join_on(placed, pairs.withColumnRenamed("rival", "_block"), [*groups, "_block"])
              .select(*[F.col(g).alias(f"r_{g}") for g in groups], F.col("target").alias("r__block"),
                      F.col("_block").alias("r__rival"), *[F.col(f).alias(f"r_{f}") for f in objectives]))
    schema = T.StructType([*[rows.schema[g] for g in groups], T.StructField("_place", T.LongType())])

    def lost(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [*groups, "_place"]
        if not a.num_rows or not b.num_rows:
            return a.slice(0, 0).select(names)
        return a.filter(pa.array(beaten(_values(a, objectives), _values(b, [f"r_{f}" for f in objectives])))).select(names)

    keys = [*groups, "_block", "_rival"]
    gone = (targets.groupBy(*keys).cogroup(rivals.groupBy(*[f"r_{k}" for k in keys])).applyInArrow(lost, schema).distinct())
    return join_on(placed, gone, [*groups, "_place"], "left_anti").select(rows.columns)


def pareto_front(df: DataFrame, groups: Sequence[str], objectives: Sequence[str], row_id: str) -> DataFrame:
    """Rows no other row of their group dominates; equal rows all stay.

    Local fronts come first, written out because all later steps read them. What they leave of groups that fit a task
    meets there, many groups at once. Larger groups are sifted with their strong rows, then compared block by block.
    """
    groups = list(groups)
    local = cut(_local_fronts(df.select(*groups, row_id, *objectives), groups, objectives))
    kept = list(local.columns)

    def front(table: pa.Table) -> pa.Table:
        table = table.select(kept)
        values, code = _values(table, objectives), _group_codes(table, groups)
        return table.filter(pa.array(fronts_in_groups(values, code)))

    part = _split(local, groups, BLOCK)
    fronts = _in_buckets(part, groups, front, local.schema)
    if part.large is not None:
        part = _split(cut(_sift(part.large, groups, objectives, row_id, STRONG, 1)), groups, BLOCK)
        fronts += _in_buckets(part, groups, front, local.schema)
        if part.large is not None:
            fronts.append(_large_fronts(part.large, groups, objectives, row_id, part.most))
    return reduce(DataFrame.unionByName, fronts)


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    """Positions in parts that are turned to lists one at a time."""
    return np.array_split(rows, max(1, ceil(len(rows) / POOL)))


def _grid_ranks(points: DataFrame, groups: Sequence[str], objectives: Sequence[str], limit: int, most: int,
                gap: bool) -> DataFrame:
    """Front numbers of the different points of groups that fit no task.

    Two objectives cut a group into a grid of ranges; a cell depends on the cells below and to the left of it, so the cells
    of a diagonal are ranked together, and there are as many rounds as diagonals, whatever the number of fronts. A cell is
    given what was ranked before as layers: of its own column and row with one objective settled, of all cells below both
    with two (there only the least values of the rest by rank). Of two objectives all layers are such least values, so a cell
    reads its own points and a few rows for each rank (all ranked points of its lines if some objective is no number: `gap`).
    The points are written by diagonal, so that a round reads its own only.
    """
    objectives = list(objectives)
    wide = points.agg(*[F.approx_count_distinct(f).alias(f) for f in objectives]).first()
    told_least = len(objectives) <= 2 and not gap  # what is no number takes its place in a layer as it comes
    in_plane = told_least and len(objectives) == 2
    axes = sorted(sorted(range(len(objectives)), key=lambda k: -wide[objectives[k]])[:2])
    a, b = axes if len(axes) > 1 else (axes[0], axes[0])
    sides = max(2, ceil(most / limit))
    shares = F.array(*[F.lit(k / sides) for k in range(1, sides)])
    cuts = points.groupBy(*groups).agg(F.percentile_approx(objectives[a], shares, F.lit(10_000)).alias("_cut_a"),
                                       F.percentile_approx(objectives[b], shares, F.lit(10_000)).alias("_cut_b"))

    def range_of(cut_points: str, f: str) -> Column:
        return F.size(F.filter(cut_points, lambda c: c < F.col(f))).cast("int")

    path = scratch_path(points.sparkSession, "cells")
    (join_on(points, cuts, groups).withColumn("_a", range_of("_cut_a", objectives[a]))
     .withColumn("_b", range_of("_cut_b", objectives[b]) if a != b else F.lit(0))
     .select(*groups, *objectives, "_a", "_b", (F.col("_a") + F.col("_b")).alias("_step"))
     .repartition(*groups, "_a", "_b").write.partitionBy("_step").parquet(path))
    placed = points.sparkSession.read.parquet(path)
    every_cell = cut(placed.groupBy("_step", *groups, "_a", "_b").agg(F.count("*").alias("_rows")))
    steps = sorted(r[0] for r in every_cell.select("_step").distinct().collect())
    rest = [k for k in range(len(objectives)) if k not in (a, b)]
    open_own = [k for k in range(len(objectives)) if k != a]
    open_column = [k for k in range(len(objectives)) if k != b] if a != b else []
    open_ = {OWN: open_own, COLUMN: open_column, ROW: open_own, BELOW: rest}
    cell = [*groups, "_a", "_b"]
    schema = T.StructType([*[placed.schema[g] for g in groups], *[T.StructField(f, T.DoubleType()) for f in objectives],
                           T.StructField("_a", T.IntegerType()), T.StructField("_b", T.IntegerType()),
                           T.StructField("rank", T.IntegerType())])
    names = [*groups, *objectives, "_a", "_b"]

    def answer(table: pa.Table, own: np.ndarray, rank: np.ndarray) -> pa.Table:
        return table.take(pa.array(own)).select(names).append_column("rank", pa.array(rank.astype(np.int32))).cast(
            pa.schema([table.schema.field(g) for g in groups] + [pa.field(f, pa.float64()) for f in objectives]
                      + [pa.field(n, pa.int32()) for n in ("_a", "_b", "rank")]))

    def rank_cell_of_plane(table: pa.Table) -> pa.Table:
        kind, values = column(table, "_kind"), _values(table, objectives)
        own, given = np.flatnonzero(kind == OWN), column(table, "rank")
        base = np.zeros(len(own), dtype=np.int64)
        for k, axis in ((COLUMN, a), (ROW, b)):
            rows = np.flatnonzero(kind == k)
            if len(rows):
                base = np.maximum(base, _above(values[rows, axis], given[rows].astype(np.int64), values[own, axis]))
        rows = np.flatnonzero(kind == BELOW)
        if len(rows):
            base = np.maximum(base, int(given[rows].max()) + 1)
        return answer(table, own, chain_ranks(values[own], (a, b), base))

    def rank_cell(table: pa.Table) -> pa.Table:
        kind, values = column(table, "_kind"), _values(table, objectives)
        order = [a, *open_own]
        layers = {k: Layers(len(o)) for k, o in open_.items()}
        earlier = np.flatnonzero(kind != OWN)
        given = column(table, "rank")
        for part in _parts(earlier):
            for k, p, r in zip(kind[part].tolist(), values[part].tolist(), given[part].tolist()):
                layers[k].add(int(r), [p[j] for j in open_[k]])
        own = np.flatnonzero(kind == OWN)
        own = own[np.lexsort([values[own, j] for j in reversed(order)])]
        told = [(layers[k], open_[k]) for k in (COLUMN, ROW, BELOW)]
        rank = np.concatenate([np.array(place_in_layers(values[part].tolist(), told, layers[OWN], open_own), dtype=np.int32)
                               for part in _parts(own)])
        return answer(table, own, rank)

    least = [F.min(f).alias(f) for f in objectives]
    done: DataFrame | None = None
    known: DataFrame | None = None  # what later cells are told
    for turn, step in enumerate(steps):
        now = placed.where(F.col("_step") == step)
        parts = [now.select(*names, F.lit(OWN).alias("_kind"), F.lit(None).cast("int").alias("rank"))]
        if known is not None:
            cells = every_cell.where(F.col("_step") == step).select(*groups, F.col("_a").alias("_to_a"), F.col("_b").alias("_to_b"))
            met = join_on(known, F.broadcast(cells), groups).where((F.col("_a") <= F.col("_to_a")) & (F.col("_b") <= F.col("_to_b")))
            kind = F.when(F.col("_a") == F.col("_to_a"), F.lit(COLUMN)).when(F.col("_b") == F.col("_to_b"), F.lit(ROW)).otherwise(F.lit(BELOW))
            met = met.withColumn("_kind", kind).drop("_a", "_b").withColumnsRenamed({"_to_a": "_a", "_to_b": "_b"})
            lines = met.where(F.col("_kind") != BELOW)
            below = met.where(F.col("_kind") == BELOW)
            if told_least:
                lines = lines.groupBy(*cell, "_kind", "rank").agg(*least)
            if in_plane:  # beaten by all of them, so the largest rank will do
                below = below.groupBy(*cell, "_kind").agg(F.max("rank").alias("rank"), *least)
            elif len(rest) < 2:
                below = below.groupBy(*cell, "_kind", "rank").agg(*least)
            parts += [lines.select(*names, "_kind", "rank"), below.select(*names, "_kind", "rank")]
        found = cut(reduce(DataFrame.unionByName, parts).groupBy(*cell).applyInArrow(rank_cell_of_plane if in_plane else rank_cell, schema))
        done = found if done is None else done.unionByName(found)
        # with one objective left open, the least values of a cell by rank are all that others need
        told = cut(found.groupBy(*cell, "rank").agg(*least)) if told_least else found
        known = told if known is None else known.unionByName(told)
        if told_least and turn % 16 == 15:
            known = cut(known)
    return done.select(*groups, *objectives, "rank")


def _plane_ranks(points: DataFrame, groups: Sequence[str], objectives: Sequence[str], limit: int, strip: int) -> DataFrame:
    """Front numbers of the different points of two objectives: groups up to a limit whole, others on the grid."""
    schema = T.StructType([*points.schema.fields, T.StructField("rank", T.IntegerType())])
    kept = list(points.columns)

    def rank_bucket(table: pa.Table) -> pa.Table:
        values, rank = _values(table, objectives), np.zeros(table.num_rows, dtype=np.int32)
        for rows in _slices(_group_codes(table, groups)):
            rank[rows] = chain_ranks(values[rows], (0, 1), np.zeros(len(rows), dtype=np.int64))
        return table.select(kept).append_column("rank", pa.array(rank))

    part = _split(points, groups, limit)
    out = _in_buckets(part, groups, rank_bucket, schema)
    if part.large is not None:
        out.append(_grid_ranks(part.large, groups, objectives, strip, part.most, False))
    return reduce(DataFrame.unionByName, out)


def pareto_rank(df: DataFrame, groups: Sequence[str], objectives: Sequence[str], row_id: str,
                group_limit: int | None = None, enough: int | None = None) -> DataFrame:
    """Front number of every row in its group: `groups, row_id, objectives, rank`.

    Groups up to `group_limit` rows are ranked whole, many groups per task, in one pass. The different points of larger
    groups are ranked on a grid of ranges and joined back to the rows; of two objectives without gaps the different points
    decide whether a grid is needed, and its ranges hold up to STRIP_LIMIT of them. With `enough` only the first fronts that hold so many
    rows are asked for: rows that so many others of a large group dominate are left out before anything is ranked.
    """
    groups = list(groups)
    data = df.select(*groups, row_id, *objectives)
    schema = T.StructType(data.schema.fields + [T.StructField("rank", T.IntegerType())])
    kept = list(data.columns)

    def rank_bucket(table: pa.Table) -> pa.Table:
        values, rank = _values(table, objectives), np.zeros(table.num_rows, dtype=np.int32)
        for rows in _slices(_group_codes(table, groups)):
            rank[rows] = ranks(values[rows])
        return table.select(kept).append_column("rank", pa.array(rank))

    out = []
    if enough is not None:
        part = _split(data, groups, max(BLOCK, 4 * enough))
        out += _in_buckets(part, groups, rank_bucket, schema)
        data = None if part.large is None else cut(_sift(part.large, groups, objectives, row_id, 4 * enough, enough))
    if data is not None:
        limit = group_limit or RANK_LIMIT
        part = _split(data, groups, limit)
        out += _in_buckets(part, groups, rank_bucket, schema)
        large, most = part.large, part.most
        if large is not None:
            points = cut(large.select(*groups, *[F.col(f).cast("double").alias(f) for f in objectives]).distinct())
            holes = reduce(lambda p, q: p | q, (F.col(f).isNull() | F.isnan(f) for f in objectives))
            gap = bool(points.agg(F.max(holes)).first()[0])
            if len(objectives) == 2 and not gap:
                found = _plane_ranks(points, groups, objectives, limit, group_limit or STRIP_LIMIT)
            else:
                found = _grid_ranks(points, groups, objectives, limit, most, gap)
            exact = large.withColumns({f"_{f}": F.col(f).cast("double") for f in objectives})
            found = found.withColumnsRenamed({f: f"_{f}" for f in objectives})
            out.append(join_on(exact, found, [*groups, *[f"_{f}" for f in objectives]]).select(*kept, "rank"))
    return reduce(DataFrame.unionByName, out)


def feasible_front(df: DataFrame, groups: Sequence[str], objectives: Sequence[str], row_id: str,
                   g: str = "g") -> DataFrame:
    """Front among the rows that meet the constraint; a group without such rows gives nothing."""
    return pareto_front(df.where(F.col(g) <= 0), groups, objectives, row_id)
