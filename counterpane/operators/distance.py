"""Distances between two panels, between given pairs, and warping paths."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import spread
from .batches import column, cubes, matrix
from .blocks import cross_block
from .metrics import LOCK_STEP, Metric, metric as find_metric

BROADCAST_BYTES = 64 << 20  # a panel up to this size may be sent to every task
BLOCK_BYTES = 8 << 20       # series of one block of a block join
BLOCK_ROWS = 512


def panel_size(panel: DataFrame) -> tuple[int, int]:
    """Number of series and the largest number of cells of one."""
    row = panel.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("cells")).first()
    return row["n"], row["cells"] or 1


def panel_bytes(n: int, cells: int) -> int:
    """Size of a panel in memory: its cells and the columns beside them."""
    return n * (8 * cells + 48)


def block_rows(cells: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * cells)))


def _pairs_table(metric: Metric, left: pa.Table | pa.RecordBatch, right: pa.Table) -> Iterator[pa.RecordBatch]:
    left_ids, right_ids = column(left, "left_id"), column(right, "right_id")
    for lw, X in cubes(left):
        for rw, Y in cubes(right):
            step = max(1, (1 << 18) // len(Y))
            for a in range(0, len(X), step):
                dist = cross_block(metric, X[a:a + step], Y)
                ids = left_ids[lw[a:a + step]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, len(Y))), pa.array(np.tile(right_ids[rw], len(ids))),
                     pa.array(dist.ravel())], names=["left_id", "right_id", "dist"])


SCHEMA = "left_id bigint, right_id bigint, dist double"


def distance_join(left: DataFrame, right: DataFrame, metric: str | Metric, *, window: int | None = None,
                  gamma: float = 1.0, sigma: float = 1.0,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every left series against every right one: `left_id, right_id, dist`.

    All pairs are what this operator returns, so the smaller panel should be the right one: below
    `broadcast_bytes` it is sent to the tasks and the left panel stays where it is. Above, both sides are
    cut into blocks of bounded size, each row goes once to every block of the other side, and a task
    compares two blocks.
    """
    m = find_metric(metric, window, gamma, sigma)
    lhs = left.select(F.col("series_id").alias("left_id"), "t_len", "n_ch", "x")
    rhs = right.select(F.col("series_id").alias("right_id"), "t_len", "n_ch", "x")
    n_right, cells = panel_size(right)
    if panel_bytes(n_right, cells) <= broadcast_bytes:
        table = rhs.toArrow()

        def against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _pairs_table(m, batch, table)

        return (lhs if m.name in LOCK_STEP else spread(lhs, "left_id")).mapInArrow(against_all, SCHEMA)

    n_left, left_cells = panel_size(left)
    n_lb, n_rb = ceil(n_left / block_rows(left_cells)), ceil(n_right / block_rows(cells))

    named = ["right_id", "t_len", "n_ch", "x"]

    def two_blocks(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.select([f"r_{c}" for c in named]).rename_columns(named)
        parts = list(_pairs_table(m, a, b)) if a.num_rows and b.num_rows else []
        return pa.Table.from_batches(parts, pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()),
                                                       ("dist", pa.float64())]))

    def side(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).withColumn(
            other, F.col(other).cast("bigint")))

    grid_left = side(lhs, "left_id", "lb", n_lb, "rb", n_rb)
    grid_right = side(rhs, "right_id", "rb", n_rb, "lb", n_lb)
    # names of their own: both panels may stem from one table, and the two sides must not share columns
    grid_right = grid_right.select(*[F.col(c).alias(f"r_{c}") for c in grid_right.columns])
    return (grid_left.groupBy("lb", "rb").cogroup(grid_right.groupBy("r_lb", "r_rb"))
            .applyInArrow(two_blocks, SCHEMA))


def pair_distance(pairs: DataFrame, metric: str | Metric, x: str = "x", y: str = "y", out: str = "dist",
                  x_len: str = "t_len", y_len: str = "t_len", **params) -> DataFrame:
    """Add the distance of two array columns of each row; rows stay in their partition."""
    m = find_metric(metric, **params)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist = np.full(batch.num_rows, np.nan)
            n_ch, t1, t2 = (column(batch, c).astype(np.int64) for c in ("n_ch", x_len, y_len))
            shapes = np.stack([t1, t2, n_ch], axis=1)
            for shape in np.unique(shapes, axis=0) if batch.num_rows else ():
                where = np.flatnonzero((shapes == shape).all(axis=1))
                rows = batch.take(pa.array(where))
                dist[where] = m(matrix(rows.column(x)).reshape(len(where), shape[0], shape[2]),
                                matrix(rows.column(y)).reshape(len(where), shape[1], shape[2]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dist)], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(measure, f"{fields}, `{out}` double")


def cost_cells(pairs: DataFrame, x: str = "x", y: str = "y", y_len: str = "t_len") -> DataFrame:
    """Squared step-to-step distances of each pair: `left_id, right_id, i, j, cost`."""
    n_ch = F.col("n_ch")
    steps = (pairs.select("left_id", "right_id", "n_ch", x, y, y_len,
                          F.explode(F.sequence(F.lit(0), F.col("t_len") - 1)).alias("i"))
             .withColumn("xi", F.slice(x, F.col("i") * n_ch + 1, n_ch))
             .select("left_id", "right_id", "n_ch", "xi", y, "i",
                     F.explode(F.sequence(F.lit(0), F.col(y_len) - 1)).alias("j")))
    yj = F.slice(y, F.col("j") * n_ch + 1, n_ch)
    cost = F.aggregate(F.zip_with("xi", yj, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return steps.select("left_id", "right_id", "i", "j", cost.alias("cost"))


def dtw_path(pairs: DataFrame, window: int | None = None, y_len: str = "t_len") -> DataFrame:
    """Warping path of each pair: `left_id, right_id, pos, i, j, dist`."""
    find_metric("dtw", window)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, c = (column(batch, k) for k in ("t_len", y_len, "n_ch"))
            xs, ys = batch.column("x"), batch.column("y")
            for n, (left, right) in enumerate(zip(column(batch, "left_id"), column(batch, "right_id"))):
                dist, i, j = kernels.dtw_path(xs[n].values.to_numpy().reshape(t1[n], c[n]),
                                              ys[n].values.to_numpy().reshape(t2[n], c[n]), window)
                size = len(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, left)), pa.array(np.full(size, right)),
                     pa.array(np.arange(size, dtype=np.int32)), pa.array(i.astype(np.int32)),
                     pa.array(j.astype(np.int32)), pa.array(np.full(size, dist))],
                    names=["left_id", "right_id", "pos", "i", "j", "dist"])

    return (pairs.select("left_id", "right_id", "n_ch", "x", "y", *dict.fromkeys(["t_len", y_len]))
            .mapInArrow(walk, "left_id bigint, right_id bigint, pos int, i int, j int, dist double"))


def warp_pairs(paths: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The two series stretched along their path: for every path position the steps that meet.

    Equal to multiplying each series with its 0/1 warp matrix; a matrix row is one path row here.
    """
    lhs = left.select(F.col("series_id").alias("left_id"), F.col("x").alias("lx"), "n_ch")
    rhs = right.select(F.col("series_id").alias("right_id"), F.col("x").alias("rx"))
    n_ch = F.col("n_ch")
    return (paths.join(lhs, "left_id").join(rhs, "right_id")
            .select("left_id", "right_id", "pos", "i", "j",
                    F.slice("lx", F.col("i") * n_ch + 1, n_ch).alias("left_step"),
                    F.slice("rx", F.col("j") * n_ch + 1, n_ch).alias("right_step")))


def self_kernel(panel: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Raw alignment kernel of every series with itself, once per series."""
    return (pair_distance(panel.withColumn("y", F.col("x")), "gakraw", sigma=sigma, out="self_kernel").drop("y"))
