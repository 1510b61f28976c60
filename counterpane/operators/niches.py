"""Normalisation, reference directions, niches and environmental selection per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import violation
from ..functions.draws import SALT_NICHE, SALT_PICK, draw
from ..session import cut, join_on
from .batches import column, matrix
from .fronts import pareto_rank

# Fixed values of the normalisation and the niche distances.
OTHER_AXIS_WEIGHT = 1e6
SMALLEST_COEFFICIENT = 1e-14
SMALLEST_RANGE = 1e-12
SMALLEST_DIRECTION = 1e-14
DISTANCE_DIGITS = 12  # niche distances are compared at this precision, so mirror images tie exactly
MAX_DIRECTIONS = 100_000


def direction_list(n_dim: int, n_partitions: int) -> list[list[float]]:
    """All points with coordinates `i / p` that sum to 1, in lexicographic order."""
    if n_dim < 1 or n_partitions < 0:
        raise ValueError(f"need n_dim >= 1 and n_partitions >= 0, got {n_dim} and {n_partitions}")
    if n_dim == 1:
        return [[1.0]]
    if n_partitions == 0:
        return [[1.0 / n_dim] * n_dim]
    if comb(n_dim + n_partitions - 1, n_partitions) > MAX_DIRECTIONS:
        raise ValueError("too many reference directions")
    places = n_partitions + n_dim - 1
    points = []
    for bars in combinations(range(places), n_dim - 1):  # stars and bars
        edges = (-1, *bars, places)
        points.append([(edges[i + 1] - edges[i] - 1) / n_partitions for i in range(n_dim)])
    return sorted(points)


def reference_directions(spark: SparkSession, n_dim: int, n_partitions: int) -> DataFrame:
    """The directions as a table `dir_id, w`."""
    return spark.createDataFrame(list(enumerate(direction_list(n_dim, n_partitions))), "dir_id int, w array<double>")


def penalise(df: DataFrame, groups: Sequence[str], objectives: Sequence[str], g: str = "g") -> DataFrame:
    """Put infeasible rows behind the worst feasible value of every objective, ordered by their violation.

    The worst values come from an aggregation and are joined back, so a large group is not gathered.
    """
    groups, cv = list(groups), violation(g)
    feasible = F.col(g) <= 0
    worst = df.groupBy(*groups).agg(*[
        F.coalesce(F.max(F.when(feasible, F.col(f))), F.max(f)).alias(f"worst_{f}") for f in objectives])
    keep = [c for c in df.columns if c not in objectives]
    return (join_on(df, worst, groups)
            .select(*keep, *[F.when(feasible, F.col(f)).otherwise(F.col(f"worst_{f}") + cv).alias(f)
                             for f in objectives]))


def ideal_point(df: DataFrame, groups: Sequence[str], objectives: Sequence[str]) -> DataFrame:
    """Smallest value of every objective per group: `groups, ideal`."""
    return df.groupBy(*groups).agg(F.array(*[F.min(f) for f in objectives]).alias("ideal"))


def _axis_score(objectives: Sequence[str], axis: int) -> Column:
    scaled = [(F.col(f) - F.get("ideal", F.lit(k))) * (1.0 if k == axis else OTHER_AXIS_WEIGHT)
              for k, f in enumerate(objectives)]
    return F.greatest(*scaled) if len(scaled) > 1 else scaled[0]


def _extremes(objectives: Sequence[str], row_id: str) -> Column:
    """Aggregate: per axis the front row nearest to it."""
    point = F.struct(F.col(row_id), F.array(*objectives).alias("f"))
    return F.array(*[F.min_by(point, F.struct(_axis_score(objectives, j), F.col(row_id)))
                     for j in range(len(objectives))])


def extreme_points(front: DataFrame, ideal: DataFrame, groups: Sequence[str], objectives: Sequence[str],
                   row_id: str) -> DataFrame:
    """Per group and axis the front row nearest to that axis, first row on ties: `groups, axis, row_id, f`."""
    groups = list(groups)
    best = join_on(front, ideal, groups).groupBy(*groups).agg(_extremes(objectives, row_id).alias("found"))
    return (best.select(*groups, F.posexplode("found").alias("axis", "p"))
            .select(*groups, "axis", f"p.{row_id}", "p.f"))


def _plane(rows: Column, n_dim: int) -> Column:
    """Coefficients of the plane through 2 or 3 points, by determinants; null if they span none."""
    e = [[F.get(F.get(rows, F.lit(i)), F.lit(k)) for k in range(n_dim)] for i in range(n_dim)]

    def det(m):
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return m[0][0] * m[1][1] - m[0][1] * m[1][0]
        return (m[0][0] * det([r[1:] for r in m[1:]]) - m[0][1] * det([[r[0], r[2]] for r in m[1:]])
                + m[0][2] * det([r[:2] for r in m[1:]]))

    whole = det(e)
    replaced = [det([[F.lit(1.0) if k == j else e[i][k] for k in range(n_dim)] for i in range(n_dim)])
                for j in range(n_dim)]
    return F.when(whole != 0, F.array(*[F.try_divide(r, whole) for r in replaced]))


def _solve(rows):
    """More than three objectives: one small linear system per row."""
    out = []
    for points in rows:
        try:
            matrix = np.array([np.asarray(p, dtype=float) for p in points])
            out.append(np.linalg.solve(matrix, np.ones(len(matrix))))
        except np.linalg.LinAlgError:
            out.append(None)
    return out


def nadir_point(front: DataFrame, ideal: DataFrame, groups: Sequence[str], objectives: Sequence[str],
                row_id: str) -> DataFrame:
    """Per group the nadir: where the plane through the extreme points meets the axes, or the largest front
    values where there is no such plane. Returns `groups, ideal, nadir`."""
    groups, n_dim = list(groups), len(objectives)
    rows = (join_on(front, ideal, groups).groupBy(*groups, "ideal")
            .agg(F.count("*").alias("size"), F.array(*[F.max(f) for f in objectives]).alias("worst"),
                 _extremes(objectives, row_id).alias("e"))
            .withColumn("e", F.transform("e", lambda p: F.zip_with(p["f"], "ideal", lambda a, b: a - b))))
    if n_dim <= 3:
        plane = _plane(F.col("e"), n_dim)
    else:
        plane = F.pandas_udf(lambda s: s.__class__(_solve(s)), "array<double>")("e")
    rows = rows.withColumn("plane", plane)
    good = (F.col("plane").isNotNull() & (F.col("size") >= n_dim)
            & F.forall("plane", lambda v: (F.abs(v) >= SMALLEST_COEFFICIENT) & (v > 0)))
    return rows.select(*groups, "ideal", F.when(
        good, F.zip_with("ideal", "plane", lambda a, v: a + F.try_divide(F.lit(1.0), v))).otherwise(
        F.col("worst")).alias("nadir"))


def nearest_direction(values: np.ndarray, low: np.ndarray, high: np.ndarray,
                      directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Niche and distance of every row of `values`, normalised between `low` and `high`."""
    v = (values - low) / np.maximum(high - low, SMALLEST_RANGE)
    share = v @ directions.T / np.maximum((directions ** 2).sum(axis=1), SMALLEST_DIRECTION)
    square = np.zeros(share.shape)
    for k, u in enumerate(directions.T):
        square += (v[..., k, None] - share * u) ** 2
    dist = np.round(np.sqrt(square), DISTANCE_DIGITS)
    return dist.argmin(axis=-1), dist.min(axis=-1)


def assign_niche(df: DataFrame, scales: DataFrame, groups: Sequence[str], objectives: Sequence[str],
                 n_partitions: int) -> DataFrame:
    """Add `niche` and `niche_dist`: the nearest reference direction of the normalised objectives.

    The directions travel with the task (their number depends on the partitions only) and rows are
    compared with them in place, a batch at a time.
    """
    groups, names, kept = list(groups), list(objectives), list(df.columns)
    directions = np.array(direction_list(len(names), n_partitions))
    schema = T.StructType(df.schema.fields + [T.StructField("niche", T.IntegerType()),
                                              T.StructField("niche_dist", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.stack([column(batch, f).astype(np.float64) for f in names], axis=1)
                niche, dist = nearest_direction(values, matrix(batch.column("ideal")), matrix(batch.column("nadir")),
                                                directions)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(niche.astype(np.int32)), pa.array(dist)],
                    names=[*kept, "niche", "niche_dist"])

    return (join_on(df, scales.select(*groups, "ideal", "nadir"), groups).select(*kept, "ideal", "nadir")
            .mapInArrow(place, schema))


def niche_select(candidates: DataFrame, counts: DataFrame, n: int | str, groups: Sequence[str], row_id: str,
                 seed: int = 1, instance: str | None = None, generation: Column | int = 0,
                 n_max: int | None = None) -> DataFrame:
    """Fill the emptiest niches first until `n` rows (a number or a column) per group are taken.

    The r-th pick of a niche that starts with `c` members happens at level `c + r - 1`; levels are served in
    order, niches of a level in drawn order. An empty niche gives its closest candidate first, all other
    picks are drawn. `counts` holds `groups, niche, members`. Closest candidates come from an aggregation
    and no niche keeps more than `n` rows; where `n` is a column, `n_max` names its largest value, so that tasks
    drop the rest of a crowded niche before the shuffle. Running counts of the levels tell which level is the last one;
    only its rows, at most one of each niche, are put in order, so no task orders a group.
    """
    groups = list(groups)
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    most = n if isinstance(n, int) else n_max
    who = F.col(instance) if instance else F.lit(0)
    slot = F.col(row_id)
    closest = (candidates.groupBy(*groups, "niche").agg(F.min(F.struct("niche_dist", row_id)).alias("c"))
               .select(*groups, "niche", F.col(f"c.{row_id}").alias("_closest")))
    known = join_on(candidates, counts.select(*groups, "niche", "members"), [*groups, "niche"], "left")
    keyed = (join_on(known, closest, [*groups, "niche"])
             .withColumn("members", F.coalesce("members", F.lit(0)).cast("bigint"))
             .withColumn("_turn", F.when((F.col("members") == 0) & (slot == F.col("_closest")), F.lit(-1.0))
                         .otherwise(draw(seed, SALT_PICK, who, generation, slot, 0))))
    in_niche = Window.partitionBy(*groups, "niche").orderBy("_turn", row_id)
    first = keyed.withColumn("_r", F.row_number().over(in_niche))
    if most is not None:
        first = first.where(F.col("_r") <= most)
    leveled = cut(first.where(F.col("_r") <= limit).withColumn("level", F.col("members") + F.col("_r") - 1)
                  .withColumn("_limit", limit))
    by_level = Window.partitionBy(*groups).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    levels = (leveled.groupBy(*groups, "level").agg(F.count("*").alias("_size"))
              .withColumn("_upto", F.sum("_size").over(by_level)))
    counted = join_on(leveled, levels, [*groups, "level"])
    room = F.col("_limit") - (F.col("_upto") - F.col("_size"))
    whole = counted.where(F.col("_upto") <= F.col("_limit"))
    last = Window.partitionBy(*groups).orderBy("_lot", "niche")
    part = (counted.where((F.col("_upto") > F.col("_limit")) & (room > 0))
            .withColumn("_lot", draw(seed, SALT_NICHE, who, generation, F.col("niche"), F.col("level")))
            .withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= room))
    columns = [*candidates.columns, "level"]
    return whole.select(*columns).unionByName(part.select(*columns))


def survive(df: DataFrame, groups: Sequence[str], objectives: Sequence[str], row_id: str, n: int,
            n_partitions: int = 3, g: str = "g", seed: int = 1, instance: str | None = None,
            generation: Column | int = 0, ideal: DataFrame | None = None) -> DataFrame:
    """Keep `n` rows per group: whole fronts in rank order, the front that does not fit by niches.

    Returns the rows with their `rank`; ranks and niches are written out once, as several steps read them. Groups of at most `n` rows stay as they are.
    """
    groups = list(groups)
    ranked = pareto_rank(penalise(df, groups, objectives, g), groups, objectives, row_id, enough=n)
    rows = cut(join_on(df, ranked.select(*groups, row_id, "rank"), [*groups, row_id]))
    by_rank = Window.partitionBy(*groups).orderBy("rank")
    fronts = (rows.groupBy(*groups, "rank").agg(F.count("*").alias("size"))
              .withColumn("upto", F.sum("size").over(by_rank))
              .select(*groups, "rank", "upto", (F.lit(n) - (F.col("upto") - F.col("size"))).alias("room"))
              .where(F.col("room") > 0))
    placed = join_on(rows, fronts, [*groups, "rank"])
    front = rows.where(F.col("rank") == 0)
    now = ideal_point(rows, groups, objectives)
    if ideal is not None:
        past = ideal.select(*groups, F.col("ideal").alias("_past"))
        now = (join_on(now, past, groups, "left")
               .select(*groups, F.when(F.col("_past").isNull(), F.col("ideal")).otherwise(
                   F.zip_with("ideal", "_past", lambda a, b: F.least(a, b))).alias("ideal")))
    scales = nadir_point(front, now, groups, objectives, row_id)
    niched = cut(assign_niche(placed, scales, groups, objectives, n_partitions))
    whole = niched.where(F.col("upto") <= n)
    counts = whole.groupBy(*groups, "niche").agg(F.count("*").alias("members"))
    picked = niche_select(niched.where(F.col("upto") > n), counts, "room", groups, row_id, seed, instance, generation,
                          n_max=n)
    columns = [*df.columns, "rank"]
    return whole.select(*columns).unionByName(picked.select(*columns))
