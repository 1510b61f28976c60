"""k-nearest-neighbour joins and the nearest-unlike-neighbour join, exact for every metric.

Two plans give the same rows:

* a reference panel below a checked size travels to every task, and the queries are spread over all cores;
* beyond it, queries and references are dealt into blocks by hash, and each task compares a block of queries
  with one of references. There are about as many pairs of blocks as the cluster works on at a time, so
  what is shuffled grows with the series (about twice the square root of the number of tasks copies of
  each), never with the pairs, until a block of references reaches its bound.

Copies of one reference collapse to the k smallest ids before they are compared. Inside a task references that are
near each other form tiles, and a query leaves out the tiles whose box lies beyond its k-th neighbour (`blocks`).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import bad_data, bad_parameter
from ..session import spread
from .batches import column, cubes
from .blocks import scatter, top_k_block
from .distance import BROADCAST_BYTES, panel_bytes, panel_size
from .metrics import LOCK_STEP, Metric, metric as find_metric

HITS = "query_id bigint, ref_id bigint, ref_label int, ref_confidence double, dist double"
HIT_FIELDS = pa.schema([("query_id", pa.int64()), ("ref_id", pa.int64()), ("ref_label", pa.int32()),
                        ("ref_confidence", pa.float64()), ("dist", pa.float64())])
BLOCK_BYTES = 64 << 20  # references of one block
TASKS_PER_CORE = 4      # pairs of blocks, for an even load
SPREAD_ROWS = 4096      # below, lock-step queries are answered where they are

_scatter = scatter


def _columns(df: DataFrame, name: str) -> DataFrame:
    label = F.col("pred_label").cast("int") if "pred_label" in df.columns else F.lit(None).cast("int")
    conf = F.col("confidence").cast("double") if "confidence" in df.columns else F.lit(None).cast("double")
    return df.select(F.col("series_id").alias(name), "t_len", "n_ch", "x", label.alias("label"), conf.alias("conf"))


def _labels(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return column(table, "label").astype(np.float64)


def _hits(metric: Metric, k: int, unlike: bool, queries: pa.Table | pa.RecordBatch, refs: pa.Table,
          n_pivots: int | None = None) -> Iterator[pa.RecordBatch]:
    """The k best references in `refs` (sorted by id) for every query of a batch."""
    q_ids, r_ids = column(queries, "query_id"), column(refs, "ref_id")
    q_lab, r_lab = _labels(queries), _labels(refs)
    conf = column(refs, "conf").astype(np.float64)
    for qw, X in cubes(queries):
        for rw, Y in cubes(refs):
            ours, theirs = q_lab[qw], r_lab[rw]
            differ = (lambda q, r: ours[q][:, None] != theirs[r][None, :]) if unlike else None
            qi, ri, dist = top_k_block(metric, k, X, Y, differ, n_pivots)
            found = rw[ri]
            label = r_lab[found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[qw[qi]]), pa.array(r_ids[found]),
                 pa.array(np.nan_to_num(label).astype(np.int32), mask=np.isnan(label)),
                 pa.array(conf[found], mask=np.isnan(conf[found])), pa.array(dist)], schema=HIT_FIELDS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of the partial results of each query; ties to the smaller reference id."""
    order = Window.partitionBy("query_id").orderBy("dist", "ref_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _without_copies(refs: DataFrame, k: int) -> DataFrame:
    """Of equal copies only the k smallest ids can be among the nearest."""
    copies = Window.partitionBy("x", "t_len", "n_ch", "label").orderBy("ref_id")
    return refs.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")


def _small(queries: DataFrame, refs: DataFrame, metric: Metric, k: int, unlike: bool, n_pivots: int | None) -> DataFrame:
    table = _without_copies(refs, k).toArrow().sort_by("ref_id")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and table.num_rows:
                found = pa.Table.from_batches(list(_hits(metric, k, unlike, batch, table, n_pivots)), HIT_FIELDS)
                order = np.lexsort([column(found, c) for c in ("ref_id", "dist", "query_id")])
                query = column(found, "query_id")[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                best = rank < k
                yield from (found.take(pa.array(order[best])).append_column("rank", pa.array(rank[best].astype(np.int32) + 1))
                            .to_batches())

    still = metric.name in LOCK_STEP and table.num_rows < SPREAD_ROWS
    return (queries if still else spread(queries, "query_id")).mapInArrow(nearest, f"{HITS}, rank int")


def _dealt(queries: DataFrame, refs: DataFrame, metric: Metric, k: int, unlike: bool, n_bytes: int,
           n_pivots: int | None) -> DataFrame:
    """The k best references of every pair of blocks: `HITS`, up to k rows for each block of references."""
    pairs = TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    n_refs = max(ceil(n_bytes / BLOCK_BYTES), ceil(sqrt(pairs)))
    n_queries = ceil(pairs / n_refs)
    kinds = ["t_len", "n_ch", "x", "label", "conf"]

    def side(df: DataFrame, key: str, tag: int, own: Column, others: Column) -> DataFrame:
        return df.select(F.lit(tag).alias("side"), F.col(key).alias("id"), *kinds,
                         own.alias("own"), F.explode(others).alias("other"))

    def block_of(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(n), F.col(key)), F.lit(n)).cast("int")

    known = side(_without_copies(refs, k), "ref_id", 0, block_of("ref_id", n_refs),
                 F.sequence(F.lit(0), F.lit(n_queries - 1)))
    asked = side(queries, "query_id", 1, block_of("query_id", n_queries), F.sequence(F.lit(0), F.lit(n_refs - 1)))
    cell = F.when(F.col("side") == 0, F.col("own") * n_queries + F.col("other")).otherwise(
        F.col("other") * n_queries + F.col("own"))
    met = (known.unionByName(asked).withColumn("cell", cell).drop("own", "other")
           .repartitionById(n_refs * n_queries, F.col("cell")).sortWithinPartitions("cell", "side"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, table = None, [], None
        for batch in batches:
            # a batch is cut where its block or side changes
            key = column(batch, "cell").astype(np.int64) * 2 + column(batch, "side")
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if at != key[a] // 2:
                    at, held, table = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    held.append(part)
                elif held:
                    if table is None:
                        table = pa.Table.from_batches(held).rename_columns(
                            ["ref_id" if c == "id" else c for c in batch.schema.names]).sort_by("ref_id")
                    asked = part.rename_columns(["query_id" if c == "id" else c for c in batch.schema.names])
                    yield from _hits(metric, k, unlike, asked, table, n_pivots)

    return met.mapInArrow(compare, HITS)


def _neighbours(queries: DataFrame, reference: DataFrame, k: int, metric: Metric, unlike: bool,
                broadcast_bytes: int, n_pivots: int | None, size: tuple[int, int] | None = None) -> DataFrame:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise bad_parameter("the number of neighbours must be a positive integer", got=k, name="k")
    q, r = _columns(queries, "query_id"), _columns(reference, "ref_id")
    n_refs, cells = size or panel_size(reference)
    if panel_bytes(n_refs, cells) <= broadcast_bytes:
        return _small(q, r, metric, k, unlike, n_pivots)
    return _ranked(_dealt(q, r, metric, k, unlike, panel_bytes(n_refs, cells), n_pivots), k)


def knn_join(queries: DataFrame, reference: DataFrame, k: int = 1, metric: str | Metric = "euclidean", *,
             return_distance: bool = True, broadcast_bytes: int = BROADCAST_BYTES, n_pivots: int | None = None,
             **params) -> DataFrame:
    """The k nearest references of every query: `query_id, rank, ref_id, dist`, ascending for every metric."""
    found = _neighbours(queries, reference, k, find_metric(metric, **params), False, broadcast_bytes, n_pivots)
    return found.select("query_id", "rank", "ref_id", *(["dist"] if return_distance else []))


def nun_join(queries: DataFrame, reference: DataFrame, metric: str | Metric = "euclidean", *,
             n_neighbors: int = 1, theta: float = 0.51, broadcast_bytes: int = BROADCAST_BYTES,
             n_pivots: int | None = None, size: tuple[int, int] | None = None, **params) -> DataFrame:
    """Nearest unlike neighbour of every scored query: `query_id, nun_id, nun_label, nun_confidence, dist`.

    Both panels carry `pred_label`, the reference also `confidence`. The confidence filter comes after the
    top-k, so a query whose nearest unlike references are all unsure has no neighbour and gives no row.
    `size` (number of references, cells of one) saves a pass where the caller knows it.
    """
    found = _neighbours(queries, reference, n_neighbors, find_metric(metric, **params), True, broadcast_bytes, n_pivots,
                        size)
    kept = found.where(F.col("ref_confidence") >= theta)
    if n_neighbors > 1:
        kept = (kept.groupBy("query_id").agg(F.min_by(F.struct("ref_id", "ref_label", "ref_confidence", "dist"), "rank")
                                             .alias("best")).select("query_id", "best.*"))
    return kept.select("query_id", F.col("ref_id").alias("nun_id"), F.col("ref_label").alias("nun_label"),
                       F.col("ref_confidence").alias("nun_confidence"), "dist")


def with_neighbour(nuns: DataFrame, reference: DataFrame, *columns: str, salts: int = 16) -> DataFrame:
    """Attach columns of the neighbour (`nun_<column>`).

    One reference may be the neighbour of very many queries: the looked-up rows are copied `salts` times and
    the queries spread over the copies. Only references that are somebody's neighbour are copied.
    """
    wanted = nuns.select("nun_id").distinct()
    looked_up = (reference.join(wanted, F.col("series_id") == F.col("nun_id"), "left_semi")
                 .select(F.col("series_id").alias("nun_id"), *[F.col(c).alias(f"nun_{c}") for c in columns],
                         F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    return (nuns.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
            .join(looked_up, ["nun_id", "salt"]).drop("salt"))
