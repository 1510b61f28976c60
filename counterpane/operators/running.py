"""Running sums over orders of any length: range partitions, sums inside each, offsets from the parts before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, join_on


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], **sums: Column) -> DataFrame:
    """Add to every row the sums over the rows of its group up to and with itself, in the given total order.

    No group has to fit one task: rows are range-partitioned by group and order, so a large group spreads over
    neighbouring parts. The cut points come from samples, so the placed rows are written once; what passes between parts
    is one row per part and group. `order` must tell the rows of a group apart.
    """
    groups = list(groups)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(df.repartitionByRange(_parts(df), *[F.col(g) for g in groups], *columns)
                 .withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*groups, "_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(*groups, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
               .select(*groups, "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}")
                                           for n in sums]))
    local = placed.select("*", *[F.sum(c).over(here).alias(n) for n, c in sums.items()])
    return (join_on(local, offsets, [*groups, "_part"])
            .select(*df.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in sums]))
