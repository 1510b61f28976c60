"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int = 8, name: str = "counterpane") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is named, a folder of this machine.

    A machine-local folder is accepted for a local master alone: executors elsewhere could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="counterpane-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core rows, for operators whose work per row outweighs moving the row once.

    Hashing the hashed key keeps this shuffle even where the input is partitioned by the key already:
    adaptive execution merges such partitions by bytes, not by the work that follows.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64(key))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null keys included; without keys `right` is one row for all of `left`."""
    names = [f"_key_{i}" for i in range(len(keys))]
    named = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                         *[c for c in right.columns if c not in keys])
    if not keys:
        one = F.broadcast(named.withColumn("_one", F.lit(1)))
        return left.withColumn("_one", F.lit(1)).join(one, "_one", how).drop("_one")
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(named[n]) for k, n in zip(keys, names)))
    return left.join(named, same, how).drop(*names)
