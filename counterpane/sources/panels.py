"""Building panels from rows, long tables, vectors and CSV, and writing them back.

A panel is a DataFrame `series_id BIGINT, t_len INT, n_ch INT, x ARRAY<DOUBLE>`.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import bad_data, bad_parameter

PANEL = ("series_id", "t_len", "n_ch", "x")
MAX_CHANNELS = 10_000


def _refuse(message: str, key: str | Column) -> Column:
    """An expression that fails the job and names the row at fault."""
    return F.raise_error(F.concat(F.lit(f"{message}: "), (F.col(key) if isinstance(key, str) else key).cast("string")))


def panel_from_rows(df: DataFrame, key: str, step: Column, channel: str, value: str, steps: int | None = None,
                    channels: list[str] | None = None, digits: int | None = None,
                    outside: str = "raise") -> DataFrame:
    """Sum raw rows into `(series, step, channel)` cells; cells without rows are 0.

    The grid is `steps` steps and the named channels; what is not given is taken from the data (steps up to the last
    one, channels in order of their names). A row outside the grid fails the job, unless `outside` is `drop`. The cells
    are summed before the shuffle, so a key with very many rows costs one task no more than `steps * channels` rows per
    map task.
    """
    if outside not in ("raise", "drop"):
        raise bad_parameter("rows outside the grid are raised or dropped", name="outside", value=outside)
    if channels is None:
        names = df.select(channel).where(F.col(channel).isNotNull()).distinct().limit(MAX_CHANNELS + 1).collect()
        channels = sorted(r[0] for r in names)
        if len(channels) > MAX_CHANNELS:
            raise bad_data(f"more than {MAX_CHANNELS} channels", name="channel")
    if steps is None:
        steps = int(df.agg(F.max(step.cast("int"))).first()[0] or 0) + 1
    lookup = F.create_map(*[part for i, name in enumerate(channels) for part in (F.lit(name), F.lit(i))])
    rows = df.select(F.col(key).cast("bigint").alias("series_id"), step.cast("int").alias("t"),
                     (lookup[F.col(channel)] if channels else F.lit(None).cast("int")).alias("c"),
                     F.col(value).cast("double").alias("v"))
    fits = F.coalesce((F.col("t") >= 0) & (F.col("t") < steps) & F.col("c").isNotNull(), F.lit(False))
    if outside == "raise":
        rows = rows.withColumn("t", F.when(fits, F.col("t")).otherwise(
            _refuse("a row lies outside the steps and channels, of series", F.coalesce(
                F.col("series_id").cast("string"), F.lit("null"))).cast("int")))
    else:
        rows = rows.where(fits)
    total = F.sum("v") if digits is None else F.round(F.sum("v"), digits)
    cells = (rows.groupBy("series_id", (F.col("t") * len(channels) + F.col("c")).alias("i"))
             .agg(total.alias("v")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(1, steps * len(channels)) - 1)),
                         lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return (cells.groupBy("series_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("cells"))
            .select("series_id", F.lit(steps).alias("t_len"), F.lit(len(channels)).alias("n_ch"),
                    filled.alias("x")))


def panel_from_vectors(df: DataFrame, key: str, vector: str, channels: int, *keep: str) -> DataFrame:
    """One array column read as `(steps, channels)`; further columns are kept."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return df.select(F.col(key).cast("bigint").alias("series_id"),
                     (F.size(vector) / channels).cast("int").alias("t_len"), F.lit(channels).alias("n_ch"),
                     x.alias("x"), *keep)


def to_long(panel: DataFrame, *keep: str) -> DataFrame:
    """One row per cell: `series_id, t, c, value`."""
    return (panel.select("series_id", "n_ch", *keep, F.posexplode("x").alias("i", "value"))
            .select("series_id", (F.col("i") / F.col("n_ch")).cast("int").alias("t"),
                    (F.col("i") % F.col("n_ch")).alias("c"), "value", *keep))


def from_long(long: DataFrame) -> DataFrame:
    """Cells back to series; the order comes from the step and channel, never from the file.

    A series whose cells do not fill its steps and channels, once each, fails the job.
    """
    cells = F.array_sort(F.collect_list(F.struct("t", "c", F.col("value").cast("double").alias("value"))))
    grouped = long.groupBy("series_id").agg(cells.alias("cells"), F.max("c").alias("top"), F.max("t").alias("last"))
    n_ch, t_len = (F.col("top") + 1).cast("int"), (F.col("last") + 1).cast("int")
    placed = F.forall(F.transform("cells", lambda x, i: (x["t"] == F.floor(i / n_ch)) & (x["c"] == i % n_ch)),
                      lambda ok: ok)
    whole = F.coalesce((F.size("cells") == t_len * n_ch) & placed, F.lit(False))
    return grouped.select("series_id", t_len.alias("t_len"), n_ch.alias("n_ch"), F.when(
        whole, F.col("cells.value")).otherwise(_refuse("missing or repeated cells in series", "series_id").cast(
            "array<double>")).alias("x"))


def to_wide(panel: DataFrame, n_ch: int) -> DataFrame:
    """One row per step: `sample_id, time_step, feature_0 ...`."""
    step = F.col("time_step")
    return (panel.select(F.col("series_id").alias("sample_id"), "x",
                         F.explode(F.sequence(F.lit(0), F.col("t_len") - 1)).alias("time_step"))
            .select("sample_id", "time_step",
                    *[F.get("x", step * n_ch + c).alias(f"feature_{c}") for c in range(n_ch)]))


def from_wide(wide: DataFrame) -> DataFrame:
    """Steps back to series; one map-side-combinable shuffle on the series."""
    features = sorted((c for c in wide.columns if c.startswith("feature_")), key=lambda c: int(c[8:]))
    if not features:
        raise bad_data("no feature columns found", name="wide", advice="expected feature_0, feature_1, ...")
    row = F.array(*[F.col(c).cast("double") for c in features])
    steps = F.array_sort(F.collect_list(F.struct(F.col("time_step").cast("int").alias("t"), row.alias("v"))))
    grouped = wide.groupBy(F.col("sample_id").cast("bigint").alias("series_id")).agg(steps.alias("steps"))
    whole = F.coalesce(F.forall(F.transform("steps", lambda s, i: s["t"] == i), lambda ok: ok), F.lit(False))
    return grouped.select("series_id", F.size("steps").alias("t_len"), F.lit(len(features)).alias("n_ch"), F.when(
        whole, F.flatten("steps.v")).otherwise(_refuse("missing or repeated steps in sample", "series_id").cast(
            "array<double>")).alias("x"))


def _companion(path: str) -> str:
    stem, suffix = os.path.splitext(path)
    return f"{stem}_labels{suffix}"


def write_panel(panel: DataFrame, path: str, n_ch: int, fmt: str = "csv", label: str | None = "label",
                mode: str = "errorifexists") -> None:
    """Write the long form to `path` and, if the panel has labels, `sample_id,label` next to it."""
    def save(df: DataFrame, where: str) -> None:
        writer = df.write.mode(mode)
        (writer.option("header", True).csv(where) if fmt == "csv" else writer.format(fmt).save(where))

    save(to_wide(panel, n_ch), path)
    if label is not None and label in panel.columns:
        save(panel.select(F.col("series_id").alias("sample_id"), F.col(label).alias("label")), _companion(path))


def read_panel(spark: SparkSession, path: str, fmt: str = "csv", check: bool = True) -> DataFrame:
    """Read a long panel and its labels (`<stem>_labels<suffix>`): panel columns plus `label`."""
    def load(where: str) -> DataFrame:
        try:
            return (spark.read.option("header", True).csv(where) if fmt == "csv"
                    else spark.read.format(fmt).load(where))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                raise FileNotFoundError(where) from error
            raise

    wide, labels = load(path), load(_companion(path))
    panel = from_wide(wide)
    if check:
        sizes = panel.agg(F.min("t_len").alias("low"), F.max("t_len").alias("high")).first()
        if sizes["low"] != sizes["high"]:
            raise bad_data(f"series of different lengths: {sizes['low']} to {sizes['high']} steps",
                                name="path")
    if fmt == "csv":
        kind = labels.select("label", F.expr("try_cast(label AS BIGINT)").alias("whole"),
                             F.expr("try_cast(label AS DOUBLE)").alias("number")).agg(
            F.count("label").alias("n"), F.count("whole").alias("whole"), F.count("number").alias("number")).first()
        if kind["whole"] == kind["n"]:
            labels = labels.withColumn("label", F.col("label").cast("bigint"))
        elif kind["number"] == kind["n"]:
            labels = labels.withColumn("label", F.col("label").cast("double"))
    named = (labels.groupBy(F.col("sample_id").cast("bigint").alias("series_id"))
             .agg(F.min("label").alias("label"), F.count("*").alias("_labels")))
    if not check:
        return panel.join(named, "series_id", "left").drop("_labels")
    whole = panel.withColumn("_sampled", F.lit(True)).join(named, "series_id", "full")
    fault = (F.when(F.col("_sampled").isNull(), F.lit("no sample for label")).when(
        F.col("_labels").isNull(), F.lit("no label for sample")).when(F.col("_labels") > 1, F.lit("more than one label for sample")))
    refused = F.raise_error(F.concat(fault, F.lit(": "), F.coalesce(F.col("series_id").cast("string"), F.lit("null"))))
    return whole.withColumn("x", F.when(fault.isNull(), F.col("x")).otherwise(refused.cast("array<double>"))).drop(
        "_sampled", "_labels")
