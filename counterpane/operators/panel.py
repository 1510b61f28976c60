"""Operators on whole panels: scaling over the dataset, changed spans, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panels import to_long


def minmax_by_step(weights: DataFrame, key: str = "series_id", w: str = "weights") -> DataFrame:
    """Scale every step over all rows into [0, 1]; a constant step becomes 0.

    The extremes of all steps come from one two-level aggregation and travel back as a single row of
    two arrays (as long as one series), so no row of the dataset is shuffled.
    """
    bounds = (weights.select(F.posexplode(w).alias("i", "v"))
              .groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high"))
              .agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("steps"))
              .select(F.col("steps.low").alias("lows"), F.col("steps.high").alias("highs"), F.lit(1).alias("one")))

    def scaled(v, i):
        low, high = F.get("lows", i), F.get("highs", i)
        return F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0))

    return (weights.withColumn("one", F.lit(1)).join(F.broadcast(bounds), "one")
            .select(*[c for c in weights.columns if c != w], F.transform(w, scaled).alias(w)))


def changed_span(pairs: DataFrame, key: str = "series_id", original: str = "x", edited: str = "cf") -> DataFrame:
    """Per series and channel the first and last changed step, with the values there and at the unchanged
    neighbours outside (null at the border of the series); unchanged channels give no row."""
    places = F.filter(F.sequence(F.lit(0), F.size(original) - 1),
                      lambda i: F.get(original, i) != F.get(edited, i))
    channel = F.col("c")
    spans = (pairs.withColumn("hits", places)
             .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_ch") - 1)))
             .withColumn("own", F.transform(F.filter("hits", lambda i: i % F.col("n_ch") == channel),
                                            lambda i: (i / F.col("n_ch")).cast("int")))
             .where(F.size("own") > 0)
             .withColumn("first_t", F.array_min("own")).withColumn("last_t", F.array_max("own")))

    def at(name, step):
        return F.get(name, F.when((step >= 0) & (step < F.col("t_len")), step * F.col("n_ch") + channel))

    return spans.select(
        key, "c", "first_t", "last_t", F.size("own").alias("n_changed"),
        at(edited, F.col("first_t")).alias("first_value"), at(edited, F.col("last_t")).alias("last_value"),
        at(original, F.col("first_t") - 1).alias("before_value"),
        at(original, F.col("last_t") + 1).alias("after_value"))


def scale_to_channel(df: DataFrame, key: str = "series_id", w: str = "weights", x: str = "x") -> DataFrame:
    """Importance in [0, 1] stretched onto the value range of every channel: rows `(key, c, scaled)`."""
    channel = F.col("c")
    return (df.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_ch") - 1)))
            .withColumn("values", F.filter(x, lambda v, i: i % F.col("n_ch") == channel))
            .withColumn("low", F.array_min("values"))
            .withColumn("range", F.array_max("values") - F.col("low"))
            .select(key, "c", F.transform(w, lambda v: v * F.col("range") + F.col("low")).alias("scaled")))


def validate_panel(panel: DataFrame, weights: str | None = None) -> DataFrame:
    """Violations per rule over the whole panel: one row `(rule, n_bad, example_id)` for every broken rule.

    One pass, one row of counters per task. Checks the declared shape, nulls, NaN and infinite cells, that
    all series share one shape, ids that are null, and, if named, that the importance has one value per step.
    """
    rules = {
        "null_id": F.col("series_id").isNull(),
        "shape_mismatch": F.col("x").isNull() | (F.size("x") != F.col("t_len") * F.col("n_ch")),
        "null_value": F.exists("x", lambda v: v.isNull()),
        "not_finite": F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))),
    }
    if weights is not None:
        rules["importance_length"] = F.col(weights).isNull() | (F.size(weights) != F.col("t_len"))
    hits = [F.count_if(bad).alias(f"n_{name}") for name, bad in rules.items()]
    firsts = [F.min(F.when(bad, F.col("series_id"))).alias(f"id_{name}") for name, bad in rules.items()]
    shape = F.struct("t_len", "n_ch")
    row = panel.agg(*hits, *firsts, F.min(shape).alias("low"), F.max(shape).alias("high"))
    found = [F.struct(F.lit(name).alias("rule"), F.col(f"n_{name}").alias("n_bad"),
                      F.col(f"id_{name}").cast("bigint").alias("example_id")) for name in rules]
    mixed = F.struct(F.lit("mixed_shapes").alias("rule"),
                     F.when(F.col("low") != F.col("high"), F.lit(1)).otherwise(0).cast("bigint").alias("n_bad"),
                     F.lit(None).cast("bigint").alias("example_id"))
    return row.select(F.inline(F.array(*found, mixed))).where(F.col("n_bad") > 0)


def panel_cells(panel: DataFrame, digits: int = 6) -> DataFrame:
    """The long form with rounded values, the shape used in reports."""
    return to_long(panel).withColumn("value", F.round("value", digits))
