"""The registered queries: every operator over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import distance as D
from ..operators import fronts, niches, variation
from ..operators.model import (ConvModel, cam_weights, class_means, deviation_weights, fit_centroids, fit_logit,
                               score_panel)
from ..operators.neighbours import knn_join, nun_join, with_neighbour
from ..operators.panel import changed_span, minmax_by_step, panel_cells, scale_to_channel, validate_panel
from ..operators.search import SearchSettings, evaluate_masks, search_masks
from ..operators.windows import long_max_window, max_sum_window, naive_search, select_best
from ..session import cut, scratch_path
from ..sources import panels as P
from ..sources.results import flag_best, result_count, results_table, text_table, write_results
from .explain import explain, neighbour_pairs

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
BETA, THETA = 160.0, 0.51
DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """16 steps of 4 channels per vector."""
    return P.panel_from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 4, "label")


def events(spark: SparkSession, sf: str, days: int = 1) -> DataFrame:
    """Summed values per user, span of days and event type."""
    step = F.floor(F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / days)
    return P.panel_from_rows(table(spark, sf, "events"), "user_id", step, "event_type", "value", 30 // days,
                             EVENT_TYPES, 2)


def conv_model() -> ConvModel:
    """A small fixed network: 3 steps wide, 4 filters, 2 classes."""
    o, c, f, k = np.arange(3), np.arange(4), np.arange(4), np.arange(2)
    kernel = ((o[:, None, None] * 7 + c[None, :, None] * 3 + f[None, None, :] * 5) % 11 - 5) / 10.0
    dense = ((f[:, None] * 3 + k[None, :] * 4) % 7 - 3) / 0.2
    return ConvModel(kernel, np.zeros(4), dense, np.zeros(2))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(F.col(c), DIGITS).alias(c) if c in names else F.col(c) for c in df.columns])


def cells(df: DataFrame, key: str, array: str, index: str = "i", value: str = "value") -> DataFrame:
    """One row per array element, rounded."""
    return (df.select(key, F.posexplode(array).alias(index, value))
            .withColumn(value, F.round(value, DIGITS)))


def scored_embeddings(spark: SparkSession, sf: str):
    panel = embeddings(spark, sf)
    model = fit_centroids(panel, "label", BETA)
    return panel, model, score_panel(panel, model)


def scored_events(spark: SparkSession, sf: str, days: int = 3):
    panel = events(spark, sf, days)
    model = fit_logit(panel)
    return panel, model, score_panel(panel, model).drop("proba")


# --- sources, sinks, scalar functions ---

@query
def panel_events(spark, sf):
    return panel_cells(events(spark, sf))


@query
def panel_events_wide(spark, sf):
    """The grid is taken from the data: steps of two days up to the last event, channels by name."""
    step = F.floor(F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 2)
    return panel_cells(P.panel_from_rows(table(spark, sf, "events"), "user_id", step, "event_type", "value", digits=2))


@query
def panel_embeddings(spark, sf):
    return panel_cells(embeddings(spark, sf))


@query
def panel_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "panel") + "/panel.csv"
    P.write_panel(embeddings(spark, sf), path, 4)
    return P.to_long(P.read_panel(spark, path), "label").withColumn("value", F.round("value", DIGITS))


@query
def panel_long_roundtrip(spark, sf):
    return panel_cells(P.from_long(P.to_long(embeddings(spark, sf))))


@query
def format_array(spark, sf):
    fixed = F.transform("x", lambda v: v.cast("decimal(12,6)"))
    return embeddings(spark, sf).select("series_id", A.format_array(fixed).alias("text"))


@query
def parse_array(spark, sf):
    text = F.concat(F.lit("["), A.format_array("x"), F.lit("]"))
    return cells(embeddings(spark, sf).select("series_id", A.parse_array(text, 16, 4).alias("x")), "series_id", "x")


@query
def as_series(spark, sf):
    nested = A.single_series(F.array(A.nest_steps("x", "n_ch")))
    return cells(embeddings(spark, sf).select("series_id", nested.alias("x")), "series_id", "x")


@query
def select_channels(spark, sf):
    panel = embeddings(spark, sf)
    return cells(panel.select("series_id", A.select_channels("x", "n_ch", [3, 1]).alias("x")), "series_id", "x")


@query
def channels_first(spark, sf):
    panel = embeddings(spark, sf)
    return cells(panel.select("series_id", A.channels_first("x", "n_ch").alias("x")), "series_id", "x")


@query
def slice_window(spark, sf):
    panel = embeddings(spark, sf)
    return cells(panel.select("series_id", A.slice_window("x", "n_ch", F.col("label") + 3, 8).alias("x")),
                 "series_id", "x")


def own_class(spark, sf):
    """Every series next to the mean series of its class."""
    panel = embeddings(spark, sf)
    means = class_means(panel).select(F.col("series_id").alias("label"), F.col("x").alias("y"))
    return panel.withColumn("label", F.col("label").cast("bigint")).join(means, "label")


@query
def splice_window(spark, sf):
    return cells(own_class(spark, sf).select(
        "series_id", A.splice_window("x", "y", "n_ch", F.col("label"), 4).alias("x")), "series_id", "x")


@query
def minmax_weights(spark, sf):
    w = deviation_weights(embeddings(spark, sf))
    return cells(w.select("series_id", A.minmax_weights("weights").alias("w")), "series_id", "w", "t")


@query
def minmax_step(spark, sf):
    return cells(minmax_by_step(deviation_weights(embeddings(spark, sf))), "series_id", "weights", "t")


@query
def peak_step(spark, sf):
    return (deviation_weights(events(spark, sf))
            .select("series_id", A.peak_step(A.minmax_weights("weights")).alias("peak")))


@query
def validate_declared_shapes(spark, sf):
    return validate_panel(embeddings(spark, sf).withColumn("t_len", F.col("label") + 12))


@query
def deviation(spark, sf):
    return cells(deviation_weights(events(spark, sf)), "series_id", "weights", "t")


# --- scoring and attribution ---

@query
def score_centroid(spark, sf):
    _, _, scored = scored_embeddings(spark, sf)
    return rounded(scored.select("series_id", "pred_label", "confidence",
                                 A.target_proba("proba", "label").alias("own_proba")), "confidence", "own_proba")


@query
def score_logit(spark, sf):
    _, _, scored = scored_events(spark, sf, 1)
    return rounded(scored.select("series_id", "pred_label", "confidence"), "confidence")


@query
def score_conv(spark, sf):
    scored = score_panel(embeddings(spark, sf), conv_model())
    return rounded(scored.select("series_id", "pred_label", "confidence"), "confidence")


@query
def cam(spark, sf):
    return cells(cam_weights(embeddings(spark, sf), conv_model()), "series_id", "weights", "t")


@query
def class_mean(spark, sf):
    return cells(class_means(embeddings(spark, sf)), "series_id", "x")


# --- distances of every series to every class mean ---

def class_distances(metric: str, **params) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        panel = embeddings(spark, sf)
        found = D.distance_join(panel, class_means(panel), metric, **params)
        if metric == "gak_raw":
            found = found.withColumn("dist", F.log("dist"))
        return rounded(found, "dist")
    return run


for _name, _metric, _params in (
        ("dist_euclidean", "euclidean", {}), ("dist_manhattan", "manhattan", {}), ("dist_dtw", "dtw", {}),
        ("dist_dtw_band", "dtw", {"window": 2}), ("dist_soft_dtw", "soft_dtw", {"gamma": 1.0}),
        ("dist_gak_raw", "gak_raw", {"sigma": 1.0}), ("dist_gak", "gak", {"sigma": 0.3})):
    QUERIES[_name] = class_distances(_metric, **_params)


def class_pairs(spark, sf):
    return own_class(spark, sf).withColumnRenamed("series_id", "left_id").withColumnRenamed("label", "right_id")


@query
def cost_cells(spark, sf):
    return rounded(D.cost_cells(class_pairs(spark, sf)), "cost")


@query
def pair_dtw(spark, sf):
    found = D.pair_distance(class_pairs(spark, sf), "dtw")
    return rounded(found.select("left_id", "right_id", "dist"), "dist")


@query
def dtw_path(spark, sf):
    """The cost along the path, which must be the distance."""
    panel = embeddings(spark, sf)
    path = D.dtw_path(class_pairs(spark, sf))
    warped = D.warp_pairs(path, panel, class_means(panel))
    square = A.total(F.zip_with("left_step", "right_step", lambda a, b: (a - b) * (a - b)))
    return rounded(warped.groupBy("left_id", "right_id").agg(F.sqrt(F.sum(square)).alias("dist")), "dist")


# --- neighbours ---

def neighbours_of(metric: str, k: int, panel_of, **params) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        panel = panel_of(spark, sf)
        found = knn_join(panel, panel, k, metric, **params)
        return rounded(found, "dist")
    return run


QUERIES["knn_euclidean"] = neighbours_of("euclidean", 5, embeddings)
QUERIES["knn_manhattan"] = neighbours_of("manhattan", 5, embeddings)
QUERIES["knn_dtw"] = neighbours_of("dtw", 3, lambda spark, sf: events(spark, sf, 6))
QUERIES["knn_gak"] = neighbours_of("gak", 3, lambda spark, sf: events(spark, sf, 6), sigma=500.0)
QUERIES["knn_soft_dtw"] = neighbours_of("soft_dtw", 3, lambda spark, sf: events(spark, sf, 6))


@query
def knn_ids(spark, sf):
    panel = embeddings(spark, sf)
    return knn_join(panel, panel, 3, return_distance=False)


@query
def nun_euclidean(spark, sf):
    panel, _, scored = scored_embeddings(spark, sf)
    scored = scored.drop("proba")
    return rounded(nun_join(scored, scored, theta=THETA, size=D.panel_size(panel)), "nun_confidence", "dist")


@query
def nun_euclidean_k5(spark, sf):
    panel, _, scored = scored_embeddings(spark, sf)
    scored = scored.drop("proba")
    return rounded(nun_join(scored, scored, n_neighbors=5, theta=0.9, size=D.panel_size(panel)),
                   "nun_confidence", "dist")


@query
def nun_dtw(spark, sf):
    panel, _, scored = scored_events(spark, sf, 6)
    return rounded(nun_join(scored, scored, "dtw", theta=THETA, size=D.panel_size(panel)), "nun_confidence", "dist")


@query
def nun_dtw_band(spark, sf):
    panel, _, scored = scored_events(spark, sf, 6)
    return rounded(nun_join(scored, scored, "dtw", theta=THETA, window=1, size=D.panel_size(panel)),
                   "nun_confidence", "dist")


@query
def nun_attributes(spark, sf):
    panel, _, scored = scored_embeddings(spark, sf)
    scored = scored.drop("proba")
    nuns = nun_join(scored, scored, theta=THETA, size=D.panel_size(panel))
    found = with_neighbour(nuns, panel.join(deviation_weights(panel), "series_id"), "x", "weights")
    return rounded(found.select("query_id", "nun_id", A.total(F.col("nun_x")).alias("x_sum"),
                                A.total(F.col("nun_weights")).alias("weight_sum")), "x_sum", "weight_sum")


@query
def nun_euclidean_cells(spark, sf):
    """The plan for references that are too large to broadcast."""
    panel, _, scored = scored_embeddings(spark, sf)
    scored = scored.drop("proba")
    return rounded(nun_join(scored, scored, theta=THETA, size=D.panel_size(panel), broadcast_bytes=0),
                   "nun_confidence", "dist")


QUERIES["knn_dtw_cells"] = neighbours_of("dtw", 3, lambda spark, sf: events(spark, sf, 6), broadcast_bytes=0)
QUERIES["dist_manhattan_blocks"] = class_distances("manhattan", broadcast_bytes=0)


# --- windows and candidates ---

@query
def max_sum_start(spark, sf):
    return (max_sum_window(deviation_weights(embeddings(spark, sf)), 5).select("series_id", "start"))


@query
def event_window(spark, sf):
    """All events as one series: the thousand in a row with the largest sum of values."""
    return rounded(long_max_window(table(spark, sf, "events"), [], "event_id", "value", 1000), "total")


@query
def user_windows(spark, sf):
    """The three events in a row with the largest sum, per user."""
    return rounded(long_max_window(table(spark, sf, "events"), ["user_id"], "event_id", "value", 3), "total")


def embedding_pairs(spark, sf):
    panel = embeddings(spark, sf)
    model = fit_centroids(panel, "label", BETA)
    return neighbour_pairs(panel, panel, model, deviation_weights(panel), theta=THETA), model


@query
def naive_candidates(spark, sf):
    pairs, model = embedding_pairs(spark, sf)
    return rounded(naive_search(pairs, model, THETA), "target_confidence")


def spliced(spark, sf):
    """Every series with four steps of its class mean, from the step given by its label."""
    return own_class(spark, sf).withColumn("cf", A.splice_window("x", "y", "n_ch", F.col("label"), 4))


@query
def changed_spans(spark, sf):
    return rounded(changed_span(spliced(spark, sf)), "first_value", "last_value", "before_value", "after_value")


@query
def scaled_importance(spark, sf):
    panel = embeddings(spark, sf)
    w = minmax_by_step(deviation_weights(panel))
    return (scale_to_channel(panel.join(w, "series_id"))
            .select("series_id", "c", F.posexplode("scaled").alias("t", "value"))
            .withColumn("value", F.round("value", DIGITS)))


@query
def best_candidates(spark, sf):
    """Per instance the best of eight random masks, by the weighted score of two objectives."""
    judged = judged_masks(spark, sf, 8).withColumn("visit", F.lit(0)).withColumn("pos", F.col("slot"))
    candidates = judged.select("series_id", "visit", "pos", F.transform("f", lambda v: F.round(v, 9)).alias("f"))
    return rounded(select_best(candidates, 0.4).select("series_id", "pos", "score"), "score")


# --- masks ---

def judged_masks(spark, sf, size: int):
    pairs, model = embedding_pairs(spark, sf)
    groups = max_sum_window(pairs.drop("start"), 8, "nun_weights").withColumn("window", F.lit(8))
    masks = variation.random_masks(groups, size, F.lit(32), "series_id")
    return evaluate_masks(masks, model, SearchSettings(theta=THETA))


@query
def evaluated_masks(spark, sf):
    judged = judged_masks(spark, sf, 4)
    return rounded(judged.select("series_id", "slot", "start", "label", "f1", "f2", "f3", "g"), "f1", "f2", "f3", "g")


def bits(df: DataFrame, *keys: str) -> DataFrame:
    """Masks as text of zeros and ones."""
    text = F.concat_ws("", F.transform("mask", lambda b: b.cast("int").cast("string")))
    return df.select(*keys, text.alias("mask"))


def population(spark, sf, size: int = 6):
    """Random masks of 12 bits per series with a violation that ties now and then."""
    ids = embeddings(spark, sf).select("series_id")
    masks = variation.random_masks(ids, size, F.lit(12), "series_id")
    set_bits = F.size(F.filter("mask", lambda b: b))
    return masks.withColumn("cv", F.greatest(F.lit(0.0), 6.0 - set_bits))


@query
def random_masks(spark, sf):
    return bits(population(spark, sf), "series_id", "slot")


@query
def tournament_pairs(spark, sf):
    return variation.tournament_pairs(population(spark, sf), "series_id", 6, generation=1)


def crossed(spark, sf):
    members = population(spark, sf)
    pairs = variation.tournament_pairs(members, "series_id", 6, generation=1)
    return variation.crossover_masks(variation.mate(members, pairs, "series_id"), "series_id", 6, 0.8, generation=1)


@query
def crossover_masks(spark, sf):
    return bits(crossed(spark, sf), "series_id", "slot")


@query
def mutate_masks(spark, sf):
    return bits(variation.mutate_masks(crossed(spark, sf), "series_id", 0.9, generation=1), "series_id", "slot")


# --- fronts, ranks and niches ---

def offers(spark, sf):
    """Parts per supplier: low price, high discount, high quantity sold."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("row_id"))
            .agg(F.min("l_extendedprice").alias("f0"), (F.lit(0.0) - F.max("l_discount")).alias("f1"),
                 (F.lit(0.0) - F.sum("l_quantity")).alias("f2")).withColumn("g", F.col("f2") + 10.0))


OFFER = ["f0", "f1", "f2"]


def purchases(spark, sf):
    """Orders per customer: low price, early date; orders above 300,000 break the constraint."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("f0"),
        F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("f1"),
        (F.col("o_totalprice") - 300000.0).alias("g"))


PURCHASE = ["f0", "f1"]


@query
def pareto_front(spark, sf):
    return fronts.pareto_front(offers(spark, sf), ["grp"], OFFER, "row_id")


@query
def feasible_front(spark, sf):
    return fronts.feasible_front(purchases(spark, sf), ["grp"], PURCHASE, "row_id")


@query
def pareto_rank(spark, sf):
    return fronts.pareto_rank(purchases(spark, sf), ["grp"], PURCHASE, "row_id").select(
        "grp", "row_id", F.col("rank").cast("bigint").alias("rank"))


def bargains(spark, sf):
    """All lines as one group: low price, high quantity, high discount."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_extendedprice").alias("f0"),
        (F.lit(0.0) - F.col("l_quantity")).alias("f1"), (F.lit(0.0) - F.col("l_discount")).alias("f2"))


@query
def pareto_front_global(spark, sf):
    return fronts.pareto_front(bargains(spark, sf), [], OFFER, "row_id")


@query
def pareto_rank_global(spark, sf):
    return fronts.pareto_rank(purchases(spark, sf), [], PURCHASE, "row_id").select(
        "row_id", F.col("rank").cast("bigint").alias("rank"))


@query
def pareto_rank_grid(spark, sf):
    """All orders as one group again, as if a task could hold a quarter of them."""
    orders = purchases(spark, sf)
    return fronts.pareto_rank(orders, [], PURCHASE, "row_id", group_limit=max(1, orders.count() // 4)).select(
        "row_id", F.col("rank").cast("bigint").alias("rank"))


@query
def violation(spark, sf):
    return rounded(offers(spark, sf).select("grp", "row_id", A.violation("g").alias("cv"), (F.col("g") <= 0).alias("ok")),
                   "cv")


@query
def penalise(spark, sf):
    return rounded(niches.penalise(purchases(spark, sf), ["grp"], PURCHASE).select("grp", "row_id", *PURCHASE),
                   *PURCHASE)


@query
def niche_null_groups(spark, sf):
    """Penalties where every fourth customer's orders have no group."""
    orders = purchases(spark, sf).withColumn("grp", F.when(F.col("grp") % 4 != 0, F.col("grp") % 4))
    return rounded(niches.penalise(orders, ["grp"], PURCHASE).select("grp", "row_id", *PURCHASE), *PURCHASE)


@query
def ideal_point(spark, sf):
    found = niches.ideal_point(offers(spark, sf), ["grp"], OFFER)
    return found.select("grp", *[F.get("ideal", F.lit(k)).alias(f"ideal{k}") for k in range(3)])


def offer_scales(spark, sf):
    """Offers, their fronts and ideal points; the first two are read several times, so they are written once."""
    rows = cut(offers(spark, sf))
    front = cut(fronts.pareto_front(rows, ["grp"], OFFER, "row_id"))
    return rows, front, niches.ideal_point(rows, ["grp"], OFFER)


@query
def extreme_points(spark, sf):
    _, front, ideal = offer_scales(spark, sf)
    found = niches.extreme_points(front, ideal, ["grp"], OFFER, "row_id")
    return found.select("grp", "axis", "row_id", *[F.get("f", F.lit(k)).alias(f"f{k}") for k in range(3)])


@query
def nadir_point(spark, sf):
    _, front, ideal = offer_scales(spark, sf)
    found = niches.nadir_point(front, ideal, ["grp"], OFFER, "row_id")
    return rounded(found.select("grp", *[F.get("nadir", F.lit(k)).alias(f"nadir{k}") for k in range(3)]),
                   "nadir0", "nadir1", "nadir2")


@query
def assign_niche(spark, sf):
    rows, front, ideal = offer_scales(spark, sf)
    scales = niches.nadir_point(front, ideal, ["grp"], OFFER, "row_id")
    found = niches.assign_niche(rows, scales, ["grp"], OFFER, 3)
    return rounded(found.select("grp", "row_id", "niche", "niche_dist"), "niche_dist")


@query
def niche_select(spark, sf):
    """Eight lines per supplier beyond its front, which already fills some niches."""
    rows, front, ideal = offer_scales(spark, sf)
    scales = niches.nadir_point(front, ideal, ["grp"], OFFER, "row_id")
    placed = cut(niches.assign_niche(rows, scales, ["grp"], OFFER, 3))
    counts = (placed.join(front.select("grp", "row_id"), ["grp", "row_id"], "left_semi")
              .groupBy("grp", "niche").agg(F.count("*").alias("members")))
    rest = placed.join(front.select("grp", "row_id"), ["grp", "row_id"], "left_anti")
    chosen = niches.niche_select(rest, counts, 8, ["grp"], "row_id", instance="grp", generation=2)
    return chosen.select("grp", "row_id", "niche", F.col("level").cast("bigint").alias("level"))


@query
def survivors(spark, sf):
    kept = niches.survive(purchases(spark, sf), ["grp"], PURCHASE, "row_id", 5, instance="grp", generation=3)
    return kept.select("grp", "row_id", F.col("rank").cast("bigint").alias("rank"))


# --- jobs ---

def explained(spark, sf, **params):
    panel = embeddings(spark, sf)
    model = fit_centroids(panel, "label", BETA)
    return explain(panel, panel, model, deviation_weights(panel), theta=THETA, **params)


@query
def searched_masks(spark, sf):
    pairs, model = embedding_pairs(spark, sf)
    groups = max_sum_window(pairs, 8, "nun_weights").withColumn("window", F.lit(8))
    found = search_masks(groups, model, SearchSettings(theta=THETA))
    return bits(found, "series_id", "start", "pos", "g")


@query
def explain_all(spark, sf):
    return explained(spark, sf).select("series_id", "nun_id", "visit", "window", "start", "pos", "label", "is_best",
                                       "n_changed")


@query
def explain_best(spark, sf):
    best = explained(spark, sf, optimize_proximity=False).where("is_best")
    return best.select("series_id", "nun_id", "original_label", "label", "window", "n_changed")


@query
def explain_unweighted(spark, sf):
    panel = events(spark, sf, 3)
    found = explain(panel, panel, fit_logit(panel), proximity_distance="dtw", theta=THETA)
    return found.select("series_id", "nun_id", "window", "pos", "label", "is_best", "n_changed")


@query
def flagged_edits(spark, sf):
    """Edits with one to four spliced steps per series, the best one by heaviest change flagged by its label and values."""
    edits = own_class(spark, sf).withColumn("visit", F.explode(F.sequence(F.lit(1), F.lit(4))))
    edits = cut(edits.withColumn("cf", A.splice_window("x", "y", "n_ch", F.lit(0), "visit")).withColumn("pos", F.lit(0)))
    best = edits.where(F.col("visit") == 1 + F.col("series_id") % 4)
    return flag_best(edits, best).select("series_id", "visit", "is_best")


@query
def results_read_back(spark, sf):
    """A result table written as CSV and read again: texts of arrays, flags and labels survive."""
    edits = own_class(spark, sf).withColumn("cf", A.splice_window("x", "y", "n_ch", F.lit(0), 4))
    table_ = results_table(edits.select("series_id", "cf", (F.col("series_id") % 2 == 0).alias("is_best"), "label", "x",
                                        F.col("label").alias("original_label"), F.col("y").alias("nun_x"),
                                        F.slice("x", 1, 2).alias("nun_weights")))
    path = scratch_path(spark, "results")
    write_results(table_, path)
    back = spark.read.option("header", True).csv(path)
    values = A.parse_array("counterfactual", 16, 4)
    return rounded(back.select(F.col("instance_id").cast("bigint").alias("series_id"), F.col("is_best").cast("boolean").alias("is_best"),
                               F.col("label").cast("bigint").alias("label"), F.size(values).cast("bigint").alias("cells"),
                               A.total(values).alias("total")), "total")


@query
def results_text(spark, sf):
    return text_table(results_table(explained(spark, sf)))


@query
def explained_count(spark, sf):
    return result_count(results_table(explained(spark, sf)))
