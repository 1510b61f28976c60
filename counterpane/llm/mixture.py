"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are the weighted shares of all tokens, limited to `REPEATS` times what a source holds; what a limit frees goes to
the others by weight. Targets are dealt out as blocks of equal length by highest quotients `target / (2 k + 1)`, first to
the sources, then a source's blocks to its shards, so that every shard has an integer quota. A shard is a range of the
seeded hash of ids with about `SHARD_DOCS` documents; its documents in hash order make a line of tokens that is cut into
blocks, and the quota takes the blocks from the line's start, round after round. So a source of any size is selected in
shards of bounded size, a shard cuts one document at most, and no document is taken more than `REPEATS` times.

Quotients are ranked only where the ranking is open: with S units that hold the votes V, a unit with votes v has surely
`v (N - S/2) / V - 1` of N seats and at most `v (N + S/2) / V + 1`, so that about 5 S quotients are compared, whatever N.
All of it is DataFrame functions; what the driver sees are single numbers (totals, the level of the shares, the block).

Defined results: a null text has no tokens; null sources are one source, last in order; documents without tokens take
nothing; a table without tokens has targets of zero. Rows with equal ids are rows of their own, neighbours in their shard.
Very long texts count whole. A reseeded or repeated run depends on ids and sizes alone. Other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.running import running_sums
from ..session import join_on
from .common import hot_keys, join_back, keep

REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARD_DOCS = 1 << 16
#: Without a given block length the smallest target makes so many blocks; a block has MOST_BLOCK tokens at most.
FINEST, MOST_BLOCK = 256, 1024
WORD = "[^\\x20\\x09-\\x0D]+"


def apportion(units: DataFrame, groups: Sequence[str], key: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: seats of each group to its units by highest quotients, ties to the smaller key.

    `units` holds `groups, key, votes, seats` (the last alike for a group). Returns `groups, key, quota`; units without
    votes get none.
    """
    groups = list(groups)
    rows = units.select(*groups, key, F.col(votes).cast("double").alias("v"), F.col(seats).cast("bigint").alias("n"))
    rows = rows.where(F.col("v") > 0)
    totals = rows.groupBy(*groups).agg(F.sum("v").alias("all_v"), F.count("*").alias("units"))
    share = F.col("v") / F.col("all_v")
    room = share * F.col("units") / 2 + 1
    ranged = (join_on(rows, totals, groups)
              .withColumn("low", F.greatest(F.lit(0), F.floor(share * F.col("n") - room)).cast("bigint"))
              .withColumn("high", F.ceil(share * F.col("n") + room).cast("bigint")))
    sure = ranged.groupBy(*groups).agg((F.max("n") - F.sum("low")).alias("open"))
    quotients = (join_on(ranged, sure, groups)
                 .select(*groups, key, "open", "v", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
                 .select(*groups, key, "open", (F.col("v") / (2 * F.col("k") + 1)).alias("quotient"), "k"))
    placed = running_sums(quotients, groups, [F.desc("quotient"), F.col(key), F.col("k")], place=F.lit(1))
    won = (placed.where(F.col("place") <= F.col("open")).groupBy(*groups, key).agg(F.count("*").alias("won")))
    return (join_on(ranged, won, [*groups, key], "left")
            .select(*groups, key, (F.col("low") + F.coalesce("won", F.lit(0))).alias("quota")))


def fill_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Add `no`, `weight` and `target` to `source, source_size`: shares by weight, limited to `repeats` sizes.

    In the order of limit over weight the limited sources come first; the first one that its share does not exceed, given
    all before it at their limits, fixes the level of all shares from there on.
    """
    numbered = running_sums(sources, [], [F.col("source").isNull(), F.col("source")], no=F.lit(1))
    chosen = F.get(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("no") - 1) % len(weights)).cast("int"))
    known = (numbered.withColumn("weight", chosen.cast("bigint"))
             .withColumn("most", F.col("source_size") * repeats)
             .withColumn("ratio", F.col("most") / F.col("weight")))
    ordered = running_sums(known, [], [F.col("ratio"), F.col("no")], most_upto=F.col("most"), weight_upto=F.col("weight"))
    sums = ordered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = sums["size"] or 0, sums["weight"] or 0
    left = F.lit(size) - (F.col("most_upto") - F.col("most"))
    weights_left = F.lit(weight) - (F.col("weight_upto") - F.col("weight"))

    def exact(a: Column, b: Column) -> Column:
        return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")

    level = (ordered.where(exact(F.col("most"), weights_left) >= exact(left, F.col("weight")))
             .agg(F.min(F.struct("ratio", "no", left.alias("left"), weights_left.alias("weights"))).alias("x")).first().x)
    if level is None:
        return ordered.select(*sources.columns, "no", "weight", F.lit(0.0).alias("target"))
    limited = (F.col("ratio") < level.ratio) | ((F.col("ratio") == level.ratio) & (F.col("no") < level.no))
    share = (F.lit(level.left) * F.col("weight")).cast("double") / F.lit(level.weights)
    return ordered.select(*sources.columns, "no", "weight",
                          F.when(limited, F.col("most").cast("double")).otherwise(share).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, block: int | None = None,
             shard_docs: int = SHARD_DOCS, seed: int = 1) -> DataFrame:
    """What the mix takes of every row: `doc_id, source, size, source_size, target, block, shard, taken`.

    `block` is the length of a block in tokens (default: the smallest target makes `FINEST` blocks).
    """
    rows = keep(docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")),
        "mix-sizes")
    sources = keep(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    targets = keep(fill_targets(sources, weights, repeats), "mix-targets")
    whole = targets.agg(F.sum("source_size").alias("size"), F.sum("n").alias("n"),
                        F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    length = block or max(1, min(MOST_BLOCK, int((whole["least"] or 0) // FINEST)))
    seats = (2 * (whole["size"] or 0) + length) // (2 * length)
    quotas = apportion(targets.withColumn("seats", F.lit(seats)), [], "no", "target", "seats")
    shards = F.greatest(F.lit(1), F.ceil(F.col("n") / shard_docs)).cast("bigint").alias("shards")
    known = keep(targets.join(quotas.hint("merge"), "no", "left").select(
        F.concat(F.lit("s"), "source").alias("named"), "n", "no", "source_size", "target", shards,
        F.coalesce("quota", F.lit(0)).alias("quota")).withColumn("named", F.coalesce("named", F.lit(""))), "mix-quotas")
    hot = hot_keys(known, ["named"], whole["n"] or 0)
    line = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    dealt = (join_back(rows.withColumn("named", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
                       .withColumn("line", line).withColumn("rid", F.xxhash64("line", "size")),
                       known.drop("n"), ["named"], hot)
             .withColumn("shard", F.floor(F.conv(F.substring("line", 1, 8), 16, 10).cast("bigint") * F.col("shards")
                                          / F.lit(1 << 32)).cast("bigint")))
    dealt = keep(dealt.select("doc_id", "source", "size", "source_size", "target", "no", "shard", "quota", "line"), "mix-dealt")
    sizes = dealt.groupBy("no", "shard").agg(F.sum("size").alias("shard_size"), F.max("quota").alias("seats"))
    given = apportion(sizes, ["no"], "shard", "shard_size", "seats")
    takes = (sizes.join(given.hint("merge"), ["no", "shard"])
             .select("no", "shard", "shard_size", F.least(F.col("quota") * length, F.col("shard_size") * repeats).alias("takes")))
    in_line = (Window.partitionBy("no", "shard").orderBy("line", "doc_id", "size")
               .rowsBetween(Window.unboundedPreceding, 0))
    start = F.sum("size").over(in_line) - F.col("size")
    rounds = F.floor(F.try_divide(F.col("takes"), F.col("shard_size")))
    rest = F.col("takes") - rounds * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return (dealt.withColumn("start", start).join(takes.hint("merge"), ["no", "shard"], "left")
            .select("doc_id", "source", "size", "source_size", "target", F.lit(length).cast("bigint").alias("block"), "shard",
                    F.coalesce(rounds * F.col("size") + part, F.lit(0)).cast("bigint").alias("taken")))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The plan with the columns that fix it: `doc_id, size, source_size, target, taken`."""
    return mix_plan(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: `doc_id, copy, text`, whole copies first; of a cut copy the first words, joined by blanks.

    Ids must be distinct: texts are joined by them.
    """
    plan = mix_plan(docs, **options).where(F.col("taken") > 0).select("doc_id", "size", "taken")
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    text = F.when(words == F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " "))
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.join(copies.hint("merge"), "doc_id").select("doc_id", "copy", text.alias("text"))
