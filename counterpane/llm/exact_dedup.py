"""Exact duplicates by distributed MSD radix partitioning: no digest decides equality.

All documents begin as one group. Each level cuts the next bytes of the normalised text, groups by (group, bytes) with
map-side partial aggregation, and gives every document the smallest row number of its subgroup as its new group. Rows
whose group has one member drop out, and so do groups whose text has ended. Levels widen fourfold, so the number of
levels is logarithmic in the longest text, and a text moves at most once in all: the first level moves `WIDTH` bytes of
each document and passes the rest of those that share them, later ones pass only what still shares all bytes so far.

A subgroup that holds more than 1/HOT of all rows (there are fewer than HOT of these, the bound of what is sent to all
tasks) is joined back in SALTS parts.

Defined results: null text counts as empty, and empty texts are equal to each other. Rows are told apart by an
internal number, so repeated rows and repeated or null ids count as rows of their own; of rows that tie in code points,
the smallest id stays (nulls last), and `kept` is true for every row whose id is that of the row that stays. Other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frame, hot_keys, join_back, keep

WIDTH, GROWTH = 64, 4
SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, SPACE, "")


def radix_groups(docs: DataFrame) -> DataFrame:
    """Groups of two or more equal texts: `rid, gid, n` for a table of `rid, body` (bytes), one row for each member."""
    done = docs.select("rid", F.col("rid").alias("gid"), F.lit(1).cast("bigint").alias("n")).limit(0)
    active, width, total = docs.withColumn("gid", F.lit(0).cast("bigint")), WIDTH, 0
    while True:
        level = active.withColumn("part", F.substring("body", 1, width))
        groups = keep(level.groupBy("gid", "part").agg(F.count("*").alias("n"), F.min("rid").alias("new"))
                      .where("n > 1"), "radix-groups")
        members = groups.agg(F.sum("n")).first()[0]
        if not members:
            return done
        total = total or members
        more = F.length("part") == width
        found = keep(join_back(level, groups, ["gid", "part"], hot_keys(groups, ["gid", "part"], total)).select(
            "rid", F.col("new").alias("gid"), "n", (~more).alias("ended"),
            F.when(more, F.expr(f"substring(body, {width + 1})")).alias("body")), "radix-members")
        done = done.unionByName(found.where("ended").select("rid", "gid", "n"))
        active = found.where("not ended").select("rid", "gid", "body")
        width *= GROWTH


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256` of every row."""
    rows = frame(docs, id_col, text_col).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.select("rid", "doc_id", F.length("text").cast("bigint").alias("points"),
                       normalised(F.col("text")).alias("body"))
    # the numbers are written once: computed again after a lost executor they could differ
    rows = keep(rows.select("rid", "doc_id", "points", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
                            F.col("body").cast("binary").alias("body")), "radix-rows")
    groups = radix_groups(rows.select("rid", "body"))
    facts = rows.select("rid", "doc_id", "points", "text_sha256")
    member = facts.join(groups, "rid", "left").select(
        *facts.columns, F.coalesce("gid", "rid").alias("gid"), F.coalesce("n", F.lit(1)).alias("group_size"))
    alone = member.where("group_size = 1").select(
        "doc_id", F.col("doc_id").alias("keep_id"), "group_size", F.lit(True).alias("kept"), "text_sha256")
    shared = member.where("group_size > 1")
    best = shared.groupBy("gid").agg(
        F.count("*").alias("n"),
        F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"))
    best = keep(best.select("gid", "n", F.col("best.doc_id").alias("keep_id")), "radix-best")
    total = best.agg(F.sum("n")).first()[0] or 0
    joined = join_back(shared, best.select("gid", "keep_id", "n"), ["gid"], hot_keys(best, ["gid"], total)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)
