"""Filter interaction audit by relations of failing ids.

One table of failing rows per filter is stored. A filter applied after a set of others removes the rows of its table that
are in none of theirs (left anti join), and fails again what they removed (left semi join); what survives a set is in none
of its tables (left anti join). What a filter removes depends on the set before it, not on that set's order, so the joins
run over sets and the orders are written out at the end: counts per part, filter and set are a small table.

A row is paired with the sets after it has been placed by its number, so the pairs do not travel. Rows that fail nothing
survive every set; they are counted once and never paired.

Defined results: a null text is an empty one, a null language is the part named by the empty text; words, letters and code
points are counted over whole texts. A text counts as a copy where some row with a smaller `doc_id` has the same text
(compared by SHA-256); rows with equal ids are no copies of one another, a null id is neither smaller nor larger than any
other. Rows count, not ids. A repeated label row counts once with its largest labels, a row without a label has none.
Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import hot_keys, join_back, keep, numbered

SPACE = "[\\x20\\x09-\\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPIES = "E"
MOST_FILTERS = 7  # 5,040 orders


def text_filters() -> dict[str, Column]:
    """The failure conditions on a text: short, repetitive, in capitals, with signs."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", LETTERS, ""))
    return {"words": words, "A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length("text"),
            "D": F.col("text").rlike("[#$%&*|]")}


def copies_of_smaller(rows: DataFrame) -> DataFrame:
    """Rows of `rid, doc_id, digest, ...` whose digest a row with a smaller id has, wherever it is."""
    groups = keep(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "audit-same")
    total = rows.count()
    hot = hot_keys(groups, ["digest"], total)
    return join_back(rows, groups, ["digest"], hot).where(F.col("doc_id") > F.col("least")).select(rows.columns)


def failing_tables(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (`rid, part`) and the stored relations (`rid, part, good, toxic, filter`, a folder per filter)."""
    spark = docs.sparkSession
    rows = numbered(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"),
                                docs["lang"].cast("string").alias("lang")), "audit-rows")
    tests = text_filters()
    letters = [f for f in tests if f != "words"]
    facts = (rows.select("rid", "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
             .withColumn("words", tests["words"])
             .select("rid", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
                     F.array_compact(F.array(*[F.when(tests[f], F.lit(f)) for f in letters])).alias("failed")))
    facts = keep(facts, "audit-facts")
    known = (labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("none"),
                           (labels["quality"] == 1).cast("int").alias("good"), (labels["toxic"] == 1).cast("int").alias("toxic"))
             .where("doc_id is not null").groupBy("doc_id", "none").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    copies = copies_of_smaller(facts.select("rid", "doc_id", "part", "digest")).select("rid", "doc_id", "part", F.lit(COPIES).alias("filter"))
    failing = facts.select("rid", "doc_id", "part", F.explode("failed").alias("filter")).unionByName(copies)
    spread = F.when(F.col("doc_id").isNull(), F.col("rid")).otherwise(F.lit(0))  # rows without an id are no hot key
    labelled = (failing.withColumn("none", spread).join(known.hint("merge"), ["doc_id", "none"], "left")
                .select("rid", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "filter"))
    path = scratch_path(spark, "audit-failing")
    labelled.write.option("compression", "zstd").partitionBy("filter").parquet(path)
    stored = spark.read.schema(labelled.schema).parquet(path)
    return facts.select("rid", "part"), stored


def audit(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """Every order of the filters step by step, per part: see the contract of the result in `audit_filters`.

    `rows` holds `rid, part`; a failing table holds `rid, part, good, toxic` of the rows that its filter fails.
    """
    spark, names = rows.sparkSession, sorted(failing)
    if not 1 <= len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"between 1 and {MOST_FILTERS} filters named by one letter, got {names}")
    bit = {f: 1 << i for i, f in enumerate(names)}
    every = range(1 << len(names))

    def sets(of: list[int]) -> Column:
        return F.explode(F.array(*[F.lit(m) for m in of]))

    def placed(table: DataFrame) -> DataFrame:
        return table.repartition("rid")

    def union(of: list[DataFrame]) -> DataFrame:
        out = of[0]
        for more in of[1:]:
            out = out.unionByName(more)
        return out

    marks = placed(union([failing[f].select("rid", F.lit(bit[f]).alias("bit")) for f in names])).alias("m")
    hit = (F.col("p.rid") == F.col("m.rid")) & (F.col("p.before").bitwiseAND(F.col("m.bit")) != 0)
    own = union([failing[f].select("rid", "part", "good", "toxic", F.lit(f).alias("filter"), F.lit(bit[f]).alias("own"))
                 for f in names])
    pairs = (placed(own).select("rid", "part", "good", "toxic", "filter", "own", sets(list(every)).alias("before"))
             .where(F.col("before").bitwiseAND(F.col("own")) == 0).alias("p"))
    removed = (pairs.join(marks.hint("merge"), hit, "left_anti").groupBy("part", "filter", "before")
               .agg(F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")))
    redundant = (pairs.join(marks.hint("merge"), hit, "left_semi").groupBy("part", "filter", "before")
                 .agg(F.count("*").alias("redundant")))
    any_failing = own.select("rid", "part").distinct()
    clean = (rows.join(any_failing.select("rid").hint("merge"), "rid", "left_anti").groupBy("part").agg(F.count("*").alias("clean")))
    survive = (placed(any_failing).select("rid", "part", sets(list(every)[1:]).alias("before")).alias("p")
               .join(marks.hint("merge"), hit, "left_anti").groupBy("part", "before").agg(F.count("*").alias("survivors")))

    parts = rows.groupBy("part").agg(F.count("*").alias("rows"))
    steps = [(f, m, m | bit[f]) for f in names for m in every if not m & bit[f]]
    grid = parts.select("part", F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(m).alias("before"), F.lit(a).alias("after"))
                                                    for f, m, a in steps])).alias("s")).select("part", "s.*")
    counts = ["removed", "redundant", "good_lost", "toxic_lost"]
    kept = survive.select("part", F.col("before").alias("after"), "survivors")
    cells = (grid.join(removed, ["part", "filter", "before"], "left").join(redundant, ["part", "filter", "before"], "left")
             .join(kept, ["part", "after"], "left").join(clean, "part", "left")
             .select("part", "filter", "before", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
                     (F.coalesce("clean", F.lit(0)) + F.coalesce("survivors", F.lit(0))).alias("kept")))
    cells = keep(cells, "audit-cells")
    size = len(names)
    orders_with = F.get(F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)]),
                        F.bit_count("before").cast("int"))
    others = {f: sum(bit.values()) - bit[f] for f in names}
    alone = F.coalesce(*[F.when(F.col("filter") == f, F.lit(m)) for f, m in others.items()])
    per_filter = cells.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders_with).alias("shapley"),
        F.sum(F.when(F.col("before") == alone, F.col("removed")).otherwise(0)).alias("unique_fails"))
    orders = []
    for order in permutations(names):
        before = 0
        for step, f in enumerate(order, 1):
            orders.append(("".join(order), step, f, before))
            before |= bit[f]
    table = spark.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    return (cells.join(per_filter, ["part", "filter"]).join(F.broadcast(table), ["filter", "before"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                    "shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`part, filter_order, step` and what that step keeps, removes, finds removed already, loses; all orders and parts."""
    rows, stored = failing_tables(docs, labels)
    return audit(rows, {f: stored.where(F.col("filter") == f) for f in "ABCDE"})
