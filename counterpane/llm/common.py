"""What the document operators share: input frames, learning folds, bounded samples, Arrow loops, hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bytes of text that a worker turns into Python objects at once (one text at least).
SLICE_BYTES = 4 << 20
#: A key is hot with more than 1/HOT of all rows; its rows are joined in SALTS parts.
HOT, SALTS = 128, 64


def frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, text` alone: whatever else the table holds, under any name, cannot clash with results."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    """Whether a row is kept away from learning; a row without an id always is."""
    return F.coalesce(fold(doc_id, folds) == held, F.lit(True))


def first_rows(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of each key, in hash order of `doc_id`: first in each of SALTS parts of a key, then among those."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    salted = rows.withColumn("salt", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(SALTS)))
    for keys in ([key, "salt"], [key]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("place") <= most).drop("place")
    return salted.drop("salt")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int,
                    max_chars: int) -> DataFrame:
    """`doc_id, text, y, weight` of at most `rows` labelled rows of each label outside the held-out fold.

    The ids are drawn first, from the narrow label table in hash order within each label, so that only a bounded number
    of ids is broadcast and no text is shuffled; `weight` is the number of rows that a drawn row stands for. Null ids,
    null labels, null texts and texts beyond `max_chars` are not learned from; a repeated label row counts once, with
    its largest label.
    """
    known = (labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label].cast("int").alias("y"))
             .where(~held_out(F.col("doc_id"), folds, held) & F.col("y").isNotNull())
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").limit(1000).collect()}
    chosen = first_rows(known, "y", rows)
    chosen = chosen.withColumn("weight", F.coalesce(*[F.when(F.col("y") == y, F.lit(n / min(n, rows)))
                                                      for y, n in sizes.items()], F.lit(1.0)))
    return frame(docs).where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[list[str]]:
    """A text column as lists of bounded size, nulls as empty texts."""
    values = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(ends):
        if i > start and held + n > most:
            yield [t or "" for t in values.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n
    if start < len(ends):
        yield [t or "" for t in values.slice(start).to_pylist()]


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], Iterable[tuple]]], kinds: str,
              most: int = SLICE_BYTES) -> DataFrame:
    """Apply a function of a list of texts to the last column of `df` (named `text`), in Arrow batches.

    `make` runs once per task and gives the function, which yields one tuple per text; the other columns are kept.
    """
    kept = [f for f in df.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), kinds])
    names = [f.name for f in kept]
    arrow = _arrow_types(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(batch.schema.get_field_index("text")), most):
                rows = list(work(texts))
                part = batch.slice(at, len(texts))
                at += len(texts)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in names),
                     *(pa.array(c, t) for c, (_, t) in zip(cols, arrow))],
                    names=[*names, *(n for n, _ in arrow)])

    return df.select(*names, "text").mapInArrow(run, schema)


def filter_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]],
                 most: int = SLICE_BYTES) -> DataFrame:
    """The rows, with all their columns, for which a function of a list of texts says true. Nothing is shuffled."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = 0
            for texts in slices(batch.column(position), most):
                yield batch.slice(at, len(texts)).filter(pa.array(work(texts), pa.bool_()))
                at += len(texts)

    return docs.mapInArrow(run, docs.schema)


def _arrow_types(kinds: str) -> list[tuple[str, pa.DataType]]:
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
    return [(name, types[kind]) for name, kind in (part.split() for part in kinds.split(", "))]


def hot_keys(groups: DataFrame, keys: list[str], total: int) -> list[int]:
    """Hashes of the keys of groups with more than 1/HOT of all rows: fewer than HOT."""
    rows = groups.where(F.col("n") > max(total // HOT, 1000)).select(F.xxhash64(*keys).alias("h")).collect()
    return [r.h for r in rows]


def join_back(rows: DataFrame, groups: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """Join rows with their groups; rows of hot groups are spread over SALTS copies of the group's row.

    The join is by shuffle at every size, so that what is measured on small tables holds for large ones.
    """
    if not hot:
        return rows.join(groups.hint("merge"), keys)
    of = F.xxhash64(*keys).isin(hot)
    left = rows.withColumn("salt", F.when(of, F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = groups.withColumn("salt", F.explode(F.when(of, F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                                .otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [*keys, "salt"]).drop("salt")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it again: lineage ends here, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str, key: str = "rid") -> DataFrame:
    """The rows with a distinct number `rid` (or `key`) that stays the same whenever they are read again.

    Where `doc_id` is distinct and never null it is the number; else rows are numbered and written once.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(
        F.max("n").alias("most"), F.max(F.col("doc_id").isNull()).alias("none")).first()
    if (ids.most or 0) <= 1 and not ids.none:
        return docs.withColumn(key, F.col("doc_id").cast("bigint"))
    return keep(docs.withColumn(key, F.monotonically_increasing_id()), name)
