"""The corpus pipeline: stages over the table of documents, each written as Parquet and read again by the next.

Toxic documents go, later occurrences of repeated passages are cut out of the texts, one document of each group of near
copies stays, documents that hold benchmark passages go, and what is left is encoded. A removed passage may leave an
empty text; such rows stay, for a stage that edits does not decide about documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpane.llm import bpe, decontaminate, line_dedup, near_dup, toxicity
from counterpane.llm.common import keep, numbered

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_ROW = "pipeline_row_number"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not reject; it is learned from the documents of this stage."""
    return toxicity.keep_clean(docs, toxicity.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later occurrences of repeated passages taken out; `n_chars` follows the text."""
    rows = numbered(docs, "pipeline-rows", _ROW)
    cleaned = line_dedup.without_repeats(rows.select(F.col(_ROW).alias("rid"), "text")).select(
        F.col("rid").alias(_ROW), F.col("text"))
    joined = rows.drop("text").join(cleaned, _ROW)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: five-word shingles, similarity of 0.8 or more."""
    rows = numbered(docs, "pipeline-rows", _ROW)
    found = near_dup.near_components(rows.select(F.col(_ROW).alias("rid"), "text"), size=5, percent=80)
    copies = keep(found.where("rid <> comp").select(F.col("rid").alias(_ROW)), "pipeline-copies")
    return rows.join(copies.hint("merge"), _ROW, "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the digest of the text that they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeats),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("encoding", encoded),
]
#: Trained scores, learned lexicons and vocabulary merges are beyond SQL: brute force tests take its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what they write lies below the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
