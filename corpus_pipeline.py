"""A training-corpus pipeline: quality, repeated passages, near duplicates, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm.common import staged
from vigil.llm.decontaminate import drop_contaminated
from vigil.llm.line_dedup import drop_repeated_lines
from vigil.llm.near_dedup import keep_one_of_each
from vigil.llm.quality import keep_good
from vigil.llm.sentencepiece import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model doesn't reject. Null and wordless texts go; repeated rows stay or go together."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of passages of 50 words or more; null and empty texts, and repeated rows, stay as they are."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    A row is kept, not an id: two texts under one id are two documents, repeated rows are one. Null and wordless texts stay."""
    return keep_one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of ten words, or a whole shorter item. Null and empty texts stay, as do all without a benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, round_trip, tokens of each document; none for null and empty texts."""
    return encode(docs)


#: Each takes what the one before returned; all but the last return the columns of documents.
STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokens", tokens)]
#: Trained and probabilistic stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
