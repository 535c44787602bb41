"""The registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import byte_bpe
from vigil.llm.collocations import collocations
from vigil.llm.decontaminate import find_contamination
from vigil.llm.html_text import extract_main_text
from vigil.llm.language_id import identify_language
from vigil.llm.licenses import scan_licenses
from vigil.llm.line_dedup import line_dedup_digest
from vigil.llm.near_dedup import near_duplicates
from vigil.llm.nearest import nearest
from vigil.llm.oracles import ORACLES
from vigil.llm.quality import classify_quality
from vigil.llm.secrets import find_secrets
from vigil.llm.sentencepiece import digest
from vigil.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out quarter."""
    return identify_language(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and decision of the weak-label quality model for every document."""
    return classify_quality(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their four-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, and whether decoding gives its text back."""
    return digest(_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps once later repeats of passages are cut."""
    return line_dedup_digest(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by pattern and by randomness."""
    return find_secrets(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes that they decode to, as digests."""
    return byte_bpe.digest(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every vector."""
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations over all documents."""
    return collocations(_table(spark, sf_dir, "documents"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed kinds of op8_secrets in every document, as SQL can count them."""
    return find_secrets(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed phrases of op9_licenses in every document, as SQL can find them."""
    return scan_licenses(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality, op3_decontaminate, op4_near_dedup, op5_sentencepiece, op6_nearest, op7_line_dedup, op8_secrets, op9_licenses, op10_main_text, op11_byte_bpe, op12_whitening, op13_collocations, secret_base_counts, license_base_places)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
