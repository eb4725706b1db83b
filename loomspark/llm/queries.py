"""Queries of the training-data operators over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, negatives, simhash, spelling, url_filter
from .common import documents
from .decontamination import contaminated
from .html_extract import main_text
from .jaccard_join import near_duplicates
from .packing import pack
from .quality import quality
from .secrets_scan import scan
from .token_counts import token_counts
from .toxicity import toxicity


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose statistics are no outliers of their language and source, with the base rules' counts."""
    return quality(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and bytes of every document, by whole tokens where that is proven."""
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds within the edit budget."""
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(documents(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt outside the held-out fold."""
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles are 0.9 alike."""
    return near_duplicates(documents(spark, sf_dir), words=3, percent=90)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines counted and dropped per document, and the digest of what stays."""
    return line_dedup.line_digests(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: by pattern, and by the randomness tests."""
    return scan(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page, by rules and by its aliases."""
    return url_filter.judge(documents(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), words_kept=800_000)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with each word's near words, form and root."""
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, and components of those that differ in three bits or fewer."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best negatives of every anchor and positive."""
    return negatives.hard_negatives(documents(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_outliers, op2_token_counts, op3_decontamination, op4_html_extract, op5_toxicity, op6_ngram_jaccard, op7_line_dedup, op8_secret_scan, op9_url_filter, op10_packing, op11_spelling_variants, op12_simhash, op13_hard_negatives)}
ORACLE = {"op7_line_dedup": line_dedup.SQL, "op9_url_filter": url_filter.SQL, "op11_spelling_variants": spelling.SQL, "op13_hard_negatives": negatives.SQL}
