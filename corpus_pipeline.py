"""A training corpus from `documents`: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import bounded_batches, documents
from loomspark.llm.decontamination import decontaminate
from loomspark.llm.jaccard_join import one_of_each
from loomspark.llm.line_dedup import without_repeated_lines
from loomspark.llm.packing import pack
from loomspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    bounded_batches(spark)
    return without_toxic(docs, documents(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters in three documents or more stay in the largest doc_id alone; n_chars follows the text."""
    out = without_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 alike stays."""
    bounded_batches(spark)
    return one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded_batches(spark)
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows. Workers that earlier stages have filled keep fewer words."""
    bounded_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), words_kept=100_000)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("packing", packing)]
#: The toxicity stage is a trained model, so SQL cannot express the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
