"""The corpus pipeline: five stages over documents, each by one operator of the corpus subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isobar.llm import bpe, decontaminate, line_dedup, quality, simhash
from isobar.llm.common import forget, passing, stored
from isobar.llm.queries import table, word_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from `labels` and the documents it is given."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one repeats; n_chars counts the text that is left."""
    from pyspark.sql import functions as F

    found = line_dedup.dedup(docs)
    n = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id; rows of one id are told apart by their texts."""
    return simhash.keep_first(docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and their round trip, as digests."""
    return bpe.encode_decode(docs, word_bpe())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", near_stage),
    ("decontaminate", benchmark_stage),
    ("bpe", token_stage),
]

#: Trained weights, walks and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn over documents, each result written to the shared folder and read again; what a stage leaves besides goes with it."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with passing() as keep:
            docs = keep(stored(stage(spark, before, sf_dir), f"pipeline-{name}"))
        if k:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
