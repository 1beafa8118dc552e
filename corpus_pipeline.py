"""The corpus pipeline: documents -> quality -> line dedup -> near-duplicate removal -> mixture -> packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a frame; ``run`` writes
it as Parquet to the shared folder and reads it again as the next one's docs. All stages but the last return the columns
of ``documents``; what a stage rejects is gone from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import line_dedup, mixing, ngram_join, packing, quality
from fieldlens.llm.common import read_table, stage, unstage


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it learns from the labelled rows among ``docs``."""
    return quality.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that it shares with later ones; n_chars follows the text."""
    cleaned = line_dedup.line_dedup(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return ngram_join.drop_near_duplicates(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their target shares of tokens, or all of a value's
    documents where it is short of its target (see mixing)."""
    return mixing.sample_mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", accept_quality),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, the raking and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)
        before = docs
    return docs
