"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing and SentencePiece ids, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystream.llm import lines, mixing, near_dup, pieces, quality_rules
from tallystream.llm.shared import staged
from tallystream.session import read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur in earlier documents; n_chars follows the text."""
    return lines.without_repeated_lines(docs, length="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return near_dup.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids and the text decoded from them."""
    return pieces.round_trip(docs, pieces.read_vocabulary(pieces.MODEL))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix),
    ("SentencePiece", tokenize),
]

# hashing templates and signatures has no SQL form; tests/llm compares each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of `sf_dir`; each stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
