"""Text expressions and small helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystream.staging import drop_staged, scratch_root, staged

__all__ = ["drop_staged", "remainder", "scratch_root", "staged", "word_count", "words_of"]

# The six white-space characters that end a word.
BLANKS = " \t\n\x0b\f\r"
BLANK_PATTERN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_PATTERN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, as long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo `divisor`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(divisor)
