"""Key counting, the first step of every sketch over a batch table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, key: str, *keep: str) -> DataFrame:
    """`key` as string plus the kept columns; rows with a null or empty key are dropped."""
    text = F.col(key).cast("string")
    return df.select(text.alias("key"), *keep).where(F.col("key").isNotNull() & (F.col("key") != ""))


def whole_weight(weight: str) -> Column:
    """A weight as bigint; a fractional one ends the query, because cutting it would break the bounds."""
    value = F.col(weight)
    whole = value.cast("bigint")
    return F.when(value.isNull() | (value == whole), whole).otherwise(
        F.raise_error(F.lit(f"weights in {weight!r} must be whole numbers")))


def key_counts(
    df: DataFrame, key: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(by..., key, n): rows, or summed weight, per key.

    Partial counts are taken before the shuffle, so a key with a third of all rows sends one row
    per map task.
    """
    kept = [*by] + ([weight] if weight else [])
    amount = F.sum(whole_weight(weight)) if weight else F.count(F.lit(1))
    return keyed(df, key, *kept).groupBy(*by, "key").agg(amount.alias("n"))
