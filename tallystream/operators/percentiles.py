"""Latency percentiles by the index rule sorted[min(n * p div 100, n - 1)]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.operators.ordered import last_n, last_n_per_group, select_ranks

# Up to this many samples a group's values are sorted as one array; both ways give the same rows.
ARRAY_MAX = 10_000


def percentile_rank(n: Column, p: int) -> Column:
    """0-based index of the p-th percentile among n sorted values, in integer arithmetic."""
    return F.least(F.floor((n * p - F.pmod(n * p, F.lit(100))) / 100), n - 1).cast("bigint")


def array_percentile(values: Column, p: int) -> Column:
    """Percentile of a sorted array."""
    return F.get(values, percentile_rank(F.size(values).cast("bigint"), p).cast("int"))


def rolling_percentiles(
    df: DataFrame, value: str, ts: str, tie: str, by: Sequence[str] = (), n: int = 500,
    ps: Sequence[int] = (50, 95, 99),
) -> DataFrame:
    """(by..., samples, p50, p95, p99) over the n latest samples of each group."""
    recent = df.select(*by, ts, tie, value)
    recent = last_n_per_group(recent, by, ts, tie, n) if by else last_n(recent, ts, tie, n)
    if n > ARRAY_MAX:
        return exact_percentiles(recent, value, by, ps)
    sorted_values = F.array_sort(F.collect_list(value)).alias("_values")
    return recent.groupBy(*by).agg(sorted_values).select(
        *by,
        F.size("_values").cast("bigint").alias("samples"),
        *[F.coalesce(array_percentile(F.col("_values"), p), F.lit(0.0)).alias(f"p{p}") for p in ps],
    )


def exact_percentiles(
    df: DataFrame, value: str, by: Sequence[str] = (), ps: Sequence[int] = (50, 95, 99)
) -> DataFrame:
    """The same over all samples, by rank selection instead of a sort. Null values do not count, NaN is the largest
    value; a group without values has 0 samples and percentiles 0."""
    found = select_ranks(
        df, value, {f"p{p}": percentile_rank(F.col("n"), p) for p in ps}, by
    )
    # a row for every group, and for an ungrouped empty input; both sides meet in one aggregation, without a join
    groups = df.groupBy(*by).agg(F.count(value).alias("samples"))
    both = groups.unionByName(found.select(*by, "target", "value"), allowMissingColumns=True)
    columns = [F.coalesce(F.max(F.when(F.col("target") == f"p{p}", F.col("value"))), F.lit(0.0)).alias(f"p{p}") for p in ps]
    return both.groupBy(*by).agg(F.max("samples").alias("samples"), *columns)


def approx_percentiles(
    df: DataFrame, value: str, by: Sequence[str] = (), ps: Sequence[int] = (50, 95, 99),
    accuracy: int = 10_000,
) -> DataFrame:
    """Spark's mergeable quantile summary: one pass, rank error n / accuracy."""
    columns = [F.percentile_approx(value, p / 100, accuracy).alias(f"p{p}") for p in ps]
    return df.groupBy(*by).agg(F.count(value).alias("samples"), *columns)
