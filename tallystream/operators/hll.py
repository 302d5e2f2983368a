"""HyperLogLog: distinct counts from 2^p registers.

A sketch is a table (by..., idx int, rho int) of its non-zero registers: at most 2^p rows per
group, mergeable by maximum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.functions.formulas import (
    check_hll, hll_alpha, hll_estimate_of, hll_memory_bytes, hll_relative_error,
)
from tallystream.functions.hashing import hll_idx, hll_rest, hll_rho, spread_down, with_bits
from tallystream.functions.numbers import epoch_micros, interval_seconds
from tallystream.operators.keys import keyed
from tallystream.operators.ordered import running


@dataclass(frozen=True)
class HyperLogLog:
    registers: DataFrame
    p: int
    by: tuple[str, ...] = field(default=())
    hash_mode: str = "md5"

    def __post_init__(self):
        check_hll(self.p)


def with_registers(df: DataFrame, key: str, p: int | Column, hash_mode: str = "md5") -> DataFrame:
    """Adds idx and rho of each key; p may depend on the row.

    Step by step, so that each step is a column that the next one reads.
    """
    kept = df.columns
    own_p = p if isinstance(p, Column) else F.lit(p)
    return (
        with_bits(df.select(*kept, own_p.alias("_p")), F.col(key), "_h", hash_mode)
        .select(*kept, "_p", hll_idx(F.col("_h"), F.col("_p")).alias("idx"),
                hll_rest(F.col("_h"), F.col("_p")).alias("_rest"))
        .select(*kept, "_p", "idx", spread_down(F.col("_rest"), 1, 2, 4).alias("_some"))
        .select(*kept, "_p", "idx", spread_down(F.col("_some"), 8, 16, 32).alias("_all"))
        .select(*kept, "idx", hll_rho(F.col("_all"), F.col("_p")).alias("rho"))
    )


def hll_build(df: DataFrame, key: str, p: int, by: Sequence[str] = (),
              hash_mode: str = "md5") -> HyperLogLog:
    """Registers straight from the rows: the maximum is taken map-side, at most 2^p rows per
    group leave a task, and no shuffle by key is needed."""
    check_hll(p)
    hashed = with_registers(keyed(df, key, *by), "key", p, hash_mode)
    registers = hashed.groupBy(*by, "idx").agg(F.max("rho").alias("rho"))
    return HyperLogLog(registers, p, tuple(by), hash_mode)


def hll_merge(*sketches: HyperLogLog) -> HyperLogLog:
    first = sketches[0]
    union = first.registers
    for other in sketches[1:]:
        if (other.p, other.hash_mode, other.by) != (first.p, first.hash_mode, first.by):
            raise ValueError("only sketches with equal parameters can be merged")
        union = union.unionByName(other.registers)
    registers = union.groupBy(*first.by, "idx").agg(F.max("rho").alias("rho"))
    return HyperLogLog(registers, first.p, first.by, first.hash_mode)


def hll_fold(sketch: HyperLogLog, q: int) -> HyperLogLog:
    """The registers a direct build at the lower precision q would give.

    The low p - q bits of idx become the leading bits of the hash rest, so they decide rho
    unless they are all zero.
    """
    check_hll(q)
    if q > sketch.p:
        raise ValueError("precision can only be lowered; rebuild from the rows to raise it")
    if q == sketch.p:
        return sketch
    idx, rho = folded_register(F.lit(sketch.p - q))
    registers = (
        sketch.registers.select(*sketch.by, idx.alias("idx"), rho.alias("rho"))
        .groupBy(*sketch.by, "idx")
        .agg(F.max("rho").alias("rho"))
    )
    return HyperLogLog(registers, q, sketch.by, sketch.hash_mode)


def folded_register(s: Column) -> tuple[Column, Column]:
    """idx and rho of a register once its s low index bits are given up."""
    low = F.col("idx").bitwiseAND(F.call_function("shiftleft", F.lit(1), s) - 1)
    rho = F.when(low == 0, s + F.col("rho")).otherwise(s + 1 - F.length(F.bin(low.cast("bigint"))))
    return F.call_function("shiftright", F.col("idx"), s).cast("int"), rho.cast("int")


def hll_estimate(sketch: HyperLogLog) -> DataFrame:
    """(by..., estimate, relative_error, precision, memory_bytes); 0 for an empty ungrouped input."""
    m = float(1 << sketch.p)
    parts = sketch.registers.groupBy(*sketch.by).agg(
        F.count(F.lit(1)).alias("_used"),
        F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)).alias("_inverse"),
    )
    zeros = F.lit(m) - F.col("_used")
    estimate = hll_estimate_of(
        F.col("_inverse") + zeros, zeros, F.lit(m), F.lit(hll_alpha(sketch.p))
    )
    return parts.select(
        *sketch.by,
        estimate.alias("estimate"),
        hll_relative_error(sketch.p).alias("relative_error"),
        F.lit(sketch.p).alias("precision"),
        hll_memory_bytes(sketch.p).alias("memory_bytes"),
    )


def hll_running(df: DataFrame, key: str, bucket: str, p: int, by: Sequence[str] = (),
                hash_mode: str = "md5", chunk: str = "64 days") -> DataFrame:
    """(by..., bucket, estimate): distinct keys since the start, at the end of each bucket (a time, or a number).

    Per register the running maximum over buckets is turned into increments of the inverse sum and of the used
    count; these add up per bucket, so no dense bucket x register grid is built. Both runs are scans by chunks of time.
    """
    number = isinstance(df.schema[bucket].dataType, T.IntegralType)
    length = 64 if number else interval_seconds(chunk) * 1_000_000
    at = F.col(bucket).cast("bigint") if number else epoch_micros(F.col(bucket))
    per_bucket = hll_build(df, key, p, [*by, bucket], hash_mode).registers.withColumn("_at", at)
    grown = running(per_bucket, [*by, "idx"], "_at", largest={"_before": "rho"}, chunk=length, before=True)
    old = F.coalesce(F.col("_before"), F.lit(0))
    new = F.greatest(F.col("rho"), old)
    power = lambda r: F.pow(F.lit(2.0), -r)
    steps = grown.groupBy(*by, bucket, "_at").agg(
        F.sum(power(new) - power(old)).alias("_inverse_step"),
        F.sum(F.when(F.col("_before").isNull(), 1).otherwise(0)).alias("_used_step"),
    )
    m = float(1 << p)
    return (
        running(steps, by, "_at", sums={"_inverse": "_inverse_step", "_used": "_used_step"}, chunk=length)
        .withColumns({"_inverse": F.lit(m) + F.col("_inverse"), "_zeros": F.lit(m) - F.col("_used")})
        .select(
            *by, bucket,
            hll_estimate_of(F.col("_inverse"), F.col("_zeros"), F.lit(m), F.lit(hll_alpha(p)))
            .alias("estimate"),
        )
    )


def hll_accuracy(df: DataFrame, key: str, precisions: Sequence[int] = (10, 12, 14),
                 hash_mode: str = "md5") -> DataFrame:
    """(precision, estimate, exact_count, error, relative_error): one register build, folded down."""
    finest = hll_build(df, key, max(precisions), hash_mode=hash_mode)
    exact = keyed(df, key).agg(F.count_distinct("key")).scalar()
    answers = [hll_estimate(hll_fold(finest, p)) for p in precisions]
    union = answers[0]
    for more in answers[1:]:
        union = union.unionByName(more)
    return (
        union.withColumn("exact_count", exact)
        .withColumn(
            "error",
            F.abs(F.col("estimate") - F.col("exact_count"))
            / F.greatest(F.col("exact_count"), F.lit(1)),
        )
        .select("precision", "estimate", "exact_count", "error", "relative_error")
    )


def approx_distinct_native(df: DataFrame, key: str, p: int, by: Sequence[str] = ()) -> DataFrame:
    """Spark's own HLL++ and DataSketches estimates at the same size (other hashes)."""
    check_hll(p)
    rsd = 1.04 / (1 << p) ** 0.5
    sketch_p = min(max(p, 4), 21)
    return keyed(df, key, *by).groupBy(*by).agg(
        F.approx_count_distinct("key", rsd).alias("hllpp_estimate"),
        F.hll_sketch_estimate(F.hll_sketch_agg("key", sketch_p)).alias("datasketch_estimate"),
    )
