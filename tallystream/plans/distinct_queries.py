"""HyperLogLog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.numbers import time_bucket
from tallystream.operators.hll import (
    HyperLogLog, approx_distinct_native, hll_accuracy, hll_build, hll_estimate, hll_fold, hll_merge, hll_running,
)
from tallystream.plans import sql
from tallystream.plans.inputs import EVENTS_SQL, LINES_SQL, part_lines, user_events

P = 12


def _built(spark: SparkSession, directory: str, p: int = P, **options) -> HyperLogLog:
    return hll_build(part_lines(spark, directory), "key", p, **options)


def hll_registers(spark: SparkSession, directory: str) -> DataFrame:
    return _built(spark, directory).registers


def hll_cardinality(spark: SparkSession, directory: str) -> DataFrame:
    return hll_estimate(_built(spark, directory))


def hll_fold_query(spark: SparkSession, directory: str) -> DataFrame:
    """Registers at p = 14 folded down to 10."""
    return hll_fold(_built(spark, directory, 14), 10).registers


def hll_merge_query(spark: SparkSession, directory: str) -> DataFrame:
    lines = part_lines(spark, directory)
    returned = hll_build(lines.where(F.col("l_returnflag") == "R"), "key", P)
    others = hll_build(lines.where(F.col("l_returnflag") != "R"), "key", P)
    return hll_merge(returned, others).registers


def hll_by_group(spark: SparkSession, directory: str) -> DataFrame:
    by = ["l_returnflag", "l_linestatus"]
    return hll_estimate(_built(spark, directory, by=by)).select(*by, "estimate")


def hll_accuracy_query(spark: SparkSession, directory: str) -> DataFrame:
    return hll_accuracy(part_lines(spark, directory), "key")


def approx_distinct_native_query(spark: SparkSession, directory: str) -> DataFrame:
    return approx_distinct_native(part_lines(spark, directory), "key", P, ["l_returnflag"])


def approx_distinct_check(spark: SparkSession, directory: str) -> DataFrame:
    """Spark's estimates against exact distinct counts: groups that are off by more than five standard errors."""
    lines = part_lines(spark, directory)
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("key").alias("exact"))
    near = approx_distinct_native(lines, "key", P, ["l_returnflag"])
    allowed = 5 * 1.04 / (1 << P) ** 0.5 * F.col("exact") + 1
    off = [F.abs(F.col(c) - F.col("exact")) > allowed for c in ("hllpp_estimate", "datasketch_estimate")]
    return exact.join(near, "l_returnflag").select(
        "l_returnflag", "exact", (off[0].cast("bigint") + off[1].cast("bigint")).alias("violations"))


def running_distinct(spark: SparkSession, directory: str) -> DataFrame:
    """Users seen since the start, at the end of each day."""
    daily = user_events(spark, directory).withColumn("day", time_bucket(F.col("ts"), "1 day"))
    return hll_running(daily, "key", "day", 10)


def running_distinct_by_group(spark: SparkSession, directory: str) -> DataFrame:
    daily = user_events(spark, directory).withColumn("day", time_bucket(F.col("ts"), "1 day"))
    return hll_running(daily, "key", "day", 10, ["event_type"])


QUERIES = {
    "hll_registers": hll_registers,
    "hll_cardinality": hll_cardinality,
    "hll_fold": hll_fold_query,
    "hll_merge": hll_merge_query,
    "hll_by_group": hll_by_group,
    "hll_accuracy": hll_accuracy_query,
    "approx_distinct_native": approx_distinct_native_query,
    "approx_distinct_check": approx_distinct_check,
    "running_distinct": running_distinct,
    "running_distinct_by_group": running_distinct_by_group,
}

_REGS = {"src": LINES_SQL, "regs": sql.registers("src", P)}
_GROUP = ["l_returnflag", "l_linestatus"]


def _running(by: list[str]) -> str:
    keys = [*by, "day"]
    same = "".join(f" and a.{c} = b.{c}" for c in by)
    columns = "".join(f"a.{c}, " for c in by)
    return sql.with_steps(
        {
            "src": f"select *, date_trunc('day', ts)::timestamp as day from ({EVENTS_SQL})",
            "daily": sql.registers("src", 10, keys),
            "days": f"select distinct {', '.join(keys)} from daily",
            "regs": (
                f"select {columns}a.day, b.idx, max(b.rho) as rho from days a "
                f"join daily b on b.day <= a.day{same} group by all"
            ),
        },
        sql.hll_estimates("regs", 10, keys),
    )


def _accuracy() -> str:
    steps = {"src": LINES_SQL, "exact": "select count(distinct key) as exact_count from src"}
    parts = []
    for p in (10, 12, 14):
        steps[f"regs{p}"] = sql.registers("src", p)
        steps[f"est{p}"] = sql.hll_estimates(f"regs{p}", p)
        parts.append(
            f"select {p} as precision, estimate, exact_count, "
            "abs(estimate - exact_count) / greatest(exact_count, 1) as error, "
            f"{sql.relative_error(p)} as relative_error from est{p}, exact"
        )
    return sql.with_steps(steps, " union all ".join(parts))


ORACLES = {
    "approx_distinct_check": (
        "select l_returnflag, count(distinct l_partkey) as exact, 0::bigint as violations from lineitem group by 1"
    ),
    "hll_registers": sql.with_steps(_REGS, "select idx, rho from regs"),
    "hll_merge": sql.with_steps(_REGS, "select idx, rho from regs"),
    "hll_fold": sql.with_steps(
        {"src": LINES_SQL, "regs": sql.registers("src", 10)}, "select idx, rho from regs"
    ),
    "hll_cardinality": sql.with_steps(
        {**_REGS, "est": sql.hll_estimates("regs", P)},
        f"select estimate, {sql.relative_error(P)} as relative_error, {P} as precision, "
        f"{1 << P}::bigint as memory_bytes from est",
    ),
    "hll_by_group": sql.with_steps(
        {"src": LINES_SQL, "regs": sql.registers("src", P, _GROUP)}, sql.hll_estimates("regs", P, _GROUP)
    ),
    "hll_accuracy": _accuracy(),
    "running_distinct": _running([]),
    "running_distinct_by_group": _running(["event_type"]),
}
