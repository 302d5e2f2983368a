"""Reads over the append-only metrics and log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.numbers import epoch_micros, interval_seconds, round_half_up
from tallystream.operators.ordered import last_n_per_group, previous_row, top_k

# Snapshot life time, history length and log lengths.
SNAPSHOT_TTL = "30 seconds"
HISTORY_LENGTH = 60
CONTROLLER_LOG_CAP = 100
ROUTING_LOG_CAP = 200


def cluster_metrics(
    metrics: DataFrame, as_of: Column | None = None, ttl: str = SNAPSHOT_TTL
) -> DataFrame:
    """Latest snapshot per worker, unless older than `ttl` at `as_of` (default: the newest row)."""
    interval_seconds(ttl)
    life = F.expr(f"interval {ttl}")
    # stale rows are dropped before the aggregation; the newest row of a live worker is not stale
    if as_of is None:
        live = metrics.where(F.col("ts") > metrics.select(F.max("ts") - life).scalar())
    else:
        live = metrics.where((F.col("ts") > as_of - life) & (F.col("ts") <= as_of))
    newest = F.max_by(F.struct(*metrics.columns), F.col("ts")).alias("_row")
    return live.groupBy(F.col("worker_id").alias("_worker")).agg(newest).select("_row.*")


def latency_history(metrics: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """(worker_id, position, ts, p99_latency_ms): the last n reports, oldest first."""
    rows = metrics.select("worker_id", "ts", "p99_latency_ms")
    recent = last_n_per_group(rows, ["worker_id"], "ts", "p99_latency_ms", n)
    # at most n rows per worker are left
    position = F.row_number().over(Window.partitionBy("worker_id").orderBy("ts", "p99_latency_ms"))
    return recent.withColumn("position", position)


def latency_history_arrays(metrics: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """(worker_id, latency_history array<double>), oldest first."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "p99_latency_ms")))
    return latency_history(metrics, n).groupBy("worker_id").agg(
        F.transform(ordered, lambda x: x["p99_latency_ms"]).alias("latency_history")
    )


def log_tail(log: DataFrame, n: int, cap: int, tie: str) -> DataFrame:
    """The last n of the newest `cap` rows, oldest first."""
    if not 1 <= n <= cap:
        raise ValueError(f"n must be between 1 and {cap}")
    return top_k(log, [F.col("ts").desc(), F.col(tie).desc()], n).orderBy("ts", tie)


def controller_log_tail(log: DataFrame, n: int = 20) -> DataFrame:
    return log_tail(log, n, CONTROLLER_LOG_CAP, "worker_id")


def query_log_tail(log: DataFrame, n: int = 50) -> DataFrame:
    return log_tail(log, n, ROUTING_LOG_CAP, "query_type")


def sketch_params(live: DataFrame) -> DataFrame:
    return live.select("worker_id", "template", "cms_width", "cms_depth", "hll_precision", "mg_k")


def cluster_summary(live: DataFrame) -> DataFrame:
    """Worker count, mean load, and the worker with the lowest positive p99 (ties: worker_id)."""
    missing = F.coalesce(F.nullif("p99_latency_ms", F.lit(0.0)), F.lit(float("inf")))
    kept = ["worker_id", "template", "p99_latency_ms", "cms_total_count", "cms_error_estimate"]
    best = F.min_by(F.struct(*kept), F.struct(missing.alias("rank"), F.col("worker_id")))
    mean = lambda c: round_half_up(F.avg(F.coalesce(c, F.lit(0.0))), 1)
    return live.agg(
        F.count(F.lit(1)).alias("worker_count"),
        mean("memory_percent").alias("avg_memory_percent"),
        mean("cpu_percent").alias("avg_cpu_percent"),
        best.alias("best"),
    ).select(
        "worker_count", "avg_memory_percent", "avg_cpu_percent",
        F.col("best.worker_id").alias("best_worker"),
        F.col("best.template").alias("best_template"),
        F.col("best.p99_latency_ms").alias("best_p99_latency_ms"),
        F.col("best.cms_total_count").alias("best_total_count"),
        F.col("best.cms_error_estimate").alias("best_error_estimate"),
    )


def throughput(metrics: DataFrame, chunk: str = "1 day") -> DataFrame:
    """(worker_id, ts, cms_total_count, events_per_sec) between consecutive reports; null on a
    worker's first report and after a reset (the total drops)."""
    rows = previous_row(
        metrics.select("worker_id", "ts", "cms_total_count"), ["worker_id"], "ts",
        {"ts": "_ts", "cms_total_count": "_total"}, chunk, tie=["cms_total_count"],
    )
    gained = F.col("cms_total_count") - F.col("_total")
    seconds = (epoch_micros(F.col("ts")) - epoch_micros(F.col("_ts"))) / F.lit(1e6)
    rate = F.when((gained >= 0) & (seconds > 0), gained / seconds)
    return rows.select("worker_id", "ts", "cms_total_count", rate.alias("events_per_sec"))
