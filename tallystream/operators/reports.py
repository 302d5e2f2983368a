"""Reports that combine the sketches: one worker's snapshot, all templates side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallystream.functions.formulas import (
    cms_delta, cms_epsilon, cms_error, hll_relative_error, mg_error, sketch_memory_mb,
)
from tallystream.functions.numbers import interval_seconds, round_half_up, time_bucket
from tallystream.operators.cms import cms_cells, cms_from_counts
from tallystream.operators.epochs import estimate_by_template, own_registers
from tallystream.operators.heavy_hitters import mg_truncate, top_n
from tallystream.operators.hll import folded_register, hll_build
from tallystream.operators.keys import key_counts, keyed
from tallystream.operators.ordered import join_on, last_n_per_group, top_k
from tallystream.operators.percentiles import exact_percentiles, rolling_percentiles
from tallystream.schemas import METRICS
from tallystream.templates import TEMPLATES, template_rows, template_value

# Samples behind a report's percentiles, listed candidates, events in the window.
REPORT_SAMPLES = 500
REPORT_TOP = 20
REPORT_WINDOW = 10_000


def multi_template_report(df: DataFrame, key: str) -> DataFrame:
    """One row per template: bounds, estimates, true values and memory over the same keys.

    The table is scanned and shuffled by key once. Sketches are built at the finest
    template only; the coarser ones are folded out of it, which is exact (nested power-of-two widths, fewer
    rows, fewer index bits).
    """
    finest = TEMPLATES[-1]
    counts = key_counts(df, key)
    counted = counts.where(F.col("n") > 0)
    leader = top_k(counted, [F.col("n").desc(), F.col("key")], 1)
    per_template = F.explode(template_rows()).alias("t")

    # Count-Min: fold the finest cells into every template, and mark the leader's cells
    cells = cms_from_counts(counted, finest.cms_width, finest.cms_depth).cells
    folded = (
        cells.select("row_id", "col_id", "cnt", per_template)
        .where(F.col("row_id") < F.col("t.cms_depth"))
        .select(
            "t.template", "row_id",
            F.col("col_id").bitwiseAND(F.col("t.cms_width") - 1).alias("col_id"), "cnt",
        )
        .groupBy("template", "row_id", "col_id")
        .agg(F.sum("cnt").alias("cnt"))
    )
    marks = (
        cms_cells(leader, "key", finest.cms_width, finest.cms_depth, ["n"])
        .select("key", "n", "row_id", "col_id", per_template)
        .where(F.col("row_id") < F.col("t.cms_depth"))
        .select(
            F.col("key").alias("top_key"), F.col("n").alias("top_count"), "t.template", "row_id",
            F.col("col_id").bitwiseAND(F.col("t.cms_width") - 1).alias("col_id"),
        )
    )
    # the leader's cells: depth rows per template
    frequency = (
        folded.join(F.broadcast(marks), ["template", "row_id", "col_id"], "left")
        .groupBy("template")
        .agg(
            F.sum(F.when(F.col("row_id") == 0, F.col("cnt"))).alias("total_count"),
            F.max("top_key").alias("top_key"),
            F.max("top_count").alias("top_count"),
            F.min(F.when(F.col("top_key").isNotNull(), F.col("cnt"))).alias("top_estimate"),
        )
    )

    # HyperLogLog: fold the finest registers into every template
    registers = hll_build(counted, "key", finest.hll_p).registers
    idx, rho = folded_register(F.lit(finest.hll_p) - F.col("hll_p"))
    folded_registers = (
        registers.select("idx", "rho", per_template)
        .select("idx", "rho", "t.template", "t.hll_p")
        .select("template", idx.alias("idx"), rho.alias("rho"))
        .groupBy("template", "idx")
        .agg(F.max("rho").alias("rho"), F.lit(0).alias("n"))
    )
    distinct = estimate_by_template(folded_registers, []).drop("total_count")
    exact = counts.agg(F.sum(F.when(F.col("n") > 0, 1))).scalar()

    value = lambda field: template_value(F.col("template"), field)
    sizes = [value(f) for f in ("cms_width", "cms_depth", "hll_p", "mg_k")]
    return frequency.join(distinct, "template").select(
        "template", "total_count",
        cms_epsilon(sizes[0]).alias("epsilon"),
        cms_delta(sizes[1]).alias("delta"),
        cms_error(sizes[0], F.col("total_count")).alias("cms_error_bound"),
        "top_key", "top_count", "top_estimate",
        F.col("estimate").alias("hll_estimate"),
        hll_relative_error(sizes[2]).alias("hll_relative_error"),
        exact.alias("exact_distinct"),
        mg_error(F.col("total_count"), sizes[3]).alias("mg_error_bound"),
        sketch_memory_mb(*sizes).alias("memory_mb"),
    )


def sketch_report(
    df: DataFrame,
    key: str,
    worker: str,
    template: Column,
    ts: str,
    tie: str,
    latency: str,
    window: int = REPORT_WINDOW,
    samples: int = REPORT_SAMPLES,
    top: int = REPORT_TOP,
) -> DataFrame:
    """One snapshot row per worker: parameters, totals, bounds, estimates, heavy hitters, percentiles.

    `template` is an expression over the rows, constant per worker.
    """
    rows = df.select(
        F.col(worker).alias("worker_id"), template.alias("template"), key, ts, tie, latency
    )
    by = ["worker_id"]
    sketched = own_registers(keyed(rows, key, "worker_id", "template"), by)
    totals = estimate_by_template(sketched, by).withColumnRenamed("total_count", "cms_total_count")

    # the window holds the latest countable events: rows without a key were never added to it
    countable = keyed(rows, key, "worker_id", "template", ts, tie)
    recent = last_n_per_group(countable, by, ts, tie, window)
    recent_counts = key_counts(recent, "key", ["worker_id", "template"])
    window_totals = recent_counts.groupBy("worker_id").agg(F.sum("n").alias("mg_window_total"))
    largest = max(t.mg_k for t in TEMPLATES)
    summary = mg_truncate(recent_counts, largest, ["worker_id", "template"],
                          own_k=template_value(F.col("template"), "mg_k"))
    listed = top_n(summary, top, ["worker_id", "template"]).groupBy("worker_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "est"))).alias("_top")
    )
    latencies = rolling_percentiles(rows, latency, ts, tie, by, samples)

    value = lambda field: template_value(F.col("template"), field)
    sizes = [value(f) for f in ("cms_width", "cms_depth", "hll_p", "mg_k")]
    hitters = F.transform(
        F.col("_top"), lambda x: F.struct(x["key"].alias("item"), x["est"].alias("count"))
    )
    return (
        join_on(join_on(join_on(totals, window_totals, by, "left"), listed, by, "left"), latencies, by, "left")
        .withColumn("mg_window_total", F.coalesce("mg_window_total", F.lit(0)))
        .select(
            "worker_id", "template",
            sizes[0].alias("cms_width"), sizes[1].alias("cms_depth"), "cms_total_count",
            round_half_up(cms_error(sizes[0], F.col("cms_total_count")), 2).alias("cms_error_estimate"),
            sizes[2].alias("hll_precision"),
            F.col("estimate").alias("hll_cardinality"),
            round_half_up(hll_relative_error(sizes[2]), 6).alias("hll_relative_error"),
            sizes[3].alias("mg_k"),
            hitters.alias("mg_heavy_hitters"),
            "mg_window_total",
            round_half_up(mg_error(F.col("mg_window_total"), sizes[3]), 2).alias("mg_error_bound"),
            round_half_up(F.col("p50"), 4).alias("p50_latency_ms"),
            round_half_up(F.col("p95"), 4).alias("p95_latency_ms"),
            round_half_up(F.col("p99"), 4).alias("p99_latency_ms"),
            sketch_memory_mb(*sizes).alias("memory_mb"),
        )
    )


def periodic_metrics(
    df: DataFrame,
    worker: str,
    ts: str,
    tie: str,
    latency: str,
    tick: str,
    template: Column,
    memory_percent: Column,
    cpu_percent: Column,
) -> DataFrame:
    """Metrics table: one row per worker and tick, over what the worker saw until the tick.

    `template` is an expression over the tick's start `ts`; the two loads are aggregates over the
    rows of a tick. Percentiles are over all samples of the tick.
    """
    interval_seconds(tick)
    rows = df.withColumn("worker_id", F.col(worker)).withColumn("_tick", time_bucket(F.col(ts), tick))
    by = ["worker_id", "_tick"]
    loads = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), memory_percent.alias("memory_percent"), cpu_percent.alias("cpu_percent")
    )
    line = Window.partitionBy("worker_id").orderBy("_tick").rowsBetween(Window.unboundedPreceding, 0)
    latencies = exact_percentiles(rows, latency, by)
    named = (
        join_on(loads.withColumn("event_count", F.sum("n").over(line)), latencies, by)
        .withColumn("ts", F.col("_tick"))
        .withColumn("template", template)
    )
    value = lambda field: template_value(F.col("template"), field)
    sizes = [value(f) for f in ("cms_width", "cms_depth", "hll_p", "mg_k")]
    return named.select(
        "worker_id", "ts", "template", "event_count",
        sizes[0].alias("cms_width"), sizes[1].alias("cms_depth"),
        F.col("event_count").alias("cms_total_count"),
        round_half_up(cms_error(sizes[0], F.col("event_count")), 2).alias("cms_error_estimate"),
        sizes[2].alias("hll_precision"),
        round_half_up(hll_relative_error(sizes[2]), 6).alias("hll_relative_error"),
        sizes[3].alias("mg_k"),
        F.col("n").alias("mg_window_total"),
        round_half_up(mg_error(F.col("n"), sizes[3]), 2).alias("mg_error_bound"),
        F.col("p50").alias("p50_latency_ms"),
        F.col("p95").alias("p95_latency_ms"),
        F.col("p99").alias("p99_latency_ms"),
        sketch_memory_mb(*sizes).alias("memory_mb"),
        "memory_percent", "cpu_percent",
    )


def as_snapshots(rows: DataFrame, ts: Column | None = None) -> DataFrame:
    """Report rows in the schema of the metrics history; what a report lacks is null. `ts` stamps
    reports without a time of their own."""
    stamped = rows if ts is None else rows.withColumn("ts", ts)
    wanted = StructType.fromDDL(METRICS).fields
    return stamped.select(*[
        (F.col(f.name) if f.name in stamped.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in wanted
    ])
