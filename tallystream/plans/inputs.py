"""The key streams and the metrics table that the catalogue's queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.numbers import epoch_micros
from tallystream.operators.control import Thresholds
from tallystream.operators.reports import periodic_metrics
from tallystream.plans import sql
from tallystream.session import read_table
from tallystream.templates import TEMPLATE_NAMES

TICK = "6 hours"
TICK_MICROS = 6 * 3600 * 1_000_000
COOLDOWN = "18 hours"
# Limits at which all three rules select rows of the derived metrics table.
THRESHOLDS = Thresholds(latency_ms=200.0, memory_percent=55.0, error=0.001)


def user_events(spark: SparkSession, directory: str) -> DataFrame:
    """events with its key stream `key` (the user) and `k` out of the JSON properties."""
    events = read_table(spark, directory, "events")
    return events.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("key"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def dirty_events(spark: SparkSession, directory: str) -> DataFrame:
    """user_events with null and empty keys, null groups, times and values, chosen by `k`."""
    k = F.col("k")
    return user_events(spark, directory).select(
        "event_id", "k",
        F.when(k >= 10, F.col("key")).when(k >= 5, F.lit("")).alias("key"),
        F.when(k % 7 != 0, F.col("event_type")).alias("event_type"),
        F.when(k % 11 != 0, F.col("ts")).alias("ts"),
        F.when((k % 13 != 0) & (k % 7 != 0), F.col("value")).alias("value"),
    )


def part_lines(spark: SparkSession, directory: str) -> DataFrame:
    """lineitem with its key stream `key` (the part)."""
    lines = read_table(spark, directory, "lineitem")
    return lines.withColumn("key", F.col("l_partkey").cast("string"))


def worker_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """Metrics per event type and six-hour tick; the template changes from tick to tick."""
    cycle = F.array(*[F.lit(t) for t in TEMPLATE_NAMES])
    turn = F.pmod(F.floor(epoch_micros(F.col("ts")) / TICK_MICROS), F.lit(3)).cast("int")
    cents = F.least(F.round(F.col("value") * 100).cast("bigint"), F.lit(10_000))
    return periodic_metrics(
        user_events(spark, directory), "event_type", "ts", "event_id", "value", TICK,
        template=F.get(cycle, turn),
        memory_percent=F.sum("k") / F.count(F.lit(1)),
        cpu_percent=F.sum(cents) / F.lit(100.0) / F.count(F.lit(1)),
    )


# ---- the same in SQL ------------------------------------------------------------------------

EVENTS_SQL = (
    "select event_id, ts, cast(user_id as varchar) as key, event_type, value, "
    "json_extract_string(props, '$.k')::int as k from events"
)
DIRTY_SQL = (
    "select event_id, k, case when k >= 10 then key when k >= 5 then '' end as key, "
    "case when k % 7 <> 0 then event_type end as event_type, case when k % 11 <> 0 then ts end as ts, "
    f"case when k % 13 <> 0 and k % 7 <> 0 then value end as value from ({EVENTS_SQL})"
)
LINES_SQL = "select *, cast(l_partkey as varchar) as key from lineitem"


def percentile_sql(values: str, n: str, p: int) -> str:
    return f"{values}[(least({n} * {p} // 100, {n} - 1) + 1)::int]"


def metrics_steps() -> dict[str, str]:
    latest = (
        "select worker_id, tick, list_sort(list(value)) as vals, count(*) as samples from ticked group by 1, 2"
    )
    return {
        "ev": EVENTS_SQL,
        "ticked": "select *, event_type as worker_id, time_bucket(interval '6 hours', ts) as tick from ev",
        "loads": (
            "select worker_id, tick, count(*) as n, sum(k)::bigint / count(*) as memory_percent, "
            "sum(least(round(value * 100)::bigint, 10000))::bigint / 100.0::double / count(*) as cpu_percent "
            "from ticked group by 1, 2"
        ),
        "latest": latest,
        "tpl": sql.template_values(),
        "named": (
            "select l.*, vals, samples, "
            "(sum(n) over (partition by l.worker_id order by l.tick))::bigint as event_count, "
            "['low', 'medium', 'high'][(epoch_us(l.tick) // 21600000000 % 3 + 1)::int] as template "
            "from loads l join latest using (worker_id, tick)"
        ),
        "metrics": (
            "select worker_id, tick as ts, template, event_count, cms_width, cms_depth, "
            "event_count as cms_total_count, "
            f"{sql.rhu(f'{sql.E} / cms_width * event_count', 2)} as cms_error_estimate, "
            f"hll_precision, {sql.rhu(sql.relative_error('hll_precision'), 6)} as hll_relative_error, "
            f"mg_k, n as mg_window_total, {sql.rhu('n / mg_k', 2)} as mg_error_bound, "
            f"{percentile_sql('vals', 'samples', 50)} as p50_latency_ms, "
            f"{percentile_sql('vals', 'samples', 95)} as p95_latency_ms, "
            f"{percentile_sql('vals', 'samples', 99)} as p99_latency_ms, "
            f"{sql.memory_mb('cms_width', 'cms_depth', 'hll_precision', 'mg_k')} as memory_mb, "
            "memory_percent, cpu_percent, capability "
            "from named join tpl using (template)"
        ),
    }


METRICS_COLUMNS = (
    "worker_id, ts, template, event_count, cms_width, cms_depth, cms_total_count, "
    "cms_error_estimate, hll_precision, hll_relative_error, mg_k, mg_window_total, mg_error_bound, "
    "p50_latency_ms, p95_latency_ms, p99_latency_ms, memory_mb, memory_percent, cpu_percent"
)
