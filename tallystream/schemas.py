"""Row types exchanged between operators."""

from __future__ import annotations

EVENT = "key string, ts timestamp"

# One row per worker and report.
METRICS = (
    "worker_id string, ts timestamp, template string, event_count bigint, "
    "cms_width int, cms_depth int, cms_total_count bigint, cms_error_estimate double, "
    "hll_precision int, hll_cardinality bigint, hll_relative_error double, "
    "mg_k int, mg_heavy_hitters array<struct<item:string,count:bigint>>, "
    "mg_window_total bigint, mg_error_bound double, "
    "p50_latency_ms double, p95_latency_ms double, p99_latency_ms double, "
    "memory_mb double, memory_percent double, cpu_percent double"
)

CONTROLLER_LOG = "ts timestamp, worker_id string, message string"
ROUTING_LOG = "ts timestamp, query_type string, routed_to string, score double"
COMMAND = "worker_id string, ts timestamp, action string, template string, k int"
