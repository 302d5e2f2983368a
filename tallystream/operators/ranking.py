"""Weighted ranking of workers per query type."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.numbers import number_or, round_half_up
from tallystream.templates import QUERY_PROFILES, profile, template_value


@dataclass(frozen=True)
class Weights:
    """Accuracy, latency and memory weight of the score."""

    accuracy: float = 0.5
    latency: float = 0.3
    memory: float = 0.2


@dataclass(frozen=True)
class Request:
    """A query to place; accuracy and latency target default to its type's profile."""

    query_type: str = "frequency"
    alpha_q: float | None = None
    latency_sla_ms: float | None = None

    @property
    def accuracy(self) -> float:
        return profile(self.query_type).accuracy if self.alpha_q is None else self.alpha_q

    @property
    def latency(self) -> float:
        default = profile(self.query_type).latency_sla_ms
        return default if self.latency_sla_ms is None else self.latency_sla_ms


ALL_TYPES = tuple(Request(q.query_type) for q in QUERY_PROFILES)


def node_score(alpha_q: Column, latency_sla_ms: Column, weights: Weights = Weights()) -> Column:
    """Score of a metrics row: capability per demanded accuracy, less latency and memory terms.

    The latency term reads the p99; a missing one counts as 1 ms, missing memory as 0.
    """
    capability = template_value(F.coalesce("template", F.lit("")), "capability")
    latency = F.greatest(number_or("p99_latency_ms", 1.0), F.lit(0.001))
    memory = number_or("memory_percent", 0.0) / F.lit(100.0)
    return (
        F.lit(weights.accuracy) * (capability / F.greatest(alpha_q, F.lit(1e-6)))
        - F.lit(weights.latency) * (latency / F.greatest(latency_sla_ms, F.lit(1.0)))
        - F.lit(weights.memory) * memory
    )


def router_scores(
    live: DataFrame, requests: Iterable[Request] = ALL_TYPES, weights: Weights = Weights()
) -> DataFrame:
    """The live rows once per request, with query_type and score."""
    wanted = F.array(*[
        F.struct(
            F.lit(r.query_type).alias("query_type"),
            F.lit(float(r.accuracy)).alias("alpha_q"),
            F.lit(float(r.latency)).alias("latency_sla_ms"),
        )
        for r in requests
    ])
    placed = live.withColumn("_r", F.explode(wanted)).select(*live.columns, "_r.*")
    return placed.withColumn("score", node_score(F.col("alpha_q"), F.col("latency_sla_ms"), weights))


def rank_nodes(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds `rank` per query type, best first (ties: worker_id). One row per live worker is ranked."""
    order = Window.partitionBy(*by, "query_type").orderBy(F.col("score").desc(), "worker_id")
    return scores.withColumn("rank", F.row_number().over(order))


def route(
    live: DataFrame, requests: Iterable[Request] = ALL_TYPES, weights: Weights = Weights(),
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., query_type, alpha_q, latency_sla_ms, routed_to, score): the best worker per request.

    An aggregation with map-side combine; no row for an empty cluster.
    """
    scores = router_scores(live, requests, weights)
    best = F.min_by(F.struct("worker_id", "score"), F.struct(-F.col("score"), F.col("worker_id")))
    return (
        scores.groupBy(*by, "query_type", "alpha_q", "latency_sla_ms")
        .agg(best.alias("_best"))
        .select(
            *by, "query_type", "alpha_q", "latency_sla_ms",
            F.col("_best.worker_id").alias("routed_to"), F.col("_best.score").alias("score"),
        )
    )


def routing_log(metrics: DataFrame, requests: Iterable[Request] = ALL_TYPES) -> DataFrame:
    """(ts, query_type, routed_to, score): the decision per request at every report time."""
    placed = route(metrics, requests, by=["ts"])
    return placed.select("ts", "query_type", "routed_to", round_half_up(F.col("score"), 4).alias("score"))


def node_scores(live: DataFrame, query_type: str = "frequency") -> DataFrame:
    """All live workers for one query type, best first, scores with 4 digits."""
    ranked = rank_nodes(router_scores(live, [Request(query_type)]))
    return ranked.select(
        "rank", "query_type", "worker_id", round_half_up(F.col("score"), 4).alias("score"),
        "template", "p99_latency_ms", "memory_percent",
    )
