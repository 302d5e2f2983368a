"""The questions a user asks, as functions over sketch and metrics tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions.formulas import cms_delta, cms_epsilon, cms_error, mg_error
from tallystream.functions.numbers import round_half_up
from tallystream.operators.cms import CountMin, cms_from_counts, cms_lookup, cms_query, cms_total
from tallystream.operators.control import controller_log, override_commands
from tallystream.operators.heavy_hitters import mg_truncate, top_n, top_share
from tallystream.operators.hll import HyperLogLog, hll_build, hll_estimate
from tallystream.operators.keys import key_counts
from tallystream.operators.ranking import Request, node_scores, rank_nodes, route, router_scores
from tallystream.operators.snapshots import (
    SNAPSHOT_TTL, cluster_metrics, controller_log_tail, latency_history_arrays, query_log_tail, sketch_params,
)
from tallystream.templates import DEFAULT_TEMPLATE, template


@dataclass(frozen=True)
class SketchSet:
    """The three sketches of one key stream at one template, and the live workers to place
    queries on. The tables may be freshly planned or read from storage."""

    cms: CountMin
    hll: HyperLogLog
    summary: DataFrame
    window_total: Column
    mg_k: int
    live: DataFrame


def build_sketch_set(
    df: DataFrame, key: str, live: DataFrame, template_name: str = DEFAULT_TEMPLATE
) -> SketchSet:
    t = template(template_name)
    counted = key_counts(df, key).where(F.col("n") > 0)
    cms = cms_from_counts(counted, t.cms_width, t.cms_depth)
    return SketchSet(
        cms=cms,
        hll=hll_build(counted, "key", t.hll_p),
        summary=mg_truncate(counted, t.mg_k),
        window_total=counted.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(),
        mg_k=t.mg_k,
        live=live,
    )


def _placed(answer: DataFrame, live: DataFrame, query_type: str) -> DataFrame:
    """Adds routed_to and router_score; both null without live workers."""
    best = route(live, [Request(query_type)]).select(F.struct("routed_to", "score")).scalar()
    return (
        answer.withColumn("_best", best)
        .withColumn("routed_to", F.col("_best.routed_to"))
        .withColumn("router_score", round_half_up(F.col("_best.score"), 4))
        .drop("_best")
    )


def frequency(sketches: SketchSet, key: str) -> DataFrame:
    """One row: the key's estimate, its bound, and where the query is placed."""
    cms = sketches.cms
    total = cms_total(cms).select("total_count").scalar()
    ranked = rank_nodes(router_scores(sketches.live, [Request("frequency")]))
    pairs = F.sort_array(F.collect_list(F.struct(
        "rank", F.col("worker_id").alias("worker"), round_half_up(F.col("score"), 4).alias("score")
    )))
    scores = ranked.agg(F.transform(pairs, lambda x: F.struct(x["worker"], x["score"]))).scalar()
    answer = cms_query(cms, key).select(
        "key", "estimate",
        round_half_up(cms_error(cms.width, total), 2).alias("cms_error_bound"),
        total.alias("cms_total_count"),
        round_half_up(cms_epsilon(cms.width), 5).alias("epsilon"),
        round_half_up(cms_delta(cms.depth), 5).alias("delta"),
    )
    return _placed(answer, sketches.live, "frequency").withColumn("all_scores", scores)


def cardinality(sketches: SketchSet) -> DataFrame:
    answer = hll_estimate(sketches.hll).select(
        F.col("estimate").alias("estimated_cardinality"),
        round_half_up(F.col("relative_error"), 4).alias("relative_error"),
        F.col("precision").alias("hll_precision"),
    )
    return _placed(answer, sketches.live, "cardinality")


def heavy_hitters(sketches: SketchSet, n: int = 10) -> DataFrame:
    """One row with up to n (item, count) pairs, most frequent first."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    pairs = F.sort_array(F.collect_list(F.struct("rank", F.col("key").alias("item"), F.col("est").alias("count"))))
    answer = top_n(sketches.summary, n).agg(
        F.transform(pairs, lambda x: F.struct(x["item"], x["count"])).alias("heavy_hitters")
    ).select(
        "heavy_hitters",
        sketches.window_total.alias("window_total"),
        round_half_up(mg_error(sketches.window_total, sketches.mg_k), 2).alias("error_bound"),
        F.lit(sketches.mg_k).alias("mg_k"),
    )
    return _placed(answer, sketches.live, "heavy_hitters")


def cluster(metrics: DataFrame, as_of: Column | None = None, ttl: str = SNAPSHOT_TTL) -> DataFrame:
    """Live workers with their latency history and the number of live workers."""
    live = cluster_metrics(metrics, as_of, ttl)
    count = live.agg(F.count(F.lit(1))).scalar()
    return live.join(latency_history_arrays(metrics), "worker_id", "left").withColumn("worker_count", count)


def sketches(metrics: DataFrame, as_of: Column | None = None, ttl: str = SNAPSHOT_TTL) -> DataFrame:
    return sketch_params(cluster_metrics(metrics, as_of, ttl))


def router(metrics: DataFrame, query_type: str = "frequency", as_of: Column | None = None,
           ttl: str = SNAPSHOT_TTL) -> DataFrame:
    return node_scores(cluster_metrics(metrics, as_of, ttl), query_type)


def controller_decisions(log: DataFrame, n: int = 20) -> DataFrame:
    return controller_log_tail(log, n)


def routing_decisions(log: DataFrame, n: int = 50) -> DataFrame:
    return query_log_tail(log, n)


def set_params(overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commands, log rows, rejected rows) of manual template overrides."""
    commands, rejected = override_commands(overrides)
    return commands.select("worker_id", "ts", "action", "template", "k"), controller_log(commands), rejected


def live_answers(sketches: SketchSet) -> DataFrame:
    """One row: distinct keys, the top key with its share of the window, and its frequency by the
    Count-Min sketch."""
    leader = cms_lookup(sketches.cms, top_share(sketches.summary, sketches.window_total, 1))
    top = leader.agg(F.first(F.struct("key", "share", "estimate"))).scalar()
    total = cms_total(sketches.cms).select("total_count").scalar()
    return (
        hll_estimate(sketches.hll)
        .withColumn("_top", top)
        .select(
            F.col("estimate").alias("distinct_keys"),
            F.col("relative_error").alias("distinct_relative_error"),
            F.col("_top.key").alias("top_key"),
            round_half_up(F.col("_top.share"), 1).alias("top_share_percent"),
            F.col("_top.estimate").alias("top_frequency"),
            cms_error(sketches.cms.width, total).alias("frequency_error_bound"),
        )
    )
