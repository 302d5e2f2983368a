"""Queries over metrics: snapshots, ranking, decisions, epochs, and the combined reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.numbers import round_half_up
from tallystream.operators import control, epochs, ranking, reports, snapshots, stored
from tallystream.plans import answers, sql
from tallystream.plans.inputs import (
    COOLDOWN, DIRTY_SQL, EVENTS_SQL, LINES_SQL, METRICS_COLUMNS, THRESHOLDS, TICK, dirty_events, metrics_steps, part_lines,
    percentile_sql, user_events, worker_metrics,
)
from tallystream.staging import FOLDER, scratch_root, staged
from tallystream.templates import QUERY_PROFILES, TEMPLATE_NAMES, TEMPLATES

FREQUENCY_KEY = "42"
REQUESTS = (
    *ranking.ALL_TYPES,
    ranking.Request("range_count"),
    ranking.Request("cardinality", alpha_q=0.5, latency_sla_ms=400.0),
)


def _live(spark: SparkSession, directory: str) -> DataFrame:
    return snapshots.cluster_metrics(worker_metrics(spark, directory), ttl=TICK)


def _decisions(spark: SparkSession, directory: str) -> DataFrame:
    return control.decide(worker_metrics(spark, directory), THRESHOLDS)


def _accepted(spark: SparkSession, directory: str) -> DataFrame:
    return control.apply_cooldown(_decisions(spark, directory), COOLDOWN)


def _overrides(metrics: DataFrame) -> DataFrame:
    """Manual overrides read off the load: a known template on busy ticks, an unknown one on idle ones."""
    cpu = F.col("cpu_percent")
    asked = F.when(cpu > 48, F.lit("low")).when(cpu > 44, F.lit("high")).when(cpu < 41, F.lit("maximal"))
    return metrics.select("worker_id", "ts", asked.alias("template")).where(F.col("template").isNotNull())


# ---- snapshots ------------------------------------------------------------------------------

def cluster_latest(spark: SparkSession, directory: str) -> DataFrame:
    return _live(spark, directory)


def q_cluster(spark: SparkSession, directory: str) -> DataFrame:
    """The live workers with their number, their latency histories as rows."""
    live = answers.cluster(worker_metrics(spark, directory), ttl=TICK)
    return live.select(
        "worker_count", "worker_id", "ts", "template",
        F.posexplode("latency_history").alias("position", "latency_ms"),
    )


def template_latency(spark: SparkSession, directory: str) -> DataFrame:
    """Reports of each template and their mean p99."""
    return worker_metrics(spark, directory).groupBy("template").agg(
        F.count(F.lit(1)).alias("reports"), round_half_up(F.avg("p99_latency_ms"), 6).alias("avg_p99_ms"))


def latency_history(spark: SparkSession, directory: str) -> DataFrame:
    return snapshots.latency_history(worker_metrics(spark, directory))


def controller_log_tail(spark: SparkSession, directory: str) -> DataFrame:
    return answers.controller_decisions(control.controller_log(_accepted(spark, directory)))


def query_log_tail(spark: SparkSession, directory: str) -> DataFrame:
    return answers.routing_decisions(ranking.routing_log(worker_metrics(spark, directory)))


def sketch_params(spark: SparkSession, directory: str) -> DataFrame:
    return answers.sketches(worker_metrics(spark, directory), ttl=TICK)


def cluster_summary(spark: SparkSession, directory: str) -> DataFrame:
    return snapshots.cluster_summary(_live(spark, directory))


def throughput(spark: SparkSession, directory: str) -> DataFrame:
    return snapshots.throughput(worker_metrics(spark, directory))


# ---- ranking --------------------------------------------------------------------------------

def router_scores(spark: SparkSession, directory: str) -> DataFrame:
    """The score of every report, live or not, per query type."""
    scores = ranking.router_scores(worker_metrics(spark, directory))
    return scores.select("worker_id", "ts", "query_type", round_half_up(F.col("score"), 9).alias("score"))


def router_ranking(spark: SparkSession, directory: str) -> DataFrame:
    ranked = ranking.rank_nodes(ranking.router_scores(_live(spark, directory)))
    return ranked.select("query_type", "rank", "worker_id", round_half_up(F.col("score"), 9).alias("score"))


def route_best(spark: SparkSession, directory: str) -> DataFrame:
    """Default profiles, an unknown query type and a request with its own demands."""
    placed = ranking.route(_live(spark, directory), REQUESTS)
    return placed.withColumn("score", round_half_up(F.col("score"), 9))


def node_scores(spark: SparkSession, directory: str) -> DataFrame:
    return answers.router(worker_metrics(spark, directory), "frequency", ttl=TICK)


# ---- decisions ------------------------------------------------------------------------------

def controller_decisions(spark: SparkSession, directory: str) -> DataFrame:
    return _decisions(spark, directory)


def controller_cooldown(spark: SparkSession, directory: str) -> DataFrame:
    return _accepted(spark, directory)


def commands(spark: SparkSession, directory: str) -> DataFrame:
    """Commands of the accepted decisions and of the valid overrides, as messages."""
    manual, _, _ = answers.set_params(_overrides(worker_metrics(spark, directory)))
    automatic = control.command_rows(_accepted(spark, directory))
    return control.command_json(automatic.unionByName(manual))


def rejected_overrides(spark: SparkSession, directory: str) -> DataFrame:
    _, _, rejected = answers.set_params(_overrides(worker_metrics(spark, directory)))
    return rejected.select("worker_id", "ts", "template", "reason")


def template_timeline(spark: SparkSession, directory: str) -> DataFrame:
    return control.template_timeline(worker_metrics(spark, directory), _orders(spark, directory))


def decision_classes(spark: SparkSession, directory: str) -> DataFrame:
    _, manual, _ = answers.set_params(_overrides(worker_metrics(spark, directory)))
    log = control.controller_log(_accepted(spark, directory)).unionByName(manual)
    return control.decision_classes(log)


def dirty_cooldown(spark: SparkSession, directory: str) -> DataFrame:
    """Cooldown over events without a worker or time: what is accepted per worker."""
    events = dirty_events(spark, directory).select(F.col("event_type").alias("worker_id"), "ts", "event_id")
    return control.apply_cooldown(events, COOLDOWN).groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_if(F.col("ts").isNull()).alias("timeless"))


def _orders(spark: SparkSession, directory: str) -> DataFrame:
    """All commands: those of accepted decisions, resizes among them, and valid overrides."""
    metrics = staged(worker_metrics(spark, directory), "metrics")
    manual, _, _ = answers.set_params(_overrides(metrics))
    accepted = control.apply_cooldown(control.decide(metrics, THRESHOLDS), COOLDOWN)
    return staged(control.command_rows(accepted).unionByName(manual), "orders")


def template_epochs(spark: SparkSession, directory: str) -> DataFrame:
    return epochs.template_epochs(user_events(spark, directory), "key", "event_type", "ts", _orders(spark, directory))


def epoch_heavy_hitters(spark: SparkSession, directory: str) -> DataFrame:
    return epochs.epoch_heavy_hitters(user_events(spark, directory), "key", "event_type", "ts", _orders(spark, directory))


def epoch_frequency(spark: SparkSession, directory: str) -> DataFrame:
    """Estimates of a few keys, one of them absent, in every epoch."""
    keys = user_events(spark, directory).where(F.col("event_id") % 200 == 0).select("key").orderBy("key").limit(5)
    keys = keys.unionByName(spark.createDataFrame([("no such key",)], "key string"))
    found = epochs.epoch_frequency(user_events(spark, directory), "key", "event_type", "ts", _orders(spark, directory), keys)
    return found.withColumn("cms_error_bound", round_half_up(F.col("cms_error_bound"), 9))


# ---- reports and answers --------------------------------------------------------------------

def multi_template_report(spark: SparkSession, directory: str) -> DataFrame:
    report = reports.multi_template_report(user_events(spark, directory), "key")
    return report.withColumn("delta", round_half_up(F.col("delta"), 9))


def multi_template_report_parts(spark: SparkSession, directory: str) -> DataFrame:
    report = reports.multi_template_report(part_lines(spark, directory), "key")
    return report.withColumn("delta", round_half_up(F.col("delta"), 9))


def sketch_report(spark: SparkSession, directory: str) -> DataFrame:
    """One report per event type, its heavy hitters as rows."""
    cycle = F.array(*[F.lit(t) for t in TEMPLATE_NAMES])
    own = F.get(cycle, F.pmod(F.length("event_type"), F.lit(3)))
    report = reports.sketch_report(
        user_events(spark, directory), "key", "event_type", own, "ts", "event_id", "value"
    )
    listed = F.posexplode_outer("mg_heavy_hitters").alias("position", "hitter")
    flat = report.select(*[c for c in report.columns if c != "mg_heavy_hitters"], listed)
    return flat.select(
        *[c for c in flat.columns if c not in ("position", "hitter")],
        (F.col("position") + 1).alias("hitter_rank"),
        F.col("hitter.item").alias("hitter_item"),
        F.col("hitter.count").alias("hitter_count"),
    )


def _sketches(spark: SparkSession, directory: str) -> answers.SketchSet:
    return answers.build_sketch_set(user_events(spark, directory), "key", _live(spark, directory))


def q_frequency(spark: SparkSession, directory: str) -> DataFrame:
    answer = answers.frequency(_sketches(spark, directory), FREQUENCY_KEY)
    exploded = answer.select("*", F.explode("all_scores").alias("s")).drop("all_scores")
    return exploded.select(
        *[c for c in exploded.columns if c != "s"],
        F.col("s.worker").alias("worker"), F.col("s.score").alias("worker_score"),
    )


def q_cardinality(spark: SparkSession, directory: str) -> DataFrame:
    return answers.cardinality(_sketches(spark, directory))


def q_heavy_hitters(spark: SparkSession, directory: str) -> DataFrame:
    answer = answers.heavy_hitters(_sketches(spark, directory), 10)
    return answer.select("*", F.inline("heavy_hitters")).drop("heavy_hitters")


def _stored_sketches(spark: SparkSession, directory: str) -> answers.SketchSet:
    """Sketches of two halves of the events, saved, loaded and merged."""
    events, root = user_events(spark, directory), f"{scratch_root(spark)}/{FOLDER}/sketches-{uuid.uuid4().hex}"
    for half in (0, 1):
        stored.save_sketches(events.where(F.col("event_id") % 2 == half), "key", f"{root}/{half}")
    merged = stored.merge_stored(*[stored.load_sketches(spark, f"{root}/{half}") for half in (0, 1)])
    return answers.SketchSet(merged.cms, merged.hll, merged.summary, F.lit(merged.total), merged.k, _live(spark, directory))


def stored_frequency(spark: SparkSession, directory: str) -> DataFrame:
    return answers.frequency(_stored_sketches(spark, directory), FREQUENCY_KEY).drop("all_scores")


def stored_cardinality(spark: SparkSession, directory: str) -> DataFrame:
    return answers.cardinality(_stored_sketches(spark, directory))


def stored_heavy_hitters(spark: SparkSession, directory: str) -> DataFrame:
    answer = answers.heavy_hitters(_stored_sketches(spark, directory), 10)
    return answer.select("*", F.inline("heavy_hitters")).drop("heavy_hitters")


def live_answers(spark: SparkSession, directory: str) -> DataFrame:
    return answers.live_answers(_sketches(spark, directory))


QUERIES = {
    "cluster_latest": cluster_latest,
    "q_cluster": q_cluster,
    "latency_history": latency_history,
    "template_latency": template_latency,
    "controller_log_tail": controller_log_tail,
    "query_log_tail": query_log_tail,
    "sketch_params": sketch_params,
    "cluster_summary": cluster_summary,
    "throughput": throughput,
    "router_scores": router_scores,
    "router_ranking": router_ranking,
    "route_best": route_best,
    "node_scores": node_scores,
    "controller_decisions": controller_decisions,
    "controller_cooldown": controller_cooldown,
    "commands": commands,
    "dirty_cooldown": dirty_cooldown,
    "rejected_overrides": rejected_overrides,
    "template_timeline": template_timeline,
    "decision_classes": decision_classes,
    "template_epochs": template_epochs,
    "epoch_heavy_hitters": epoch_heavy_hitters,
    "epoch_frequency": epoch_frequency,
    "multi_template_report": multi_template_report,
    "multi_template_report_parts": multi_template_report_parts,
    "sketch_report": sketch_report,
    "q_frequency": q_frequency,
    "q_cardinality": q_cardinality,
    "q_heavy_hitters": q_heavy_hitters,
    "live_answers": live_answers,
    "stored_frequency": stored_frequency,
    "stored_cardinality": stored_cardinality,
    "stored_heavy_hitters": stored_heavy_hitters,
}

# ---- the same in SQL ------------------------------------------------------------------------

_M = metrics_steps()
_LIVE = {
    **_M,
    "live": (
        "select * from metrics where ts > (select max(ts) from metrics) - interval '6 hours' "
        "qualify row_number() over (partition by worker_id order by ts desc) = 1"
    ),
}
_PROFILES = "select * from (values {}) v(query_type, alpha_q, latency_sla_ms)".format(
    ", ".join(f"('{q.query_type}', {q.accuracy}::double, {q.latency_sla_ms}::double)" for q in QUERY_PROFILES)
)
_REQUESTS = "select * from (values {}) v(query_type, alpha_q, latency_sla_ms)".format(
    ", ".join(f"('{r.query_type}', {r.accuracy}::double, {r.latency}::double)" for r in REQUESTS)
)
_SCORE = sql.score("alpha_q", "latency_sla_ms")
_FREQUENCY_SCORE = sql.score(f"{QUERY_PROFILES[0].accuracy}::double", f"{QUERY_PROFILES[0].latency_sla_ms}::double")

_T = THRESHOLDS
_P99_TEXT = f"printf('%.1f', {sql.rhu('p99_latency_ms', 1)})"
_MEM_TEXT = f"printf('%.1f', {sql.rhu('memory_percent', 1)})"
_ERR_TEXT = f"printf('%.4f', {sql.rhu('rel_error', 4)})"
_DECIDE = {
    **_M,
    "judged": (
        "select *, case "
        f"when p99_latency_ms > {_T.latency_ms} then 'latency' "
        f"when rel_error > {_T.error}::double and memory_percent < {_T.memory_percent} then 'error' "
        f"when memory_percent > {_T.memory_percent} then 'memory' end as rule "
        "from (select *, cms_error_estimate / cms_total_count as rel_error from metrics)"
    ),
    "moved": (
        "select * exclude (template), template as old, case "
        "when rule = 'latency' and template = 'high' then 'medium' "
        "when rule = 'latency' and template = 'medium' then 'low' "
        "when rule = 'error' and template = 'low' then 'medium' "
        "when rule = 'error' and template = 'medium' then 'high' end as template "
        "from judged where rule is not null"
    ),
    "decided": (
        "select worker_id, ts, rule, case when rule = 'memory' then 'resize_mg' else 'set_template' end "
        "as action, template, case when rule = 'memory' then 50 end as k, "
        f"case rule when 'latency' then 'P99=' || {_P99_TEXT} || 'ms > {_T.latency_ms}ms → downgrade ' "
        "|| old || '→' || template "
        f"when 'error' then 'rel_error=' || {_ERR_TEXT} || ' > {_T.error} AND mem=' || {_MEM_TEXT} || "
        "'% OK → upgrade ' || old || '→' || template "
        f"else 'memory=' || {_MEM_TEXT} || '% > {_T.memory_percent}% → shrink MG window' end as message "
        "from moved where rule = 'memory' or template is not null"
    ),
}
_COOLED = {
    **_DECIDE,
    "taken": (
        "select worker_id, min(ts) as ts from decided group by 1 union all "
        "select t.worker_id, min(d.ts) as ts from taken t join decided d "
        "on d.worker_id = t.worker_id and d.ts >= t.ts + interval '18 hours' group by t.worker_id"
    ),
    "accepted": "select d.* from decided d join taken using (worker_id, ts)",
}
_OVERRIDES = (
    "select worker_id, ts, case when cpu_percent > 48 then 'low' when cpu_percent > 44 then 'high' "
    "when cpu_percent < 41 then 'maximal' end as template from metrics"
)
_MANUAL = {
    **_COOLED,
    "asked": f"select * from ({_OVERRIDES}) where template is not null",
    "manual": "select * from asked where template in ('low', 'medium', 'high')",
}
_ORDERS = {
    **_MANUAL,
    "orders": (
        "select worker_id, ts, action, template, k from accepted union all "
        "select worker_id, ts, 'set_template', template, null from manual"
    ),
    "swaps": (
        "select worker_id, ts, max_by(template, case template when 'low' then 1 when 'medium' then 2 else 3 end) as template "
        "from orders where action = 'set_template' group by 1, 2"
    ),
}
_EPOCHS = {
    **_ORDERS,
    "numbered": "select *, row_number() over (partition by worker_id order by ts)::int as epoch from swaps",
    "spans": (
        "select worker_id, ts, template, epoch, lead(ts) over (partition by worker_id order by ts) as until from numbered "
        "union all select w.worker_id, timestamp '0001-01-01', 'medium', 0, "
        "(select min(n.ts) from numbered n where n.worker_id = w.worker_id) from (select distinct worker_id from metrics) w"
    ),
    "last_k": (
        "select s.worker_id, s.epoch, coalesce(max_by(o.k, o.ts), any_value(t.mg_k))::int as mg_k "
        "from spans s join tpl t using (template) left join orders o on o.worker_id = s.worker_id and o.action = 'resize_mg' "
        "and o.ts >= s.ts and (s.until is null or o.ts < s.until) group by 1, 2"
    ),
    "placed": (
        "select e.event_type as worker_id, e.key, coalesce(s.epoch, 0) as epoch, coalesce(s.template, 'medium') as template, l.mg_k "
        "from ev e asof left join numbered s on s.worker_id = e.event_type and e.ts >= s.ts "
        "join last_k l on l.worker_id = e.event_type and l.epoch = coalesce(s.epoch, 0)"
    ),
}


def _report(source: str) -> str:
    steps = {
        "src": source,
        "kc": sql.counts("src"),
        "lead": "select key, n from kc order by n desc, key limit 1",
        "whole": "select sum(n)::bigint as total, count(*) as exact_distinct from kc",
    }
    parts = []
    for t in TEMPLATES:
        steps[f"cells_{t.name}"] = sql.cells("kc", t.cms_width, t.cms_depth)
        steps[f"top_{t.name}"] = sql.estimates("lead", f"cells_{t.name}", t.cms_width, t.cms_depth)
        steps[f"regs_{t.name}"] = sql.registers("src", t.hll_p)
        steps[f"est_{t.name}"] = sql.hll_estimates(f"regs_{t.name}", t.hll_p)
        parts.append(
            f"select '{t.name}' as template, total as total_count, {sql.E} / {t.cms_width} as epsilon, "
            f"{sql.rhu(f'exp(-{t.cms_depth})', 9)} as delta, {sql.E} / {t.cms_width} * total as cms_error_bound, "
            f"lead.key as top_key, lead.n as top_count, top_{t.name}.estimate as top_estimate, "
            f"est_{t.name}.estimate as hll_estimate, {sql.relative_error(t.hll_p)} as hll_relative_error, "
            f"exact_distinct, total / {t.mg_k} as mg_error_bound, "
            f"{sql.memory_mb(t.cms_width, t.cms_depth, t.hll_p, t.mg_k)} as memory_mb "
            f"from whole, lead, top_{t.name}, est_{t.name}"
        )
    return sql.with_steps(steps, " union all ".join(parts))


def _sketch_report() -> str:
    by = ["worker_id", "template", "hll_precision"]
    steps = {
        "ev": EVENTS_SQL,
        "tpl": sql.template_values(),
        "rows": (
            "select e.*, event_type as worker_id, t.* from ev e "
            "join tpl t on t.template = ['low', 'medium', 'high'][length(event_type) % 3 + 1]"
        ),
        "totals": "select worker_id, count(*) as total from rows group by 1",
        "regs": sql.registers("rows", "hll_precision", by),
        "est": sql.hll_estimates("regs", "hll_precision", by),
        "numbered": (
            "select *, row_number() over (partition by worker_id order by ts desc, event_id desc) as nth from rows"
        ),
        "recent": "select * from numbered where nth <= 10000",
        "sizes": "select worker_id, count(*) as mg_window_total from recent group by 1",
        "rc": sql.counts("recent", ["worker_id", "mg_k"]),
        "mg": sql.summary("rc", "mg_k", ["worker_id", "mg_k"]),
        "top": (
            "select worker_id, key, est, row_number() over (partition by worker_id order by est desc, key)::int "
            "as hitter_rank from mg qualify hitter_rank <= 20"
        ),
        "lat": (
            "select worker_id, count(*) as samples, list_sort(list(value)) as vals from numbered "
            "where nth <= 500 group by 1"
        ),
    }
    p = lambda q: sql.rhu(percentile_sql("vals", "samples", q), 4)
    return sql.with_steps(
        steps,
        "select e.worker_id, e.template, cms_width, cms_depth, total as cms_total_count, "
        f"{sql.rhu(f'{sql.E} / cms_width * total', 2)} as cms_error_estimate, tpl.hll_precision, "
        f"estimate as hll_cardinality, {sql.rhu(sql.relative_error('tpl.hll_precision'), 6)} as hll_relative_error, "
        f"mg_k, mg_window_total, {sql.rhu('mg_window_total / mg_k', 2)} as mg_error_bound, "
        f"{p(50)} as p50_latency_ms, {p(95)} as p95_latency_ms, {p(99)} as p99_latency_ms, "
        f"{sql.memory_mb('cms_width', 'cms_depth', 'tpl.hll_precision', 'mg_k')} as memory_mb, "
        "hitter_rank, key as hitter_item, est as hitter_count "
        "from est e join tpl on tpl.template = e.template join totals using (worker_id) "
        "join sizes using (worker_id) join lat using (worker_id) left join top using (worker_id)",
    )


_MEDIUM = TEMPLATES[1]
_SET = {
    **_LIVE,
    "kc": sql.counts("ev"),
    "whole": "select sum(n)::bigint as total from kc",
    "cells": sql.cells("kc", _MEDIUM.cms_width, _MEDIUM.cms_depth),
    "regs": sql.registers("ev", _MEDIUM.hll_p),
    "est": sql.hll_estimates("regs", _MEDIUM.hll_p),
    "mg": sql.summary("kc", _MEDIUM.mg_k),
    "profiles": _PROFILES,
    "scored": f"select query_type, worker_id, {_SCORE} as score from live, profiles",
    "best": (
        "select query_type, worker_id as routed_to, score from scored "
        "qualify row_number() over (partition by query_type order by score desc, worker_id) = 1"
    ),
}
_ROUTED = f"routed_to, {sql.rhu('score', 4)} as router_score"

ORACLES = {
    "template_latency": sql.with_steps(
        metrics_steps(),
        f"select template, count(*) as reports, {sql.rhu('avg(p99_latency_ms)', 6)} as avg_p99_ms from metrics group by 1",
    ),
    "cluster_latest": sql.with_steps(_LIVE, f"select {METRICS_COLUMNS} from live"),
    "q_cluster": sql.with_steps(
        {
            **_LIVE,
            "recent": (
                "select worker_id, ts, p99_latency_ms from metrics "
                "qualify row_number() over (partition by worker_id order by ts desc) <= 60"
            ),
        },
        "select (select count(*) from live) as worker_count, live.worker_id, live.ts, template, "
        "(row_number() over (partition by live.worker_id order by r.ts) - 1)::int as position, "
        "r.p99_latency_ms as latency_ms from live join recent r on r.worker_id = live.worker_id",
    ),
    "latency_history": sql.with_steps(
        {
            **_M,
            "recent": (
                "select worker_id, ts, p99_latency_ms from metrics "
                "qualify row_number() over (partition by worker_id order by ts desc) <= 60"
            ),
        },
        "select *, row_number() over (partition by worker_id order by ts)::int as position from recent",
    ),
    "controller_log_tail": sql.with_steps(
        _COOLED,
        "select ts, worker_id, message from accepted order by ts desc, worker_id desc limit 20",
        recursive=True,
    ),
    "query_log_tail": sql.with_steps(
        {
            **_M,
            "profiles": _PROFILES,
            "scored": f"select ts, query_type, worker_id, {_SCORE} as score from metrics, profiles",
            "log": (
                f"select ts, query_type, worker_id as routed_to, {sql.rhu('score', 4)} as score from scored "
                "qualify row_number() over (partition by ts, query_type order by scored.score desc, worker_id) = 1"
            ),
        },
        "select * from log order by ts desc, query_type desc limit 50",
    ),
    "sketch_params": sql.with_steps(
        _LIVE, "select worker_id, template, cms_width, cms_depth, hll_precision, mg_k from live"
    ),
    "cluster_summary": sql.with_steps(
        {
            **_LIVE,
            "leader": (
                "select * from live order by coalesce(nullif(p99_latency_ms, 0), 'infinity'::double), "
                "worker_id limit 1"
            ),
        },
        f"select count(*) as worker_count, {sql.rhu('avg(live.memory_percent)', 1)} as avg_memory_percent, "
        f"{sql.rhu('avg(live.cpu_percent)', 1)} as avg_cpu_percent, "
        "any_value(b.worker_id) as best_worker, any_value(b.template) as best_template, "
        "any_value(b.p99_latency_ms) as best_p99_latency_ms, "
        "any_value(b.cms_total_count) as best_total_count, "
        "any_value(b.cms_error_estimate) as best_error_estimate from live, leader b",
    ),
    "throughput": sql.with_steps(
        {
            **_M,
            "pairs": (
                "select worker_id, ts, cms_total_count, "
                "cms_total_count - lag(cms_total_count) over w as gained, "
                "(epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000000.0::double as secs "
                "from metrics window w as (partition by worker_id order by ts)"
            ),
        },
        "select worker_id, ts, cms_total_count, case when gained >= 0 then gained / secs end "
        "as events_per_sec from pairs",
    ),
    "router_scores": sql.with_steps(
        {**_M, "profiles": _PROFILES},
        f"select worker_id, ts, query_type, {sql.rhu(_SCORE, 9)} as score from metrics, profiles",
    ),
    "router_ranking": sql.with_steps(
        {
            **_LIVE,
            "profiles": _PROFILES,
            "scored": f"select query_type, worker_id, {_SCORE} as s from live, profiles",
        },
        "select query_type, row_number() over (partition by query_type order by s desc, worker_id)::int "
        f"as rank, worker_id, {sql.rhu('s', 9)} as score from scored",
    ),
    "route_best": sql.with_steps(
        {
            **_LIVE,
            "profiles": _REQUESTS,
            "scored": f"select query_type, alpha_q, latency_sla_ms, worker_id, {_SCORE} as s from live, profiles",
        },
        f"select query_type, alpha_q, latency_sla_ms, worker_id as routed_to, {sql.rhu('s', 9)} as score from scored "
        "qualify row_number() over (partition by query_type, alpha_q, latency_sla_ms "
        "order by s desc, worker_id) = 1",
    ),
    "node_scores": sql.with_steps(
        {**_LIVE, "scored": f"select *, {_FREQUENCY_SCORE} as s from live"},
        "select row_number() over (order by s desc, worker_id)::int as rank, 'frequency' as query_type, "
        f"worker_id, {sql.rhu('s', 4)} as score, template, p99_latency_ms, memory_percent from scored",
    ),
    "controller_decisions": sql.with_steps(_DECIDE, "select * from decided"),
    "controller_cooldown": sql.with_steps(_COOLED, "select * from accepted", recursive=True),
    "commands": sql.with_steps(
        {
            **_MANUAL,
            "sent": (
                "select worker_id, ts, action, template, k from accepted union all "
                "select worker_id, ts, 'set_template', template, null from manual"
            ),
        },
        "select worker_id, ts, '{\"action\":\"' || action || '\"' || "
        "coalesce(',\"template\":\"' || template || '\"', '') || coalesce(',\"k\":' || k, '') || '}' "
        "as value from sent",
        recursive=True,
    ),
    "dirty_cooldown": sql.with_steps(
        {
            "dirty": f"select event_type as worker_id, ts, min(event_id) as event_id from ({DIRTY_SQL}) where ts is not null group by 1, 2",
            "taken": (
                "select worker_id, min(ts) as ts from dirty group by 1 union all "
                "select t.worker_id, min(d.ts) as ts from taken t join dirty d "
                "on d.worker_id is not distinct from t.worker_id and d.ts >= t.ts + interval '18 hours' group by t.worker_id"
            ),
            "accepted": (
                "select d.worker_id, d.ts, d.event_id from dirty d join taken t "
                "on d.worker_id is not distinct from t.worker_id and d.ts = t.ts union all "
                f"select event_type, ts, event_id from ({DIRTY_SQL}) where ts is null"
            ),
        },
        "select worker_id, count(*) as n, sum(event_id)::bigint as ids, count(*) filter (ts is null) as timeless from accepted group by 1",
        recursive=True,
    ),
    "rejected_overrides": sql.with_steps(
        {**_M, "asked": f"select * from ({_OVERRIDES}) where template is not null"},
        "select worker_id, ts, template, 'template must be one of low, medium, high' as reason "
        "from asked where template not in ('low', 'medium', 'high')",
    ),
    "template_timeline": sql.with_steps(
        _ORDERS,
        "select m.worker_id, m.ts, coalesce(s.template, 'medium') as template from metrics m "
        "asof left join swaps s on s.worker_id = m.worker_id and m.ts >= s.ts",
        recursive=True,
    ),
    "decision_classes": sql.with_steps(
        {
            **_MANUAL,
            "log": (
                "select worker_id, message from accepted union all select worker_id, "
                "'Manual override: template set to ''' || template || '''' from manual"
            ),
        },
        "select worker_id, case when contains(message, 'upgrade') then 'upgrade' "
        "when contains(message, 'downgrade') then 'downgrade' when contains(message, 'memory') then 'memory' "
        "when lower(message) like '%manual%' then 'manual' else '' end as class, count(*) as n "
        "from log group by all",
        recursive=True,
    ),
    "template_epochs": sql.with_steps(
        {
            **_EPOCHS,
            "keys": "select p.*, hll_precision from placed p join tpl using (template)",
            "regs": sql.registers("keys", "hll_precision", ["worker_id", "epoch", "template", "hll_precision"]),
            "est": sql.hll_estimates("regs", "hll_precision", ["worker_id", "epoch", "template", "hll_precision"]),
            "totals": "select worker_id, epoch, mg_k, count(*) as total from placed group by all",
        },
        f"select worker_id, epoch, template, totals.mg_k, total as total_count, {sql.E} / cms_width * total as cms_error_bound, "
        f"estimate as hll_estimate, {sql.relative_error('est.hll_precision')} as hll_relative_error, "
        "total / totals.mg_k as mg_error_bound "
        "from est join totals using (worker_id, epoch) join tpl using (template)",
        recursive=True,
    ),
    "epoch_heavy_hitters": sql.with_steps(
        {
            **_EPOCHS,
            "kc": sql.counts("placed", ["worker_id", "epoch", "template", "mg_k"]),
            "mg": sql.summary("kc", "mg_k", ["worker_id", "epoch", "template", "mg_k"]),
        },
        "select worker_id, epoch, template, mg_k, key, est from mg",
        recursive=True,
    ),
    "epoch_frequency": sql.with_steps(
        {
            **_EPOCHS,
            "sized": "select p.*, cms_width, cms_depth from placed p join tpl using (template)",
            "kc": "select worker_id, epoch, template, cms_width, cms_depth, key, count(*) as n from sized group by all",
            "cells": (
                "select worker_id, epoch, r::int as row_id, (md5_number_upper(key || ':' || r) % cms_width)::int as col_id, "
                "sum(n)::bigint as cnt from kc, range(7) t(r) where r < cms_depth group by all"
            ),
            "wanted": (
                "select distinct key from (select key from ev where event_id % 200 = 0 order by key limit 5) "
                "union all select 'no such key'"
            ),
            "ages": "select worker_id, epoch, template, cms_width, cms_depth, sum(n)::bigint as total from kc group by all",
            "slots": (
                "select a.*, w.key, r::int as row_id, (md5_number_upper(w.key || ':' || r) % cms_width)::int as col_id "
                "from ages a, wanted w, range(7) t(r) where r < cms_depth"
            ),
        },
        "select s.worker_id, s.epoch, template, s.key, min(coalesce(c.cnt, 0))::bigint as estimate, "
        f"{sql.rhu(f'{sql.E} / any_value(cms_width) * any_value(total)', 9)} as cms_error_bound "
        "from slots s left join cells c on c.worker_id = s.worker_id and c.epoch = s.epoch and c.row_id = s.row_id "
        "and c.col_id = s.col_id group by s.worker_id, s.epoch, template, s.key",
        recursive=True,
    ),
    "multi_template_report": _report(EVENTS_SQL),
    "multi_template_report_parts": _report(LINES_SQL),
    "sketch_report": _sketch_report(),
    "q_frequency": sql.with_steps(
        {
            **_SET,
            "wanted": f"select '{FREQUENCY_KEY}' as key",
            "answer": sql.estimates("wanted", "cells", _MEDIUM.cms_width, _MEDIUM.cms_depth),
        },
        f"select key, estimate, {sql.rhu(f'{sql.E} / {_MEDIUM.cms_width} * total', 2)} as cms_error_bound, "
        f"total as cms_total_count, {sql.rhu(f'{sql.E} / {_MEDIUM.cms_width}', 5)} as epsilon, "
        f"{sql.rhu(f'exp(-{_MEDIUM.cms_depth})', 5)} as delta, routed_to, "
        f"{sql.rhu('best.score', 4)} as router_score, worker_id as worker, "
        f"{sql.rhu('scored.score', 4)} as worker_score "
        "from answer, whole, best, scored "
        "where best.query_type = 'frequency' and scored.query_type = 'frequency'",
    ),
    "q_cardinality": sql.with_steps(
        _SET,
        f"select estimate as estimated_cardinality, {sql.rhu(sql.relative_error(_MEDIUM.hll_p), 4)} "
        f"as relative_error, {_MEDIUM.hll_p} as hll_precision, {_ROUTED} "
        "from est, best where query_type = 'cardinality'",
    ),
    "q_heavy_hitters": sql.with_steps(
        _SET,
        f"select key as item, est as count, total as window_total, {sql.rhu(f'total / {_MEDIUM.mg_k}', 2)} "
        f"as error_bound, {_MEDIUM.mg_k} as mg_k, {_ROUTED} from mg, whole, best "
        "where query_type = 'heavy_hitters' qualify row_number() over (order by est desc, key) <= 10",
    ),
    "live_answers": sql.with_steps(
        {
            **_SET,
            "lead": "select key, est from mg order by est desc, key limit 1",
            "answer": sql.estimates("lead", "cells", _MEDIUM.cms_width, _MEDIUM.cms_depth),
        },
        f"select est.estimate as distinct_keys, {sql.relative_error(_MEDIUM.hll_p)} as distinct_relative_error, "
        f"lead.key as top_key, {sql.rhu('least(100.0::double * lead.est / total, 100.0::double)', 1)} "
        f"as top_share_percent, answer.estimate as top_frequency, "
        f"{sql.E} / {_MEDIUM.cms_width} * total as frequency_error_bound from est, whole, lead, answer",
    ),
}

# the merged halves: exact for cells and registers, two summaries cut once more for heavy hitters
_HALVES = {k: v for k, v in _SET.items() if k != "mg"}
for _half in (0, 1):
    _HALVES[f"kc{_half}"] = sql.counts(f"(select * from ev where event_id % 2 = {_half})")
    _HALVES[f"mg{_half}"] = sql.summary(f"kc{_half}", _MEDIUM.mg_k)
_HALVES["kept"] = "select key, sum(est)::bigint as n from (select * from mg0 union all select * from mg1) group by key"
_HALVES["mg"] = sql.summary("kept", _MEDIUM.mg_k)
ORACLES |= {
    "stored_frequency": (
        "select distinct key, estimate, cms_error_bound, cms_total_count, epsilon, delta, routed_to, router_score "
        f"from ({ORACLES['q_frequency']})"
    ),
    "stored_cardinality": ORACLES["q_cardinality"],
    "stored_heavy_hitters": sql.with_steps(
        _HALVES,
        f"select key as item, est as count, total as window_total, {sql.rhu(f'total / {_MEDIUM.mg_k}', 2)} "
        f"as error_bound, {_MEDIUM.mg_k} as mg_k, {_ROUTED} from mg, whole, best "
        "where query_type = 'heavy_hitters' qualify row_number() over (order by est desc, key) <= 10",
    ),
}
