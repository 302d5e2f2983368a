"""Threshold decisions on metric rows, with cooldown, commands and timelines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions.numbers import epoch_micros, interval_seconds, number_or, round_half_up
from tallystream.operators.ordered import join_on, last_known, nearest
from tallystream.staging import drop_staged, staged
from tallystream.templates import DEFAULT_TEMPLATE, TEMPLATE_NAMES

# Fixed value: k that a memory decision shrinks heavy hitters to.
SHRUNK_K = 50
COOLDOWN = "15 seconds"


@dataclass(frozen=True)
class Thresholds:
    """The limits of the three rules."""

    latency_ms: float = 200.0
    memory_percent: float = 80.0
    error: float = 0.05


def ladder_move(current: Column, step: int) -> Column:
    """Template `step` rungs up, clamped to the ladder; null for an unknown template."""
    position = F.array_position(F.array(*[F.lit(t) for t in TEMPLATE_NAMES]), current)
    target = F.least(F.greatest(position + step, F.lit(1)), F.lit(len(TEMPLATE_NAMES)))
    moved = F.element_at(F.array(*[F.lit(t) for t in TEMPLATE_NAMES]), target.cast("int"))
    return F.when(position > 0, moved)


def _one_digit(value: Column) -> Column:
    return F.format_string("%.1f", round_half_up(value, 1))


def decide(metrics: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(worker_id, ts, rule, action, template, k, message): one row per metrics row that asks for a
    change.

    The first matching rule counts: high latency - one template down; high relative error with free
    memory - one up; high memory - shrink k. A rule that matches but cannot move gives no row and
    still hides the later rules.
    """
    limit = thresholds
    current = F.coalesce("template", F.lit(DEFAULT_TEMPLATE))
    p99 = number_or("p99_latency_ms", 0.0)
    memory = number_or("memory_percent", 0.0)
    total = F.coalesce(F.nullif("cms_total_count", F.lit(0)), F.lit(1))
    error = F.coalesce("cms_error_estimate", F.lit(0.0)) / total

    rule = (
        F.when(p99 > limit.latency_ms, F.lit("latency"))
        .when((error > limit.error) & (memory < limit.memory_percent), F.lit("error"))
        .when(memory > limit.memory_percent, F.lit("memory"))
    )
    rows = metrics.withColumn("_current", current).withColumn("rule", rule)
    rows = rows.where(F.col("rule").isNotNull())
    by_rule = lambda latency, err, mem: (
        F.when(F.col("rule") == "latency", latency).when(F.col("rule") == "error", err).otherwise(mem)
    )
    nothing = F.lit(None).cast("string")
    moved = by_rule(ladder_move(F.col("_current"), -1), ladder_move(F.col("_current"), 1), nothing)
    message = by_rule(
        F.concat(F.lit("P99="), _one_digit(p99), F.lit(f"ms > {limit.latency_ms}ms → downgrade "),
                 "_current", F.lit("→"), "template"),
        F.concat(F.lit("rel_error="), F.format_string("%.4f", round_half_up(error, 4)),
                 F.lit(f" > {limit.error} AND mem="), _one_digit(memory),
                 F.lit("% OK → upgrade "), "_current", F.lit("→"), "template"),
        F.concat(F.lit("memory="), _one_digit(memory),
                 F.lit(f"% > {limit.memory_percent}% → shrink MG window")),
    )
    shrink = F.col("rule") == "memory"
    return (
        rows.withColumn("_error", error)
        .drop("template")
        .withColumn("template", moved)
        .where(shrink | (F.col("template") != F.col("_current")))
        .select(
            "worker_id", "ts", "rule",
            F.when(shrink, F.lit("resize_mg")).otherwise(F.lit("set_template")).alias("action"),
            "template",
            F.when(shrink, F.lit(SHRUNK_K)).alias("k"),
            message.alias("message"),
        )
    )


def unknown_templates(metrics: DataFrame) -> DataFrame:
    """Metric rows whose template is not on the ladder; `decide` cannot move them."""
    return metrics.where(F.col("template").isNotNull() & ~F.col("template").isin(*TEMPLATE_NAMES))


# Length of a chunk of a group's timeline, in cooldowns.
CHUNK_COOLDOWNS = 512


def apply_cooldown(
    candidates: DataFrame, cooldown: str = COOLDOWN, by: Sequence[str] = ("worker_id",), ts: str = "ts"
) -> DataFrame:
    """The candidates that remain if every accepted one blocks its group for `cooldown`.

    Acceptance depends on all earlier acceptances of the group, but it can be followed from many places at once. Every time
    points to its successor, the first candidate at or after the end of its cooldown. A time with no candidate within
    a cooldown before it is accepted for certain. From these the accepted ones are found by pointer doubling: in each round
    all accepted times mark what they point to, and every pointer is replaced by its target's. After r rounds
    2^r steps have been made, so a stretch of n acceptances takes log2(n) rounds, each two joins of small rows. Successors come
    from a scan by chunks of time; no group's history is collected or sorted in one task.

    Of several candidates of a group at one time the smallest row counts. Candidates without a time block nothing and are all
    accepted; null is a group like any other. Rounds run when this function is called and keep their rows in the shared folder.
    """
    wait = interval_seconds(cooldown) * 1_000_000
    by = list(by)
    kept = staged(candidates.withColumn("_t", epoch_micros(F.col(ts))), "candidates")
    times = kept.where(F.col("_t").isNotNull()).select(*by, F.col("_t").alias("_at")).distinct()

    # one row per time, with the place to look from; known times are rows with a value
    known = times.withColumn("_value", F.col("_at"))
    nothing = F.lit(None).cast("bigint")

    def look(from_: Column, name: str, after: bool) -> DataFrame:
        asked = times.select(*by, (F.col("_at") + from_).alias("_at"), nothing.alias("_value"), F.col("_at").alias("_from"))
        both = known.withColumn("_from", nothing).unionByName(asked)
        found = nearest(both, by, "_at", "_value", name, wait * CHUNK_COOLDOWNS, after)
        return found.where(F.col("_from").isNotNull()).select(*by, F.col("_from").alias("_at"), name)

    before = look(F.lit(-1), "_before", after=False)
    fresh = F.col("_before").isNull() | (F.col("_at") - F.col("_before") >= wait)
    started = before.select(*by, "_at", fresh.alias("_taken"))
    points = staged(join_on(started, look(F.lit(wait), "_next", after=True), [*by, "_at"]), "cooldown")
    while not points.where(F.col("_taken") & F.col("_next").isNotNull()).isEmpty():
        marked = points.where(F.col("_taken") & F.col("_next").isNotNull()).select(
            *by, F.col("_next").alias("_at"), F.lit(True).alias("_marked")).distinct()
        targets = points.select(*by, F.col("_at").alias("_next"), F.col("_next").alias("_further"), F.col("_taken").alias("_met"))
        further = join_on(join_on(points, marked, [*by, "_at"], "left"), targets, [*by, "_next"], "left")
        # a pointer to a certain start leads nowhere new
        onward = F.when(~F.coalesce("_met", F.lit(False)), F.col("_further"))
        stepped = staged(further.select(
            *by, "_at", (F.col("_taken") | F.coalesce("_marked", F.lit(False))).alias("_taken"), onward.alias("_next")), "cooldown")
        drop_staged(points)
        points = stepped

    others = [c for c in candidates.columns if c not in by]
    accepted = points.where("_taken").select(*by, F.col("_at").alias("_t"))
    smallest = kept.where(F.col("_t").isNotNull()).groupBy(*by, "_t").agg(F.min(F.struct(*others)).alias("_row"))
    timed = join_on(smallest, accepted, [*by, "_t"]).select(*by, *[F.col(f"_row.{c}").alias(c) for c in others])
    return timed.select(*candidates.columns).unionByName(kept.where(F.col("_t").isNull()).select(*candidates.columns))


def override_commands(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commands, rejected) from manual overrides (worker_id, ts, template)."""
    valid = F.coalesce(F.col("template").isin(*TEMPLATE_NAMES), F.lit(False))
    message = F.concat(F.lit("Manual override: template set to '"), "template", F.lit("'"))
    commands = overrides.where(valid).select(
        "worker_id", "ts", F.lit("manual").alias("rule"), F.lit("set_template").alias("action"),
        "template", F.lit(None).cast("int").alias("k"), message.alias("message"),
    )
    rejected = overrides.where(~valid).withColumn(
        "reason", F.lit(f"template must be one of {', '.join(TEMPLATE_NAMES)}")
    )
    return commands, rejected


def command_rows(decisions: DataFrame) -> DataFrame:
    return decisions.select("worker_id", "ts", "action", "template", "k")


def command_json(commands: DataFrame) -> DataFrame:
    """(worker_id, ts, value): the message a worker receives; absent fields are left out."""
    return commands.select("worker_id", "ts", F.to_json(F.struct("action", "template", "k")).alias("value"))


def controller_log(decisions: DataFrame) -> DataFrame:
    return decisions.select("ts", "worker_id", "message")


def in_force(commands: DataFrame) -> DataFrame:
    """The set_template commands, one for each worker and time: of several at one time the finest template holds.

    Timeline and epochs both use this order, so they cannot disagree.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in TEMPLATE_NAMES]), F.col("template"))
    swaps = commands.where(F.col("action") == "set_template")
    return swaps.groupBy("worker_id", "ts").agg(F.max_by("template", F.struct(rank, "template")).alias("template"))


def template_timeline(metrics: DataFrame, commands: DataFrame, chunk: str = "1 day") -> DataFrame:
    """(worker_id, ts, template): the commanded template in force at each report; medium before the
    first command."""
    asked = in_force(commands).select(
        "worker_id", "ts", F.col("template").alias("_set"), F.lit(False).alias("_report")
    )
    reports = metrics.select(
        "worker_id", "ts", F.lit(None).cast("string").alias("_set"), F.lit(True).alias("_report")
    )
    # a command at the time of a report is in force in that report
    merged = reports.unionByName(asked).groupBy("worker_id", "ts").agg(
        F.max("_set").alias("_set"), F.max("_report").alias("_report")
    )
    known = last_known(merged, ["worker_id"], "ts", "_set", "template", chunk)
    return known.where("_report").select(
        "worker_id", "ts", F.coalesce("template", F.lit(DEFAULT_TEMPLATE)).alias("template")
    )


def decision_class(message: Column) -> Column:
    """Class of a log message by the first matching word."""
    return (
        F.when(message.contains("upgrade"), F.lit("upgrade"))
        .when(message.contains("downgrade"), F.lit("downgrade"))
        .when(message.contains("memory"), F.lit("memory"))
        .when(message.rlike("(?i)manual"), F.lit("manual"))
        .otherwise(F.lit(""))
    )


def decision_classes(log: DataFrame) -> DataFrame:
    """(worker_id, class, n)."""
    return (
        log.groupBy("worker_id", decision_class(F.col("message")).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
