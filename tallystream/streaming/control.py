"""Decisions over a metrics stream, with the cooldown carried from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallystream.functions.numbers import interval_seconds
from tallystream.operators.control import COOLDOWN, Thresholds, apply_cooldown, decide
from tallystream.operators.ordered import join_on
from tallystream.staging import drop_staged, staged
from tallystream.streaming.sketches import start_batches
from tallystream.streaming.versions import append_run, read_version, write_version

_LAST = "worker_id string, last timestamp"


def start_decisions(
    metrics: DataFrame,
    path: str,
    checkpoint: str | None = None,
    thresholds: Thresholds = Thresholds(),
    cooldown: str = COOLDOWN,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the accepted decisions of a metrics stream to `path` (`read_table`).

    Carried between micro-batches is one time per worker, its last accepted decision, in a table beside the output, of
    which a batch reads the newest only. Within a batch the distributed `apply_cooldown` runs, so that a worker with most of
    the rows does not end up in one task. Candidates that come after a later one was accepted go to `<path>_late`.
    """
    state = f"{path}_last"
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(interval_seconds(cooldown)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_version(spark, state, before=batch_id, schema=_LAST)
        candidates = decide(batch, thresholds).withColumn("ts", F.col("ts").cast("timestamp"))
        known = join_on(candidates, before, ["worker_id"], "left")
        # older than an accepted one: cannot be put in any more, and is kept beside with its reason
        late = F.coalesce(F.col("ts") < F.col("last"), F.lit(False))
        append_run(known.where(late).select(*candidates.columns, F.lit("late").alias("reason")), f"{path}_late", batch_id)
        waited = F.col("last").isNull() | F.col("ts").isNull() | (F.col("ts") >= F.col("last") + wait)
        free = known.where(waited).select(*candidates.columns)
        accepted = staged(apply_cooldown(free, cooldown), "accepted")
        append_run(accepted, path, batch_id)
        after = before.unionByName(accepted.select("worker_id", F.col("ts").alias("last")))
        write_version(after.groupBy("worker_id").agg(F.max("last").alias("last")), state, batch_id)
        drop_staged(accepted)

    return start_batches(metrics, write, path, checkpoint, trigger=trigger)
