"""Sketches over event streams.

Running sketches are plain streaming aggregations whose state is the sketch itself: width * depth cells,
2^p registers. Windows keep counts per (bucket, key) until the watermark closes the bucket.
Sinks write in the layout of `versions`: a retry overwrites its own folder, so a restart from the
checkpoint neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallystream.operators.cms import CountMin, cms_build
from tallystream.operators.epochs import SketchParts, place_parts, sketch_parts
from tallystream.operators.hll import HyperLogLog, hll_build
from tallystream.operators.keys import keyed
from tallystream.session import stream_state_dir
from tallystream.streaming.versions import append_run, read_runs, read_version, write_version


def running_cms(events: DataFrame, key: str, width: int, depth: int, by: Sequence[str] = (),
                hash_mode: str = "md5") -> CountMin:
    """Since-start Count-Min cells; one streaming aggregation, straight from rows to cells."""
    return cms_build(events, key, width, depth, by, hash_mode=hash_mode, pre_aggregate=False)


def running_hll(events: DataFrame, key: str, p: int, by: Sequence[str] = (),
                hash_mode: str = "md5") -> HyperLogLog:
    """Since-start registers."""
    return hll_build(events, key, p, by, hash_mode)


def with_event_time(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked events; a zone-less timestamp column is read as UTC session time."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def bucket_counts_stream(events: DataFrame, key: str, ts: str, bucket: str, delay: str) -> DataFrame:
    """(bucket, key, n): in append mode every bucket once, when the watermark closes it.

    The streaming twin of `windows.bucket_counts`; the sliding operators run over its output table.
    """
    timed = with_event_time(events, ts, delay)
    counted = keyed(timed, key, ts).groupBy(F.window(ts, bucket), "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("bucket"), "key", "n")


def tick_counts_stream(events: DataFrame, key: str, ts: str, tick: str, delay: str) -> DataFrame:
    """(tick, n) of closed ticks: events with a key, as its batch twin counts them."""
    timed = keyed(with_event_time(events, ts, delay), key, ts)
    return timed.groupBy(F.window(ts, tick)).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("tick"), "n"
    )


def start_batches(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    path: str,
    checkpoint: str | None = None,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run `write` on every micro-batch. Progress is kept in `checkpoint`, by default in the shared folder
    named after `path`; the default trigger runs on what is there and stops."""
    progress = checkpoint or stream_state_dir(rows.sparkSession, path.strip("/").replace("/", "_"))
    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def start_table(
    rows: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write a stream as a table in the layout of `versions`.

    `complete` mode gives a full state per batch (`read_state`), of which the newest are kept; `append` a growing table
    (`read_table`), whose runs are merged.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (write_version if mode == "complete" else append_run)(batch, path, batch_id)

    return start_batches(rows, write, path, checkpoint, mode, trigger)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return read_runs(spark, path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state after the newest micro-batch; no other state is opened."""
    return read_version(spark, path)


def start_snapshots(
    metrics: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Append metric rows to the history table; the latest snapshot and the latency history are queries
    over it."""
    return start_table(metrics, path, checkpoint, "append", trigger)


PARTS = ("cells", "registers", "candidates")


def start_epoch_sketches(
    events: DataFrame,
    key: str,
    worker: str,
    ts: str,
    path: str,
    checkpoint: str | None = None,
    grain: str = "1 minute",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Partial sketches of every micro-batch per (worker, bucket of `grain`), in three tables below `path`.

    Commands are not looked at: which epoch a bucket belongs to is decided when the parts are read, so neither late events nor
    late commands need a correction.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(worker, ts, key).persist()
        parts = sketch_parts(batch, key, worker, ts, grain)
        for name in PARTS:
            append_run(getattr(parts, name), f"{path}/{name}", batch_id)
        batch.unpersist()

    return start_batches(events, write, path, checkpoint, trigger=trigger)


def read_epochs(spark: SparkSession, path: str, commands: DataFrame, grain: str = "1 minute") -> SketchParts:
    """The sketches of every epoch under `commands`; answers by `epochs.parts_report`, `parts_frequency`, `parts_heavy_hitters`."""
    parts = SketchParts(*[read_table(spark, f"{path}/{name}") for name in PARTS])
    return place_parts(parts, commands, grain)
