"""Reports over a stream that need more than a windowed count: idle ticks, and rows that come too late."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallystream.functions.numbers import epoch_micros, interval_seconds
from tallystream.operators.keys import keyed
from tallystream.streaming.sketches import start_batches, with_event_time
from tallystream.streaming.versions import append_run, read_version, write_version

# The state store that timers need.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
_REPORT = "at long, n long, top_key string, top_count long, total_count long"


class _Ticks(StatefulProcessor):
    """Puts closed busy ticks in order and fills in the idle ones; state is the last reported tick and the total.

    A timer is set for the end of the next tick. It fires when the watermark has passed it and no busy tick has come in the same
    batch, so an idle tick is reported as soon as it is certain, not with the next event.
    """

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("ticks", "at long, total long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        busy = sorted(r for part in rows for r in part[["at", "n", "top_key", "top_count"]].itertuples(index=False, name=None))
        last, total = self._state.get() if self._state.exists() else (None, 0)
        out = []
        for at, n, top, count in busy:
            out += [(t, 0, None, None, total) for t in self._idle(last, at)]
            total += n
            last = at
            out.append((at, n, top, count, total))
        yield from self._report(out, last, total)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._state.exists():
            last, total = self._state.get()
            passed = timerValues.getCurrentWatermarkInMs() * 1000  # ticks that end by then have no more events
            out = [(t, 0, None, None, total) for t in self._idle(last, passed - self.step + 1)]
            if out:
                yield from self._report(out, out[-1][0], total)

    def _idle(self, last: int | None, upto: int) -> range:
        return range(0) if last is None else range(last + self.step, upto, self.step)

    def _report(self, out: list[tuple], last: int | None, total: int) -> Iterator[pd.DataFrame]:
        if last is None:
            return
        self._state.update((int(last), int(total)))
        for old in self._handle.listTimers():
            self._handle.deleteTimer(old)
        self._handle.registerTimer((int(last) + 2 * self.step) // 1000)
        frame = pd.DataFrame(out, columns=["at", "n", "top_key", "top_count", "total_count"])
        yield frame.astype({"at": "int64", "n": "int64", "top_count": "Int64", "total_count": "int64"})

    def close(self) -> None:
        pass


def tick_report_stream(events: DataFrame, key: str, ts: str, tick: str, delay: str) -> DataFrame:
    """(tick, n, top_key, top_count, total_count) of every closed tick from the first event's on, idle ones included.

    The streaming twin of `windows.tumbling_report`. Keys are counted per tick by two windowed aggregations; only one row for each
    busy tick reaches the keyed state. The session needs `STATE_STORE`.
    """
    step = interval_seconds(tick) * 1_000_000
    counted = keyed(with_event_time(events, ts, delay), key, ts).groupBy(F.window(ts, tick), "key").agg(F.count(F.lit(1)).alias("n"))
    leader = F.min_by(F.struct("key", "n"), F.struct(-F.col("n"), F.col("key")))
    busy = counted.groupBy("window").agg(F.sum("n").alias("n"), leader.alias("_top")).select(
        F.unix_micros("window.start").alias("at"), "n", F.col("_top.key").alias("top_key"), F.col("_top.n").alias("top_count"),
        F.lit("all").alias("line"))
    report = busy.groupBy("line").transformWithStateInPandas(
        _Ticks(step), _REPORT, "Append", "EventTime")
    return report.select(F.timestamp_micros("at").alias("tick"), "n", "top_key", "top_count", "total_count")


def start_on_time(
    events: DataFrame, ts: str, delay: str, path: str, checkpoint: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Splits a stream into two tables below `path`: `on_time`, and `late` with a reason for each row.

    A row is late if its time is more than `delay` before the latest time of all earlier micro-batches, the rule by which
    Spark's watermark drops rows without a trace; a row without a time can be in no window. Both tables together hold every row once.
    """
    wait = interval_seconds(delay) * 1_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        seen = read_version(spark, f"{path}/seen", before=batch_id, schema="latest long")
        latest = seen.agg(F.max("latest")).first()[0]
        at = epoch_micros(F.col(ts))
        late = F.lit(False) if latest is None else at < F.lit(latest - wait)
        reason = F.when(at.isNull(), "no time").when(late, "late")
        append_run(batch.where(reason.isNull()), f"{path}/on_time", batch_id)
        append_run(batch.where(reason.isNotNull()).withColumn("reason", reason), f"{path}/late", batch_id)
        both = seen.unionByName(batch.agg(F.max(at).alias("latest"))).agg(F.max("latest").alias("latest"))
        write_version(both.coalesce(1), f"{path}/seen", batch_id)
        batch.unpersist()

    return start_batches(events, write, path, checkpoint, trigger=trigger)


def late_counts(late: DataFrame) -> DataFrame:
    """(reason, n)."""
    return late.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
