"""Event-time windows: sliding heavy hitters, totals and periodic reports.

Raw events are touched once, by the count per (bucket, key). Everything else - window length, k,
totals - is a query over that bucket table, so it can change without losing history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.formulas import check_mg
from tallystream.functions.numbers import epoch_micros, interval_seconds, time_bucket
from tallystream.operators.heavy_hitters import mg_summary, mg_truncate
from tallystream.operators.keys import key_counts, keyed
from tallystream.operators.ordered import join_on, last_n, last_n_per_group, running


def _ratio(window: str, bucket: str) -> int:
    wide, narrow = interval_seconds(window), interval_seconds(bucket)
    if narrow > wide:
        raise ValueError("bucket must not be longer than the window")
    if wide % narrow:
        raise ValueError("bucket must divide the window")
    return wide // narrow


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


def bucket_counts(
    df: DataFrame, key: str, ts: str, bucket: str = "5 seconds", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., bucket, key, n): the stored state of all windows. Rows without a time are in none."""
    timed = df.withColumn("bucket", time_bucket(F.col(ts), bucket))
    return key_counts(timed.where(F.col("bucket").isNotNull()), key, [*by, "bucket"])


def slide(buckets: DataFrame, window: str, bucket: str) -> DataFrame:
    """Each bucket row once per sliding window that covers it, as (window_start, window_end)."""
    step, count = interval_seconds(bucket), _ratio(window, bucket)
    placed = buckets.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(count))))
    end = F.col("bucket") + _seconds(F.col("_i") * step)
    return (
        placed.withColumn("window_end", end)
        .withColumn("window_start", F.col("window_end") - _seconds(F.lit(interval_seconds(window))))
        .drop("_i", "bucket")
    )


def _bucket_floors(buckets: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """(by..., bucket, floor): the k-th largest count of each bucket, 0 with fewer than k keys, from
    the number of keys per count."""
    per_count = buckets.groupBy(*by, "bucket", "n").agg(F.count(F.lit(1)).alias("_keys"))
    downwards = (
        Window.partitionBy(*by, "bucket").orderBy(F.col("n").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    reached = F.when(F.sum("_keys").over(downwards) >= k, F.col("n"))
    return (
        per_count.withColumn("_reached", reached)
        .groupBy(*by, "bucket")
        .agg(F.coalesce(F.max("_reached"), F.lit(0)).alias("floor"))
    )


# Length of a chunk of a key's history, in windows.
CHUNK_WINDOWS = 8


def _micros(ts: str) -> Column:
    return epoch_micros(F.col(ts)).alias("_at")


def _rising(buckets: DataFrame, floors: DataFrame, span: int, by: Sequence[str], chunk: int) -> DataFrame:
    """(by..., key, _at, n): bucket rows whose key has more than the bucket's floor in the buckets within `span` around.

    A key's history is cut into chunks of time; rows within `span` of a border are also sent to the neighbouring chunk, where
    they only add to the others' sums.
    """
    placed = join_on(buckets, floors, [*by, "bucket"]).select(*by, "key", _micros("bucket"), "n", "floor")
    own = F.floor(F.col("_at") / chunk)
    reached = F.array_distinct(F.array(own, F.floor((F.col("_at") - span) / chunk), F.floor((F.col("_at") + span) / chunk)))
    around = Window.partitionBy(*by, "key", "_chunk").orderBy("_at").rangeBetween(-span, span)
    sums = placed.withColumn("_chunk", F.explode(reached)).withColumn("_around", F.sum("n").over(around))
    return sums.where((F.col("_chunk") == own) & (F.col("_around") > F.col("floor"))).select(*by, "key", "_at", "n")


def _window_counts(rows: DataFrame, width: int, step: int, by: Sequence[str], chunk: int) -> DataFrame:
    """(by..., window_start, window_end, key, n) of bucket rows (by..., key, _at, n).

    A bucket enters the windows that end from its own end on and leaves them a window later, so a key's count is a running
    sum over these two kinds of events, constant in between. Rows are multiplied only when such a stretch is written out
    as its windows, once for each window with a positive count.
    """
    signed = F.explode(F.array(
        F.struct((F.col("_at") + step).alias("_end"), F.col("n").alias("_change")),
        F.struct((F.col("_at") + step + width).alias("_end"), (-F.col("n")).alias("_change"))))
    changes = rows.select(*by, "key", signed.alias("_e")).select(*by, "key", "_e.*").groupBy(*by, "key", "_end").agg(
        F.sum("_change").alias("_change"))
    counts = running(changes, [*by, "key"], "_end", sums={"n": "_change"}, chunk=chunk)
    # a chunk is longer than a window: a count that goes on into the next chunk changes there, and is begun there anew
    own = F.floor(F.col("_end") / chunk)
    line = Window.partitionBy(*by, "key", "_chunk").orderBy("_end")
    placed = counts.withColumn("_chunk", own).withColumn("_until", F.lead("_end").over(line))
    last = placed.where(F.col("_until").isNull() & (F.col("n") > 0))
    border = (F.col("_chunk") + 1) * chunk
    after = last.select(*by, "key", border.cast("bigint").alias("_end"), "n", (F.col("_chunk") + 1).alias("_chunk"))
    heads = placed.groupBy(*by, "key", "_chunk").agg(F.min("_end").alias("_until"))
    begun = join_on(after, heads, [*by, "key", "_chunk"], "left").where(F.col("_until") > F.col("_end"))
    stretches = placed.where(F.col("n") > 0).withColumn("_until", F.coalesce("_until", border)).select(
        *by, "key", "_end", "_until", "n").unionByName(begun.select(*by, "key", "_end", "_until", "n"))
    first = F.ceil(F.col("_end") / step) * step
    ends = F.when(first < F.col("_until"), F.sequence(first, F.col("_until") - 1, F.lit(step).cast("bigint")))
    end = F.timestamp_micros("_window")
    return stretches.withColumn("_window", F.explode(ends)).select(
        *by, F.timestamp_micros(F.col("_window") - width).alias("window_start"), end.alias("window_end"), "key", "n")


def sliding_heavy_hitters(
    buckets: DataFrame, k: int, window: str = "60 seconds", bucket: str = "5 seconds",
    by: Sequence[str] = (),
) -> DataFrame:
    """A summary per sliding window, from stored buckets; k and window are query-time choices.

    The k-th count of a window is at least the k-th count of each of its buckets. A key whose
    counts around a bucket add up to no more than that cannot rise above it in any window with the
    bucket, so its row is left out before rows are multiplied: long tails of rare keys stay out
    of the windows, and results stay exact. Tasks work on chunks of time of a key, never on its whole history.
    """
    check_mg(k)
    _ratio(window, bucket)
    floors = _bucket_floors(buckets, k, by)
    width, step = (interval_seconds(x) * 1_000_000 for x in (window, bucket))
    chunk = CHUNK_WINDOWS * width
    windows = [*by, "window_start", "window_end"]
    counts = _window_counts(_rising(buckets, floors, width - step, by, chunk), width, step, by, chunk)
    kind = buckets.schema["bucket"].dataType
    counts = counts.withColumns({c: F.col(c).cast(kind) for c in ("window_start", "window_end")})
    window_floors = slide(floors, window, bucket).groupBy(*windows).agg(F.max("floor").alias("floor"))
    return mg_truncate(counts, k, windows, floors=window_floors)


def windowed_heavy_hitters(
    df: DataFrame, key: str, ts: str, k: int, window: str = "60 seconds",
    bucket: str = "5 seconds", by: Sequence[str] = (),
) -> DataFrame:
    _ratio(window, bucket)
    return sliding_heavy_hitters(bucket_counts(df, key, ts, bucket, by), k, window, bucket, by)


def window_totals(
    df: DataFrame, key: str, ts: str, window: str, bucket: str, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., window_start, window_end, window_total) over the rows that summaries count: those with a key."""
    per_bucket = (
        keyed(df, key, *by, ts).where(F.col(ts).isNotNull()).select(*by, time_bucket(F.col(ts), bucket).alias("bucket"))
        .groupBy(*by, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        slide(per_bucket, window, bucket)
        .groupBy(*by, "window_start", "window_end")
        .agg(F.sum("n").alias("window_total"))
    )


def last_n_heavy_hitters(
    df: DataFrame, key: str, ts: str, tie: str, k: int, n: int = 10_000, by: Sequence[str] = ()
) -> DataFrame:
    """Summary of the n latest events (per group)."""
    recent = df.select(*by, key, ts, tie)
    recent = last_n_per_group(recent, by, ts, tie, n) if by else last_n(recent, ts, tie, n)
    return mg_summary(recent, key, k, by)


def running_total(df: DataFrame, key: str, ts: str, bucket: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bucket, n, total_count): events with a key in the bucket and since the start."""
    per_bucket = (
        keyed(df, key, *by, ts).where(F.col(ts).isNotNull()).select(*by, time_bucket(F.col(ts), bucket).alias("bucket"))
        .groupBy(*by, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = per_bucket.withColumn("_at", _micros("bucket"))
    chunk = CHUNK_TICKS * interval_seconds(bucket) * 1_000_000
    return running(placed, by, "_at", sums={"total_count": "n"}, chunk=chunk).drop("_at")


# Length of a chunk of a running report, in buckets.
CHUNK_TICKS = 4096


def tumbling_report(df: DataFrame, key: str, ts: str, tick: str) -> DataFrame:
    """One row per tick from the first event's to the last's, idle ticks included:
    events in the tick, events since the start, and the tick's most frequent key."""
    counts = bucket_counts(df, key, ts, tick)
    leader = F.min_by(F.struct("key", "n"), F.struct(-F.col("n"), F.col("key")))
    busy = counts.groupBy("bucket").agg(F.sum("n").alias("n"), leader.alias("_top"))
    step = interval_seconds(tick) * 1_000_000
    chunk = CHUNK_TICKS * step
    # the chunks from the first tick to the last are dealt to tasks, which write out their own ticks
    ends = busy.agg(F.min(_micros("bucket")).alias("first"), F.max(_micros("bucket")).alias("last"))
    chunks = ends.select(
        "first", "last", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor(F.col("last") / chunk))).alias("part"))
    own = F.sequence(
        F.greatest("first", _next_tick(F.col("part") * chunk, F.col("first"), step)),
        F.least("last", _next_tick((F.col("part") + 1) * chunk, F.col("first"), step) - step), F.lit(step).cast("bigint"))
    ticks = chunks.repartition("part").select(F.explode(own).alias("_at"))
    every = ticks.join(busy.withColumn("_at", _micros("bucket")), "_at", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = running(every, (), "_at", sums={"total_count": "n"}, chunk=chunk)
    return totals.select(
        F.timestamp_micros("_at").cast(busy.schema["bucket"].dataType).alias("tick"), "n",
        F.col("_top.key").alias("top_key"), F.col("_top.n").alias("top_count"), "total_count")


def _next_tick(at: Column, first: Column, step: int) -> Column:
    """The first tick, counted from `first`, at or after `at`."""
    return (first + F.ceil((at - first) / step) * step).cast("bigint")
