"""Zipf-distributed keyed events, with drift, as expressions over row numbers.

Every draw is a hash of (seed, row id), so a recomputed partition gives the same rows, a stream and
its batch twin agree, and no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystream.functions.hashing import bits_mod, unit_interval, with_bits
from tallystream.functions.numbers import epoch_micros, interval_seconds

# Vocabulary up to this many keys is broadcast; a larger one is joined by shuffle.
BROADCAST_ITEMS_MAX = 250_000
PREFIX_BLOCK = 65_536


def cumulative_distribution(ranks: DataFrame, rank: str, s: float) -> DataFrame:
    """(rank, lo, hi): each rank's slice of [0, 1) under P(rank k) ~ 1 / k^s; s = 0 is uniform.

    Prefix sums run within blocks of ranks; the blocks' totals are summed up separately.
    """
    weighed = ranks.select(F.col(rank).cast("bigint").alias("rank")).withColumn(
        "_w", F.lit(1.0) / F.pow(F.col("rank").cast("double"), F.lit(float(s)))
    ).withColumn("_block", F.floor((F.col("rank") - 1) / PREFIX_BLOCK))
    inside = Window.partitionBy("_block").orderBy("rank")
    summed = weighed.withColumn(
        "_upto", F.sum("_w").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        summed.groupBy("_block")
        .agg(F.max_by("_upto", "rank").alias("_sum"), F.max("rank").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
        .withColumn("_total", F.last(F.col("_before") + F.col("_sum")).over(last))
        .withColumn("_n", F.last("_n").over(last))
        .select("_block", "_before", "_total", "_n")
    )
    # lo repeats the very steps of the previous rank's hi, so that slices leave no gap
    previous = F.coalesce(F.lag("_upto").over(inside), F.lit(0.0))
    placed = summed.withColumn("_under", previous).join(blocks, "_block")
    hi = (F.col("_before") + F.col("_upto")) / F.col("_total")
    return placed.select(
        "rank",
        ((F.col("_before") + F.col("_under")) / F.col("_total")).alias("lo"),
        # the last rank takes what rounding leaves over
        F.when(F.col("rank") == F.col("_n"), F.lit(1.0)).otherwise(hi).alias("hi"),
    )


def zipf_cdf(ranks: DataFrame, rank: str, s: float) -> DataFrame:
    """(rank, cdf)."""
    return cumulative_distribution(ranks, rank, s).select("rank", F.col("hi").alias("cdf"))


def zipf_keys(
    rows: DataFrame,
    row_id: str,
    n_items: int = 10_000,
    s: float = 1.2,
    seed: int = 0,
    ts: str | None = None,
    shift_interval: str | None = None,
    start: Column | None = None,
) -> DataFrame:
    """The rows (a table or a stream) with a drawn `key` item_1 ... item_n.

    A draw finds its rank by an equality join on one of n_items cells of [0, 1) and the rank's slice; each slice
    is listed in the cells it touches, at most 2 n_items rows in all. With `shift_interval` all ranks rotate
    by a new offset in each interval of `ts` after `start`.
    """
    if n_items < 1 or s < 0:
        raise ValueError("n_items must be at least 1 and s not negative")
    spark = rows.sparkSession
    ranks = spark.range(1, n_items + 1).withColumnRenamed("id", "rank")
    slices = cumulative_distribution(ranks, "rank", s)
    cell = lambda u: F.least(F.floor(u * n_items), F.lit(n_items - 1)).cast("bigint")
    listed = slices.select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("_cell"))
    if n_items <= BROADCAST_ITEMS_MAX:
        listed = F.broadcast(listed)
    seeded = lambda c: F.concat(F.lit(f"{seed}:"), c.cast("string"))
    drawn = with_bits(rows, seeded(F.col(row_id)), "_bits")
    drawn = drawn.withColumn("_u", unit_interval(F.col("_bits"))).withColumn("_cell", cell(F.col("_u")))
    placed = drawn.join(listed, "_cell").where(
        (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))
    )
    zero_rank = F.col("rank") - 1
    if shift_interval is not None:
        if ts is None or start is None:
            raise ValueError("drift needs ts and start")
        width = interval_seconds(shift_interval) * 1_000_000
        epoch = F.floor((epoch_micros(F.col(ts)) - epoch_micros(start)) / width)
        placed = with_bits(placed.withColumn("_epoch", epoch), seeded(F.col("_epoch")), "_turn")
        # no rotation in epoch 0, then an offset drawn per epoch
        offset = F.when(F.col("_epoch") <= 0, F.lit(0)).otherwise(bits_mod(F.col("_turn"), n_items))
        zero_rank = F.pmod(zero_rank + offset, F.lit(n_items))
    key = F.concat(F.lit("item_"), (zero_rank + 1).cast("string"))
    return placed.select(*rows.columns, key.alias("key"))


def zipf_events(
    spark: SparkSession,
    n_rows: int,
    n_items: int = 10_000,
    s: float = 1.2,
    seed: int = 0,
    rate: float = 5000.0,
    start: str = "2024-01-01 00:00:00",
    shift_interval: str | None = None,
) -> DataFrame:
    """(id, key, ts): n_rows events, `rate` per second of event time from `start` on (0: all at start)."""
    first = F.lit(start).cast("timestamp")
    micros = F.floor(F.col("id") * F.lit(1e6 / rate)) if rate > 0 else F.lit(0)
    rows = spark.range(n_rows).withColumn(
        "ts", F.timestamp_micros(F.unix_micros(first) + micros.cast("bigint"))
    )
    return zipf_keys(rows, "id", n_items, s, seed, "ts", shift_interval, first)


def zipf_event_stream(
    spark: SparkSession, rows_per_second: int = 5000, n_items: int = 10_000, s: float = 1.2, seed: int = 0,
    shift_interval: str | None = None, start: str = "2024-01-01 00:00:00",
) -> DataFrame:
    """(key, ts) as an endless paced stream."""
    ticks = (
        spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
        .withColumnsRenamed({"timestamp": "ts", "value": "id"})
    )
    keyed = zipf_keys(ticks, "id", n_items, s, seed, "ts", shift_interval, F.lit(start).cast("timestamp"))
    return keyed.select("key", "ts")
