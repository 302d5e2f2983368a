"""Keyed events as JSON messages {"key": str, "ts": epoch seconds}: reading, checking, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.numbers import epoch_micros

DEFAULT_TOPIC = "stream_events"
# `ts` is in seconds since 1970; what lies before that or beyond the year 9999 is in another unit or damaged.
MAX_SECONDS = 253_402_300_800


def read_messages(
    spark: SparkSession, source: str = "kafka", path: str | None = None, stream: bool = True, **options: str
) -> DataFrame:
    """Raw messages as one string column `value`.

    `kafka` reads a topic from the latest offsets on (needs the spark-sql-kafka package on the cluster);
    `file` reads a folder of JSON lines, as a stream of new files or as a table.
    """
    reader = spark.readStream if stream else spark.read
    if source == "kafka":
        defaults = {"subscribe": DEFAULT_TOPIC}
        if stream:
            defaults["startingOffsets"] = "latest"
        raw = reader.format("kafka").options(**{**defaults, **options}).load()
        return raw.select(F.col("value").cast("string").alias("value"))
    if source == "file":
        if path is None:
            raise ValueError("a file source needs a path")
        return reader.format("text").options(**options).load(path)
    raise ValueError(f"unknown source {source!r}")


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds key, ts and reason; `reason` is 'ok' or why the message is not an event. No message ends the query."""
    parsed = messages.withColumn("_v", F.try_parse_json(F.col(value)))
    kind = F.schema_of_variant(F.try_variant_get("_v", "$.key", "variant"))
    seconds = F.try_variant_get("_v", "$.ts", "double")
    in_range = (seconds >= 0) & (seconds < MAX_SECONDS)
    micros = F.when(in_range, F.round(seconds * F.lit(1e6)).cast("bigint"))
    typed = parsed.withColumns({
        "_kind": kind, "_key": F.try_variant_get("_v", "$.key", "string"), "_bad_ts": seconds.isNotNull() & ~in_range,
    })
    reason = (
        F.when(F.col("_v").isNull(), F.lit("malformed"))
        .when(F.col("_kind").isNull(), F.lit("missing_key"))
        .when(F.col("_kind") != "STRING", F.lit("non_string_key"))
        .when(F.col("_key") == "", F.lit("empty_key"))
        .when(F.col("_bad_ts"), F.lit("bad_ts"))
        .otherwise(F.lit("ok"))
    )
    kept = [c for c in messages.columns]
    return typed.withColumn("reason", reason).select(
        *kept,
        F.when(F.col("reason") == "ok", F.col("_key")).alias("key"),
        F.timestamp_micros(micros).alias("ts"),
        "reason",
    )


def valid_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason") == "ok").select("key", "ts")


def quarantine(parsed: DataFrame, value: str = "value") -> DataFrame:
    """The rejected messages, with the reason."""
    return parsed.where(F.col("reason") != "ok").select(value, "reason")


def read_events(spark: SparkSession, source: str = "kafka", **options) -> DataFrame:
    """(key, ts) of the valid events."""
    return valid_events(parse_messages(read_messages(spark, source, **options)))


def event_message(key: Column, ts: Column) -> Column:
    """The JSON message of an event; seconds keep their microseconds."""
    seconds = (epoch_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast(
        "decimal(20,6)"
    )
    return F.to_json(F.struct(key.cast("string").alias("key"), seconds.alias("ts")))


def to_messages(events: DataFrame) -> DataFrame:
    return events.select(event_message(F.col("key"), F.col("ts")).alias("value"))


def write_events(
    events: DataFrame, sink: str = "kafka", path: str | None = None, checkpoint: str | None = None,
    **options: str,
):
    """Publish (key, ts) rows as messages; a stream gives its query, a table is written at once."""
    messages = to_messages(events)
    if sink not in ("kafka", "file"):
        raise ValueError(f"unknown sink {sink!r}")
    if sink == "file" and path is None:
        raise ValueError("a file sink needs a path")
    form = "kafka" if sink == "kafka" else "text"
    settings = {"topic": DEFAULT_TOPIC, **options} if sink == "kafka" else {"path": path, **options}
    if events.isStreaming:
        if checkpoint is None:
            raise ValueError("a streaming sink needs a checkpoint folder")
        return (
            messages.writeStream.format(form).options(**settings)
            .option("checkpointLocation", checkpoint).outputMode("append").start()
        )
    messages.write.format(form).options(**settings).mode("append").save()
    return None
