import random

import pytest
from pyspark.sql import functions as F

from tallystream.operators import cms, hll, windows
from tallystream.operators.control import Thresholds, apply_cooldown, decide
from tallystream.operators import epochs
from tallystream.operators.snapshots import cluster_metrics, latency_history
from tallystream.sources import events as ev
from tallystream.sources.zipf import zipf_event_stream
from tallystream.streaming import control as stream_control
from tallystream.streaming import sketches as ss

EVENTS = "/root/testdata/sf0.001/events.parquet"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    df = spark.read.parquet(EVENTS)
    return df.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("key"),
        "event_type", "value",
    ).cache()


@pytest.fixture(scope="module")
def folder(table, tmp_path_factory):
    """The events in five files, in time order."""
    path = str(tmp_path_factory.mktemp("events"))
    for i in range(5):
        part = table.where(F.floor((F.dayofmonth("ts") - 1) / 6) == i).coalesce(1)
        part.write.mode("append").parquet(path)
    return path


def stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def test_running_sketches_equal_batch(spark, table, folder, tmp_path):
    events = stream(spark, folder, table.schema)
    cells = ss.running_cms(events, "key", 512, 3)
    ss.start_table(cells.cells, str(tmp_path / "cms"), str(tmp_path / "c1"), "complete").awaitTermination(120)
    registers = ss.running_hll(events, "key", 10)
    ss.start_table(registers.registers, str(tmp_path / "hll"), str(tmp_path / "c2"), "complete").awaitTermination(120)
    assert rows(ss.read_state(spark, str(tmp_path / "cms"))) == rows(cms.cms_build(table, "key", 512, 3).cells)
    assert rows(ss.read_state(spark, str(tmp_path / "hll"))) == rows(hll.hll_build(table, "key", 10).registers)


def test_buckets_equal_batch_and_feed_sliding_windows(spark, table, folder, tmp_path):
    events = stream(spark, folder, table.schema)
    counted = ss.bucket_counts_stream(events, "key", "ts", "1 hour", "0 seconds")
    ss.start_table(counted, str(tmp_path / "b"), str(tmp_path / "c")).awaitTermination(120)
    got = ss.read_table(spark, str(tmp_path / "b"))
    # buckets that the watermark has closed
    newest = table.agg(F.max("ts")).first()[0]
    closed = windows.bucket_counts(table, "key", "ts", "1 hour").where(
        F.col("bucket") + F.expr("interval 1 hour") <= F.lit(newest)
    )
    assert rows(got.select("bucket", "key", "n")) == rows(closed)
    assert rows(windows.sliding_heavy_hitters(got, 5, "6 hours", "1 hour")) == rows(
        windows.sliding_heavy_hitters(closed, 5, "6 hours", "1 hour")
    )


def test_tick_counts(spark, table, folder, tmp_path):
    events = stream(spark, folder, table.schema)
    ticks = ss.tick_counts_stream(events, "key", "ts", "6 hours", "0 seconds")
    ss.start_table(ticks, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    want = {r.bucket: r.n for r in windows.running_total(table, "key", "ts", "6 hours").collect()}
    got = {r.tick: r.n for r in ss.read_table(spark, str(tmp_path / "t")).collect()}
    assert got and all(want[t] == n for t, n in got.items())


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    def write(name, seconds):
        spark.createDataFrame([("k", s) for s in seconds], "key string, s bigint").select(
            "key", F.timestamp_seconds("s").alias("ts")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    source = str(tmp_path / "in")
    write("first", [1000, 1001, 5000])
    events = stream(spark, source, "key string, ts timestamp")
    counted = ss.bucket_counts_stream(events, "key", "ts", "100 seconds", "10 seconds")
    ss.start_table(counted, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    write("second", [1002, 9000])
    query = ss.start_table(counted, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(120)
    dropped = sum(
        s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]
    )
    assert dropped == 1
    got = {int(r.bucket.timestamp()): r.n for r in ss.read_table(spark, str(tmp_path / "out")).collect()}
    assert got == {1000: 2, 5000: 1}


def test_restart_from_checkpoint_neither_loses_nor_doubles(spark, table, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    half = table.where("event_id < 400").coalesce(1)
    half.write.parquet(source)
    events = stream(spark, source, table.schema)
    ss.start_snapshots(events, out, checkpoint).awaitTermination(120)
    table.where("event_id >= 400").coalesce(1).write.mode("append").parquet(source)
    ss.start_snapshots(stream(spark, source, table.schema), out, checkpoint).awaitTermination(120)
    assert rows(ss.read_table(spark, out)) == rows(table)


def test_snapshot_history_answers(spark, tmp_path):
    metrics = spark.range(200).select(
        F.concat(F.lit("w"), F.col("id") % 2).alias("worker_id"), F.timestamp_seconds("id").alias("ts"),
        F.col("id").cast("double").alias("p99_latency_ms"),
    )
    metrics.write.parquet(str(tmp_path / "in"))
    ss.start_snapshots(
        stream(spark, str(tmp_path / "in"), metrics.schema), str(tmp_path / "h"), str(tmp_path / "c")
    ).awaitTermination(120)
    history = ss.read_table(spark, str(tmp_path / "h"))
    assert sorted(r.p99_latency_ms for r in cluster_metrics(history).collect()) == [198.0, 199.0]
    assert latency_history(history).count() == 120


def metrics_table(spark):
    rng = random.Random(9)
    data, t = [], 0
    for _ in range(300):
        t += rng.randint(1, 9)
        data.append((f"w{rng.randint(0, 2)}", t, rng.choice(["low", "medium", "high"]), rng.uniform(100, 300), rng.uniform(0, 100), 100, rng.uniform(0, 10)))
    return spark.createDataFrame(
        data, "worker_id string, s bigint, template string, p99_latency_ms double, memory_percent double, cms_total_count bigint, cms_error_estimate double"
    ).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_streamed_cooldown_equals_batch(spark, tmp_path):
    metrics = metrics_table(spark)
    source = str(tmp_path / "in")
    for low, high in ((0, 400), (400, 900), (900, 10_000)):
        part = metrics.where((F.col("ts") >= F.timestamp_seconds(F.lit(low))) & (F.col("ts") < F.timestamp_seconds(F.lit(high))))
        part.coalesce(1).write.mode("append").parquet(source)
        stream_control.start_decisions(
            stream(spark, source, metrics.schema), str(tmp_path / "out"), str(tmp_path / "c"), Thresholds(), "15 seconds"
        ).awaitTermination(120)
    want = apply_cooldown(decide(metrics), "15 seconds")
    got = ss.read_table(spark, str(tmp_path / "out")).select(*want.columns)
    assert want.count() > 20
    assert rows(got) == rows(want)


def test_streamed_epochs_equal_batch_with_late_files_and_late_commands(spark, table, tmp_path):
    days = spark.range(1, 25, 5).withColumnRenamed("id", "d")
    commands = days.select(
        F.explode(F.array(F.lit("click"), F.lit("view"))).alias("worker_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 86400).alias("ts"),
        F.lit("set_template").alias("action"),
        F.element_at(F.array(F.lit("low"), F.lit("high")), (F.col("d") % 2 + 1).cast("int")).alias("template"),
        F.lit(None).cast("int").alias("k"),
    )
    late = commands.limit(3).select(
        "worker_id", (F.col("ts") + F.expr("interval 2 days 30 seconds")).alias("ts"), F.lit("resize_mg").alias("action"),
        F.lit(None).cast("string").alias("template"), F.lit(30).alias("k"))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    for part in (2, 0, 1):  # files come out of order, with a restart between any two
        cut = table.where(f"floor((unix_timestamp(ts) - 1704067200) / 864000) = {part}" if part < 2 else "unix_timestamp(ts) - 1704067200 >= 1728000")
        cut.coalesce(1).write.mode("append").parquet(source)
        ss.start_epoch_sketches(stream(spark, source, table.schema), "key", "event_type", "ts", out, checkpoint).awaitTermination(120)
    keys = spark.createDataFrame([("1",), ("17",), ("absent",)], "key string")
    for known in (commands, commands.unionByName(late)):
        parts = ss.read_epochs(spark, out, known)
        batch = (table, "key", "event_type", "ts", known)
        assert rows(epochs.parts_report(parts)) == rows(epochs.template_epochs(*batch, grain="1 minute"))
        assert rows(epochs.parts_heavy_hitters(parts)) == rows(epochs.epoch_heavy_hitters(*batch, grain="1 minute"))
        assert rows(epochs.parts_frequency(parts, keys)) == rows(epochs.epoch_frequency(*batch, keys, grain="1 minute"))


def test_message_stream(spark, tmp_path):
    good = spark.range(20).select(F.concat(F.lit("k"), "id").alias("key"), F.timestamp_seconds("id").alias("ts"))
    ev.write_events(good, "file", str(tmp_path / "in"))
    spark.createDataFrame([("{broken",), ('{"key":7}',)], "value string").write.mode("append").text(str(tmp_path / "in"))
    parsed = ev.parse_messages(ev.read_messages(spark, "file", path=str(tmp_path / "in")))
    ss.start_table(ev.valid_events(parsed), str(tmp_path / "ok"), str(tmp_path / "c1")).awaitTermination(120)
    ss.start_table(ev.quarantine(parsed), str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination(120)
    assert rows(ss.read_table(spark, str(tmp_path / "ok"))) == rows(good)
    assert sorted(r.reason for r in ss.read_table(spark, str(tmp_path / "bad")).collect()) == ["malformed", "non_string_key"]
    written = ev.write_events(
        ev.read_events(spark, "file", path=str(tmp_path / "in")), "file", str(tmp_path / "copy"), str(tmp_path / "c3")
    )
    written.processAllAvailable()
    written.stop()
    assert spark.read.text(str(tmp_path / "copy")).count() == 20


def test_paced_zipf_stream(spark):
    events = zipf_event_stream(spark, 50, n_items=20)
    query = events.writeStream.format("memory").queryName("zipf_paced").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("zipf_paced").count() > 0:
                break
    finally:
        query.stop()
    got = spark.table("zipf_paced")
    assert got.count() > 0
    assert got.where(~F.col("key").rlike("^item_([1-9]|1[0-9]|20)$")).count() == 0


def test_snapshots_have_the_metrics_schema(spark, table, tmp_path):
    from pyspark.sql.types import StructType

    from tallystream.operators.reports import as_snapshots, sketch_report
    from tallystream.schemas import METRICS

    report = sketch_report(table, "key", "event_type", F.lit("medium"), "ts", "event_id", "value")
    rows_ = as_snapshots(report, F.lit(1704067200).cast("timestamp"))
    assert [(f.name, f.dataType) for f in rows_.schema] == [
        (f.name, f.dataType) for f in StructType.fromDDL(METRICS)
    ]
    rows_.write.parquet(str(tmp_path / "in"))
    # no checkpoint given: progress goes to the shared folder of the session
    source = stream(spark, str(tmp_path / "in"), rows_.schema)
    ss.start_snapshots(source, str(tmp_path / "h")).awaitTermination(120)
    live = cluster_metrics(ss.read_table(spark, str(tmp_path / "h"))).collect()
    assert len(live) == 5 and all(r.mg_heavy_hitters[0]["count"] > 0 for r in live)
