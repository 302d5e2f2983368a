"""Stored sketches, versions of stream state, merged runs, and the reports that need them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallystream.operators import stored, windows
from tallystream.operators.cms import cms_build, cms_query
from tallystream.operators.heavy_hitters import mg_summary
from tallystream.operators.hll import hll_build, hll_estimate
from tallystream.streaming import reports, versions
from tallystream.streaming import sketches as ss


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    data = [(i, f"k{int(rng.paretovariate(1)) % 90}", float(i // 4)) for i in range(3_000)]
    return spark.createDataFrame(data, "id long, key string, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s").cache()


def test_saved_halves_answer_like_the_whole(spark, events, tmp_path):
    for half in (0, 1):
        stored.save_sketches(events.where(F.col("id") % 2 == half), "key", str(tmp_path / f"h{half}"))
    whole = stored.merge_stored(*[stored.load_sketches(spark, str(tmp_path / f"h{i}")) for i in (0, 1)])
    assert rows(cms_query(whole.cms, "k1")) == rows(cms_query(cms_build(events, "key", 2048, 5), "k1"))
    assert rows(hll_estimate(whole.hll)) == rows(hll_estimate(hll_build(events, "key", 12)))
    assert rows(whole.summary) == rows(mg_summary(events, "key", 200)) and whole.total == 3_000


def test_sketches_that_do_not_fit_are_refused(spark, events, tmp_path):
    stored.save_sketches(events, "key", str(tmp_path / "a"))
    stored.save_sketches(events, "key", str(tmp_path / "b"), "high")
    stored.save_sketches(events, "key", str(tmp_path / "c"), hash_mode="xxhash64")
    a, b, c = (stored.load_sketches(spark, str(tmp_path / x)) for x in "abc")
    for other in (b, c):
        with pytest.raises(ValueError, match="equal parameters"):
            stored.merge_stored(a, other)
    with pytest.raises(ValueError, match="no complete sketches"):
        stored.load_sketches(spark, str(tmp_path / "none"))
    spark.read.parquet(str(tmp_path / "a" / "parameters")).withColumn("format", F.lit(99)).write.parquet(str(tmp_path / "d" / "parameters"))
    with pytest.raises(ValueError, match="format"):
        stored.load_sketches(spark, str(tmp_path / "d"))


def test_state_keeps_the_newest_versions_only(spark, tmp_path):
    path = str(tmp_path / "state")
    assert versions.read_version(spark, path, schema="x long").count() == 0
    for v in range(5):
        versions.write_version(spark.range(v), path, v)
        versions.write_version(spark.range(v + 1), path, v)  # a retry
    os.makedirs(f"{path}/version=9")  # a batch that failed half-way
    assert versions.versions(spark, path) == [3, 4]
    assert versions.read_version(spark, path).count() == 5
    assert versions.read_version(spark, path, before=4).count() == 4


def test_runs_are_merged_and_retries_change_nothing(spark, tmp_path):
    path, n = str(tmp_path / "runs"), 70
    for batch in range(n):
        versions.append_run(spark.range(batch, batch + 1).coalesce(1), path, batch)
        if batch % 9 == 0:
            versions.append_run(spark.range(batch, batch + 1).coalesce(1), path, batch)
    assert sorted(r.id for r in versions.read_runs(spark, path).collect()) == list(range(n))
    known = versions.runs(spark, path)
    assert len(known) <= 2 * versions.FAN_IN and known[0] == (0, 63)
    assert len([f for f in os.listdir(path) if f.startswith("run=")]) == len(known)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_tick_report_equals_batch(spark, tmp_path):
    """Idle ticks, rows without a key, files in steps with a restart between them, and a late row."""
    for name, value in reports.STATE_STORE.items():
        spark.conf.set(name, value)
    seconds = [1, 2, 2, 3, 61, 62, 400, 401, 402, 700, 705, 1_300, 1_301, 2_000]
    data = [(f"k{s % 3}", s) for s in seconds] + [("", 500), (None, 501)]
    table = spark.createDataFrame(data, "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    cuts = [(0, 100), (100, 450), (450, 1_000), (1_000, 1_500), (1_500, 3_000)]
    for i, (low, high) in enumerate(cuts):
        table.where(f"s >= {low} and s < {high}").coalesce(1).write.mode("append").parquet(source)
        if i == 3:
            table.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(5))).coalesce(1).write.mode("append").parquet(source)
        report = reports.tick_report_stream(stream(spark, source, table.schema), "key", "ts", "60 seconds", "10 seconds")
        ss.start_table(report, out, checkpoint).awaitTermination(180)
    got = {r.tick: tuple(r)[1:] for r in ss.read_table(spark, out).collect()}
    want = {r.tick: (r.n, r.top_key, r.top_count, r.total_count) for r in windows.tumbling_report(table, "key", "ts", "60 seconds").collect()}
    last = max(got)
    assert got == {t: x for t, x in want.items() if t <= last}
    assert last.timestamp() >= 1_860 and sum(x[0] == 0 for x in got.values()) > 20


def test_on_time_and_late_rows_are_all_rows(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    schema = "id long, s double"
    parts = [[(1, 100.0), (2, 5.0)], [(3, 95.0), (4, 89.0), (5, None)], [(6, 300.0), (7, 90.5)], [(8, 289.0), (9, 290.0)]]
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(source)
        events = stream(spark, source, spark.read.parquet(source).schema)
        reports.start_on_time(events, "ts", "10 seconds", out, checkpoint).awaitTermination(120)
    on_time = sorted(r.id for r in ss.read_table(spark, f"{out}/on_time").collect())
    late = ss.read_table(spark, f"{out}/late")
    assert on_time == [1, 2, 3, 6, 7, 9]
    assert {r.id: r.reason for r in late.collect()} == {4: "late", 5: "no time", 8: "late"}
    assert {r.reason: r.n for r in reports.late_counts(late).collect()} == {"late": 2, "no time": 1}
