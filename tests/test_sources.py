import datetime

import pytest
from pyspark.sql import functions as F

from tallystream.sources import events as ev
from tallystream.sources import zipf

MESSAGES = [
    ('{"key":"a","ts":1704067207.179575}', "ok"),
    ('{"key":"b","ts":1.7e9,"source":"p0"}', "ok"),
    ('{"key":"c"}', "ok"),
    ('{"key":"a","ts":', "malformed"),
    ("", "malformed"),
    ('{"key":42,"ts":1.0}', "non_string_key"),
    ('{"key":{"x":1},"ts":1.0}', "non_string_key"),
    ('{"key":null,"ts":1.0}', "non_string_key"),
    ('{"key":"","ts":1.0}', "empty_key"),
    ('{"name":"a","ts":1.0}', "missing_key"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(m,) for m, _ in MESSAGES], "value string")
    parsed = ev.parse_messages(df)
    got = {r.value: r.reason for r in parsed.collect()}
    for message, reason in MESSAGES:
        if "null" in message:
            assert got[message] in ("missing_key", "non_string_key")
        else:
            assert got[message] == reason, message
    assert sorted(r.key for r in ev.valid_events(parsed).collect()) == ["a", "b", "c"]
    assert ev.quarantine(parsed).count() == 7
    first = ev.valid_events(parsed).where("key = 'a'").first()
    assert first.ts == datetime.datetime(2024, 1, 1, 0, 0, 7, 179575)


def test_messages_round_trip_through_files(spark, tmp_path):
    events = spark.range(50).select(
        F.concat(F.lit('k"'), F.col("id")).alias("key"), F.timestamp_micros(F.lit(1_700_000_000_123_456) + F.col("id")).alias("ts")
    )
    ev.write_events(events, "file", str(tmp_path / "out"))
    back = ev.read_events(spark, "file", path=str(tmp_path / "out"), stream=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, events.collect()))


def test_unknown_sources_are_refused(spark):
    with pytest.raises(ValueError):
        ev.read_messages(spark, "ftp")
    with pytest.raises(ValueError):
        ev.read_messages(spark, "file")


@pytest.mark.parametrize("n_items,s", [(1, 1.0), (10, 0.0), (1000, 1.2), (70_000, 1.2)])
def test_every_row_gets_one_key(spark, n_items, s):
    assert zipf.zipf_events(spark, 20_000, n_items, s, seed=1).count() == 20_000


def test_slices_leave_no_gap(spark, monkeypatch):
    monkeypatch.setattr(zipf, "PREFIX_BLOCK", 64)
    ranks = spark.range(1, 1001).withColumnRenamed("id", "rank")
    slices = zipf.cumulative_distribution(ranks, "rank", 1.2).orderBy("rank").collect()
    assert slices[0].lo == 0.0 and slices[-1].hi == 1.0
    assert all(a.hi == b.lo for a, b in zip(slices, slices[1:]))
    total = sum(k ** -1.2 for k in range(1, 1001))
    assert abs(slices[0].hi - 1 / total) < 1e-12


def test_frequencies_follow_the_law(spark):
    n = 100_000
    counts = {r.key: r["count"] for r in zipf.zipf_events(spark, n, 1000, 1.2, seed=5).groupBy("key").count().collect()}
    total = sum(k ** -1.2 for k in range(1, 1001))
    for k in (1, 2, 5, 20):
        p = k ** -1.2 / total
        assert abs(counts[f"item_{k}"] - n * p) < 5 * (n * p) ** 0.5


def test_uniform_draws(spark):
    counts = [r["count"] for r in zipf.zipf_events(spark, 50_000, 10, 0.0).groupBy("key").count().collect()]
    assert len(counts) == 10 and max(counts) - min(counts) < 600


def test_drift_rotates_all_ranks(spark):
    df = zipf.zipf_events(spark, 3000, 100, 1.2, seed=2, rate=10, shift_interval="100 seconds")
    still = zipf.zipf_events(spark, 3000, 100, 1.2, seed=2, rate=10)
    both = df.join(still.withColumnRenamed("key", "plain"), ["id", "ts"]).withColumn(
        "turn", F.pmod(F.substring("key", 6, 9).cast("int") - F.substring("plain", 6, 9).cast("int"), F.lit(100))
    ).withColumn("epoch", F.floor(F.col("id") / 1000))
    turns = {r.epoch: r.t for r in both.groupBy("epoch").agg(F.collect_set("turn").alias("t")).collect()}
    assert turns[0] == [0]
    assert all(len(t) == 1 for t in turns.values())
    assert len({t[0] for t in turns.values()}) > 1


def test_pacing_and_determinism(spark):
    df = zipf.zipf_events(spark, 11, rate=2, start="2024-01-01 00:00:00").orderBy("id").collect()
    assert df[10].ts - df[0].ts == datetime.timedelta(seconds=5)
    again = zipf.zipf_events(spark, 11, rate=2, start="2024-01-01 00:00:00").orderBy("id").collect()
    assert df == again
