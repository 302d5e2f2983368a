"""Nulls, NaN and empty input: both sides of each size bound give the same rows and columns."""

import pytest
from pyspark.sql import functions as F

from tallystream.operators import cms as cms_module
from tallystream.operators.cms import cms_build, cms_lookup, cms_query
from tallystream.operators.control import decide, template_timeline
from tallystream.operators.epochs import parameter_timeline
from tallystream.operators.ordered import TAKE_ORDERED_MAX, last_known, last_n, last_n_per_group, previous_row
from tallystream.operators.percentiles import ARRAY_MAX, exact_percentiles, rolling_percentiles
from tallystream.operators.ranking import node_score
from tallystream.operators.reports import sketch_report
from tallystream.sources.events import parse_messages


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def events(spark):
    times = [None, 1, 2, 2, 2, 3, None, 4, 5, 5]
    return spark.createDataFrame(
        [(i, t, None if i % 3 == 0 else "g", float(i) if i % 2 else None, "k") for i, t in enumerate(times)],
        "id long, s long, grp string, v double, key string",
    ).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_last_n_is_the_same_on_both_sides(events):
    assert rows(last_n(events, "ts", "id", TAKE_ORDERED_MAX)) == rows(last_n(events, "ts", "id", TAKE_ORDERED_MAX + 1))
    assert last_n(events, "ts", "id", 1000).count() == 8
    near = rows(last_n_per_group(events, ["grp"], "ts", "id", TAKE_ORDERED_MAX))
    assert near == rows(last_n_per_group(events, ["grp"], "ts", "id", TAKE_ORDERED_MAX + 1)) and len(near) == 8


def test_percentiles_are_the_same_on_both_sides(events, spark):
    extra = events.union(spark.createDataFrame(
        [(90, "none", None, "k"), (91, "nan", float("nan"), "k"), (92, "nan", 1.0, "k"), (93, "inf", float("inf"), "k")],
        "id long, grp string, v double, key string").withColumn("ts", F.timestamp_seconds(F.lit(9))))
    for by in ([], ["grp"]):
        got = [rolling_percentiles(extra, "v", "ts", "id", by, n) for n in (ARRAY_MAX, ARRAY_MAX + 1)]
        assert got[0].columns == got[1].columns and rows(got[0]) == rows(got[1])
        empty = [rolling_percentiles(extra.limit(0), "v", "ts", "id", by, n) for n in (ARRAY_MAX, ARRAY_MAX + 1)]
        assert rows(empty[0]) == rows(empty[1])
    none = exact_percentiles(extra, "v", ["grp"]).where("grp = 'none'").first()
    assert (none.samples, none.p50, none.p99) == (0, 0.0, 0.0)


def test_lookup_has_the_same_columns_on_both_sides(spark, keys, monkeypatch):
    sketch = cms_build(keys({"a": 3, "b": 1}), "key", 64, 3)
    wanted = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "other int, key string")
    near = cms_lookup(sketch, wanted)
    monkeypatch.setattr(cms_module, "DENSE_CELLS_MAX", 0)
    far = cms_lookup(sketch, wanted)
    assert near.columns == far.columns == ["other", "key", "estimate"] and rows(near) == rows(far)


def test_every_group_answers_a_point_query(spark):
    df = spark.createDataFrame([("x", "a")] * 4 + [("y", "b"), (None, "a")], "g string, key string")
    got = {r.g: r.estimate for r in cms_query(cms_build(df, "key", 2048, 5, ["g"]), "a").collect()}
    assert got == {"x": 4, "y": 0, None: 1}


def test_fractional_weights_are_refused(spark):
    df = spark.createDataFrame([("a", 0.5)] * 10, "key string, w double")
    with pytest.raises(Exception, match="whole numbers"):
        cms_build(df, "key", 64, 3, weight="w").cells.collect()
    whole = spark.createDataFrame([("a", 2.0)] * 10, "key string, w double")
    assert cms_query(cms_build(whole, "key", 64, 3, weight="w"), "a").first().estimate == 20


def test_timelines_keep_null_groups_and_rows_without_a_time(events):
    assert previous_row(events, ["grp"], "ts", {"id": "before"}).count() == events.count()
    assert last_known(events, ["grp"], "ts", "v", "known").count() == events.count()


def test_impossible_times_are_quarantined(spark):
    texts = ['{"key":"a","ts":1.7e15}', '{"key":"a","ts":1e30}', '{"key":"a","ts":-5}', '{"key":"a","ts":1.7e9}', '{"key":"a"}']
    got = parse_messages(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [r.reason for r in got] == ["bad_ts"] * 3 + ["ok"] * 2


def test_nan_latency_is_no_high_latency(spark):
    metrics = spark.createDataFrame(
        [("w", "high", float("nan"), 10.0, 100, 0.0)],
        "worker_id string, template string, p99_latency_ms double, memory_percent double, cms_total_count long, "
        "cms_error_estimate double").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    assert decide(metrics).count() == 0
    score = metrics.select(node_score(F.lit(0.9), F.lit(50.0)).alias("s")).first().s
    assert score == score


def test_commands_at_one_time_have_one_order(spark):
    at = F.timestamp_seconds(F.lit(100))
    commands = spark.createDataFrame(
        [("w", "set_template", "medium"), ("w", "set_template", "high")], "worker_id string, action string, template string"
    ).withColumn("ts", at)
    metrics = spark.createDataFrame([("w",)], "worker_id string").withColumn("ts", at)
    assert template_timeline(metrics, commands).first().template == "high"
    assert [r.template for r in parameter_timeline(commands).where("epoch > 0").collect()] == ["high"]


def test_report_keeps_workers_whose_last_events_have_no_key(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, 1.0), ("a", "", 2, 2.0), ("a", None, 3, 3.0), ("b", "y", 4, 4.0)],
        "worker string, key string, id long, ms double").withColumn("ts", F.timestamp_seconds("id"))
    got = {r.worker_id: r for r in sketch_report(
        df, "key", "worker", F.lit("low"), "ts", "id", "ms", window=1).collect()}
    assert set(got) == {"a", "b"} and got["a"].mg_window_total == 1 and got["a"].mg_heavy_hitters[0].item == "x"
