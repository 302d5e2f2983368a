import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallystream.operators import heavy_hitters as hh
from tallystream.operators import windows as win
from tallystream.sources.zipf import zipf_events


def as_dict(df):
    return {r["key"]: r["est"] for r in df.collect()}


def check_guarantee(found, counts, k):
    n = sum(counts.values())
    assert len(found) <= k - 1
    for key, est in found.items():
        assert counts[key] - n / k <= est <= counts[key]
    for key, f in counts.items():
        if f > n / k:
            assert key in found


@pytest.mark.parametrize("counts,k,must", [
    ({"hello": 1}, 10, ["hello"]),
    ({"A": 100, "B": 100, "C": 1}, 3, ["A", "B"]),
    ({"A": 12, "B": 8, "C": 5, "D": 4, "E": 1}, 3, ["A"]),
    ({"dominant": 5000, **{f"noise_{i}": 1 for i in range(500)}}, 10, ["dominant"]),
    ({"dominant": 1000, **{f"rare_{i}": 1 for i in range(20)}}, 10, ["dominant"]),
])
def test_frequent_keys_are_present(keys, counts, k, must):
    for build in (hh.mg_summary, hh.mg_summary_bounded):
        found = as_dict(build(keys(counts), "key", k))
        check_guarantee(found, counts, k)
        assert set(must) <= set(found)


def test_empty(keys):
    assert as_dict(hh.mg_summary(keys("x").where("false"), "key", 10)) == {}
    assert as_dict(hh.mg_summary_bounded(keys("x").where("false"), "key", 10)) == {}


@pytest.mark.parametrize("k", [2, 5, 50])
@pytest.mark.parametrize("partitions", [1, 16])
def test_bounded_summary_keeps_the_guarantee(spark, k, partitions):
    rng = random.Random(k)
    drawn = [f"k{int(rng.paretovariate(1.0))}" for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in drawn], "key string").repartition(partitions)
    check_guarantee(as_dict(hh.mg_summary_bounded(df, "key", k)), Counter(drawn), k)


def test_merge_keeps_the_guarantee(keys):
    a = {"x": 50, "y": 30, "z": 20, "u": 1}
    b = {"x": 5, "y": 30, "w": 60, "v": 2}
    merged = hh.mg_merge(hh.mg_summary(keys(a), "key", 4), hh.mg_summary(keys(b), "key", 4), k=4)
    check_guarantee(as_dict(merged), Counter(a) + Counter(b), 4)


def test_sorted_and_limited(keys, numbered):
    summary = hh.mg_summary(keys({"A": 1000, "B": 500, "C": 100}), "key", 50)
    assert [r.key for r in hh.heavy_hitters(summary).collect()] == ["A", "B", "C"]
    assert [r.key for r in hh.heavy_hitters(summary, 500).collect()] == ["A", "B"]
    many = hh.mg_summary(numbered("item_", 500, 50), "key", 100)
    assert hh.top_n(many, 10).count() == 10
    assert [r["rank"] for r in hh.top_n(many, 10).orderBy("rank").collect()] == list(range(1, 11))


def test_share_of_window(keys):
    summary = hh.mg_summary(keys({"A": 30, "B": 10}), "key", 50)
    got = {r.key: r.share for r in hh.top_share(summary, F.lit(40)).collect()}
    assert got == {"A": 75.0, "B": 25.0}
    assert {r.share for r in hh.top_share(summary, F.lit(0)).collect()} == {100.0}


def test_k_is_checked(keys):
    for k in (1, 0):
        with pytest.raises(ValueError):
            hh.mg_summary(keys("x"), "key", k)


def test_groups_and_large_k(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("k"), F.floor(F.sqrt("id"))).alias("key"))
    small = hh.mg_summary(df, "key", 20, ["g"]).where("g = 1").drop("g")
    assert as_dict(small) == as_dict(hh.mg_summary(df.where("g = 1"), "key", 20))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        salted = hh.mg_summary(df, "key", 20, ["g"]).where("g = 1").drop("g")
        assert as_dict(salted) == as_dict(small)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


# ---- windows --------------------------------------------------------------------------------

def timed(spark, n, step_seconds, distinct):
    return spark.range(n).select(
        "id",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * step_seconds).alias("ts"),
        F.concat(F.lit("item_"), (F.col("id") * F.col("id")) % distinct).alias("key"),
    )


@pytest.mark.parametrize("chunk", [1, 3, 8])
@pytest.mark.parametrize("k,window,bucket", [(3, "60 seconds", "5 seconds"), (10, "20 seconds", "20 seconds")])
def test_sliding_windows_equal_brute_force(spark, monkeypatch, k, window, bucket, chunk):
    monkeypatch.setattr(win, "CHUNK_WINDOWS", chunk)
    df = timed(spark, 400, 1, 13).where("id < 180 or id > 330")
    events = [(r.ts.timestamp(), r.key) for r in df.collect()]
    b, w = int(bucket.split()[0]), int(window.split()[0])
    got = {}
    for r in win.windowed_heavy_hitters(df, "key", "ts", k, window, bucket).collect():
        got.setdefault(r.window_end.timestamp(), {})[r.key] = r.est
    first = int(events[0][0] // b * b)
    last = int(events[-1][0] // b * b)
    for end in range(first + b, last + w + 1, b):
        inside = Counter(key for t, key in events if end - w <= t // b * b < end)
        kth = sorted(inside.values(), reverse=True)[k - 1] if len(inside) >= k else 0
        assert got.get(float(end), {}) == {key: n - kth for key, n in inside.items() if n > kth}


def test_window_totals_and_bucket_checks(spark):
    df = timed(spark, 100, 1, 5)
    totals = win.window_totals(df, "key", "ts", "20 seconds", "5 seconds")
    assert totals.agg(F.sum("window_total")).first()[0] == 400
    assert totals.agg(F.max("window_total")).first()[0] == 20
    for window, bucket in (("5 seconds", "20 seconds"), ("20 seconds", "7 seconds")):
        with pytest.raises(ValueError):
            win.window_totals(df, "key", "ts", window, bucket)


def test_last_n_window_is_bounded(spark):
    df = timed(spark, 200, 1, 200)
    found = win.last_n_heavy_hitters(df, "key", "ts", "id", 300, 100)
    assert found.agg(F.sum("est")).first()[0] == 100


def test_idle_ticks_are_reported(spark):
    df = timed(spark, 3, 7200, 5)
    report = win.tumbling_report(df, "key", "ts", "1 hour").orderBy("tick").collect()
    assert [r.n for r in report] == [1, 0, 1, 0, 1]
    assert [r.total_count for r in report] == [1, 1, 2, 2, 3]


def test_top_key_follows_a_drift(spark):
    df = zipf_events(spark, 20_000, n_items=500, s=1.5, seed=3, rate=100, shift_interval="100 seconds")
    found = win.windowed_heavy_hitters(df, "key", "ts", 50, "100 seconds", "100 seconds")
    leaders = {}
    for r in found.collect():
        leaders.setdefault(r.window_end, []).append((r.est, r.key))
    tops = [max(leaders[w])[1] for w in sorted(leaders)]
    assert tops[0] == "item_1"
    assert len(tops) == 2 and tops[1] != "item_1"


@pytest.mark.parametrize("k", [2, 4, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_left_out_tails_do_not_change_windows(spark, k, seed):
    """Many keys seen once or twice, some bursts, and ties at the k-th count."""
    rng = random.Random(seed)
    rows = []
    for t in range(600):
        kind = rng.random()
        if kind < 0.3:
            key = f"hot{rng.randint(0, 3)}"
        elif kind < 0.6:
            key = f"burst{t // 50}"
        else:
            key = f"rare{rng.randint(0, 400)}"
        rows.append((1_700_000_000 + t, key))
    df = spark.createDataFrame(rows, "s bigint, key string").withColumn("ts", F.timestamp_seconds("s"))
    got = {}
    for r in win.windowed_heavy_hitters(df, "key", "ts", k, "60 seconds", "10 seconds").collect():
        got.setdefault(int(r.window_end.timestamp()), {})[r.key] = r.est
    first = rows[0][0] // 10 * 10
    for end in range(first + 10, rows[-1][0] // 10 * 10 + 61, 10):
        inside = Counter(key for s, key in rows if end - 60 <= s // 10 * 10 < end)
        kth = sorted(inside.values(), reverse=True)[k - 1] if len(inside) >= k else 0
        assert got.get(end, {}) == {key: n - kth for key, n in inside.items() if n > kth}


def test_approx_top_k_check_on_flat_counts(spark, tmp_path):
    """Spark's approx_top_k returns nothing when no key stands above its error; the check still has its 10."""
    from tallystream.plans import hitter_queries as hq

    events = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 30_000).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert hq.approx_top_k_check(spark, str(tmp_path)).collect()[0].asDict() == {
        "items": 10, "total": 60_000, "wrong": 0, "missed": 0}


def test_approx_top_k_filled_from_exact(keys):
    counts = {f"k{i:03d}": 2 for i in range(300)} | {"top": 3}
    events = keys(counts)
    found = hh.approx_top_k_native(events, "key", 10, 16, hh.key_counts(events, "key"))
    assert as_dict(found) == {"top": 3, **{f"k{i:03d}": 2 for i in range(9)}}


def test_approx_top_k_is_whole_without_exact_counts(keys):
    """More keys than one sketch holds, counts flat: the items are Spark's own, also without exact counts."""
    events = keys({f"k{i:03d}": 2 for i in range(300)} | {"top": 3})
    assert as_dict(hh.approx_top_k_native(events, "key", 10, 16)) == {"top": 3, **{f"k{i:03d}": 2 for i in range(9)}}


def test_exact_counts_are_no_answer_of_approx_top_k(spark, keys):
    """Counts that are wrong do not come back as what Spark found."""
    events = keys({f"k{i:03d}": 2 for i in range(300)})
    wrong = spark.createDataFrame([(f"x{i}", 50) for i in range(300)], "key string, n long")
    assert as_dict(hh.approx_top_k_native(events, "key", 10, 16, wrong)) == {f"k{i:03d}": 2 for i in range(10)}


def test_approx_top_k_check_shows_a_failure(spark, tmp_path, monkeypatch):
    """A sketch that has to drop keys finds fewer than ten items, and the check says so."""
    from tallystream.plans import hitter_queries as hq

    spark.range(60_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 30_000).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    native = hh.approx_top_k_native
    few = spark.createDataFrame([("5", 2)], "key string, n long")  # one sketch for all keys
    monkeypatch.setattr(hh, "approx_top_k_native", lambda df, key, n, most, exact: native(df, key, n, most, few))
    assert hq.approx_top_k_check(spark, str(tmp_path)).collect()[0]["items"] == 0
