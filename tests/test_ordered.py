import random

import pytest
from pyspark.sql import functions as F

from tallystream.operators import ordered
from tallystream.operators.percentiles import (
    approx_percentiles, exact_percentiles, percentile_rank, rolling_percentiles,
)
from tallystream.operators.snapshots import throughput


def brute_percentile(values, p):
    s = sorted(values)
    return s[min(len(s) * p // 100, len(s) - 1)]


def sample(kind, n, rng):
    if kind == "uniform":
        return [rng.uniform(0, 1000) for _ in range(n)]
    if kind == "signed":
        return [rng.gauss(0, 1) * 10 ** rng.randint(-6, 6) for _ in range(n)]
    if kind == "ties":
        return [float(rng.randint(0, 3)) for _ in range(n)]
    return [5.0] * n


@pytest.mark.parametrize("kind", ["uniform", "signed", "ties", "constant"])
def test_exact_percentiles_equal_a_sort(spark, kind):
    rng = random.Random(1)
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 99), ("d", 1000)) for v in sample(kind, n, rng)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.samples, r.p50, r.p95, r.p99) for r in exact_percentiles(df, "v", ["g"]).collect()}
    for g in "abcd":
        values = [v for h, v in rows if h == g]
        assert got[g] == (len(values), *(brute_percentile(values, p) for p in (50, 95, 99)))
    whole = exact_percentiles(df, "v").first()
    assert whole.p99 == brute_percentile([v for _, v in rows], 99)


def test_percentile_index(spark):
    df = spark.createDataFrame([(1,), (2,), (100,), (500,)], "n bigint")
    got = [r[0] for r in df.select(percentile_rank(F.col("n"), 99)).collect()]
    assert got == [0, 1, 99, 495]


def test_approx_percentiles_are_near(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    assert abs(approx_percentiles(df, "v").first().p99 - 9900) <= 2


@pytest.fixture(scope="module")
def ticks(spark):
    """Groups of very different size, with many equal times."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        g = rng.choice("aaaaab") if i else "c"
        rows.append((g, 1_700_000_000 + rng.randint(0, 900), i, rng.random()))
    df = spark.createDataFrame(rows, "g string, s bigint, id bigint, v double")
    return df.select("g", F.timestamp_seconds("s").alias("ts"), "id", "v").cache()


@pytest.mark.parametrize("n", [1, 10, 700, 100_000])
def test_last_n_per_group_by_both_ways(ticks, n):
    want = {}
    for r in ticks.collect():
        want.setdefault(r.g, []).append((r.ts, r.id))
    want = {g: sorted(x)[-n:] for g, x in want.items()}
    for way in (
        ordered.last_n_per_group(ticks, ["g"], "ts", "id", min(n, 1000)) if n <= 1000 else None,
        ordered.last_n_from_cutoff(ticks, ["g"], "ts", "id", n),
    ):
        if way is None:
            continue
        got = {}
        for r in way.collect():
            got.setdefault(r.g, []).append((r.ts, r.id))
        assert {g: sorted(x) for g, x in got.items()} == want


@pytest.mark.parametrize("n", [1, 37, 5999, 10_000])
def test_last_n_by_both_ways(ticks, n):
    want = sorted((r.ts, r.id) for r in ticks.collect())[-n:]
    assert sorted((r.ts, r.id) for r in ordered.last_n(ticks, "ts", "id", n).collect()) == want
    assert sorted((r.ts, r.id) for r in ordered.last_n_from_cutoff(ticks, (), "ts", "id", n).collect()) == want


def test_rolling_percentiles_use_the_latest(ticks):
    got = {r.g: (r.samples, r.p95) for r in rolling_percentiles(ticks, "v", "ts", "id", ["g"], 50).collect()}
    by = {}
    for r in ticks.collect():
        by.setdefault(r.g, []).append((r.ts, r.id, r.v))
    for g, x in by.items():
        recent = [v for _, _, v in sorted(x)[-50:]]
        assert got[g] == (len(recent), brute_percentile(recent, 95))


@pytest.mark.parametrize("chunk", ["3 seconds", "1 hour"])
def test_previous_and_last_known_across_chunks(spark, chunk):
    rng = random.Random(2)
    rows = [(g, 1_700_000_000 + t, rng.choice([None, "x", "y", "z"]))
            for g in "ab" for t in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "g string, s bigint, c string").withColumn("ts", F.timestamp_seconds("s"))
    before = {(r.g, r.s): r.p for r in ordered.previous_row(df, ["g"], "ts", {"s": "p"}, chunk).collect()}
    known = {(r.g, r.s): r.k for r in ordered.last_known(df, ["g"], "ts", "c", "k", chunk).collect()}
    for g in "ab":
        previous, value = None, None
        for h, s, c in rows:
            if h == g:
                value = c or value
                assert before[g, s] == previous and known[g, s] == value
                previous = s


def test_throughput_skips_resets(spark):
    rows = [("w", 0, 100), ("w", 10, 200), ("w", 20, 50), ("w", 25, 100)]
    df = spark.createDataFrame(rows, "worker_id string, s bigint, cms_total_count bigint")
    got = throughput(df.withColumn("ts", F.timestamp_seconds("s")), "1 minute").orderBy("ts").collect()
    assert [r.events_per_sec for r in got] == [None, 10.0, None, 10.0]


@pytest.mark.parametrize("chunk", [1, 7, 1_000_000])
def test_distributed_scans_equal_loops(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(60) if i % 11 else None, rng.randrange(9), rng.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, at long, v long, known long")
    got = {r.id: r for r in ordered.running(
        df, ["g"], "at", sums={"total": "v"}, largest={"top": "v"}, latest={"last": "known"}, chunk=chunk, tie=["id"]).collect()}
    before = {r.id: r.b for r in ordered.running(df, ["g"], "at", largest={"b": "v"}, chunk=chunk, before=True, tie=["id"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        total, top, last = 0, None, None
        for _, i, _, v, known in own:
            assert before[i] == top
            total, top, last = total + v, max(v, top or 0), known if known is not None else last
            assert (got[i].total, got[i].top, got[i].last) == (total, top, last)
    assert len(got) == len(before) == len(rows)


@pytest.mark.parametrize("chunk", [1, 8, 1_000_000])
def test_nearest_known_value_on_either_side(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice(["a", None]), i, rng.randrange(200), i if rng.random() < 0.2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id long, at long, known long")
    near = {after: {r.id: r.found for r in ordered.nearest(df, ["g"], "at", "known", "found", chunk, after).collect()} for after in (False, True)}
    at = {r[1]: r[2] for r in rows}
    for g, i, t, _ in rows:
        own = [r for r in rows if r[0] == g and r[3] is not None]
        earlier, later = [r[2] for r in own if r[2] <= t], [r[2] for r in own if r[2] >= t]
        assert (at.get(near[False][i]), at.get(near[True][i])) == (max(earlier, default=None), min(later, default=None))
