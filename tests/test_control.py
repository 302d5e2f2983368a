import random

import pytest
from pyspark.sql import functions as F

from tallystream.operators import control, epochs, snapshots
from tallystream.operators.control import apply_cooldown, decide

METRICS = (
    "worker_id string, s double, template string, p99_latency_ms double, memory_percent double, "
    "cms_total_count bigint, cms_error_estimate double"
)


def metrics(spark, *rows):
    return spark.createDataFrame(rows, METRICS).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_rules(spark):
    df = metrics(
        spark,
        ("edge", 0.0, "high", 200.0, 10.0, 100, 0.1),
        ("slow", 0.0, "high", 200.1, 10.0, 100, 0.1),
        ("stuck", 0.0, "low", 300.0, 90.0, 100, 0.1),
        ("memory_edge", 0.0, "medium", 1.0, 80.0, 100, 0.1),
        ("memory", 0.0, "medium", 1.0, 80.5, 100, 0.1),
        ("wrong", 0.0, "medium", 1.0, 79.0, 100, 6.0),
        ("top", 0.0, "high", 1.0, 79.0, 100, 6.0),
        ("bare", 0.0, None, None, None, None, None),
        ("odd", 0.0, "extra", 300.0, 10.0, 100, 0.1),
    )
    got = {r.worker_id: r for r in decide(df).collect()}
    assert set(got) == {"slow", "memory", "wrong"}
    assert (got["slow"].action, got["slow"].template) == ("set_template", "medium")
    assert got["slow"].message == "P99=200.1ms > 200.0ms → downgrade high→medium"
    assert (got["wrong"].template, got["wrong"].message) == (
        "high", "rel_error=0.0600 > 0.05 AND mem=79.0% OK → upgrade medium→high")
    assert (got["memory"].action, got["memory"].k, got["memory"].template) == ("resize_mg", 50, None)
    assert got["memory"].message == "memory=80.5% > 80.0% → shrink MG window"
    assert [r.worker_id for r in control.unknown_templates(df).collect()] == ["odd"]


def test_cooldown_of_two_decisions(spark):
    for gap, kept in ((10.0, 1), (15.0, 2), (16.0, 2)):
        df = metrics(spark, ("w", 100.0, "high", 300.0, 1.0, 1, 0.0), ("w", 100.0 + gap, "medium", 300.0, 1.0, 1, 0.0))
        assert apply_cooldown(decide(df)).count() == kept


def greedy(times, wait):
    taken = []
    for t in sorted(times):
        if not taken or t >= taken[-1] + wait:
            taken.append(t)
    return taken


@pytest.mark.parametrize("chunk", [1, 2, 7, 512])
@pytest.mark.parametrize("spacing", [1, 4, 40])
def test_cooldown_equals_a_sequential_walk(spark, monkeypatch, chunk, spacing):
    monkeypatch.setattr(control, "CHUNK_COOLDOWNS", chunk)
    rng = random.Random(chunk * 100 + spacing)
    want, rows = {}, []
    for w in "abc":
        t, times = 1_700_000_000, []
        for _ in range(150):
            t += rng.randint(1, spacing)
            times.append(t)
        rows += [(w, x, f"{w}{x}") for x in times]
        want[w] = greedy(times, 15)
    df = spark.createDataFrame(rows, "worker_id string, s bigint, payload string").withColumn("ts", F.timestamp_seconds("s"))
    got = {}
    for r in apply_cooldown(df, "15 seconds").collect():
        assert r.payload == f"{r.worker_id}{r.s}"
        got.setdefault(r.worker_id, []).append(r.s)
    assert {w: sorted(x) for w, x in got.items()} == want


def test_cooldown_of_dense_long_and_null_workers(spark, monkeypatch):
    """A dense worker, one whose cooldowns touch through thousands of chunks, and rows without a worker or time."""
    monkeypatch.setattr(control, "CHUNK_COOLDOWNS", 1)
    rng = random.Random(8)
    dense = sorted(rng.sample(range(512 * 15 * 10), 60_000))  # tenths of a second
    chain, t = [], 0
    for _ in range(6_000):
        t += rng.randint(60, 149)
        chain.append(t)
    rows = [("dense", x) for x in dense] + [("chain", x) for x in chain] + [(None, x) for x in chain[:50]] + [("a", None), (None, None), ("a", None)]
    df = spark.createDataFrame(rows, "worker_id string, tenth bigint").withColumn("ts", F.timestamp_millis(F.col("tenth") * 100))
    got = {}
    for r in apply_cooldown(df, "15 seconds").collect():
        got.setdefault(r.worker_id, []).append(r.tenth)
    assert sorted(got["dense"]) == greedy(dense, 150) and sorted(got["chain"]) == greedy(chain, 150)
    assert got["a"] == [None, None] and sorted(x for x in got[None] if x is not None) == greedy(chain[:50], 150) and None in got[None]


def test_of_several_candidates_at_one_time_one_is_taken(spark):
    df = spark.createDataFrame([("w", 5, "b"), ("w", 5, "a"), ("w", 19, "c"), ("w", 20, "d")], "worker_id string, s bigint, message string")
    got = apply_cooldown(df.withColumn("ts", F.timestamp_seconds("s")), "15 seconds").collect()
    assert sorted(r.message for r in got) == ["a", "d"]


def test_overrides_and_messages(spark):
    df = spark.createDataFrame([("w0", 1.0, "low"), ("w1", 1.0, "huge"), ("w2", 1.0, None)], "worker_id string, s double, template string")
    commands, rejected = control.override_commands(df.withColumn("ts", F.timestamp_seconds("s")).drop("s"))
    assert [r.message for r in commands.collect()] == ["Manual override: template set to 'low'"]
    assert sorted(r.worker_id for r in rejected.collect()) == ["w1", "w2"]
    sent = control.command_json(commands).first().value
    assert sent == '{"action":"set_template","template":"low"}'


@pytest.mark.parametrize("message,cls", [
    ("P99=300.0ms → downgrade high→medium", "downgrade"),
    ("rel → upgrade low→medium", "upgrade"),
    ("memory=90.0% → shrink", "memory"),
    ("MANUAL override", "manual"),
    ("something else", ""),
])
def test_message_class(spark, message, cls):
    assert spark.range(1).select(control.decision_class(F.lit(message))).first()[0] == cls


def test_timeline_and_epochs(spark):
    commands = spark.createDataFrame(
        [("w", 10.0, "set_template", "high", None), ("w", 15.0, "resize_mg", None, 50), ("w", 20.0, "set_template", "low", None)],
        "worker_id string, s double, action string, template string, k int",
    ).withColumn("ts", F.timestamp_seconds("s"))
    reports = spark.createDataFrame([("w", float(t)) for t in (5, 10, 12, 25)], "worker_id string, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = control.template_timeline(reports, commands, "4 seconds").orderBy("ts").collect()
    assert [r.template for r in got] == ["medium", "high", "high", "low"]

    events = spark.createDataFrame(
        [("w", float(t), f"k{t % 4}") for t in range(30)] + [("v", 3.0, "k")], "worker string, s double, key string"
    ).withColumn("ts", F.timestamp_seconds("s"))
    for bucket in ("1 day", "3 seconds"):
        rows = epochs.template_epochs(events, "key", "worker", "ts", commands, bucket).collect()
        found = {(r.worker_id, r.epoch): (r.template, r.total_count, r.hll_estimate) for r in rows}
        assert found == {
            ("w", 0): ("medium", 10, 4), ("w", 1): ("high", 10, 4), ("w", 2): ("low", 10, 4), ("v", 0): ("medium", 1, 1),
        }
    heavy = epochs.epoch_heavy_hitters(events, "key", "worker", "ts", commands)
    assert heavy.where("worker_id = 'w' and epoch = 1").agg(F.sum("est")).first()[0] == 10


ORDERS = "worker_id string, s double, action string, template string, k int"


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("bigint"))).drop("s")


def test_resize_holds_until_the_next_template(spark):
    orders = timed(spark, [
        ("w", 3.0, "resize_mg", None, 3), ("w", 10.0, "set_template", "high", None), ("w", 15.0, "resize_mg", None, 4),
        ("w", 15.0, "resize_mg", None, 9), ("w", 17.0, "resize_mg", None, 1), ("w", 18.0, "resize_mg", None, 10**6),
        ("w", 20.0, "set_template", "low", None), ("w", 20.0, "set_template", "medium", None), (None, 5.0, "set_template", "low", None),
        (None, 5.0, "resize_mg", None, 7), ("v", None, "set_template", "low", None),
    ], ORDERS)
    got = {(r.worker_id, r.at): tuple(r)[2:] for r in epochs.parameter_timeline(orders).collect()}
    start, second = epochs.BEGINNING, 1_000_000
    assert got == {
        ("w", start): (0, "medium", 200, 3), ("w", 3 * second): (0, "medium", 3, 3), ("w", 10 * second): (1, "high", 500, 4),
        ("w", 15 * second): (1, "high", 4, 4), ("w", 20 * second): (2, "medium", 200, 200),
        (None, start): (0, "medium", 200, 200), (None, 5 * second): (1, "low", 7, 7), ("v", start): (0, "medium", 200, 200),
    }
    keys = [("w", 1.0, f"k{i % 8}") for i in range(40)] + [("w", 12.0, f"k{i % 8}") for i in range(40)] + [("w", 30.0, f"k{i % 8}") for i in range(40)]
    heavy = epochs.epoch_heavy_hitters(timed(spark, keys, "worker string, s double, key string"), "key", "worker", "ts", orders)
    found = {(r.epoch, r.mg_k): r.n for r in heavy.groupBy("epoch", "mg_k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {(2, 200): 8}  # eight equal counts leave nothing above the third and the fourth


def test_every_event_keeps_its_row(spark):
    """Events without a time or worker, of workers without commands, and in buckets of one hot hour."""
    orders = timed(spark, [("w", 10.0, "set_template", "high", None), (None, 10.0, "set_template", "low", None)], ORDERS)
    rows = [("w", None, "a"), (None, None, "a"), (None, 9.5, "a"), (None, 10.0, "b"), ("w", 10.0, "c"), ("x", 99.0, "d")]
    rows += [("w", 3600 + i / 100, "hot") for i in range(500)]
    events = timed(spark, rows, "worker string, s double, key string")
    got = epochs.with_epoch(events, "worker", "ts", orders, "1 hour")
    assert got.count() == len(rows)
    few = {(r.worker, r.key): (r.epoch, r.template) for r in got.where("key != 'a'").collect()}
    assert few == {(None, "b"): (1, "low"), ("w", "c"): (1, "high"), ("x", "d"): (0, "medium"), ("w", "hot"): (1, "high")}
    assert sorted((str(r.worker), str(r.epoch)) for r in got.where("key = 'a'").collect()) == [("None", "0"), ("None", "None"), ("w", "None")]
    totals = epochs.template_epochs(events, "key", "worker", "ts", orders)
    assert totals.agg(F.sum("total_count")).first()[0] == len(rows)


def test_parts_folded_to_a_template_equal_sketches_from_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(5_000)), f"k{int(rng.paretovariate(1)) % 300}") for _ in range(4_000)]
    events = timed(spark, rows, "worker string, s double, key string")
    orders = timed(spark, [
        ("a", 700.5, "set_template", "low", None), ("a", 2_000.0, "resize_mg", None, 20), ("a", 2_900.0, "set_template", "high", None),
        (None, 1_234.0, "set_template", "low", None), ("b", 4_000.0, "resize_mg", None, 10)], ORDERS)
    keys = spark.createDataFrame([("k1",), ("k2",), ("none",)], "key string")
    half = [epochs.sketch_parts(events.where(cut), "key", "worker", "ts", "1 minute") for cut in ("s % 2 = 0", "s % 2 = 1")]         if "s" in events.columns else [epochs.sketch_parts(events.where(f"hash(key, ts) % 2 {op} 0"), "key", "worker", "ts", "1 minute") for op in ("=", "!=")]
    both = epochs.SketchParts(*[getattr(half[0], f).unionByName(getattr(half[1], f)) for f in ("cells", "registers", "candidates")])
    placed = epochs.place_parts(both, orders, "1 minute")
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect())) and x.count() > 3
    from_rows = ("key", "worker", "ts", orders)
    assert same(epochs.parts_report(placed), epochs.template_epochs(events, *from_rows, grain="1 minute"))
    assert same(epochs.parts_heavy_hitters(placed), epochs.epoch_heavy_hitters(events, *from_rows, grain="1 minute"))
    assert same(epochs.parts_frequency(placed, keys), epochs.epoch_frequency(events, *from_rows, keys, grain="1 minute"))


def test_snapshots(spark):
    rows = [("a", float(t), "low", float(t), 1.0, 1, 0.0) for t in range(100)] + [("b", 50.0, "low", 9.0, 1.0, 1, 0.0)]
    df = metrics(spark, *rows)
    live = snapshots.cluster_metrics(df).collect()
    assert [(r.worker_id, r.p99_latency_ms) for r in live] == [("a", 99.0)]
    as_of = F.timestamp_seconds(F.lit(60))
    assert sorted(r.worker_id for r in snapshots.cluster_metrics(df, as_of).collect()) == ["a", "b"]
    history = snapshots.latency_history_arrays(df).where("worker_id = 'a'").first()[1]
    assert history == [float(t) for t in range(40, 100)]


def test_log_tail(spark):
    log = spark.range(300).select(F.timestamp_seconds("id").alias("ts"), F.lit("w").alias("worker_id"), F.col("id").cast("string").alias("message"))
    got = [r.message for r in snapshots.controller_log_tail(log, 3).collect()]
    assert got == ["297", "298", "299"]
    with pytest.raises(ValueError):
        snapshots.controller_log_tail(log, 101)


def test_cluster_summary_picks_the_fastest_that_reports(spark):
    df = metrics(spark, ("a", 1.0, "low", 0.0, 10.0, 1, 0.0), ("b", 1.0, "high", 5.0, None, 7, 0.0), ("c", 1.0, "low", 5.0, 20.0, 1, 0.0))
    r = snapshots.cluster_summary(df.withColumn("cpu_percent", F.lit(50.0))).first()
    assert (r.worker_count, r.best_worker, r.best_total_count, r.avg_memory_percent) == (3, "b", 7, 10.0)
