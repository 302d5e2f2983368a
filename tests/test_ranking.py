import pytest
from pyspark.sql import functions as F

from tallystream.operators.ranking import Request, Weights, node_scores, rank_nodes, route, router_scores
from tallystream.plans import answers

LIVE = "worker_id string, template string, p99_latency_ms double, memory_percent double"


def ranked(spark, *rows, request=Request("frequency", 0.95, 50.0)):
    live = spark.createDataFrame(rows, LIVE)
    return rank_nodes(router_scores(live, [request])).orderBy("rank").collect()


@pytest.mark.parametrize("better,worse", [
    (("high", 10.0, 20.0), ("low", 10.0, 20.0)),
    (("medium", 5.0, 30.0), ("medium", 100.0, 30.0)),
    (("medium", 10.0, 10.0), ("medium", 10.0, 90.0)),
    (("high", 3.0, 5.0), ("low", 300.0, 95.0)),
])
def test_better_worker_comes_first(spark, better, worse):
    got = ranked(spark, ("z", *better), ("a", *worse))
    assert [r.worker_id for r in got] == ["z", "a"]
    assert got[0].score > got[1].score


def test_scores_descend(spark):
    got = ranked(spark, ("w0", "high", 5.0, 10.0), ("w1", "low", 200.0, 80.0), ("w2", "medium", 50.0, 50.0))
    scores = [r.score for r in got]
    assert scores == sorted(scores, reverse=True)


def test_single_worker_is_selected(spark):
    live = spark.createDataFrame([("only", "low", 999.0, 99.0)], LIVE)
    assert [r.routed_to for r in route(live, [Request()]).collect()] == ["only"]


def test_formula(spark):
    w = Weights()
    got = ranked(spark, ("w", "medium", 10.0, 40.0))[0].score
    assert abs(got - (w.accuracy * 0.65 / 0.95 - w.latency * 10 / 50 - w.memory * 0.4)) < 1e-9


def test_missing_values(spark):
    got = ranked(spark, ("w", "other", None, None))[0].score
    assert abs(got - (0.5 * 0.65 / 0.95 - 0.3 * 1 / 50)) < 1e-9


def test_empty_cluster(spark):
    live = spark.createDataFrame([], LIVE)
    assert route(live).count() == 0
    assert node_scores(live).count() == 0


def test_profiles_and_overrides(spark):
    live = spark.createDataFrame([("fast", "low", 1.0, 1.0), ("exact", "high", 60.0, 1.0)], LIVE)
    requests = [Request("unknown"), Request("frequency"), Request("frequency", 0.3, 5000.0)]
    got = {(r.query_type, r.alpha_q): r.routed_to for r in route(live, requests).collect()}
    assert got["unknown", 0.95] == got["frequency", 0.95]
    assert got["frequency", 0.3] == "exact"


def test_answers_over_a_sketch_set(spark, keys):
    live = spark.createDataFrame([("w0", "high", 5.0, 10.0), ("w1", "low", 5.0, 10.0)], LIVE)
    events = keys({"apple": 60, "banana": 30, "cherry": 10})
    s = answers.build_sketch_set(events, "key", live)
    f = answers.frequency(s, "apple").first()
    assert (f.estimate, f.cms_total_count, f.routed_to, len(f.all_scores)) == (60, 100, "w0", 2)
    assert answers.frequency(s, "never").first().estimate == 0
    assert answers.cardinality(s).first().estimated_cardinality == 3
    h = answers.heavy_hitters(s, 2).first()
    assert [(x["item"], x["count"]) for x in h.heavy_hitters] == [("apple", 60), ("banana", 30)]
    assert (h.window_total, h.error_bound, h.mg_k) == (100, 0.5, 200)
    live_row = answers.live_answers(s).first()
    assert (live_row.distinct_keys, live_row.top_key, live_row.top_share_percent, live_row.top_frequency) == (3, "apple", 60.0, 60)
    with pytest.raises(ValueError):
        answers.heavy_hitters(s, 101)


def test_answers_without_workers(spark, keys):
    s = answers.build_sketch_set(keys("a"), "key", spark.createDataFrame([], LIVE))
    r = answers.cardinality(s).first()
    assert (r.estimated_cardinality, r.routed_to) == (1, None)


def test_cluster_answer(spark):
    rows = [("a", "low", float(t), 1.0, t) for t in range(5)]
    df = spark.createDataFrame(rows, LIVE + ", s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    r = answers.cluster(df).first()
    assert (r.worker_count, r.p99_latency_ms, r.latency_history) == (1, 4.0, [0.0, 1.0, 2.0, 3.0, 4.0])
