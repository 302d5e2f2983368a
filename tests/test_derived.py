"""Ranges, inner products and drift from Count-Min cells."""

import random

import pytest
from pyspark.sql import functions as F

from tallystream.operators import derived
from tallystream.operators.cms import cms_build


def test_dyadic_nodes_make_up_every_range():
    for low in range(0, 34):
        for high in range(low, 34):
            nodes = derived.dyadic_nodes(low, high, 5)
            covered = sorted(v for level, node in nodes for v in range(node << level, (node + 1) << level))
            assert covered == list(range(low, min(high, 31) + 1)) and len(nodes) <= 10
    assert derived.dyadic_nodes(0, 31, 5) == [(5, 0)] and derived.dyadic_nodes(5, 4, 5) == []


def test_range_counts_never_under_count(spark):
    rng = random.Random(2)
    values = [rng.randrange(1 << 10) for _ in range(3_000)] + [None, -1, 1 << 10]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    sketch = derived.range_build(df, "v", 10, 2048, 5)
    ranges = [(0, 1023), (17, 800), (512, 512), (1_000, 5_000), (9, 3)]
    got = {(r.low, r.high): r.estimate for r in derived.range_counts(sketch, ranges).collect()}
    for a, b in ranges:
        exact = sum(v is not None and 0 <= v < 1 << 10 and a <= v <= b for v in values)
        assert exact <= got[a, b] <= exact + 20 * 3_000 * 2.72 / 2048
    assert got[0, 1023] == 3_000 and got[9, 3] == 0


def test_inner_product_and_drift(spark):
    rows = [(d, f"k{(i + (500 if d >= 3 else 0)) % 700 if d >= 3 else i % 20}") for d in (1, 2, 3, 4, 8) for i in range(200)]
    df = spark.createDataFrame(rows, "d int, key string").withColumn("day", F.timestamp_seconds(F.col("d") * 86_400))
    one, two = (cms_build(df.where(f"d = {d}"), "key", 512, 3) for d in (1, 2))
    assert derived.inner_product(one, two).first().estimate >= 20 * 10 * 10
    with pytest.raises(ValueError):
        derived.inner_product(one, cms_build(df, "key", 256, 3))
    none = derived.inner_product(one, cms_build(df.where("d < 0"), "key", 512, 3)).first()
    assert none is None or none.estimate == 0
    found = {r.day.timestamp() // 86_400: r for r in derived.drift(cms_build(df, "key", 512, 3, ["day"]), "day", "1 day", 0.5).collect()}
    assert set(found) == {2, 3, 4} and [found[d].alert for d in (2, 3, 4)] == [0, 1, 0]
    assert found[2].similarity == pytest.approx(1.0) and found[4].similarity == pytest.approx(1.0)
