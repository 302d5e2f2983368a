import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallystream.functions.formulas import (
    cms_from_error, cms_memory_bytes, hll_memory_bytes, hll_relative_error, mg_memory_bytes, sketch_memory_mb,
)
from tallystream.functions.hashing import cms_col, hash64
from tallystream.operators import cms, hll
from tallystream.operators.keys import key_counts


def one(df):
    return df.collect()[0]


def estimate(sketch, key):
    return one(cms.cms_query(sketch, key))["estimate"]


def total(sketch):
    return one(cms.cms_total(sketch))["total_count"]


def distinct(df, p, mode="md5"):
    return one(hll.hll_estimate(hll.hll_build(df, "key", p, hash_mode=mode)))["estimate"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- hashing --------------------------------------------------------------------------------

@pytest.mark.parametrize("width", [1, 2, 512, 1000, 8192, 65536, 131072, 2 ** 31, 2 ** 31 - 1])
def test_md5_columns_match_a_plain_computation(spark, width):
    words = ["", "a", "item_42", "ключ", "x" * 200] + [f"k{i}" for i in range(50)]
    df = spark.createDataFrame([(w,) for w in words], "key string")
    got = {r.key: r.c for r in df.select("key", cms_col(F.col("key"), 3, width).cast("long").alias("c")).collect()}
    for w in words:
        number = int.from_bytes(hashlib.md5(f"{w}:3".encode()).digest()[:8], "little")
        expected = number % width
        assert got[w] == (expected if expected < 2 ** 31 else expected - 2 ** 32)


def test_hash64_is_the_little_endian_prefix(spark):
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "key string")
    for r in df.select("key", hash64(F.col("key")).alias("h")).collect():
        assert r.h % 2 ** 64 == int.from_bytes(hashlib.md5(r.key.encode()).digest()[:8], "little")


@pytest.mark.parametrize("p", [4, 10, 12, 18])
def test_registers_match_a_plain_computation(spark, numbered, p):
    df = numbered("w", 3000)
    expected = {}
    for i in range(3000):
        h = int.from_bytes(hashlib.md5(f"w{i}".encode()).digest()[:8], "little")
        rest = h & ((1 << (64 - p)) - 1)
        rho = 64 - p - rest.bit_length() + 1
        expected[h >> (64 - p)] = max(rho, expected.get(h >> (64 - p), 0))
    got = {r.idx: r.rho for r in hll.hll_build(df, "key", p).registers.collect()}
    assert got == expected


# ---- Count-Min ------------------------------------------------------------------------------

def test_empty_sketch(keys):
    sketch = cms.cms_build(keys({"x": 1}).where("false"), "key", 512, 3)
    assert estimate(sketch, "hello") == 0
    assert total(sketch) == 0


def test_single_update(keys):
    sketch = cms.cms_build(keys("hello"), "key", 512, 3)
    assert estimate(sketch, "hello") >= 1
    assert total(sketch) == 1


def test_repeated_key(keys):
    sketch = cms.cms_build(keys("apple", 100), "key", 2048, 5)
    assert estimate(sketch, "apple") >= 100
    assert total(sketch) == 100


def test_two_keys_never_under_count(keys):
    sketch = cms.cms_build(keys({"apple": 100, "banana": 50}), "key", 2048, 5)
    assert estimate(sketch, "apple") >= 100
    assert estimate(sketch, "banana") >= 50


def test_error_bound(numbered):
    report = one(cms.cms_accuracy(numbered("item_", 10_000, 100), "key", 2048, 5))
    assert abs(report.error_bound - math.e / 2048 * 10_000) < 0.01


@pytest.mark.parametrize("mode", ["md5", "xxhash64"])
def test_never_under_counts_random_keys(spark, mode):
    rng = random.Random(42)
    drawn = [f"item_{rng.randint(1, 50)}" for _ in range(5000)]
    df = spark.createDataFrame([(k,) for k in drawn], "key string")
    sketch = cms.cms_build(df, "key", 1024, 5, hash_mode=mode)
    for r in cms.cms_lookup(sketch, df.distinct()).collect():
        assert r.estimate >= drawn.count(r.key)


def test_overestimate_is_bounded(numbered):
    df = numbered("item_", 1000, 200)
    sketch = cms.cms_build(df, "key", 2048, 5)
    bound = math.e / 2048 * 1000
    for r in cms.cms_lookup(sketch, df.distinct()).collect():
        assert 5 <= r.estimate <= 5 + bound + 1


def test_small_table_never_under_counts(numbered):
    df = numbered("k_", 500, 50)
    sketch = cms.cms_build(df, "key", 512, 3)
    assert all(r.estimate >= 10 for r in cms.cms_lookup(sketch, df.distinct()).collect())


def test_size_from_targets():
    width, depth = cms_from_error(0.01, 0.01)
    assert math.e / width <= 0.01 and math.exp(-depth) <= 0.01
    for wrong in ((0, 0.1), (0.1, 0), (-1, 0.1)):
        with pytest.raises(ValueError):
            cms_from_error(*wrong)


def test_memory_sizes(spark):
    got = one(spark.range(1).select(
        cms_memory_bytes(512, 3).alias("cms"), hll_memory_bytes(10).alias("hll"), mg_memory_bytes(200).alias("mg"),
        sketch_memory_mb(2048, 5, 12, 200).alias("mb"), hll_relative_error(12).alias("err"),
    ))
    assert (got.cms, got.hll, got.mg) == (12288, 1024, 20000)
    assert abs(got.mb - 0.101105) < 1e-6
    assert abs(got.err - 1.04 / math.sqrt(4096)) < 1e-6


def test_resize_rebuilds_from_rows(keys):
    small = cms.cms_build(keys("x"), "key", 512, 3)
    none = keys("x").where("false")
    assert estimate(cms.cms_resize(none, "key", small, 2048, 5), "x") == 0
    assert estimate(cms.cms_resize(keys("x"), "key", small, 2048, 5), "x") == 1


@pytest.mark.parametrize("mode", ["md5", "xxhash64"])
def test_fold_and_merge_equal_direct_builds(numbered, mode):
    df = numbered("k", 5000, 700)
    wide = cms.cms_build(df, "key", 2048, 5, hash_mode=mode)
    narrow = cms.cms_build(df, "key", 512, 3, hash_mode=mode)
    assert rows(cms.cms_fold(wide, 512, 3).cells) == rows(narrow.cells)
    left = cms.cms_build(df.where(F.col("key") < "k4"), "key", 512, 3, hash_mode=mode)
    right = cms.cms_build(df.where(F.col("key") >= "k4"), "key", 512, 3, hash_mode=mode)
    assert rows(cms.cms_merge(left, right).cells) == rows(narrow.cells)


def test_direct_build_equals_pre_aggregated(numbered):
    df = numbered("k", 3000, 300)
    assert rows(cms.cms_build(df, "key", 512, 3, pre_aggregate=False).cells) == rows(
        cms.cms_build(df, "key", 512, 3).cells
    )


def test_dense_and_joined_lookup_agree(numbered, monkeypatch):
    df = numbered("k", 3000, 300)
    sketch = cms.cms_build(df, "key", 512, 3)
    wanted = numbered("k", 400)
    dense = rows(cms.cms_lookup(sketch, wanted))
    monkeypatch.setattr(cms, "DENSE_CELLS_MAX", 0)
    assert rows(cms.cms_lookup(sketch, wanted)) == dense


def test_parameters_are_checked(keys, numbered):
    df = keys("x")
    with pytest.raises(ValueError):
        cms.cms_build(df, "key", 0, 3)
    with pytest.raises(ValueError):
        cms.cms_merge(cms.cms_build(df, "key", 512, 3), cms.cms_build(df, "key", 512, 5))
    with pytest.raises(ValueError):
        cms.cms_fold(cms.cms_build(df, "key", 1000, 3), 500)
    with pytest.raises(ValueError):
        hll.hll_build(df, "key", 3)
    with pytest.raises(ValueError):
        hll.hll_build(df, "key", 19)
    with pytest.raises(ValueError):
        hll.hll_merge(hll.hll_build(df, "key", 10), hll.hll_build(df, "key", 12))
    with pytest.raises(ValueError):
        hll.hll_fold(hll.hll_build(df, "key", 10), 12)


def test_null_and_empty_keys_are_dropped(spark):
    df = spark.createDataFrame([("a",), (None,), ("",), ("a",)], "key string")
    assert rows(key_counts(df, "key")) == [("a", 2)]


# ---- HyperLogLog ----------------------------------------------------------------------------

def test_hll_empty(keys):
    assert distinct(keys("x").where("false"), 12) == 0


def test_hll_single(keys):
    assert distinct(keys("hello"), 12) == 1


def test_hll_same_element(keys):
    assert distinct(keys("same_element", 10_000), 12) <= 5


# The limits were set for one hash family each. Under md5 the last set of keys is a 3.06-sigma draw:
# a plain computation over the same digests gives 52488 as well, see the next test.
@pytest.mark.parametrize("prefix,n,p,limit,mode", [
    ("unique_", 10_000, 12, 0.20, "md5"),
    ("unique_item_", 1_000, 14, 0.10, "md5"),
    ("unique_item_", 1_000, 14, 0.10, "xxhash64"),
    ("user_", 50_000, 12, 3 * 1.04 / 64, "xxhash64"),
])
def test_hll_error(numbered, prefix, n, p, limit, mode):
    assert abs(distinct(numbered(prefix, n), p, mode) - n) / n < limit


def test_hll_estimate_equals_a_plain_computation(numbered):
    p, m, registers = 12, 4096, {}
    for i in range(50_000):
        h = int.from_bytes(hashlib.md5(f"user_{i}".encode()).digest()[:8], "little")
        rest = h & ((1 << (64 - p)) - 1)
        rho = 64 - p - rest.bit_length() + 1
        registers[h >> (64 - p)] = max(rho, registers.get(h >> (64 - p), 0))
    inverse = sum(2.0 ** -r for r in registers.values()) + (m - len(registers))
    raw = 0.7213 / (1 + 1.079 / m) * m * m / inverse
    assert raw > 2.5 * m
    assert distinct(numbered("user_", 50_000), p) == math.floor(raw + 0.5) == 52488


def test_hll_precision_improves(numbered):
    found = {r.precision: r.error for r in hll.hll_accuracy(numbered("item_", 5000), "key").collect()}
    assert set(found) == {10, 12, 14}
    assert found[14] <= found[10] + 0.05


def test_hll_merge_of_disjoint_sets(numbered):
    a, b = numbered("setA_", 10_000), numbered("setB_", 10_000)
    merged = hll.hll_merge(hll.hll_build(a, "key", 14), hll.hll_build(b, "key", 14))
    assert abs(one(hll.hll_estimate(merged))["estimate"] - 20_000) / 20_000 < 0.05
    assert rows(merged.registers) == rows(hll.hll_build(a.union(b), "key", 14).registers)


@pytest.mark.parametrize("mode", ["md5", "xxhash64"])
@pytest.mark.parametrize("p,q", [(12, 10), (14, 4), (18, 12)])
def test_hll_fold_equals_direct_build(numbered, mode, p, q):
    df = numbered("item_", 500)
    folded = hll.hll_fold(hll.hll_build(df, "key", p, hash_mode=mode), q)
    assert folded.p == q
    assert rows(folded.registers) == rows(hll.hll_build(df, "key", q, hash_mode=mode).registers)


def test_hll_running_equals_prefix_builds(spark):
    df = spark.range(2000).select((F.col("id") % 7).alias("bucket"), F.concat(F.lit("u"), F.floor(F.col("id") / 3)).alias("key"))
    got = dict(rows(hll.hll_running(df, "key", "bucket", 10)))
    for b in range(7):
        assert got[b] == distinct(df.where(F.col("bucket") <= b), 10)


def test_native_sketches_are_close(numbered):
    df = numbered("n", 5000)
    r = one(hll.approx_distinct_native(df, "key", 12))
    assert abs(r.hllpp_estimate - 5000) < 500 and abs(r.datasketch_estimate - 5000) < 500
    assert len(one(cms.cms_native(df, "key", 512, 3))["sketch"]) > 512 * 3 * 8
