"""Quality: site rates against a plain computation, and labels that took no part in fitting."""

import math
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallystream.llm import quality
from tallystream.session import read_table

TABLE = "/root/testdata/sf0.1"


def strength(groups, means):
    """Prior size by moments of [(n, good)] around their means."""
    own = [(g / n, m, n) for (n, g), m in zip(groups, means) if n > 1]
    if not own:
        return 1000.0
    average = lambda x: sum(x) / len(own)
    spread = average([(r - m) ** 2 for r, m, _ in own])
    between = max(spread - average([m * (1 - m) / n for _, m, n in own]), 0.0)
    return 1000.0 if between <= 1e-9 else min(max(average([m * (1 - m) for _, m, _ in own]) / between - 1, 1.0), 1000.0)


def test_rates_without_the_document_itself(spark):
    rows = [(f"h{i % 4}" if i % 9 else None, f"p{i % 7 % 3}", min(max((i * 37 % 101) / 100, 0.02), 0.98)) for i in range(120)] + [("alone", None, 0.3)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    paths, hosts = defaultdict(list), defaultdict(list)
    for h, p, e in rows:
        paths[h, p].append(e)
        hosts[h].append(e)
    rate = sum(r[2] for r in rows) / len(rows)
    k1 = strength([(len(x), sum(x)) for x in hosts.values()], [rate] * len(hosts))
    host_rate = {h: (sum(x) + k1 * rate) / (len(x) + k1) for h, x in hosts.items()}
    k2 = strength([(len(x), sum(x)) for x in paths.values()], [host_rate[h] for h, _ in paths])
    rates = quality.site_rates(scored)
    for r in rates.collect():
        x = paths[r.host, r.path]
        assert r.n == len(x) and r.host_rate == pytest.approx(host_rate[r.host]) and r.global_rate == pytest.approx(rate)
        assert r.path_rate == pytest.approx((sum(x) + k2 * host_rate[r.host]) / (len(x) + k2))
    others = rates.crossJoin(spark.createDataFrame([(0.3,)], "own double")).where("host = 'alone'")
    host, path = quality.rates_of_others(F.col("own"))
    r = others.select(host.alias("host_rate"), path.alias("path_rate")).first()
    assert math.isclose(r.host_rate, rate, rel_tol=1e-9) and math.isclose(r.path_rate, rate, rel_tol=1e-9)


@pytest.mark.skipif(not os.path.isdir(TABLE), reason="test tables are absent")
def test_held_out_labels_are_met(spark):
    docs = read_table(spark, TABLE, "documents")
    labels = read_table(spark, TABLE, "labels").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = quality.fit(docs, labels.where(~held))
    rows = quality.quality(docs, model, F.col("source"), F.col("lang")).select("doc_id", "kept", "evidence")
    both = rows.join(labels.where(held), "doc_id").toPandas()
    assert len(both) > 200 and ((both.kept == (both.quality == 1)).mean()) > 0.93
