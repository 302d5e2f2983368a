"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.llm import (
    language, lines, mixing, near_dup, neighbours, pieces, private, quality, quality_rules, textbytes, toxicity,
)
from tallystream.llm.components import components

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, ids string, "
    "_words int, _row int, component_id long, n_words string, private string, copies int, position string, "
    "_text string, id string, level int, n_dropped string"
)
PAD = (True, 0.5, "x", 1, 2, 3, "y", "z", 4, "w", "v", "u", 5, "t")
LONG = " ".join(f"word{i % 977}" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, LONG), (6, LONG), (7, "a" * 300_000),
        (8, "the cat sat on the mat and looked at the moon for a long while"), (None, "text without an id " * 5),
        (9, "\n\n\n"), (10, "ＡＢＣ 日本語 😀 ▁ mixed\u0000text"), (11, "same text " * 6), (11, "same text " * 6),
    ]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 1 else f"s{k % 3}", k, *PAD) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(8, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None), (11, 0, 1)], "doc_id long, quality int, toxic int")


def test_quality_rules(odd, none):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == 13
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[3].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[5].n_words == 40_000 and by_id[5].n_repeat_words == 40_000
    assert by_id[7].n_words == 1 and by_id[7].word_chars == 300_000
    assert by_id[11].n_repeat_words == 12
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert quality_rules.kept_documents(none).count() == 0


def test_language(odd, none):
    rows = language.predicted(odd, language.fit(odd, F.lit(True))).collect()
    assert len(rows) == 13
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 9))
    assert by_id[8].lang_pred == "en" and by_id[7].lang_pred == "en"
    assert {r.lang_pred for r in language.predicted(odd, None).collect()} == {"und"}
    assert language.fit(none, F.lit(True)) is None
    assert language.predicted(none, None).count() == 0


def test_toxicity(odd, none, labels):
    model = toxicity.fit(odd, labels.select("doc_id", "toxic"))
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.fit(none, labels.select("doc_id", "toxic")) is None
    assert {r.score for r in toxicity.scored(odd, None).collect()} == {0.0}
    assert toxicity.scored(none, model).count() == 0


def test_segments_are_those_of_all_intervals():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 14)
        values = [rng.choice([-0.5, -0.5, 1.0, 2.0, 0.75]) for _ in range(n)]
        places = [i for i, v in enumerate(values) if v > 0]
        got = toxicity.segments(places, [values[i] for i in places], drift=0.5)
        want = []

        def split(a, b):  # the largest interval, then what lies left and right of it
            best = max(((sum(values[i: j + 1]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i, b)), default=None)
            if best and best[0] > 0:
                want.append(best[0])
                split(a, best[3]), split(best[4] + 1, b)

        split(0, n)
        assert sorted(round(s, 9) for *_, s in got)[-1:] == sorted(round(s, 9) for s in want)[-1:]
        assert sum(s for *_, s in got) == pytest.approx(sum(want))
        assert all(sum(values[f: z + 1]) == pytest.approx(s) for f, z, s in got)


def test_lines(odd, none, spark):
    out = lines.without_repeated_lines(odd, count="n_dropped")
    assert set(out.columns) == set(odd.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 13 and got[1].text is None and got[2].text == "" and got[9].text == "\n\n\n"
    assert got[5].text == LONG and got[6].text == ""
    assert got[11].n_dropped == 0  # rows of one id are one document
    assert lines.without_repeated_lines(none).count() == 0
    logs = [(i, f"start {i}\nuser with name n{i} connected to server alpha from address 10.0.0.{i} today\nend") for i in range(6)]
    logs += [(9, "user with name bob connected to other machines than all of them today")]
    rows = {r.doc_id: r.text for r in lines.without_repeated_lines(
        spark.createDataFrame(logs, "doc_id long, text string")).collect()}
    assert rows[0] == logs[0][1] and rows[9] == logs[6][1]
    assert all(rows[i] == f"start {i}\nend" for i in range(1, 6))


def test_pieces(odd, none):
    vocabulary = pieces.read_vocabulary(pieces.MODEL)
    coded = pieces.decoded(pieces.encoded(odd, vocabulary), vocabulary)
    rows = coded.collect()
    assert len(rows) == 13 and all(r.text == r.decoded for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].ids is None and by_id[2].ids == []
    assert pieces.encoded(none, vocabulary).count() == 0


def test_near_duplicates(odd, none, spark):
    rows = near_dup.near_duplicates(odd).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and by_id[6].component_id == 5 and not by_id[6].kept
    assert by_id[1].n_shingles == by_id[3].n_shingles == 0 and by_id[1].kept and by_id[3].component_id == 3
    assert by_id[4].n_shingles == 1 and by_id[11].component_id == 11
    assert by_id[None].component_id is None and by_id[None].kept
    assert near_dup.near_duplicates(none).count() == 0
    assert {r.doc_id for r in near_dup.without_near_duplicates(odd).collect()} == set(by_id) - {6}
    # a tie at exactly four fifths links: sets of 9 with 8 in common, 8 / 10
    words = [f"w{i}" for i in range(14)]
    tied = [(1, " ".join(words[:12])), (2, " ".join(words[1:13])), (3, " ".join(words[3:14]))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(
        spark.createDataFrame(tied, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_large_group_of_near_copies_and_common_passage(spark, monkeypatch):
    """Blocks and splitting of buckets at small sizes give the groups of brute force."""
    from tests_llm_brute import near_groups

    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dup, "SPLIT_ROWS", 16)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(60, 110):
        texts[i] = " ".join([*passage, *[f"y{rng.randrange(10**6)}" for _ in range(25)]])
    want, _ = near_groups(texts, 4)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201)], "u long, v long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


def test_mixing(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == 13 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.doc_id: r.size for r in rows}[1] == 0
    assert all(len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_plan(odd).collect()), key=str)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_plan(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_curriculum_order_and_targets_at_their_limit(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 3}") for i in range(900)]
    rows += [(5000, "w w", "zz")]  # a fourth source, far too small for its share
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).toPandas()
    per = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert per.loc["zz"].target == 6 and per.loc["zz"].taken == 6
    assert ((per.taken - per.target).abs() <= 7).all()
    first = plan[plan.copies > 0].assign(p=lambda x: x.positions.map(np.mean)).groupby("source").p.mean()
    assert first["s0"] < first["s1"] < first["s2"]  # heavier sources come later


def test_private(odd, none, spark):
    rows = private.private_spans(odd).collect()
    assert len(rows) == 13 and all(r.private == [] for r in rows)
    assert private.private_spans(none).count() == 0
    texts = {
        "é a.b@c.d_e@f.g x": "email:2:9,email:9:15",
        "ip 1.2.3.4.5 and 300.1.1.1 and 0255.1.1.1": "ip:3:10,ip:31:41",
        "4111 1111-1111 1111": "card:0:19",
        "4111111111111112 49927398716": "",
        "call +49 (30) 1234-5678, +1 2": "phone:5:23",
        "iban GB82 WEST 1234 5698 7654 32 GB83WEST12345698765432": "iban:5:32",
        "ssn 078-05-1120 part 078-05-1121": "ssn:4:15",
        "tel (030) 555-1234 x 555-123-4567": "tel:4:18,tel:21:33",
        'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok': "secret:12:52",
        "API_KEY=sk9Zk3mQ0x7Lp2Vw8RtB, passwort: aaaaaaaaaaaaaaaa1": "secret:8:28",
        "commit token: 04dbebab91ab85687d33eeaaf9ac699e1188f962 color: 04dbebab91ab85687d33eeaaf9ac699e": "",
        "token: internationalization": "",
    }
    found = private.private_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(
        "doc_id", "text", "private", private.written(F.col("private")).alias("spans")).collect()
    assert {r.text: r.spans for r in found} == texts
    hidden = private.redacted(private.private_spans(spark.createDataFrame([("mail a@b.cd now",)], "text string")))
    assert hidden.first().text == "mail <email> now"


def test_private_patterns_are_linear(spark):
    text = "a." * 100_000 + "@" + ".a" * 50_000
    row = private.private_spans(spark.createDataFrame([("1" * 150_000 + text,)], "text string")).first()
    assert row.n_email == 0 and row.n_card == 0


def test_quality(odd, none, labels):
    model = quality.fit(odd, labels.select("doc_id", "quality"))
    rows = quality.quality(odd, model, F.col("source"), F.col("lang")).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(none, model, F.col("source"), F.col("lang")).count() == 0
    assert quality.fit(none, labels.select("doc_id", "quality")).weights[1:] == [0.0] * len(quality.FEATURES)


def test_sparse_paths_stay_near_their_host(spark):
    docs = [("a", "x", 0.9)] * 400 + [("a", "y", 0.1)] + [("b", "z", 0.2)] * 400 + [("c", "w", 0.9)]
    rates = {(r.host, r.path): r for r in quality.site_rates(
        spark.createDataFrame(docs, "host string, path string, evidence double")).collect()}
    assert rates["a", "x"].path_rate > 0.85 and rates["b", "z"].path_rate < 0.25
    assert 0.5 < rates["a", "y"].path_rate < 0.9 and 0.5 < rates["c", "w"].host_rate < 0.9


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    ties = [(100 + i, good[0][1]) for i in range(30)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6),
           (280, [float("inf")] + [0.0] * 5), (300, [1.0]), (None, good[1][1])]
    table = spark.createDataFrame(good + ties + bad, "vec_id long, embedding array<double>")
    rows = neighbours.nearest(table, F.col("id") % 20 == 0).collect()
    pool = dict(good + ties)
    for q in {r.query_id for r in rows}:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        score = {v: float((np.array(x) * np.array(pool[q])).sum()) for v, x in pool.items() if v != q}
        want = sorted(score, key=lambda v: (-score[v], v))[:20]
        assert [r.vec_id for r in own] == want
    assert {r.query_id for r in rows} == {0, 20, 40, 100, 120}
    few = neighbours.nearest(table.filter("vec_id in (0, 1, 20)"), F.col("id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (20, 1), (20, 2)]
    assert neighbours.nearest(table.filter("vec_id < 0"), F.col("id") % 20 == 0).count() == 0
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = ["Ab cd, ef " * 50, None, "", "x" * 5000, "é ü"]
    data, bounds = textbytes.joined(texts)
    want = textbytes.words(data, textbytes.separators(" \n"))
    monkeypatch.setattr(textbytes, "BLOCK", 64)
    textbytes._powers.cache_clear()
    got = textbytes.words(data, textbytes.separators(" \n"))
    textbytes._powers.cache_clear()
    assert all(np.array_equal(a, b) for a, b in zip(want, got))
    low = textbytes.words(np.frombuffer(b"ABC abc", np.uint8), textbytes.separators(" "))[0]
    assert low[0] == low[1]


def test_digest_of_spans(spark):
    row = private.private_spans(spark.createDataFrame([(None,)], "text string")).select(
        F.sha2(private.written(F.col("private")), 256).alias("s")).first()
    assert row.s == hashlib.sha256(b"").hexdigest()
