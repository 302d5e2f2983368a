"""Queries against their SQL, against brute force over the same tables, or against held-out labels."""

import collections
import os
import re

import duckdb
import numpy as np
import pytest
from tests_llm_brute import near_groups, repeated_lines

from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from tallystream.llm import pieces
from tallystream.session import read_table

DIRECTORY = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    connection = connect(DIRECTORY)
    yield connection
    connection.close()


@pytest.fixture(scope="module")
def documents(spark):
    return read_table(spark, DIRECTORY, "documents").toPandas()


@pytest.mark.parametrize("name", ["op2_private", "op8_quality_rules", "op10_mixing"])
def test_equals_sql(spark, con, name):
    assert name in oracle_sql()
    assert compare(spark, con, DIRECTORY, name) is None


def test_language_is_right_on_held_out_documents(spark):
    rows = queries()["op1_language"](spark, LARGER).toPandas()
    both = rows.merge(read_table(spark, LARGER, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(rows) == len(both) and len(held) > 200
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert rows.score.between(0, 1).all()
    assert held.rejected.mean() < 0.1


def test_toxicity_ranks_held_out_documents(spark):
    rows = queries()["op3_toxicity"](spark, LARGEST).toPandas()
    both = rows.merge(read_table(spark, LARGEST, "labels").toPandas(), on="doc_id")
    held = both[both.held_out]
    rank, toxic = held.score.rank().to_numpy(), held.toxic.to_numpy()
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    assert (rank[toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 2
    assert rows.score.between(0, 1).all() and len(rows) == 10_000


def test_lines_equal_brute_force(spark, documents):
    want = repeated_lines(dict(zip(documents.doc_id, documents.text)))
    rows = queries()["op4_line_dedup"](spark, DIRECTORY).collect()
    got = {r.doc_id: r.n_dropped for r in rows if r.n_dropped}
    assert got == {d: len(x) for d, x in want.items()} and sum(got.values()) > 10


def test_pieces_round_trip_and_digest(spark, documents):
    rows = queries()["op5_sentencepiece"](spark, DIRECTORY).collect()
    assert len(rows) == len(documents) and all(r.round_trip for r in rows)
    assert all(r.n_ids == len(r.ids) for r in rows)


def test_quality_agrees_with_labels(spark):
    rows = queries()["op6_quality"](spark, LARGER).toPandas()
    both = rows.merge(read_table(spark, LARGER, "labels").toPandas(), on="doc_id")
    assert (both.kept == (both.quality == 1)).mean() > 0.95 and len(rows) == 1000


def test_neighbours_against_brute_force(spark):
    vectors = read_table(spark, LARGER, "embeddings").toPandas().sort_values("vec_id")
    x, ids = np.stack(vectors.embedding).astype(float), vectors.vec_id.to_numpy()
    rows = queries()["op7_neighbours"](spark, LARGER).toPandas()
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        score[i] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:20]])
        own = rows[rows.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing
        assert np.allclose(own.score, score[np.searchsorted(ids, own.vec_id)], rtol=0, atol=1e-15)
        hits += len(want & set(own.vec_id))
    assert hits / len(rows) >= 0.9


def test_near_duplicates_equal_brute_force(spark):
    docs = read_table(spark, LARGER, "documents").toPandas()
    want, sizes = near_groups(dict(zip(docs.doc_id, docs.text)), 4)
    rows = queries()["op9_near_duplicates"](spark, LARGER).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_mix_comes_near_its_targets(spark):
    rows = queries()["op10_mixing"](spark, LARGER).toPandas()
    source = read_table(spark, LARGER, "documents").select("doc_id", "source").toPandas()
    both = rows.merge(source, on="doc_id")
    assert (both.taken <= 3 * both["size"]).all()
    per = both.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((per.taken - per.target).abs() <= 0.02 * per.target).all()
    assert per.target.sum() == pytest.approx(both["size"].sum())


def test_pipeline_stages_against_their_own_inputs(spark):
    from corpus_pipeline import STAGES
    from tallystream.llm.shared import staged
    from tallystream.llm.sql import mixing_steps, quality_rules_steps

    docs, seen = read_table(spark, DIRECTORY, "documents"), []
    columns = docs.columns
    for name, stage in STAGES:
        seen.append(docs.toPandas())
        docs = staged(stage(spark, docs, DIRECTORY), name.replace(" ", "-"))
        assert docs.columns == columns or name == "SentencePiece"
    seen.append(docs.toPandas())
    raw, good, cut, unique, mixed, coded = seen
    con = duckdb.connect()
    con.register("raw", raw), con.register("pool", unique)
    want = con.sql(f"with {quality_rules_steps('raw')} select doc_id from verdicts where kept").df()
    assert sorted(want.doc_id) == sorted(good.doc_id)
    gone = repeated_lines(dict(zip(good.doc_id, good.text)))
    for doc_id, text, n in zip(cut.doc_id, cut.text, cut.n_chars):
        old = good[good.doc_id == doc_id].text.iloc[0].split("\n")
        assert text == "\n".join(x for i, x in enumerate(old) if i not in gone.get(doc_id, ()))
        assert n == len(text)
    groups, _ = near_groups(dict(zip(cut.doc_id, cut.text)), 5)
    assert sorted(unique.doc_id) == sorted(d for d, c in groups.items() if d == c)
    copies = con.sql(f"with {mixing_steps('pool')} select doc_id, copies from mix where copies > 0").fetchall()
    assert collections.Counter(mixed.doc_id) == dict(copies)
    assert coded.text.tolist() == coded.decoded.tolist() and sorted(coded.doc_id) == sorted(mixed.doc_id)


def test_best_pieces_equal_all_ways_to_cut():
    vocabulary = pieces.read_vocabulary(pieces.MODEL)
    encoder = pieces.Encoder(vocabulary)
    score = {t: s for t, s, u in zip(vocabulary.texts, vocabulary.scores, vocabulary.usable) if u}

    def best(word: str) -> float:
        top = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                if word[i:j] in score:
                    top[j] = max(top[j], top[i] + score[word[i:j]])
                elif j == i + 1:
                    top[j] = max(top[j], top[i] + encoder.unknown)
        return top[-1]

    for word in re.findall(r"\S+", "the quick brown fox élan straße 12,345 日本語 na​ïve 😀 thereast"):
        ids = encoder.encode(word)
        total, i = 0.0, 0
        while i < len(ids):
            if ids[i] in vocabulary.byte_ids:
                lead = vocabulary.byte_ids.index(ids[i])
                i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                total += encoder.unknown
            else:
                total += vocabulary.scores[ids[i]]
                i += 1
        assert total == pytest.approx(best("▁" + word))
