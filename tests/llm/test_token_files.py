"""Files of token codes against the tokenizer and against plain lists of ids."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallystream.llm import token_files
from tallystream.session import read_table

DIRECTORY = "/root/testdata/sf0.001"


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.MODEL)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def expected(pairs):
    """Rows of (doc_id, text) pairs that are in order."""
    rows, start = [], 0
    for (d, _), ids in zip(pairs, ids_of([t for _, t in pairs])):
        rows.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables are absent")
def test_query_equals_the_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 20_000)  # several files in a partition
    docs = read_table(spark, DIRECTORY, "documents").select("doc_id", "text").collect()
    rows = [tuple(r) for r in queries()["op13_token_files"](spark, DIRECTORY).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(rows) == expected(sorted((r.doc_id, r.text) for r in docs))


@pytest.mark.parametrize("largest", [1, 255, 256, 65_535, 65_536, 2**32 - 1])
def test_every_id_is_found_by_its_position(tmp_path, largest):
    rng = np.random.default_rng(largest)
    for n in (1, 511, 512, 513, 5_000):
        ids = (rng.random(n) ** 4 * largest).astype(np.uint32)
        ids[rng.integers(n)] = largest
        path = tmp_path / f"{n}.dac"
        path.write_bytes(b"".join(token_files.file_bytes([7, None], np.array([n // 3, n - n // 3]), ids)))
        with token_files.TokenFile(str(path)) as file:
            assert (file.documents, file.tokens, file.doc_ids()) == (2, n, [7, None])
            assert [file.token(i) for i in range(0, n, 97)] == ids[::97].tolist()
            assert file.document(1).tolist() == ids[n // 3:].tolist()
            for a in rng.integers(0, n + 1, 20):
                assert file.tokens_between(a, n).tolist() == ids[a:].tolist()
            with pytest.raises(IndexError):
                file.token(n)


def test_edges_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 64)
    texts = {5: "", 4: None, 3: " \n\t ", 2: "ÅßÇ 日本語 😀 \u0000", 1: "word " * 5_000, -3: "below zero"}
    rows = [(d, t, "x", "y") for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, place string")
    manifest = token_files.write_tokens(docs, token_files.new_folder(docs))
    got = [tuple(r) for r in token_files.read_summaries(manifest).orderBy("start").collect()]
    assert got == expected([(d, texts[d]) for d in sorted(texts)])
    everything = [i for x in ids_of([texts[d] for d in sorted(texts)]) for i in x]
    spans = [(0, 3), (2, 2), (0, len(everything)), (len(everything) - 7, len(everything)), (60, 200)]
    asked = spark.createDataFrame([(*s, "tag") for s in spans], "first long, last long, name string")
    for r in token_files.read_range(manifest, asked).collect():
        assert r.ids == everything[r.first: r["last"]] and r.name == "tag"


def test_repeated_and_missing_ids_and_no_rows(spark):
    docs = spark.createDataFrame(
        [(None, "no id"), (None, "no id"), (None, None), (9, "same"), (9, "same"), (9, "other")], "doc_id long, text string")
    rows = token_files.read_summaries(token_files.write_tokens(docs.repartition(5), token_files.new_folder(docs))).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 3 + [9] * 3
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()
    assert sorted(r.n_tokens for r in rows) == sorted(len(x) for x in ids_of([r.text for r in docs.collect()]))
    none = docs.filter(F.lit(False))
    assert token_files.read_summaries(token_files.write_tokens(none, token_files.new_folder(none))).count() == 0


def test_words_of_odd_texts_have_the_ids_of_the_texts():
    import random

    import pyarrow as pa

    rng = random.Random(4)
    marks = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "日", "1", ".", ",", "\t", "\xa0", "​", "\x85", "😀", "$$", "’", "\r\n", "\x1c", "　",
             "Z", "_", "\x00", "▁", "﻿", "́"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(20_000)] + [None, "", " ", "x" * 5_000]
    tool = token_files.TextIds(token_files.MODEL)
    for _ in range(2):  # unknown and known words
        ids, counts = tool.words.encode(pa.array(texts))
        want = tool.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert counts.tolist() == [len(e.ids) for e in want]
        assert ids.tolist() == [i for e in want for i in e.ids]
