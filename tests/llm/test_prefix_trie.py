"""The prefix trie against a plain trie of all prefixes."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallystream.llm import prefix_trie
from tallystream.session import read_table

DIRECTORY = "/root/testdata/sf0.01"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def originals(rows):
    """conv_id -> [(role, text)] in order."""
    out = collections.defaultdict(list)
    mark = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            out[conv_id].append((turn is not None, turn or 0, mark(role, text), role, text))
    return {c: [r[3:] for r in sorted(own)] for c, own in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain_trie(sequences):
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[: d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[x] for x in children[p])
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                           hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()}


def got(df):
    rows = df.select(*COLUMNS).collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def of_table(spark, rows):
    table = spark.createDataFrame([(*r, "z", 3) for r in rows], "conv_id long, turn long, role string, text string, turns string, block int")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.turn_sequences(table)))


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables are absent")
def test_query_equals_plain_trie(spark):
    table = read_table(spark, DIRECTORY, "conversations").select("conv_id", "turn", "role", "text").collect()
    want = plain_trie(rebuilt(originals([tuple(r) for r in table])))
    assert got(queries()["op11_prefix_trie"](spark, DIRECTORY)) == want
    assert max(v[1] for (_, d), v in want.items() if d) > 3


@pytest.mark.parametrize("turns", [1, 5, 40])
def test_blocks_of_any_size(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", turns)
    rng = random.Random(turns)
    rows = []
    for c in [*range(100, 130), *range(400, 430)]:  # no family has its first conversation but 100 and 400
        kind = rng.randrange(3)
        for i in range(0 if kind == 2 and rng.random() < 0.3 else rng.randrange(1, 6)):
            rows.append((c, i, rng.choice(["user", "assistant"]), rng.choice(["a", "bb"]) if kind else "same"))
    rows += [(900 + i, t, "user", "copy" * t) for i in range(40) for t in range(7)]
    assert got(of_table(spark, rows)) == plain_trie(rebuilt(originals(rows)))


def test_edges(spark):
    rows = [(7, None, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (None, 1, "user", "no id"), (-250, 3, "user", "x" * 300_000),
            (201, 0, "ab", "c"), (202, 0, "a", "bc"), (8, 2, "user", "ß😀"), (8, 1, None, "first")]
    rows += [(1001, i, "user", f"t{i}") for i in range(300)] + [(1002, i, "user", f"t{i}") for i in range(300)]
    assert got(of_table(spark, rows)) == plain_trie(rebuilt(originals(rows)))
    turnless = [(c, 0, "user", "only") for c in range(301, 340) if zlib.crc32(str(c).encode()) % 6 > 0]
    found = got(of_table(spark, turnless))
    assert found == plain_trie(rebuilt(originals(turnless))) and list(found) == [(turnless[0][0], 0)]
    assert of_table(spark, rows).filter(F.col("depth") < 0).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.turn_sequences(empty)).count() == 0


def test_range_minima_and_searches():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(-1, 6, n)
        table = prefix_trie.RangeMinimum(values)
        for _ in range(30):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a + 1, n + 1))
            floor = int(rng.integers(-1, 7))
            one = lambda x: np.array([x])
            assert table.least(one(a), one(b))[0] == values[a:b].min()
            assert table.right_end(one(a), one(floor))[0] == next((i for i in range(a, n) if values[i] < floor), n)
            assert table.left_end(one(a), one(floor))[0] == next((i for i in range(a, -1, -1) if values[i] < floor), -1)
