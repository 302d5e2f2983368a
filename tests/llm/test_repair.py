"""Conversation repair against a parser that tries every split of every span, and against all edit sequences."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tallystream.llm import repair
from tallystream.session import read_table

DIRECTORY = "/root/testdata/sf0.01"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damage(rows):
    """The damaged rows of one conversation [(conv_id, turn, role, text)], in order."""
    out = []
    text_of = lambda x: " " if x is None else str(x)
    for conv_id, turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv_id)}:{text_of(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    mark = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))


def row_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best_edits(rows, faults):
    """Least (cost, audit) over all edit sequences, by the shortest path over (row, state), audits kept whole."""
    best = [{} for _ in range(len(rows) + 1)]
    best[0][0] = (0, "")
    for i in range(len(rows) + 1):
        for _ in range(5):  # insertions before row i
            for p, (cost, audit) in list(best[i].items()):
                for c in "ua":
                    q = repair.STEPS.get((p, c))
                    if q is not None:
                        best[i][q] = min(best[i].get(q, (10**9, "")), (cost + 5, audit + "I"))
        if i == len(rows):
            break
        for p, (cost, audit) in best[i].items():
            ways = [(p, 2, "D")]
            if faults[i] in (None, "truncated"):
                extra = 5 if faults[i] else 0
                ways += [(repair.STEPS.get((p, rows[i][1][:1])), extra, "K")]
                ways += [(repair.STEPS.get((p, c)), extra + 1, "R") for c in "ua"]
            for q, more, letter in ways:
                if q is not None:
                    best[i + 1][q] = min(best[i + 1].get(q, (10**9, "")), (cost + more, audit + letter))
    return min(best[-1][q] for q in (0, 3) if q in best[-1])


def every_split(rows, faults):
    """CYK over all spans and all places to split them."""
    n = len(rows)
    cells = {(i, i + 1): repair.row_cell(rows[i][1][:1], faults[i]) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            whole = {}
            for k in range(i + 1, i + size):
                for symbol, value in repair.combined(cells[i, k], cells[k, i + size]).items():
                    whole[symbol] = min(whole.get(symbol, value), value)
            cells[i, i + size] = whole
    return cells.get((0, n), repair.EMPTY)


def repaired_text(rows, audit):
    lines, at, state = [], 0, 0
    for letter in audit:
        need = "u" if state in (0, 1, 3) else "a"
        if letter == "I":
            lines.append(repair.ROLES[need] + ":")
        else:
            _, role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            need = role[:1] if letter == "K" else need
            lines.append((role if letter == "K" else repair.ROLES[need]) + ":" + text)
        state = repair.STEPS[state, need]
    assert at == len(rows) and state in (0, 3)
    return "\n".join(lines)


def expected(conversations):
    """conv_id -> row, from [(conv_id, turn, role, text)]."""
    groups = collections.defaultdict(list)
    for r in conversations:
        groups[r[0]].append(r)
    out = {}
    for conv_id, own in groups.items():
        rows = damage(own)
        faults = row_faults(rows)
        cost, audit = best_edits(rows, faults)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = collections.Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        sha = hashlib.sha256(repaired_text(rows, audit).encode()).hexdigest()
        out[conv_id] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


def got(rows):
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables are absent")
def test_query_equals_brute_force(spark):
    table = read_table(spark, DIRECTORY, "conversations").select("conv_id", "turn", "role", "text").collect()
    rows = got(queries()["op12_conversation_repair"](spark, DIRECTORY).collect())
    assert rows == expected([tuple(r) for r in table]) and any(r[4] for r in rows.values())


def test_cells_equal_all_splits_and_all_edits():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(9)
        rows = [(i, rng.choice(["system", "user", "assistant", "tool", ""]), "x") for i in range(n)]
        faults = [rng.choice([None, None, "blank", "duplicate", "truncated"]) for _ in rows]
        spans = repair.Spans()
        for r, f in zip(rows, faults):
            spans.add(repair.row_cell(r[1][:1], f))
        assert spans.whole() == every_split(rows, faults)
        assert repair.cheapest(spans.whole()) == best_edits(rows, faults)


def test_the_cheapest_edits_are_found_among_all_strings():
    def cost(rows, faults, audit):
        total, at, state = 0, 0, 0
        for letter in audit:
            if letter == "I":
                total, role = total + 5, "u" if state in (0, 1, 3) else "a"
            else:
                if at == len(rows):
                    return None
                fault, role = faults[at], rows[at][:1]
                at += 1
                if letter == "D":
                    total += 2
                    continue
                if fault in ("blank", "duplicate"):
                    return None
                total += (5 if fault else 0) + (letter == "R")
                role = role if letter == "K" else "u" if state in (0, 1, 3) else "a"
            if (state, role) not in repair.STEPS:
                return None
            state = repair.STEPS[state, role]
        return total if at == len(rows) and state in (0, 3) else None

    rng = random.Random(6)
    for _ in range(25):
        rows = [rng.choice(["system", "user", "assistant", "x"]) for _ in range(rng.randrange(1, 5))]
        faults = [rng.choice([None, None, None, "blank", "truncated"]) for _ in rows]
        every = [(c, "".join(a)) for k in range(len(rows), len(rows) + 3) for a in itertools.product("DIKR", repeat=k)
                 if (c := cost(rows, faults, a)) is not None]
        spans = repair.Spans()
        for r, f in zip(rows, faults):
            spans.add(repair.row_cell(r[:1], f))
        assert repair.cheapest(spans.whole()) == min(every)


def test_long_conversations_in_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 7)
    monkeypatch.setattr(repair, "TURN_BITS", 4)
    rng = random.Random(7)
    rows = [(1, rng.randrange(600), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "Why?", f"t{i}!"])) for i in range(700)]
    rows += [(2, None, None, None), (2, None, "user", None), (2, -5, "", ""), (3, 0, "user", "word " * 60_000 + "."), (None, 1, "user", "No id.")]
    rows += [(4, 7, "user", "Same."), (4, 7, "user", "Same."), (4, 7, "user", "Same."), (5, 3, "assistant", "\n"), (6, 2**40, "Äther", "ß 日本."), (6, 0, "user", "?")]
    alone = next(i for i in range(100, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "Dropped."))
    wide = [(*r, 1, "k", "b") for r in rows]
    table = spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, kind int, chunk string, seq string")
    found = repair.report_digests(repair.repair(repair.damaged(table), table.select("conv_id"))).collect()
    want = expected(rows)
    assert got(found) == want and len(found) == len(want)
    assert want[alone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = table.filter(F.lit(False))
    assert repair.report_digests(repair.repair(none)).count() == 0


def test_repaired_rows_have_the_given_form(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "More?"), (2, 0, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair.repair(table).orderBy("conv_id", "position").collect()
    first = [(r.edit, r.role, r.text) for r in out if r.conv_id == 1 and r.position]
    assert first == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("R", "assistant", "More?")]
    second = [r for r in out if r.conv_id == 2]
    assert len(second) == 1 and second[0].report.audit == "D" and second[0].report.cost == 2
