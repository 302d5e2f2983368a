"""Operator 4: line dedup with a log-template tree of fixed depth.

A line's path in the tree is its token count and its first three tokens; tokens with a digit are a variable field.
The rest of a line is cut into four segments. A template is a path with some of its segments constant and the
others variable; a line has a template for every choice of segments in which six tenths of its tokens are constant, so
a copy with a changed word shares one with the verbatim copies. Variable fields are never counted as constant, wherever
they stand, so rows of different numbers have no template in common. A line with such fields has a second set of templates
in which its tokens with a digit are taken as they are, and counted: copies with the same numbers recur. A template recurs if constant tokens times further
documents that have it reach `EVIDENCE`: a line of 20 words needs two documents, one of five words five. Lines
shorter than `PATH_ONLY` tokens, down to a single one, are compared as a whole; only lines without tokens always stay.
Each character of a script that is written without blanks is a token, so such lines are compared, and their
evidence is counted, by characters.

A line is dropped if an earlier document has one of its recurring templates. The first line of a chain of such lines
therefore stays, in the document with the smallest id. Segments that no other document has under the same path
cannot be in a recurring template and are left out before the choices are made. Sharing is found
from the smallest and largest id of a group, which are combined before the shuffle, so a line with a third of
all documents costs a row per task.

Defined results: a null text stays null, an empty one empty; a row without an id is returned unchanged and does not
count; rows that share an id are one document; a text that loses all its lines becomes empty; an empty
table gives an empty result; other columns are returned as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm import textbytes
from tallystream.llm.shared import BLANKS, staged

LEAD = 3
SEGMENTS = 4
PATH_ONLY = 8
EVIDENCE = 20
CONSTANT_PERCENT = 60
SALTS = 8

_U = np.uint64
_VARIABLE = _U(0x2545F4914F6CDD1D)
# Thai, Lao, Tibetan and Burmese; Khmer; Tai scripts; Balinese; Javanese; kana; Chinese characters
UNSPACED = re.compile(
    "[\u0e00-\u109f\u1780-\u17ff\u1950-\u1aaf\u1b00-\u1b7f\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")


def spaced(text: str | None) -> str | None:
    """`text` with blanks around every character of a script that is written without them."""
    return text if not text or text.isascii() else UNSPACED.sub(r" \g<0> ", text)


def line_paths(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all lines that can recur: text, line, n, exact, path, segments and the constant tokens of lead and segments.

    A line that is compared whole is all lead. A line with tokens with a digit comes a second time, exact, with these as they are.
    """
    data, bounds = textbytes.joined([spaced(t) for t in texts])
    hashes, starts, ends = textbytes.words(data, textbytes.separators(BLANKS), lower=False)
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    variable = digits[ends] > digits[starts]
    breaks = np.flatnonzero(data == 10)
    of_line = np.searchsorted(breaks, starts)
    n = np.bincount(of_line, minlength=len(breaks))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    place = np.arange(len(hashes)) - first[of_line]
    n_own = n[of_line]
    weights = textbytes.mixed(place.astype(_U)) | _U(1)
    whole = n_own < PATH_ONLY
    segment = np.where(
        (place < LEAD) | whole, 0, 1 + (place - LEAD) * SEGMENTS // np.maximum(n_own - LEAD, 1))
    cell = of_line * (SEGMENTS + 1) + segment
    at = np.flatnonzero(np.diff(cell, prepend=-1))

    def view(exact: bool) -> tuple[np.ndarray, ...]:
        values, counted = (hashes, slice(None)) if exact else (np.where(variable, _VARIABLE, hashes), ~variable)
        sums = np.zeros(len(breaks) * (SEGMENTS + 1), _U)
        if len(cell):
            sums[cell[at]] = textbytes.mixed(np.add.reduceat(values * weights, at))
        constant = np.bincount(cell[counted], minlength=sums.size).reshape(-1, SEGMENTS + 1)
        sums = sums.reshape(-1, SEGMENTS + 1)
        fits = np.bincount(of_line[variable], minlength=len(breaks)) if exact else (
            (n > 0) & (100 * constant.sum(axis=1) >= CONSTANT_PERCENT * n))
        lines = np.flatnonzero(fits)
        path = textbytes.mixed(sums[lines, 0] + n[lines].astype(_U) * _U(0x9E3779B97F4A7C15))
        text = np.searchsorted(bounds, breaks[lines], side="right") - 1
        before = np.searchsorted(breaks, bounds)[text]
        return (text, lines - before, n[lines], np.full(len(lines), exact), path, sums[lines, 1:], constant[lines])

    return tuple(np.concatenate(pair) for pair in zip(view(False), view(True)))


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in textbytes.slices(texts):
            text, line, n, exact, path, segments, constant = line_paths(texts[a:b])
            rows = pa.array(text + a)

            def lists(values: np.ndarray) -> pa.ListArray:
                offsets = np.arange(0, SEGMENTS * len(values) + 1, SEGMENTS, dtype=np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))

            yield pa.record_batch({
                "id": batch.column("id").take(rows), "mark": batch.column("mark").take(rows),
                "line": pa.array(line.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "exact": pa.array(exact),
                "path": pa.array(path.view(np.int64)), "lead": pa.array(constant[:, 0].astype(np.int32)),
                "segments": lists(np.ascontiguousarray(segments).view(np.int64)),
                "tokens": lists(constant[:, 1:].astype(np.int32)),
            })


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one document has."""
    return rows.groupBy(*keys).agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).filter("_lo < _hi").select(*keys)


def _met(rows: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are in `small`, with its other columns; a key with very many rows is dealt out by a salt."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", "line"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"]).drop("_salt")


def _templates() -> Column:
    """constant and template of a line for each choice of its shared segments s0, s1, ... that is long enough.

    A segment is a struct of its value and its constant tokens.
    """
    found = []
    for choice in range(1, 1 << SEGMENTS):
        chosen = [j for j in range(SEGMENTS) if choice >> j & 1]
        constant = sum((F.col(f"s{j}.tokens") for j in chosen), F.col("lead")).cast("long")
        fits = reduce(Column.__and__, [F.col(f"s{j}").isNotNull() for j in chosen])
        found.append(F.when(fits & (100 * constant >= CONSTANT_PERCENT * F.col("n")), F.struct(
            constant.alias("constant"),
            F.xxhash64("path", F.lit(choice), *[f"s{j}.segment" for j in chosen]).alias("template"))))
    return F.array_compact(F.array(*found))


def dropped_lines(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (hash of the text), drops: the numbers of the lines of a document that go."""
    rows = docs.filter(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(row_id).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    lines = staged(rows.mapInArrow(
        _line_rows, "id long, mark long, line int, n int, exact boolean, path long, lead int, segments array<long>, tokens array<int>"),
        "lines")
    own = ["id", "mark", "line", "n", "exact", "path", "lead"]
    open_lines = staged(_met(lines, _shared(lines, "path"), "path").select(*own, "segments", "tokens"), "open-lines")

    parts = open_lines.filter(F.col("n") >= PATH_ONLY).select(
        *own, "tokens", F.posexplode("segments").alias("j", "segment")).withColumn(
        "tokens", F.get("tokens", F.col("j"))).filter("tokens > 0")  # a segment of variable fields adds nothing
    constant = _shared(parts, "path", "j", "segment")
    shared = _met(parts, constant, "path", "j", "segment").groupBy(*own).agg(
        *[F.max(F.when(F.col("j") == j, F.struct("segment", "tokens"))).alias(f"s{j}") for j in range(SEGMENTS)])
    templates = shared.select(*own, F.explode(_templates()).alias("one")).select(*own, "one.constant", "one.template")
    whole = open_lines.filter(F.col("n") < PATH_ONLY).select(
        *own, F.col("lead").cast("long").alias("constant"), F.col("path").alias("template"))
    both = staged(templates.unionByName(whole).select("id", "mark", "line", "constant", "template"), "templates")

    recurring = both.groupBy("template", "id").agg(F.max("constant").alias("constant")).groupBy("template").agg(
        F.count(F.lit(1)).alias("documents"), F.min("id").alias("first"), F.max("constant").alias("constant"),
    ).filter(F.col("constant") * (F.col("documents") - 1) >= EVIDENCE).select("template", "first")
    gone = _met(both, recurring, "template").filter("id > first")
    return gone.groupBy("id", "mark").agg(F.collect_set("line").alias("drops"))


def without_repeated_lines(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", count: str | None = None, length: str | None = None,
) -> DataFrame:
    """`docs` with the recurring lines taken out of `text`.

    `count` names a new column for their number, `length` a column that is to hold the text's length, if there.
    """
    gone = staged(dropped_lines(docs, row_id, text), "dropped-lines")
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(row_id).cast("long").alias("_id"), F.col(text).alias("_old"))
    joined = rows.join(gone, (rows["_id"] == gone["id"]) & (F.xxhash64("_old") == gone["mark"]), "left")
    touched = F.col("drops").isNotNull()
    shorter = joined.withColumn("_lines", F.when(touched, F.split("_old", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drops"))
    new_text = F.when(touched, F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")).otherwise(F.col("_old"))
    done = shorter.withColumn("_new", new_text)

    def column(name: str) -> Column:
        if name == text:
            return F.col("_new").alias(name)
        if name == length:
            kind = docs.schema[name].dataType
            return F.when(touched, F.length("_new").cast(kind)).otherwise(F.col("_row")[name]).alias(name)
        return F.col("_row")[name].alias(name)

    extra = [F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias(count)] if count else []
    return done.select(*[column(c) for c in docs.columns if c != count], *extra)
