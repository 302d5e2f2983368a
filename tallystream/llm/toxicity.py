"""Operator 3: toxicity by maximum-scoring segments of token log-odds.

Tokens (runs of letters, A-Z lower-cased, hashed) get log-odds between toxic and other labelled documents with an
informative Dirichlet prior from both together. Tokens whose log-odds are `SURE` standard errors above zero
count with them, all others with the negative `DRIFT`. A linear-time scan finds all maximal-scoring segments
of a text. By extreme-value theory the best of N tokens' segments exceeds a score S by chance with
E = K N exp(-lambda S); a segment with E of at most `CHANCE` is a toxic passage. The log-evidence
beyond chance of a text's segments, largest and total, is turned into a probability by a logistic curve.

The model is fitted on at most `sample` labelled rows, those with the smallest hash of their id; three quarters
give the log-odds, the rest the curve. Only bucket counts and a few numbers per document reach the driver.

Defined results: null and empty texts have the score of a text without passages; rows without an id or label
are not learned from; without labelled rows all scores are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm import textbytes
from tallystream.llm.language import smallest_hashes

BUCKETS = 1 << 18
SAMPLE = 6000
PRIOR_TOKENS = 2000.0
SURE = 3.0
DRIFT = 0.15
CHANCE = 0.05
MOST_PER_TEXT = 2  # how often one text's repetition of a token counts in the log-odds
PASSAGES = "array<struct<first:int,last:int,score:double>>"


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted buckets with a positive score
    scores: np.ndarray
    decay: float  # lambda
    scale: float  # K
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score); tokens in between cost `drift` each.

    A new segment is merged with the nearest earlier one that starts lower and ends lower, until none does.
    Each segment remembers the nearest earlier one that starts lower, which makes the scan linear.
    """
    low: list[float] = []
    high: list[float] = []
    first: list[int] = []
    last: list[int] = []
    lower: list[int] = []
    total, at = 0.0, 0
    for place, score in zip(places, scores):
        total -= drift * (place - at)
        at = place + 1
        begin, a = total, place
        total += score
        while True:
            k = len(low) - 1
            while k >= 0 and low[k] >= begin:
                k = lower[k]
            if k < 0 or high[k] >= total:
                low.append(begin), high.append(total), first.append(a), last.append(place), lower.append(k)
                break
            begin, a = low[k], first[k]
            del low[k:], high[k:], first[k:], last[k:], lower[k:]
    return [(f, z, h - b) for f, z, h, b in zip(first, last, high, low)]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of all texts, and the bounds by text."""
    data, bounds = textbytes.joined(texts)
    hashes, starts, _ = textbytes.words(data, textbytes.separators(""))
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(starts, bounds)


def log_odds(toxic: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each bucket and its standard error, under a Dirichlet prior with the pooled shares."""
    pooled = toxic + other
    prior = PRIOR_TOKENS * pooled / max(pooled.sum(), 1) + 1e-3
    n1, n0 = toxic.sum() + prior.sum(), other.sum() + prior.sum()
    a, b = toxic + prior, other + prior
    return np.log(a / (n1 - a)) - np.log(b / (n0 - b)), np.sqrt(1 / a + 1 / b)


def _decay(shares: np.ndarray, scores: np.ndarray) -> float:
    """The lambda > 0 with E[exp(lambda s)] = 1 for the background of tokens; the mean score is negative."""
    rest = 1 - shares.sum()

    def excess(x: float) -> float:
        return float((shares * np.exp(np.minimum(x * scores, 700))).sum() + rest * np.exp(-x * DRIFT) - 1)

    lo, hi = 1e-4, 50.0
    if excess(lo) >= 0:
        return lo
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def passages(model: Model, found: np.ndarray) -> tuple[list[tuple[int, int, float]], float, float]:
    """Significant passages of a text's token buckets, and its largest and total log-evidence."""
    if not len(found) or not len(model.buckets):
        return [], 0.0, 0.0
    at = np.searchsorted(model.buckets, found)
    hit = np.flatnonzero(model.buckets[np.minimum(at, len(model.buckets) - 1)] == found)
    if not len(hit):
        return [], 0.0, 0.0
    chance = np.log(model.scale * len(found))
    own = [(f, z, s, model.decay * s - chance) for f, z, s in segments(hit.tolist(), model.scores[at[hit]].tolist())]
    sure = [(f, z, s) for f, z, s, e in own if e >= -np.log(CHANCE)]
    evidence = [max(0.0, e) for *_, e in own]
    return sure, max(evidence), sum(evidence)


def _features(largest: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(largest), np.log1p(largest), np.log1p(total)], axis=1)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and label the capped token counts of the learning part, as (toxic, bucket, n)."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        labels, texts = batch.column("toxic").to_pylist(), batch.column("text").to_pylist()
        for a, b in textbytes.slices(texts):
            found, bounds = tokens(texts[a:b])
            for i in range(b - a):
                own, n = np.unique(found[bounds[i]: bounds[i + 1]], return_counts=True)
                into = counts.setdefault(labels[a + i], np.zeros(BUCKETS, np.int64))
                into[own] += np.minimum(n, MOST_PER_TEXT)
    for label, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.record_batch({
            "toxic": pa.array(np.full(len(at), label, np.int32)), "bucket": pa.array(at), "n": pa.array(n[at])})


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model | None:
    """Learns from at most `sample` rows of `labels` (row_id, toxic), which the caller has restricted."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col(row_id).isNotNull())
    chosen = smallest_hashes(rows, row_id, sample).groupBy(F.col(row_id).alias("_id")).agg(
        F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "_id")  # at most `sample` rows
    curve_part = F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(4)) == 0
    counts = texts.filter(~curve_part).select("toxic", "text").mapInArrow(
        _token_rows, "toxic int, bucket long, n long").groupBy("bucket").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("toxic"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("other")).toPandas()
    if not len(counts) or not counts.toxic.sum() or not counts.other.sum():
        return None
    counts = counts.fillna(0).sort_values("bucket")
    toxic, other = counts.toxic.to_numpy(float), counts.other.to_numpy(float)
    odds, error = log_odds(toxic, other)
    up = (odds > SURE * error) & (odds > 0)
    buckets, scores, shares = counts.bucket.to_numpy(np.int64)[up], odds[up], other[up] / other.sum()
    decay = _decay(shares, scores)
    model = Model(buckets, scores, decay, 1.0)
    seen = texts.filter(curve_part).select("toxic", F.lit(None).cast("long").alias("_id"), "text")
    marks = scored(seen, model, "text").select("toxic", "largest", "total").toPandas().sort_values(
        ["toxic", "largest", "total"])
    if not len(marks) or marks.toxic.nunique() < 2:
        return Model(buckets, scores, decay, 1.0, (-2.0, 1.0, 1.0))
    x = _features(marks.largest.to_numpy(), marks.total.to_numpy())
    return Model(buckets, scores, decay, 1.0, _curve(x, marks.toxic.to_numpy(float)))


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` without its text, with score, passages (tokens first to last), largest and total evidence."""
    own = {text, "score", "passages", "largest", "total"}
    others = [f for f in docs.schema.fields if f.name not in own]
    names = [f.name for f in others]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in textbytes.slices(texts):
                found, bounds = tokens(texts[a:b])
                empty = Model(np.zeros(0, np.int64), np.zeros(0), 1.0, 1.0)
                each = [passages(m or empty, found[bounds[i]: bounds[i + 1]]) for i in range(b - a)]
                largest, total = np.array([x[1] for x in each]), np.array([x[2] for x in each])
                score = np.zeros(b - a)
                if m is not None:
                    score = 1 / (1 + np.exp(-np.clip(_features(largest, total) @ np.array(m.curve), -30, 30)))
                yield pa.record_batch({
                    **{c: batch.column(c).slice(a, b - a) for c in names}, "score": pa.array(score),
                    "passages": pa.array(
                        [[{"first": f, "last": z, "score": s} for f, z, s in x[0]] for x in each],
                        pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))),
                    "largest": pa.array(largest), "total": pa.array(total),
                })

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others],
                        f"score double, passages {PASSAGES}, largest double, total double"])
    return docs.select(*names, text).mapInArrow(run, schema)
