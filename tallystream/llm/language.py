"""Operator 1: language ID by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 3- and 4-grams inside of words (one white space allowed at each
end), hashed into `BUCKETS` rows. Embeddings and softmax are trained together by stochastic gradient descent
on at most `sample` labelled documents, those with the smallest hash of their id; only n-gram counts reach the
driver. A fifth of the sample is held back to fit a temperature and the confidence below which a
prediction is marked as rejected. Scoring needs only the product of embeddings and softmax, one row per
bucket, so it streams over whole texts of any length.

Defined results: null texts and texts without a letter are `und` with score 0; without any usable labelled row
all are `und`; null languages and rows without an id are not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm import textbytes

BUCKETS = 1 << 15
DIMENSIONS = 16
SAMPLE = 4000
EPOCHS = 6
RATE = 1.0
ACCEPTED_ERROR = 0.01
UNKNOWN = "und"


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[textbytes.separators("")] = 32
    return table


_FOLD = _folded()


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of all texts, and which text it belongs to."""
    data, bounds = textbytes.joined(texts, end="\n")
    b = _FOLD[data].astype(np.uint32)
    space = b == 32
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found, owners = [], []
    for n in (3, 4):
        size = max(0, len(b) - n + 1)
        value, ok = np.zeros(size, np.uint32), np.ones(size, bool)
        for j in range(n):
            value |= b[j: j + size] << np.uint32(8 * j)
            if 0 < j < n - 1:
                ok &= ~space[j: j + size]
        ok &= owner[:size] == owner[n - 1: n - 1 + size]
        at = np.flatnonzero(ok)
        found.append((value[at] * np.uint32(2654435761) + np.uint32(n)) * np.uint32(2246822519) >> np.uint32(17))
        owners.append(owner[at])
    return np.concatenate(found).astype(np.int64) & (BUCKETS - 1), np.concatenate(owners)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # one row per bucket, one column per language
    bias: np.ndarray
    temperature: float
    least: float  # confidence below which a prediction is rejected


def _logits(weights: np.ndarray, bias: np.ndarray, buckets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.stack([
        np.bincount(owner, weights[buckets, c], n) / count + bias[c] for c in range(weights.shape[1])], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 11) -> Model | None:
    """Fits the model to (language, buckets, counts) rows."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    fold = max(1, len(rows) // 5) if len(rows) >= 20 else 0
    held, used = order[:fold], order[fold:]
    y = np.array([languages.index(r[0]) for r in rows])
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    share = [(r[2] / max(1, r[2].sum())).astype(np.float32) for r in rows]
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            rate = RATE * (1 - done / steps)
            done += 1
            buckets, part = rows[i][1], share[i]
            x = part @ table[buckets]
            g = _softmax(x @ soft + bias)
            g[y[i]] -= 1
            down = soft @ g
            soft -= rate * np.outer(x, g)
            bias -= np.float32(0.1 * rate) * g
            table[buckets] -= (rate * len(part) ** 0.5) * part[:, None] * down[None, :]
    weights = (table @ soft).astype(np.float64)
    temperature, least = 1.0, 0.0
    if fold:
        z = np.array([share[i] @ weights[rows[i][1]] + bias for i in held])
        right = y[held]
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 60))
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(fold), right], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        sure, wrong = p.max(axis=1), p.argmax(axis=1) != right
        best = np.argsort(-sure)
        error = np.cumsum(wrong[best]) / np.arange(1, fold + 1)
        fine = np.flatnonzero(error <= ACCEPTED_ERROR)
        least = float(sure[best][fine[-1]]) if len(fine) else 1.0
    return Model(languages, weights, bias.astype(np.float64), temperature, least)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for a, b in textbytes.slices(texts):
            buckets, owner = ngrams(texts[a:b])
            cells, counts = np.unique(owner * BUCKETS + buckets, return_counts=True)
            cuts = np.searchsorted(cells // BUCKETS, np.arange(1, b - a))
            yield pa.record_batch({
                "lang": pa.array(langs[a:b], pa.string()),
                "buckets": pa.array([x.astype(np.int32).tobytes() for x in np.split(cells % BUCKETS, cuts)], pa.binary()),
                "counts": pa.array([x.astype(np.int32).tobytes() for x in np.split(counts, cuts)], pa.binary()),
            })


def smallest_hashes(rows: DataFrame, row_id: str, most: int) -> DataFrame:
    """At most about `most` rows, those whose id has the smallest hash; the bound is found from hashes alone."""
    h = F.xxhash64(row_id, F.lit(5))
    cut = rows.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return rows.filter(h <= F.lit(cut if cut is not None else 0))


def fit(docs: DataFrame, may_learn: Column, row_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE) -> Model | None:
    """Learns from at most `sample` rows of `docs` that `may_learn` admits."""
    rows = docs.filter(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(row_id).isNotNull())
    chosen = smallest_hashes(rows, row_id, sample).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = chosen.mapInArrow(_counts, "lang string, buckets binary, counts binary").collect()
    rows = [(r.lang, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in found]
    # the sample may arrive in any order; the model does not depend on it
    return train(sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes())))


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` without its text, with lang_pred, score and rejected."""
    others = [f for f in docs.schema.fields if f.name not in {text, "lang_pred", "score", "rejected"}]
    names = [f.name for f in others]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in textbytes.slices(texts):
                part = texts[a:b]
                known = np.array([m is not None and has_letter(t) for t in part], bool)
                best, score = np.zeros(b - a, np.int64), np.zeros(b - a)
                if known.any():
                    buckets, owner = ngrams(part)
                    p = _softmax(_logits(m.weights, m.bias, buckets, owner, b - a) / m.temperature)
                    best, score = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
                least = m.least if m is not None else 1.0
                yield pa.record_batch({
                    **{c: batch.column(c).slice(a, b - a) for c in names},
                    "lang_pred": pa.array([m.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)], pa.string()),
                    "score": pa.array(score), "rejected": pa.array(~known | (score < least)),
                })

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others],
                        "lang_pred string, score double, rejected boolean"])
    return docs.select(*names, text).mapInArrow(run, schema)
