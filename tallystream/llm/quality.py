"""Operator 6: quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on counts of a text gives each document's own evidence; it is fitted on at most `sample` labelled
documents. Sites then speak through grouped aggregation: a host's rate of good documents has a Beta prior
with the global mean, a path's rate one with its host's posterior mean. Prior strengths are estimated by moments from the
spread between hosts, and between paths of a host, beyond what their sizes explain; a sparse host or path therefore
stays near its prior. A document's score adds the log-odds of its path, relative to the global rate, to its own. Its path and
host are judged by their other documents, so that no document counts twice: the only one of its path has its host's rate.

Defined results: a null or empty text has the evidence of zero counts; null hosts and paths are groups of their
own; without labels of both kinds every document's evidence is the share of good ones (1 without labels); repeated rows
count each; other columns are returned as they are, except the result columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm.language import smallest_hashes
from tallystream.llm.shared import staged, words_of

SAMPLE = 6000
SALTS = 16
KEEP = 0.5
EDGE = 1e-4  # rates and probabilities stay this far from 0 and 1
FEATURES = ("f_words", "f_symbols", "f_upper", "f_digits", "f_distinct", "f_length", "f_dup_lines", "f_short")


@dataclass(frozen=True)
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[float]  # the first is the intercept


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the classifier's features, all finite, to `docs`."""
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumns({
        "_words": words_of(F.col(text)), "_lines": F.split(body, "\n", -1), "_chars": F.greatest(F.length(body), F.lit(1))})
    n = F.greatest(F.size("_words"), F.lit(1))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(body, pattern, "")) / F.col("_chars")

    return first.withColumns({
        "f_words": F.log1p(F.size("_words").cast("double")),
        "f_symbols": share(r"[^#*$%&|<>{}=_~^@!]"),
        "f_upper": share(r"[^A-Z]"),
        "f_digits": share(r"[^0-9]"),
        "f_distinct": F.size(F.array_distinct("_words")) / n,
        "f_length": F.least(F.col("_chars") / n, F.lit(40.0)),
        "f_dup_lines": 1.0 - F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "f_short": (F.size("_words") < 10).cast("double"),
    }).drop("_words", "_lines", "_chars")


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Ridge logistic regression on at most `sample` rows of `labels` (row_id, quality)."""
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col(row_id).isNotNull())
    chosen = smallest_hashes(rows, row_id, sample).groupBy(F.col(row_id).alias("_id")).agg(
        F.max("quality").cast("double").alias("quality"))
    found = with_features(docs.select(F.col(row_id).alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "_id")).select(*FEATURES, "quality").toPandas().sort_values([*FEATURES, "quality"])
    y = found.quality.to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 1.0, EDGE, 1 - EDGE))
        return Model([0.0] * len(FEATURES), [1.0] * len(FEATURES), [float(np.log(share / (1 - share))), *[0.0] * len(FEATURES)])
    x = found[list(FEATURES)].to_numpy(float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.0, *[1.0] * len(FEATURES)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge + 1e-6 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Model(mean.tolist(), scale.tolist(), w.tolist())


def evidence(model: Model) -> Column:
    """The classifier's probability from the feature columns."""
    total = F.lit(model.weights[0])
    for name, m, s, w in zip(FEATURES, model.mean, model.scale, model.weights[1:]):
        # a feature far outside of what was seen says no more than the edge of it
        total = total + F.lit(w) * F.least(F.greatest((F.col(name) - m) / s, F.lit(-6.0)), F.lit(6.0))
    p = 1.0 / (1.0 + F.exp(-total))
    return F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1.0 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior size of Beta rates by moments: groups (n, good) around `mean`; large if they differ no more than by chance."""
    rate = F.col("good") / F.col("n")
    row = groups.filter("n > 1").agg(
        F.count(F.lit(1)).alias("k"), F.avg((rate - mean) * (rate - mean)).alias("spread"),
        F.avg(mean * (1 - mean)).alias("whole"), F.avg(mean * (1 - mean) / F.col("n")).alias("chance")).first()
    between = max((row.spread or 0.0) - (row.chance or 0.0), 0.0) if row.k else 0.0
    if not row.k or between <= 1e-9:
        return 1000.0
    return float(min(max(row.whole / between - 1.0, 1.0), 1000.0))


def site_rates(scored: DataFrame) -> DataFrame:
    """host, path, n, host_rate, path_rate, global_rate: the posterior means of every path; and good, host_n, host_good, and the
    prior sizes host_prior and path_prior, from which the rates without a document follow."""
    paths = staged(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("good")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = float(whole.good / whole.n) if whole.n else 1.0
    k1 = _strength(hosts, F.lit(rate))
    host_rates = hosts.select(
        F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"),
        ((F.col("good") + k1 * rate) / (F.col("n") + k1)).alias("host_rate"))
    both = paths.join(host_rates, paths["host"].eqNullSafe(host_rates["_host"])).drop("_host")
    k2 = _strength(both, F.col("host_rate"))
    return both.select(
        "host", "path", "n", "host_rate", ((F.col("good") + k2 * F.col("host_rate")) / (F.col("n") + k2)).alias("path_rate"),
        F.lit(rate).alias("global_rate"), "good", "host_n", "host_good", F.lit(k1).alias("host_prior"), F.lit(k2).alias("path_prior"))


def rates_of_others(own: Column) -> tuple[Column, Column]:
    """The rates of host and path without a document whose evidence is `own`, from the columns of `site_rates`."""
    host = (F.col("host_good") - own + F.col("host_prior") * F.col("global_rate")) / (F.col("host_n") - 1 + F.col("host_prior"))
    path = (F.col("good") - own + F.col("path_prior") * host) / (F.col("n") - 1 + F.col("path_prior"))
    return host, path


def quality(
    docs: DataFrame, model: Model, host: Column, path: Column, row_id: str = "doc_id", text: str = "text", keep: float = KEEP,
) -> DataFrame:
    """id, host, path, evidence, host_rate, path_rate, score and kept of every document."""
    own = with_features(docs.select(
        F.col(row_id).alias("id"), F.col(text).alias("text"), host.alias("host"), path.alias("path")))
    scored = staged(own.select("id", "host", "path", evidence(model).alias("evidence")), "evidence")
    rates = site_rates(scored).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "good", "host_n", "host_good", "host_prior", "path_prior",
        "global_rate",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    left = scored.withColumn("_own", F.pmod(F.xxhash64("id", "evidence"), F.lit(SALTS)).cast("int"))
    joined = left.join(rates, left["host"].eqNullSafe(rates["_host"]) & left["path"].eqNullSafe(rates["_path"])
                       & (left["_own"] == rates["_salt"]))
    host_rate, path_rate = rates_of_others(F.col("evidence"))
    joined = joined.withColumns({"host_rate": host_rate, "path_rate": path_rate})
    total = _log_odds(F.col("evidence")) + _log_odds(F.col("path_rate")) - _log_odds(F.col("global_rate"))
    score = 1.0 / (1.0 + F.exp(-total))
    return joined.select(
        F.col("id").alias(row_id), "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"),
        (score >= keep).alias("kept"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of an address; null for what it lacks."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    first = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*/([^/?#]+)", 1)
    return F.when(host != "", host), F.when(first != "", first)
