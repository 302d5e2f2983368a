"""Operator 8: quality rules with adaptive thresholds per language and source.

Every document gets integer measures. Per (language, source) a mergeable quantile sketch holds each
measure's distribution: counts of integer buckets that keep six leading bits, so that a value is off by at
most 1/32 and two sketches merge by adding counts. Sources merge into their language and languages into the
whole, and a group with fewer than `min_docs` documents takes the thresholds of the next level up. A
threshold is a far-out fence: quartile plus `reach` times the quartile distance, which is taken as no
smaller than a slack per measure. Documents are then joined with the thresholds of their group.

Defined results: a null or empty text has no words and fails the base rule; null language or source is a
group of its own; repeated rows count each and are all returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import BLANKS, staged, words_of

SYMBOLS = "#*$%&|<>"
SALTS = 16  # a hot source's documents meet that many copies of its thresholds


@dataclass(frozen=True)
class Measure:
    """An integer measure, its least quartile distance, and whether low values are odd as well."""

    name: str
    slack: int
    two_sided: bool = False


MEASURES = (
    Measure("symbols_permille", 40),
    Measure("dup_lines_permille", 100),
    Measure("repeat_permille", 60),
    Measure("word_length_percent", 100, two_sided=True),
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    min_docs: int = 50
    reach: int = 3


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def counted(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size("_words")
    step1 = docs.withColumns({
        "_words": words_of(F.col(text)),
        "_lines": F.filter(F.split(body, "\n", -1), lambda x: F.translate(x, BLANKS, "") != ""),
        "word_chars": _without(body, BLANKS).cast("long"),
        "n_symbols": (F.length(body) - _without(body, SYMBOLS)).cast("long"),
    })
    step2 = step1.withColumns({
        "_hashes": F.when(n >= window, F.transform(
            F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice("_words", i, window)))),
        "n_words": n.cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")
    # only texts with a repeated hash pay for writing their windows out and sorting them
    step3 = step2.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.array_sort(F.transform(F.sequence(F.lit(1), F.size("_words") - window + 1), lambda i: F.struct(
            F.concat_ws(" ", F.slice("_words", i, window)).alias("w"), i.alias("i")))),
    )).drop("_hashes", "_words")
    step4 = step3.withColumn("_starts", F.array_sort(F.transform(
        F.filter("_sorted", lambda x, j: (
            F.coalesce(x["w"] == F.get("_sorted", j - 1)["w"], F.lit(False))
            | F.coalesce(x["w"] == F.get("_sorted", j + 1)["w"], F.lit(False)))),
        lambda x: x["i"],
    ))).drop("_sorted")
    covered = F.aggregate(
        F.zip_with("_starts", F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))),
                   lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window)))),
        F.lit(0), lambda total, x: total + x,
    )
    return step4.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds `base_failed` and the measures to counted documents."""

    def share(scale: int, part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"({scale} * {part}) div {whole}")).otherwise(F.lit(0)).cast("long")

    return docs.withColumns({
        "base_failed": (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        "symbols_permille": share(1000, "n_symbols", "word_chars"),
        "dup_lines_permille": share(1000, "n_dup_lines", "n_lines"),
        "repeat_permille": share(1000, "n_repeat_words", "n_words"),
        "word_length_percent": share(100, "word_chars", "n_words"),
    })


def sketch(features: DataFrame, by: tuple[str, str]) -> DataFrame:
    """by, measure, bucket, n: the quantile sketches of documents that pass the base rule."""
    pairs = F.array(*[
        F.struct(F.lit(m.name).alias("measure"), F.col(m.name).alias("value")) for m in MEASURES
    ])
    rows = features.filter(~F.col("base_failed")).select(*by, F.explode(pairs).alias("p")).select(
        *by, "p.measure", "p.value")
    shift = F.greatest(F.length(F.bin("value")) - 6, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return rows.withColumn("bucket", F.col("value") - F.col("value") % step).groupBy(*by, "measure", "bucket").agg(
        F.count(F.lit(1)).alias("n"))


def _fences(counts: DataFrame, by: list[str], level: str, reach: int) -> DataFrame:
    """One row per group of the level with its number of documents and the fences of each measure."""
    keys = [*by, "measure"]
    # a group has at most some 1,200 buckets, whatever its number of documents
    listed = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("docs"))

    def quantile(percent: int) -> Column:
        return F.aggregate(
            "b", F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("at")),
            lambda s, x: F.struct(
                (s["below"] + x["n"]).alias("below"),
                F.coalesce(s["at"], F.when(100 * (s["below"] + x["n"]) >= percent * F.col("docs"), x["bucket"]))
                .alias("at")),
            lambda s: s["at"],
        )

    quartiles = listed.select(*keys, "docs", quantile(25).alias("q1"), quantile(75).alias("q3"))
    slack = F.coalesce(*[F.when(F.col("measure") == m.name, F.lit(m.slack)) for m in MEASURES])
    gap = F.greatest(F.col("q3") - F.col("q1"), slack)
    ends = quartiles.select(*keys, "docs", (F.col("q3") + reach * gap).alias("hi"), (F.col("q1") - reach * gap).alias("lo"))
    return ends.groupBy(*by).agg(
        F.max("docs").alias(f"{level}_docs"),
        F.struct(*[
            F.max(F.when(F.col("measure") == m.name, F.col(end))).alias(f"{m.name}_{end}")
            for m in MEASURES for end in (("hi", "lo") if m.two_sided else ("hi",))
        ]).alias(level),
    )


def thresholds(counts: DataFrame, by: tuple[str, str], rules: Rules = Rules()) -> DataFrame:
    """lang, source, docs, level and the fences in force, for each group with a sketch."""
    lang, source = by
    own = _fences(counts, [lang, source], "own", rules.reach)
    of_lang = _fences(counts, [lang], "of_lang", rules.reach).withColumnRenamed(lang, "_lang")
    whole = _fences(counts, [], "whole", rules.reach)
    joined = own.join(of_lang, own[lang].eqNullSafe(of_lang["_lang"])).join(F.broadcast(whole), F.lit(True))
    level = (
        F.when(F.col("own_docs") >= rules.min_docs, F.lit("source"))
        .when(F.col("of_lang_docs") >= rules.min_docs, F.lit("lang")).otherwise(F.lit("all")))
    chosen = F.when(level == "source", F.col("own")).when(level == "lang", F.col("of_lang")).otherwise(F.col("whole"))
    return joined.select(lang, source, F.col("own_docs").alias("docs"), level.alias("level"), chosen.alias("fence"))


def judged(features: DataFrame, limits: DataFrame, by: tuple[str, str], row_id: str = "doc_id") -> DataFrame:
    """Adds `kept` and `level`: joins each document with the fences of its group.

    A group without any document that passes the base rule has no fences; its documents have failed anyway.
    """
    salt = F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int")
    right = limits.select(*[F.col(c).alias(f"_{c}") for c in by], "level", "fence", F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    left = features.withColumn("_own_salt", salt)
    same = (left["_own_salt"] == right["_salt"])
    for c in by:
        same = same & left[c].eqNullSafe(right[f"_{c}"])
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m.name) <= F.col(f"fence.{m.name}_hi"))
        if m.two_sided:
            inside = inside & (F.col(m.name) >= F.col(f"fence.{m.name}_lo"))
    # one indivisible condition: parts of a conjunction would be pushed below the measuring and repeat it
    return left.join(right, same, "left").withColumn(
        "kept", F.least(~F.col("base_failed"), F.coalesce(inside, F.lit(False)))
    ).drop("_own_salt", "_salt", "fence", *[f"_{c}" for c in by])


def quality_rules(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source"),
    rules: Rules = Rules(),
) -> DataFrame:
    """The counts, `base_failed`, `kept` and the threshold level of each document."""
    narrow = docs.select(row_id, text, *by)
    features = staged(measured(counted(narrow, text, rules.window), rules).drop(text), "rule-features")
    limits = thresholds(sketch(features, by), by, rules)
    return judged(features, limits, by, row_id)


def kept_documents(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, unchanged. Texts are read twice and never shuffled to be measured."""
    by = ("lang", "source")
    own = docs.columns
    features = staged(measured(counted(docs.select(text, *by), text, rules.window), rules).drop(text), "rule-features")
    limits = staged(thresholds(sketch(features, by), by, rules), "fences")
    wrapped = docs.select(F.struct(*own).alias("_row"), "doc_id", text, *by)
    verdict = judged(measured(counted(wrapped, text, rules.window), rules), limits, by)
    return verdict.filter("kept").select("_row.*")
