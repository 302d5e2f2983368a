"""Operator 2: personal data in texts: patterns propose spans, checksums confirm them, context decides the rest.

Base kinds are proposed by a pattern, leftmost and without overlap within a kind, and confirmed without retry: `email`;
`ip` (four parts up to 255); `card` (13 to 19 digits passing Luhn); `phone` (a plus sign, 9 to 15 digits). The
method adds further kinds: `iban` (letters and digits whose number is 1 modulo 97), `ssn` and `tel` (three digit
groups), `secret` (a run of letters and digits that is assigned to something; the context word says to what, and length and
entropy confirm it). A candidate of these has a score: what its form and checksum are worth, more if a context word stands
within `REACH` characters before it, less if a contrary word does; it counts from `ENOUGH` on. Base spans never need
context; context raises their score only.

All of it is expressions inside one projection: no shuffle and no Python. Positions come from the lengths of what
lies between matches. Patterns are possessive and may start only where a run of their characters starts or
behind the previous match, which gives the same matches as the plain patterns in linear time.

Defined results: a null or empty text has no spans; positions are code points, end exclusive; repeated rows are
searched each; other columns are returned as they are, except the result columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 40
ENOUGH = 50
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Context words that speak for or against a kind, matched without regard to case.
SECRET = "A-Za-z0-9+/_-"
RANDOM_BITS = 2.9  # of entropy a character
FOR_CARD = "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"
FOR_PHONE = "phone|tel|call|mobile|fax|cell|telefon|teléfono|téléphone"


@dataclass(frozen=True)
class Extra:
    """A kind that the method adds: its pattern, the worth of its form, and context words."""

    kind: str
    pattern: str
    base: int
    words: str
    against: str
    needs: str  # a cheap sign without which a text cannot hold one
    apart: str  # what must not stand directly before or after


EXTRAS = (
    Extra("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", 60,
          "iban|account|konto|compte|cuenta|bank", "order|serial|isbn", "[A-Z]{2}[0-9]{2}", "[A-Za-z0-9]"),
    Extra("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 30,
          "ssn|social|security|tax", "order|serial|isbn|part", "[0-9]-[0-9]{2}-[0-9]", "[0-9-]"),
    Extra("tel", r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}", 30,
          FOR_PHONE, "order|serial|isbn|part", r"[0-9]{3}[-.\x20][0-9]{4}", "[0-9+().-]"),
    # the assignment is part of the pattern, the value its last run
    Extra("secret", rf"[=:]\x20?[\"']?[{SECRET}]{{16,256}}", 20,
          "token|secret|passw|api.?key|access.?key|private.?key|auth|credential|bearer|contraseña|mot de passe|schlüssel",
          "checksum|digest|commit|isbn|serial", rf"[=:]\x20?[\"']?[{SECRET}]{{16}}", rf"[{SECRET}]"),
)
KINDS = (*PATTERNS, *[e.kind for e in EXTRAS])


def _matches(text: Column, pattern: str) -> Column:
    """start, end and text of all matches, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(
            F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text")))).alias("out"))

    # as many gaps as matches: the last gap closes the text
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(1))), found,
                       lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda s: s["out"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(text: Column) -> Column:
    """Luhn's checksum over the digits of a text."""
    each = F.split(F.reverse(_digits(text)), "")

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(each, worth), F.lit(0), lambda total, x: total + x) % 10 == 0


def passes_mod97(text: Column) -> Column:
    """The checksum of account numbers: the first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.translate(text, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(
        F.ascii(c) >= 65, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97))
    return rest == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match["text"].rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(match["text"]))
        return F.when((n >= 13) & (n <= 19), passes_luhn(match["text"])).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match["text"])).between(9, 15)
    return F.lit(True)


def _context(text: Column, match: Column, words: str) -> Column:
    before = F.substring(text, F.greatest(match["start"] - REACH, F.lit(0)) + 1, F.least(match["start"], F.lit(REACH)))
    return before.rlike(rf"(?i)(?:{words})")


def _score(extra: Extra, text: Column, match: Column) -> Column:
    checked = F.when(passes_mod97(match["text"]), 40).otherwise(-60) if extra.kind == "iban" else F.lit(0)
    beside = F.concat(
        F.substring(text, match["start"], F.lit(1)), F.lit(" "), F.substring(text, match["end"] + 1, F.lit(1)))
    alone = F.when((match["start"] > 0) & beside.rlike(f"^{extra.apart}") | beside.rlike(f"{extra.apart}$"), -100).otherwise(0)
    if extra.kind == "secret":  # begins with its assignment, so only its end can be cut off
        checked = F.when(_looks_random(match["text"]), 0).otherwise(-100)
        alone = F.when(beside.rlike(f"{extra.apart}$"), -100).otherwise(0)
    return (F.lit(extra.base) + checked + alone + F.when(_context(text, match, extra.words), 30).otherwise(0)
            - F.when(_context(text, match, extra.against), 30).otherwise(0))


def _looks_random(text: Column) -> Column:
    """Letters and digits of at least `RANDOM_BITS` each, by the entropy of the characters of the assigned value."""
    value = F.regexp_extract(text, f"[{SECRET}]+$", 0)
    each = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(each)
    # n log2(n) less the sum of c log2(c) over distinct characters is n times the entropy
    alike = F.aggregate(F.array_distinct(each), F.lit(0.0), lambda total, c: total + _c_log_c(F.size(F.filter(each, lambda x: x == c))))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.log2(n.cast("double")) * n - alike >= RANDOM_BITS * n)


def _c_log_c(n: Column) -> Column:
    return n * F.log2(n.cast("double"))


def _base_score(kind: str, text: Column, match: Column) -> Column:
    words = {"card": FOR_CARD, "phone": FOR_PHONE}.get(kind)
    return F.lit(80) + (F.when(_context(text, match, words), 20).otherwise(0) if words else F.lit(0))


def private_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `private`, an array of kind, start, end and score by kind and start, and the count of each base kind.

    Texts without a sign of a kind (an at sign, a plus sign, digits) skip its pattern.
    """
    results = ["private", *[f"n_{k}" for k in PATTERNS]]
    others = [c for c in docs.columns if c not in results]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(text).alias("_text"))
    body = F.col("_text")
    signs = {"email": F.contains(body, F.lit("@")), "ip": body.rlike(r"[0-9]\.[0-9]"),
             "card": body.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), "phone": body.rlike(r"\+[0-9]")}
    step = docs.withColumns({f"_{k}": F.when(signs[k], _matches(body, p)) for k, p in PATTERNS.items()} | {
        f"_{e.kind}": F.when(body.rlike(e.needs), _matches(body, e.pattern)) for e in EXTRAS})

    def spans(kind: str, keep, score) -> Column:
        kept = F.filter(f"_{kind}", keep)
        if kind == "secret":  # the assignment and its quote are not part of the secret
            size = lambda m: F.length(F.regexp_extract(m["text"], f"[{SECRET}]+$", 0))
            return F.coalesce(F.transform(kept, lambda m: F.struct(
                F.lit(kind).alias("kind"), (m["end"] - size(m)).alias("start"), m["end"].alias("end"), score(m).cast("int").alias("score"))),
                F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:int>>)"))
        return F.coalesce(F.transform(kept, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score(m).cast("int").alias("score"))),
            F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:int>>)"))

    def of_base(kind: str) -> Column:
        return spans(kind, lambda m: _confirmed(kind, m), lambda m: _base_score(kind, body, m))

    def of_extra(extra: Extra) -> Column:
        return spans(extra.kind, lambda m: _score(extra, body, m) >= ENOUGH, lambda m: _score(extra, body, m))

    found = step.withColumns(
        {f"_s_{k}": of_base(k) for k in PATTERNS} | {f"_s_{e.kind}": of_extra(e) for e in EXTRAS})
    return found.withColumns({
        "private": F.concat(*[F.col(f"_s_{k}") for k in KINDS]),
        **{f"n_{k}": F.size(f"_s_{k}").cast("long") for k in PATTERNS},
    }).select("_row.*", *results)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of `private` replaced by its kind in angle brackets; the widest span wins an overlap."""
    ordered = F.array_sort(F.transform("private", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.when(fresh, s["end"]).otherwise(F.greatest(state["at"], s["end"])).alias("at"),
            F.when(fresh, F.concat(state["out"], between, F.lit("<"), s["kind"], F.lit(">")))
            .otherwise(state["out"]).alias("out"))

    done = F.aggregate(ordered, start, step, lambda s: F.concat(
        s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text) + 1)))
    return docs.withColumn(text, F.when(F.size("private") > 0, done).otherwise(F.col(text)))
