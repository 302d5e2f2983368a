"""Precision templates and query profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    cms_width: int
    cms_depth: int
    hll_p: int
    mg_k: int
    capability: float


@dataclass(frozen=True)
class QueryProfile:
    query_type: str
    accuracy: float
    latency_sla_ms: float


# The three precision templates, in ascending precision.
TEMPLATES = (
    Template("low", 512, 3, 10, 50, 0.30),
    Template("medium", 2048, 5, 12, 200, 0.65),
    Template("high", 8192, 7, 14, 500, 1.00),
)
DEFAULT_TEMPLATE = "medium"

# Accuracy demand and latency target per query type.
QUERY_PROFILES = (
    QueryProfile("frequency", 0.95, 50.0),
    QueryProfile("cardinality", 0.90, 100.0),
    QueryProfile("heavy_hitters", 0.85, 200.0),
)
DEFAULT_QUERY_TYPE = "frequency"

TEMPLATE_NAMES = tuple(t.name for t in TEMPLATES)


def template(name: str) -> Template:
    """The named template; an unknown name has medium's parameters."""
    by_name = {t.name: t for t in TEMPLATES}
    return by_name.get(name, by_name[DEFAULT_TEMPLATE])


def profile(query_type: str) -> QueryProfile:
    """The named profile; an unknown query type has frequency's."""
    by_type = {q.query_type: q for q in QUERY_PROFILES}
    return by_type.get(query_type, by_type[DEFAULT_QUERY_TYPE])


def template_value(name: Column, field: str) -> Column:
    """`field` of the template named by a column, as a lookup in the row (no join)."""
    fallback = F.lit(getattr(template(DEFAULT_TEMPLATE), field))
    chosen = F
    for t in TEMPLATES:
        chosen = chosen.when(name == t.name, F.lit(getattr(t, field)))
    return chosen.otherwise(fallback)


def profile_value(query_type: Column, field: str) -> Column:
    fallback = F.lit(getattr(profile(DEFAULT_QUERY_TYPE), field))
    chosen = F
    for q in QUERY_PROFILES:
        chosen = chosen.when(query_type == q.query_type, F.lit(getattr(q, field)))
    return chosen.otherwise(fallback)


def template_rows() -> Column:
    """All templates as an array of structs, to explode a row into one row per template."""
    return F.array(*[
        F.struct(
            F.lit(t.name).alias("template"),
            F.lit(t.cms_width).alias("cms_width"),
            F.lit(t.cms_depth).alias("cms_depth"),
            F.lit(t.hll_p).alias("hll_p"),
            F.lit(t.mg_k).alias("mg_k"),
        )
        for t in TEMPLATES
    ])
