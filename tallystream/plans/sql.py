"""SQL building pieces for the queries' counterparts, runnable by DuckDB over the same tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from tallystream.operators.ranking import Weights
from tallystream.templates import TEMPLATES

E = f"{math.e!r}::double"


def rhu(x: str, digits: int) -> str:
    """Half-up rounding by the same IEEE steps as `round_half_up`."""
    scale = f"{float(10 ** digits)!r}::double"
    return f"(floor(({x}) * {scale} + 0.5::double) / {scale})"


def _list(columns: Sequence[str]) -> str:
    return "".join(f"{c}, " for c in columns)


def counts(source: str, by: Sequence[str] = (), amount: str = "count(*)") -> str:
    """Key counts of a relation with a `key` column."""
    return (
        f"select {_list(by)}key, ({amount})::bigint as n from {source} "
        f"group by {_list(by)}key"
    )


def cells(source: str, width: int, depth: int, by: Sequence[str] = ()) -> str:
    """Count-Min cells of a relation (by..., key, n)."""
    return (
        f"select {_list(by)}r::int as row_id, "
        f"(md5_number_upper(key || ':' || r) % {width})::int as col_id, sum(n)::bigint as cnt "
        f"from {source}, range({depth}) t(r) group by all"
    )


def estimates(keys: str, cell_table: str, width: int, depth: int) -> str:
    """(key, estimate) for a relation of keys."""
    return (
        f"select k.key, min(coalesce(c.cnt, 0))::bigint as estimate "
        f"from (select key, r::int as row_id, "
        f"(md5_number_upper(key || ':' || r) % {width})::int as col_id "
        f"from {keys}, range({depth}) t(r)) k "
        f"left join {cell_table} c on c.row_id = k.row_id and c.col_id = k.col_id group by k.key"
    )


def registers(source: str, p: int | str, by: Sequence[str] = ()) -> str:
    """HyperLogLog registers of a relation (by..., key); p may be a column."""
    return (
        f"select {_list(by)}(h >> (64 - {p})::ubigint)::int as idx, "
        f"max(case when rest = 0 then 64 - {p} + 1 "
        f"else 64 - {p} - length(bin(rest)) + 1 end)::int as rho "
        f"from (select *, h % (1::ubigint << (64 - {p})::ubigint) as rest "
        f"from (select *, md5_number_upper(key) as h from {source})) group by all"
    )


def alpha(m: str) -> str:
    return f"(0.7213::double / (1.0::double + 1.079::double / {m}))"


def hll_estimates(register_table: str, p: int | str, by: Sequence[str] = ()) -> str:
    """(by..., estimate) from registers; p may be one of the `by` columns."""
    m = f"pow(2.0::double, {p})"
    return (
        f"select {_list(by)}floor(case when raw <= 2.5::double * m and zeros > 0 "
        f"then m * ln(m / zeros) else raw end + 0.5::double)::bigint as estimate "
        f"from (select *, {alpha('m')} * m * m / (inverse + zeros) as raw "
        f"from (select {_list(by)}{m} as m, {m} - count(*) as zeros, "
        f"coalesce(sum(pow(2.0::double, -rho)), 0.0::double) as inverse "
        f"from {register_table} {'group by ' + ', '.join(by) if by else ''}))"
    )


def summary(source: str, k: int | str, by: Sequence[str] = ()) -> str:
    """Heavy-hitter summary of a relation (by..., key, n); k may be one of the `by` columns."""
    part = f"partition by {', '.join(by)} " if by else ""
    return (
        f"select {_list(by)}key, (n - c)::bigint as est from ("
        f"select *, coalesce(max(case when rn = {k} then n end) over ({part}), 0) as c from ("
        f"select *, row_number() over ({part}order by n desc, key) as rn from {source})) "
        f"where n > c"
    )


def relative_error(p: int | str) -> str:
    return f"(1.04::double / sqrt(pow(2.0::double, {p})))"


def template_values() -> str:
    rows = ", ".join(
        f"('{t.name}', {t.cms_width}, {t.cms_depth}, {t.hll_p}, {t.mg_k}, {t.capability}::double)"
        for t in TEMPLATES
    )
    return (
        f"select * from (values {rows}) "
        f"v(template, cms_width, cms_depth, hll_precision, mg_k, capability)"
    )


def memory_mb(w: str, d: str, p: str, k: str) -> str:
    return f"(({w} * {d} * 8 + pow(2.0::double, {p})::bigint + {k} * 100) / 1048576.0::double)"


def score(alpha_q: str, sla: str, weights: Weights = Weights()) -> str:
    w = weights
    return (
        f"({w.accuracy}::double * (capability / greatest({alpha_q}, 1e-6::double)) "
        f"- {w.latency}::double * (greatest(p99_latency_ms, 0.001::double) / greatest({sla}, 1.0::double)) "
        f"- {w.memory}::double * (memory_percent / 100.0::double))"
    )


def with_steps(steps: dict[str, str], final: str, recursive: bool = False) -> str:
    """One statement from named steps."""
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{name} as ({body})" for name, body in steps.items()) + "\n" + final
