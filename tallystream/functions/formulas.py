"""Error bounds, sizes and estimators of the three sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: bytes counted per heavy-hitter candidate.
MG_BYTES_PER_CANDIDATE = 100
# Fixed value: bytes per Count-Min counter.
CMS_BYTES_PER_CELL = 8


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def check_cms(width: int, depth: int) -> None:
    if width < 1 or depth < 1:
        raise ValueError("width and depth must be at least 1")


def check_hll(p: int) -> None:
    if not 4 <= p <= 18:
        raise ValueError("HyperLogLog precision must be between 4 and 18")


def check_mg(k: int) -> None:
    if k < 2:
        raise ValueError("k must be at least 2")


def cms_epsilon(width) -> Column:
    return F.lit(math.e) / _lit(width)


def cms_delta(depth) -> Column:
    return F.exp(-_lit(depth))


def cms_error(width, total) -> Column:
    """Over-count that is exceeded with probability delta at most."""
    return cms_epsilon(width) * _lit(total)


def cms_memory_bytes(width, depth) -> Column:
    return (_lit(width) * _lit(depth) * CMS_BYTES_PER_CELL).cast("bigint")


def cms_from_error(epsilon: float, delta: float) -> tuple[int, int]:
    """(width, depth) of the smallest table that keeps both targets."""
    if epsilon <= 0 or delta <= 0:
        raise ValueError("epsilon and delta must be positive")
    return max(1, math.ceil(math.e / epsilon)), max(1, math.ceil(math.log(1 / delta)))


def cms_size_for(epsilon: Column, delta: Column) -> tuple[Column, Column]:
    """`cms_from_error` as columns, for targets that are rows of a table."""
    width = F.greatest(F.ceil(F.lit(math.e) / epsilon), F.lit(1)).cast("int")
    depth = F.greatest(F.ceil(F.log(F.lit(1.0) / delta)), F.lit(1)).cast("int")
    return width, depth


def hll_alpha(p: int) -> float:
    """Bias constants of the published estimator."""
    small = {16: 0.673, 32: 0.697, 64: 0.709}
    m = 1 << p
    return small.get(m, 0.7213 / (1 + 1.079 / m))


def hll_relative_error(p) -> Column:
    return F.lit(1.04) / F.sqrt(F.pow(F.lit(2.0), _lit(p)))


def hll_memory_bytes(p) -> Column:
    return F.pow(F.lit(2.0), _lit(p)).cast("bigint")


def hll_estimate_of(inverse_sum: Column, zeros: Column, m: Column, alpha: Column) -> Column:
    """Cardinality from the sum of 2^-register over all m registers and the number of zeros."""
    raw = alpha * m * m / inverse_sum
    small = m * F.log(m / zeros)
    chosen = F.when((raw <= 2.5 * m) & (zeros > 0), small).otherwise(raw)
    return F.floor(chosen + 0.5).cast("bigint")


def mg_error(total, k) -> Column:
    return _lit(total) / _lit(k)


def mg_memory_bytes(k) -> Column:
    return (_lit(k) * MG_BYTES_PER_CANDIDATE).cast("bigint")


def sketch_memory_bytes(width, depth, p, k) -> Column:
    return cms_memory_bytes(width, depth) + hll_memory_bytes(p) + mg_memory_bytes(k)


def sketch_memory_mb(width, depth, p, k) -> Column:
    return sketch_memory_bytes(width, depth, p, k) / F.lit(float(2 ** 20))
