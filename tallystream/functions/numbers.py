"""Small numeric and time expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Rounding by plain IEEE steps, so that any engine computes the same double."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number_or(column: str, default: float) -> Column:
    """The column, or a default where it is null or NaN."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.lit(default))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp (with or without zone, session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(ts: Column, width: str) -> Column:
    """Start of the tumbling window of `width` that holds ts."""
    return F.window(ts, width).getField("start")


def interval_seconds(text: str) -> int:
    """Seconds in a fixed interval such as '15 seconds', '6 hours' or '1 day'."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    words = text.split()
    if len(words) % 2:
        raise ValueError(f"not an interval: {text!r}")
    total = 0
    for amount, unit in zip(words[::2], words[1::2]):
        name = unit.lower().rstrip("s")
        if name not in units:
            raise ValueError(f"not a fixed time unit: {unit!r}")
        total += int(amount) * units[name]
    if total <= 0:
        raise ValueError(f"interval must be positive: {text!r}")
    return total
