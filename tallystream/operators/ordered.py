"""Order-dependent building blocks that never put one hot group's rows into one task.

* top-k, global and per group
* exact rank selection (quantiles, cut-offs) by narrowing histograms
* last n rows, global and per group
* previous row / last known value per group, with each group's timeline split into chunks
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.numbers import epoch_micros, interval_seconds

# Every task sends its first n rows to a single one; for raw tables with many tasks only a small n may.
# The bounds choose between plans with equal results.
TAKE_ORDERED_MAX = 100
GROUP_LIMIT_MAX = 1_000
SALTS = 64


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats null keys as equal; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(renamed[f"_on_{c}"])
    return left.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of the whole input (a k-row heap per task, no global sort)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    raw: bool = False,
) -> DataFrame:
    """First k rows per group, numbered from 1 in `rank`.

    Spark's group limit lets each map task forward at most k rows per group, for small k. `raw` tables
    have so many map tasks that even these are too many for one task: a first round then takes the
    first k per group and set of map tasks. It is also taken for large k, where tasks forward all rows.
    """
    if raw or k > GROUP_LIMIT_MAX:
        # any split of the rows gives the same result; by map task, each task still sends k rows
        split = Window.partitionBy(*by, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
            .withColumn("_first", F.row_number().over(split))
            .where(F.col("_first") <= k)
            .drop("_part", "_first")
        )
    whole = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k)


# ---- rank selection -------------------------------------------------------------------------

LOG_STEPS = 1_000    # first-round cells per unit of log1p|v|
FANOUT = 65_536      # second-round cells per selected cell


def log_cell(v: Column) -> Column:
    """Order-preserving cell with a bounded number of values over all doubles; NaN comes last."""
    v = v.cast("double")
    edge = F.lit(1 << 60)
    inside = (F.signum(v) * F.floor(F.log1p(F.abs(v)) * LOG_STEPS)).cast("bigint")
    return (
        F.when(F.isnan(v), edge + 1).when(v == float("inf"), edge).when(v == float("-inf"), -edge).otherwise(inside)
    )


def _pick(hist: DataFrame, groups: Sequence[str], cell: str) -> DataFrame:
    """Cells that hold rank k of their group; k becomes the rank inside the cell."""
    upto = F.sum("cnt").over(
        Window.partitionBy(*groups).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        hist.withColumn("_upto", upto)
        .where((F.col("k") < F.col("_upto")) & (F.col("k") >= F.col("_upto") - F.col("cnt")))
        .withColumn("k", F.col("k") - (F.col("_upto") - F.col("cnt")))
        .drop("_upto")
    )


def _beside(rows: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows in the selected cells.

    Ungrouped targets are a handful of rows: they are broadcast, and the lowest value is a filter that reaches
    the files' statistics. How to join grouped ones is left to Spark's size statistics.
    """
    if by:
        return join_on(rows, targets, [*by, "_cell"])
    # reads both bounds, as the join does, so that the histogram is computed once for the two
    low = targets.select(F.min(F.least("_from", "_to"))).scalar()
    return rows.where(F.col("_v") >= low).join(F.broadcast(targets), "_cell")


def select_ranks(
    df: DataFrame,
    value: str,
    ranks: dict[str, Column],
    by: Sequence[str] = (),
    cell: Column | None = None,
    refine: bool = True,
) -> DataFrame:
    """(by..., target, value, n, skipped, ties): the exact value at a 0-based rank of each group.

    `ranks` maps a target name to an expression over `n`, the group's row count. Of the `ties` rows
    with the found value, `skipped` lie below the rank. A histogram over cells (by default
    logarithmic ones) finds the cell that holds the rank, a second one (`refine`) a narrow range in
    that cell, and a last one over distinct values the value. All are combined map-side; no task
    sees a group's raw rows.
    """
    rows = df.select(*by, F.col(value).alias("_v"), (log_cell(F.col(value)) if cell is None else cell).alias("_cell"))
    rows = rows.where(F.col("_v").isNotNull())
    cnt = F.count(F.lit(1)).alias("cnt")

    coarse = rows.groupBy(*by, "_cell").agg(cnt, F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(name).alias("target"), k.cast("bigint").alias("k"))
                  for name, k in ranks.items()])
    )
    coarse = (
        coarse.withColumn("n", F.sum("cnt").over(Window.partitionBy(*by)))
        .withColumn("_want", wanted)
        .select("*", "_want.target", "_want.k")
        .drop("_want")
    )
    targets = _pick(coarse, [*by, "target"], "_cell").drop("cnt")

    if refine:
        low, high = F.col("_from").cast("double"), F.col("_to").cast("double")
        offset = F.floor((F.col("_v").cast("double") - low) / (high - low) * FANOUT)
        slot = F.when(high > low, F.least(offset, F.lit(FANOUT - 1))).otherwise(F.lit(0))
        fine = (
            _beside(rows, targets, by)
            .withColumn("_slot", slot.cast("bigint"))
            .groupBy(*by, "target", "k", "n", "_cell", "_slot")
            .agg(cnt, F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        )
        targets = _pick(fine, [*by, "target"], "_slot").drop("cnt", "_slot")

    last = (
        _beside(rows, targets, by)
        .where(F.col("_v").between(F.col("_from"), F.col("_to")))
        .groupBy(*by, "target", "k", "n", "_v")
        .agg(cnt)
    )
    found = _pick(last, [*by, "target"], "_v")
    return found.select(
        *by, "target", F.col("_v").alias("value"), "n",
        F.col("k").alias("skipped"), F.col("cnt").alias("ties"),
    )


# ---- last n rows ----------------------------------------------------------------------------

CUTOFF_CELL_MICROS = 60_000_000


def last_n(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    """The n latest rows by (ts, tie). Rows without a time take no part."""
    df = df.where(F.col(ts).isNotNull())
    if n <= TAKE_ORDERED_MAX:
        return top_k(df, [F.col(ts).desc(), F.col(tie).desc()], n)
    return last_n_from_cutoff(df, (), ts, tie, n)


def last_n_per_group(df: DataFrame, by: Sequence[str], ts: str, tie: str, n: int) -> DataFrame:
    """The n latest rows of each group by (ts, tie). Rows without a time take no part; null is a group."""
    df = df.where(F.col(ts).isNotNull())
    if n <= TAKE_ORDERED_MAX:
        latest = [F.col(ts).desc(), F.col(tie).desc()]
        return top_k_per_group(df, by, latest, n, rank="_latest", raw=True).drop("_latest")
    return last_n_from_cutoff(df, by, ts, tie, n)


def last_n_from_cutoff(
    df: DataFrame, by: Sequence[str], ts: str, tie: str, n: int
) -> DataFrame:
    """Rows from the exact cut-off time on; among rows at that very time `tie` decides.

    The cut-off comes from counts per minute and then per distinct time of one minute. No more than
    n rows per group (and ties) are shuffled, each distinct time on its own.
    """
    minute = F.floor(epoch_micros(F.col(ts)) / CUTOFF_CELL_MICROS)
    rank = {"cut": F.greatest(F.col("n") - F.lit(n), F.lit(0))}
    cut = select_ranks(df, ts, rank, by, cell=minute, refine=False).select(
        *by, F.col("value").alias("_cut"), (F.col("ties") - F.col("skipped")).alias("_room")
    )
    if by:
        kept = join_on(df, cut, by).where(F.col(ts) >= F.col("_cut"))
    else:
        # two subqueries over one plan; the first stays a plain value that files can be pruned by
        first, room = cut.select("_cut").scalar(), cut.agg(F.max("_room")).scalar()
        kept = df.where(F.col(ts) >= first).withColumns({"_cut": first, "_room": room})
    nth = F.row_number().over(Window.partitionBy(*by, ts).orderBy(F.col(tie).desc()))
    kept = kept.withColumn("_nth", nth)
    return kept.where((F.col(ts) > F.col("_cut")) | (F.col("_nth") <= F.col("_room"))).select(*df.columns)


# ---- timelines in chunks --------------------------------------------------------------------

def _chunked(df: DataFrame, ts: str, chunk: str) -> DataFrame:
    # a number, because a window expression would drop rows without a time
    return df.withColumn("_chunk", F.floor(epoch_micros(F.col(ts)) / (interval_seconds(chunk) * 1_000_000)))


def _carried(placed: DataFrame, by: Sequence[str], carry: Column) -> DataFrame:
    """(by..., _chunk, _carry) from the last row of each chunk."""
    return placed.where("_last").select(*by, "_chunk", carry.alias("_carry"))


def previous_row(
    df: DataFrame, by: Sequence[str], ts: str, columns: dict[str, str], chunk: str = "1 day", tie: Sequence[str] = ()
) -> DataFrame:
    """Adds, per group in order of (ts, tie), the previous row's columns under the given new names.

    Each (group, chunk of time) is a window of its own; the last row of the chunk before is carried
    in, so the widest window is one chunk, and the carries are one row per chunk.
    """
    packed = F.struct(*[F.col(c).alias(name) for c, name in columns.items()])
    local = Window.partitionBy(*by, "_chunk").orderBy(ts, *tie)
    placed = (
        _chunked(df, ts, chunk)
        .withColumn("_local", F.lag(packed).over(local))
        .withColumn("_last", F.lead(F.lit(True)).over(local).isNull())
    )
    before = Window.partitionBy(*by).orderBy("_chunk")
    carries = _carried(placed, by, packed).withColumn("_carry", F.lag("_carry").over(before))
    return (
        join_on(placed, carries, [*by, "_chunk"])
        .withColumn("_previous", F.coalesce("_local", "_carry"))
        .select(*df.columns, *[F.col(f"_previous.{name}") for name in columns.values()])
    )


def last_known(
    df: DataFrame, by: Sequence[str], ts: str, column: str, alias: str, chunk: str = "1 day", tie: Sequence[str] = ()
) -> DataFrame:
    """Adds the latest non-null value of `column` at or before each row of the group in order of (ts, tie), chunk by chunk
    like `previous_row`."""
    local = Window.partitionBy(*by, "_chunk").orderBy(ts, *tie)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        _chunked(df, ts, chunk)
        .withColumn("_local", F.last(column, ignorenulls=True).over(upto))
        .withColumn("_last", F.lead(F.lit(True)).over(local).isNull())
    )
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = _carried(placed, by, F.col("_local")).withColumn(
        "_carry", F.last("_carry", ignorenulls=True).over(before)
    )
    return join_on(placed, carries, [*by, "_chunk"]).select(
        *df.columns, F.coalesce("_local", "_carry").alias(alias)
    )


# ---- distributed scans ----------------------------------------------------------------------

def _prefix(df: DataFrame, by: Sequence[str], parts: DataFrame, place: Sequence[Column], values: dict[str, Column],
            upto: int) -> DataFrame:
    """Window values over each (by, _chunk), whose first row is what `parts` carries in; carried rows are left out again."""
    both = df.withColumn("_own", F.lit(True)).unionByName(parts.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    line = Window.partitionBy(*by, "_chunk").orderBy("_own", *place).rowsBetween(Window.unboundedPreceding, upto)
    return both.withColumns({name: value.over(line) for name, value in values.items()}).where("_own").drop("_own")


def running(
    df: DataFrame, by: Sequence[str], at: str, sums: dict[str, str] | None = None, largest: dict[str, str] | None = None,
    latest: dict[str, str] | None = None, chunk: int = 86_400_000_000, before: bool = False, tie: Sequence[str] = (),
) -> DataFrame:
    """Adds, per group in order of the number `at` (and `tie`), running sums, maxima and last non-null values of columns
    under new names.

    A scan in three steps, so that no task sees more of a group than a chunk of `at`: totals of the chunks, a scan of
    the totals (one row per chunk), and a scan inside each chunk that begins with what came before. With
    `before` a row itself does not count. Nulls of `at` come first.
    """
    sums, largest, latest = sums or {}, largest or {}, latest or {}
    last = lambda c: F.last(c, ignorenulls=True)
    place = F.struct(F.col(at).isNotNull(), at, *tie)
    # (kind, column) -> how a chunk is summed up, and how totals and rows are scanned
    kinds = {("sum", c): (F.sum(c), F.sum) for c in sums.values()}
    kinds |= {("max", c): (F.max(c), F.max) for c in largest.values()}
    kinds |= {("last", c): (F.max_by(c, F.when(F.col(c).isNotNull(), place)), last) for c in latest.values()}
    name = lambda kind: f"_{kind[0]}_{kind[1]}"
    placed = df.withColumn("_chunk", F.floor(F.col(at) / chunk))
    totals = placed.groupBy(*by, "_chunk").agg(*[total.alias(name(kind)) for kind, (total, _) in kinds.items()])
    earlier = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_chunk", *[scan(name(kind)).over(earlier).alias(name(kind)) for kind, (_, scan) in kinds.items()])
    wanted = [("sum", sums), ("max", largest), ("last", latest)]
    values = {new: kinds[kind, c][1](name((kind, c))) for kind, names in wanted for new, c in names.items()}
    own = placed.withColumns({name(kind): F.col(kind[1]) for kind in kinds})
    scanned = _prefix(own, by, carried, [F.asc_nulls_first(at), *tie], values, -1 if before else 0)
    return scanned.select(*df.columns, *values)


def nearest(
    df: DataFrame, by: Sequence[str], at: str, value: str, name: str, chunk: int, after: bool = False,
) -> DataFrame:
    """Adds the last non-null `value` at or before each row's number `at`, or with `after` the first at or after it.

    A scan like `running`, of known values instead of sums. Rows with a value come before others at the same place.
    """
    placed = df.withColumn("_chunk", F.floor(F.col(at) / chunk)).withColumn("_known", F.col(value))
    direction = F.desc if after else F.asc
    order = F.struct(at, value)
    edge = F.min_by if after else F.max_by
    totals = placed.where(F.col(value).isNotNull()).groupBy(*by, "_chunk").agg(edge(value, order).alias("_edge"))
    # a chunk without a value of its own passes on what it was handed
    chunks = placed.select(*by, "_chunk").distinct().withColumn("_edge", F.lit(None).cast(df.schema[value].dataType))
    chunks = chunks.unionByName(totals).groupBy(*by, "_chunk").agg(F.max("_edge").alias("_edge"))
    earlier = Window.partitionBy(*by).orderBy(direction("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*by, "_chunk", F.last("_edge", ignorenulls=True).over(earlier).alias("_known"))
    place = [direction(at), F.col(value).isNull()]
    scanned = _prefix(placed, by, carried, place, {name: F.last("_known", ignorenulls=True)}, 0)
    return scanned.select(*df.columns, name)
