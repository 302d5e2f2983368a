"""Count-Min Sketch: key frequencies with a one-sided error.

A sketch is a table (by..., row_id int, col_id int, cnt bigint) that holds its non-zero cells. It has at
most width * depth rows per group, is mergeable by summing, and can be stored as any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions.formulas import check_cms, cms_error
from tallystream.functions.hashing import check_mode, cms_col, cms_row_hash, cms_slot
from tallystream.operators.keys import key_counts, keyed, whole_weight
from tallystream.operators.ordered import join_on

# Largest table that may ride along as one array value (1 MB).
DENSE_CELLS_MAX = 1 << 17


@dataclass(frozen=True)
class CountMin:
    """A sketch table together with the parameters its cells were hashed with."""

    cells: DataFrame
    width: int
    depth: int
    by: tuple[str, ...] = field(default=())
    hash_mode: str = "md5"

    def __post_init__(self):
        check_cms(self.width, self.depth)
        check_mode(self.hash_mode)

    @property
    def size(self) -> int:
        return self.width * self.depth


def cms_cells(counts: DataFrame, key: str, width: int, depth: int, keep: Sequence[str] = (),
              hash_mode: str = "md5") -> DataFrame:
    """(keep..., key, row_id, col_id): the cells each key touches."""
    hashes = F.array(*[cms_row_hash(F.col(key), r, hash_mode) for r in range(depth)])
    exploded = counts.select(*keep, key, F.posexplode(hashes).alias("row_id", "_hash"))
    return exploded.select(
        *keep, key, "row_id", cms_slot(F.col("_hash"), width, hash_mode).alias("col_id")
    )


def cms_build(
    df: DataFrame,
    key: str,
    width: int,
    depth: int,
    by: Sequence[str] = (),
    weight: str | None = None,
    hash_mode: str = "md5",
    pre_aggregate: bool = True,
) -> CountMin:
    """Sketch of the key column, one per group. Weights must not be negative, or the bounds fail.

    With `pre_aggregate` rows are first counted per key: each distinct key is hashed once.
    Without it every row goes straight to its cells, which are summed map-side: one shuffle of at
    most width * depth rows per map task, the better plan when nearly all keys are distinct.
    """
    check_cms(width, depth)
    if pre_aggregate:
        counted = key_counts(df, key, by, weight)
    else:
        amount = whole_weight(weight) if weight else F.lit(1).cast("bigint")
        counted = keyed(df.withColumn("n", amount), key, *by, "n")
    return cms_from_counts(counted, width, depth, by, hash_mode)


def cms_from_counts(
    counted: DataFrame, width: int, depth: int, by: Sequence[str] = (), hash_mode: str = "md5"
) -> CountMin:
    """Sketch from (by..., key, n)."""
    check_cms(width, depth)
    touched = cms_cells(counted, "key", width, depth, [*by, "n"], hash_mode)
    cells = touched.groupBy(*by, "row_id", "col_id").agg(F.sum("n").alias("cnt"))
    return CountMin(cells, width, depth, tuple(by), hash_mode)


def cms_total(sketch: CountMin) -> DataFrame:
    """(by..., total_count): summed over one row of the table, which holds every event once."""
    first = sketch.cells.where(F.col("row_id") == 0)
    return first.groupBy(*sketch.by).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_count"))


def cms_merge(*sketches: CountMin) -> CountMin:
    """Sketch of the union of the inputs."""
    first = sketches[0]
    union = first.cells
    for other in sketches[1:]:
        if (other.width, other.depth, other.hash_mode, other.by) != (
            first.width, first.depth, first.hash_mode, first.by
        ):
            raise ValueError("only sketches with equal parameters can be merged")
        union = union.unionByName(other.cells)
    cells = union.groupBy(*first.by, "row_id", "col_id").agg(F.sum("cnt").alias("cnt"))
    return CountMin(cells, first.width, first.depth, first.by, first.hash_mode)


def cms_fold(sketch: CountMin, width: int, depth: int | None = None) -> CountMin:
    """The sketch a direct build with a smaller power-of-two width (and depth) would give."""
    depth = sketch.depth if depth is None else depth
    powers = all(w & (w - 1) == 0 for w in (width, sketch.width))
    if not powers or width > sketch.width or depth > sketch.depth:
        raise ValueError("fold only to a smaller power-of-two width and no larger depth")
    check_cms(width, depth)
    # in both hash modes a power-of-two width keeps just the low bits of the hash
    cells = (
        sketch.cells.where(F.col("row_id") < depth)
        .withColumn("col_id", F.col("col_id").bitwiseAND(F.lit(width - 1)))
        .groupBy(*sketch.by, "row_id", "col_id")
        .agg(F.sum("cnt").alias("cnt"))
    )
    return CountMin(cells, width, depth, sketch.by, sketch.hash_mode)


def cms_resize(df: DataFrame, key: str, sketch: CountMin, width: int, depth: int) -> CountMin:
    """Rebuild at other parameters from the retained rows (a sketch alone cannot grow)."""
    return cms_build(df, key, width, depth, sketch.by, hash_mode=sketch.hash_mode)


def cms_query(sketch: CountMin, key: str) -> DataFrame:
    """(by..., key, estimate) of one key for every group: the least of its depth cells, a missing one counts 0."""
    hit = F.lit(False)
    for r in range(sketch.depth):
        column = cms_col(F.lit(key), r, sketch.width, sketch.hash_mode)
        hit = hit | ((F.col("row_id") == r) & (F.col("col_id") == column))
    # every group answers, also one without any of the key's cells
    found = sketch.cells.groupBy(*sketch.by).agg(
        F.count_if(hit).alias("_found"), F.min(F.when(hit, F.col("cnt"))).alias("_least")
    )
    estimate = F.when(F.col("_found") == sketch.depth, F.col("_least")).otherwise(F.lit(0))
    return found.select(*sketch.by, F.lit(key).alias("key"), estimate.cast("bigint").alias("estimate"))


def _dense(sketch: CountMin) -> Column:
    """The whole table as one array value, computed once per query as a scalar subquery."""
    spark = sketch.cells.sparkSession
    slot = (F.col("row_id") * sketch.width + F.col("col_id")).cast("bigint")
    filled = spark.range(sketch.size).withColumnRenamed("id", "slot").join(
        F.broadcast(sketch.cells.select(slot.alias("slot"), "cnt")), "slot", "left"
    )
    pairs = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("cnt", F.lit(0)).alias("cnt"))))
    return filled.agg(F.transform(pairs, lambda x: x["cnt"]).alias("cells")).scalar()


def cms_lookup(sketch: CountMin, keys: DataFrame, key: str = "key") -> DataFrame:
    """The rows of `keys` with their `estimate`.

    An ungrouped table of bounded size travels as one array and each estimate is `depth` array reads: a map-only
    job over the keys, whatever their number. Otherwise keys and cells meet in a join. A null key has estimate 0.
    """
    if not sketch.by and sketch.size <= DENSE_CELLS_MAX:
        table = _dense(sketch)
        slots = [
            F.lit(r * sketch.width) + cms_col(F.col(key), r, sketch.width, sketch.hash_mode)
            for r in range(sketch.depth)
        ]
        reads = F.array(*[F.get(table, s) for s in slots])
        return keys.withColumn("estimate", F.coalesce(F.array_min(reads), F.lit(0)))
    touched = cms_cells(keys.select(*sketch.by, key).distinct(), key, sketch.width, sketch.depth,
                        sketch.by, sketch.hash_mode)
    estimates = (
        join_on(touched, sketch.cells, [*sketch.by, "row_id", "col_id"], "left")
        .groupBy(*sketch.by, key)
        .agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))
    )
    return join_on(keys, estimates, [*sketch.by, key], "left").select(*keys.columns, "estimate")


def cms_accuracy(df: DataFrame, key: str, width: int, depth: int, hash_mode: str = "md5") -> DataFrame:
    """Per key: true count, estimate, over-count, and the bound the sketch promises."""
    counted = key_counts(df, key)
    sketch = cms_from_counts(counted, width, depth, hash_mode=hash_mode)
    total = cms_total(sketch).select("total_count").scalar()
    return cms_lookup(sketch, counted).select(
        "key",
        F.col("n").alias("true_count"),
        "estimate",
        (F.col("estimate") - F.col("n")).alias("over_count"),
        cms_error(width, total).alias("error_bound"),
    )


def cms_native(df: DataFrame, key: str, width: int, depth: int, seed: int = 1,
               by: Sequence[str] = ()) -> DataFrame:
    """Spark's own sketch aggregate at the same width and depth, as a binary value."""
    check_cms(width, depth)
    confidence = 1.0 - 2.0 ** -depth
    sketch = F.count_min_sketch(
        F.col("key"), F.lit(2.0 / width), F.lit(confidence), F.lit(seed)
    ).alias("sketch")
    return keyed(df, key, *by).groupBy(*by).agg(sketch)
