"""What follows from Count-Min cells beyond single keys: counts of ranges, inner products, and drift between windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.operators.cms import CountMin, cms_from_counts, cms_lookup
from tallystream.operators.ordered import join_on


@dataclass(frozen=True)
class RangeSketch:
    """A Count-Min sketch for each level of dyadic intervals: at level l a key is its value divided by 2^l."""

    cms: CountMin
    bits: int


def range_build(df: DataFrame, value: str, bits: int, width: int, depth: int, hash_mode: str = "md5") -> RangeSketch:
    """Sketches of whole numbers from 0 to 2^bits - 1; null and other values are not counted.

    Values are counted once before they are written out as one node for each level.
    """
    inside = df.select(F.col(value).cast("bigint").alias("v")).where(F.col("v").between(0, (1 << bits) - 1))
    counted = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    nodes = counted.select("n", "v", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("level")).select(
        "level", F.call_function("shiftright", F.col("v"), F.col("level")).cast("string").alias("key"), "n")
    summed = nodes.groupBy("level", "key").agg(F.sum("n").alias("n"))
    return RangeSketch(cms_from_counts(summed, width, depth, ["level"], hash_mode), bits)


def dyadic_nodes(low: int, high: int, bits: int) -> list[tuple[int, int]]:
    """(level, node) of the fewest dyadic intervals that make up low..high, at most two for each level."""
    low, high, found = max(low, 0), min(high, (1 << bits) - 1), []
    level = 0
    while low <= high and level <= bits:
        if low & 1 or level == bits:
            found.append((level, low))
            low += 1
        if low <= high and not high & 1:
            found.append((level, high))
            high -= 1
        low, high, level = low >> 1, high >> 1, level + 1
    return found


def range_counts(sketch: RangeSketch, ranges: list[tuple[int, int]]) -> DataFrame:
    """(low, high, estimate) of a short list of ranges, both ends included. A range over-counts by its nodes' bounds together."""
    spark = sketch.cms.cells.sparkSession
    rows = [(a, b, level, str(node)) for a, b in ranges for level, node in dyadic_nodes(a, b, sketch.bits)]
    asked = spark.createDataFrame(rows, "low long, high long, level int, key string")
    found = cms_lookup(sketch.cms, asked)
    every = spark.createDataFrame(list(dict.fromkeys(ranges)), "low long, high long")
    sums = found.groupBy("low", "high").agg(F.sum("estimate").alias("estimate"))
    return every.join(sums, ["low", "high"], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0)))


def inner_product(a: CountMin, b: CountMin) -> DataFrame:
    """(by..., estimate): sum over keys of count in `a` times count in `b`, over-counted like a frequency; groups meet their equals.

    Cells meet on their place; of the rows' sums of products the least counts, a row without common cells counting 0.
    """
    if (a.width, a.depth, a.hash_mode, a.by) != (b.width, b.depth, b.hash_mode, b.by):
        raise ValueError("only sketches with equal parameters have an inner product")
    by = list(a.by)
    both = join_on(a.cells, b.cells.withColumnRenamed("cnt", "_other"), [*by, "row_id", "col_id"])
    rows = both.groupBy(*by, "row_id").agg(F.sum(F.col("cnt") * F.col("_other")).alias("_product"))
    least = F.when(F.count(F.lit(1)) == a.depth, F.min("_product")).otherwise(F.lit(0))
    return rows.groupBy(*by).agg(least.cast("bigint").alias("estimate"))


def drift(sketch: CountMin, window: str, step: str, below: float) -> DataFrame:
    """(window, previous, similarity, alert) of consecutive windows; `sketch` has one group per window (a time).

    Similarity is the least over the table's rows of the cosine between the windows' cells; an alert is a similarity under `below`.
    Windows without events break the chain: the first after a gap has no previous one.
    """
    cells = sketch.cells
    norms = cells.groupBy(window, "row_id").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("_norm"))
    after = F.col(window) + F.expr(f"interval {step}")
    earlier = cells.select(after.alias(window), F.col(window).alias("previous"), "row_id", "col_id", F.col("cnt").alias("_other"))
    dots = cells.join(earlier, [window, "row_id", "col_id"]).groupBy(window, "previous", "row_id").agg(
        F.sum(F.col("cnt") * F.col("_other")).alias("_dot"))
    pairs = norms.join(norms.select(after.alias(window), F.col(window).alias("previous"), "row_id", F.col("_norm").alias("_before")),
                       [window, "row_id"])
    cosine = F.coalesce("_dot", F.lit(0)) / F.sqrt(F.col("_norm").cast("double") * F.col("_before").cast("double"))
    least = pairs.join(dots.drop("previous"), [window, "row_id"], "left").groupBy(window, "previous").agg(F.min(cosine).alias("similarity"))
    return least.withColumn("alert", (F.col("similarity") < below).cast("int"))
