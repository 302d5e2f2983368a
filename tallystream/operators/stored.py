"""Sketches as stored tables: saved with their parameters, checked when they are loaded or merged.

A folder holds the tables `cms`, `hll`, `summary` and, written last, `parameters`: one row with the format, width, depth, p, k, hash
mode and the number of counted events. A folder without that row is not complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators.cms import CountMin, cms_from_counts, cms_merge
from tallystream.operators.heavy_hitters import mg_merge, mg_truncate
from tallystream.operators.hll import HyperLogLog, hll_build, hll_merge
from tallystream.operators.keys import key_counts
from tallystream.templates import DEFAULT_TEMPLATE, template

FORMAT = 1
_PARAMETERS = "format int, width int, depth int, p int, k int, hash_mode string, total bigint"


@dataclass(frozen=True)
class Stored:
    """The three sketches of one key stream and the number of events they have counted."""

    cms: CountMin
    hll: HyperLogLog
    summary: DataFrame
    k: int
    total: int

    @property
    def parameters(self) -> tuple:
        return FORMAT, self.cms.width, self.cms.depth, self.hll.p, self.k, self.cms.hash_mode


def save_sketches(
    df: DataFrame, key: str, path: str, template_name: str = DEFAULT_TEMPLATE, hash_mode: str = "md5",
) -> None:
    """Builds the sketches of `df` at a template and writes them below `path`."""
    t = template(template_name)
    counted = key_counts(df, key).persist()
    cms_from_counts(counted, t.cms_width, t.cms_depth, hash_mode=hash_mode).cells.write.mode("overwrite").parquet(f"{path}/cms")
    hll_build(counted, "key", t.hll_p, hash_mode=hash_mode).registers.write.mode("overwrite").parquet(f"{path}/hll")
    mg_truncate(counted, t.mg_k).write.mode("overwrite").parquet(f"{path}/summary")
    row = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(
        F.lit(FORMAT).alias("format"), F.lit(t.cms_width).alias("width"), F.lit(t.cms_depth).alias("depth"), F.lit(t.hll_p).alias("p"),
        F.lit(t.mg_k).alias("k"), F.lit(hash_mode).alias("hash_mode"), "total")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")
    counted.unpersist()


def load_sketches(spark: SparkSession, path: str) -> Stored:
    """The sketches below `path`; an error if they are incomplete or of another format."""
    try:
        rows = spark.read.schema(_PARAMETERS).parquet(f"{path}/parameters").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"{path} holds no complete sketches") from None
    if len(rows) != 1 or rows[0].format != FORMAT:
        raise ValueError(f"{path} does not hold sketches of format {FORMAT}")
    r = rows[0]
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Stored(
        CountMin(read("cms", "row_id int, col_id int, cnt bigint"), r.width, r.depth, hash_mode=r.hash_mode),
        HyperLogLog(read("hll", "idx int, rho int"), r.p, hash_mode=r.hash_mode),
        read("summary", "key string, est bigint"), r.k, r.total)


def merge_stored(*parts: Stored) -> Stored:
    """The sketches of all parts together; parts with other parameters are an error."""
    if len({p.parameters for p in parts}) != 1:
        raise ValueError(f"only sketches with equal parameters can be merged: {sorted({p.parameters for p in parts})}")
    return Stored(
        cms_merge(*[p.cms for p in parts]), hll_merge(*[p.hll for p in parts]),
        mg_merge(*[p.summary for p in parts], k=parts[0].k), parts[0].k, sum(p.total for p in parts))
