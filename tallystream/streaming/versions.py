"""Tables that micro-batches write: full states by version, and growing tables in runs that are merged.

A folder counts once its writer has left `_SUCCESS` in it, so a batch that fails half-way is not seen, and one that runs again
overwrites its own folder. Which folders to read is found from their names alone, without opening a file.

* State: `version=N` is the whole state after batch N. Readers take the newest; writers delete all but the last two, which a retry of
  the newest batch may still need.
* Growing table: `run=A-B` holds the rows of batches A to B. `FAN_IN` neighbouring runs of one size are merged into one, so n batches
  leave at most FAN_IN * log(n) folders. A merged run is complete before its parts are deleted, and readers skip
  runs that another one contains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FAN_IN = 8
KEPT_VERSIONS = 2


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names below `path` after `prefix`, of complete folders."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root) if f.isDirectory()]
    done = lambda n: system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return [n[len(prefix):] for n in names if n.startswith(prefix) and done(n)]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# ---- states ---------------------------------------------------------------------------------

def write_version(state: DataFrame, path: str, version: int) -> None:
    """Writes the state after batch `version` and deletes what no reader or retry needs any more."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{path}/version={version}")
    older = sorted(v for v in versions(spark, path) if v <= version)
    for v in older[:-KEPT_VERSIONS]:
        _delete(spark, f"{path}/version={v}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions below `path`."""
    return sorted(int(v) for v in _folders(spark, path, "version="))


def read_version(spark: SparkSession, path: str, before: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The newest state, or the newest one older than `before`; empty with `schema` if there is none."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    if not known:
        if schema is None:
            raise ValueError(f"no complete state below {path}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/version={known[-1]}")


# ---- growing tables -------------------------------------------------------------------------

def runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The runs (first batch, last batch) to read, in order; runs within others are left out."""
    every = [tuple(map(int, name.split("-"))) for name in _folders(spark, path, "run=")]
    chosen: list[tuple[int, int]] = []
    for run in sorted(every, key=lambda r: (r[0], -r[1])):
        if not chosen or run[1] > chosen[-1][1]:
            chosen.append(run)
    return chosen


def _run_path(path: str, run: tuple[int, int]) -> str:
    return f"{path}/run={run[0]}-{run[1]}"


def append_run(rows: DataFrame, path: str, batch_id: int) -> None:
    """Writes the rows of one batch, unless a merged run holds them already, and merges runs where `FAN_IN` of a size lie side by side."""
    spark = rows.sparkSession
    if not any(a <= batch_id <= b and a < b for a, b in runs(spark, path)):
        rows.write.mode("overwrite").parquet(_run_path(path, (batch_id, batch_id)))
    while parts := _mergeable(runs(spark, path), batch_id):
        merged = (parts[0][0], parts[-1][1])
        spark.read.parquet(*[_run_path(path, p) for p in parts]).write.mode("overwrite").parquet(_run_path(path, merged))
    chosen = set(runs(spark, path))
    for name in _folders(spark, path, "run="):
        run = tuple(map(int, name.split("-")))
        if run not in chosen:
            _delete(spark, _run_path(path, run))


def _mergeable(known: list[tuple[int, int]], newest: int) -> list[tuple[int, int]]:
    """The first FAN_IN neighbouring runs of one size before the newest batch, which a retry may still write again."""
    settled = [r for r in known if r[1] < newest]
    for i in range(len(settled) - FAN_IN + 1):
        part = settled[i: i + FAN_IN]
        if len({b - a for a, b in part}) == 1:
            return part
    return []


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All rows of a growing table; empty with `schema` if there are none."""
    known = runs(spark, path)
    if not known:
        if schema is None:
            raise ValueError(f"no complete run below {path}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*[_run_path(path, r) for r in known])
