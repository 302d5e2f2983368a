"""Template hot-swap: sketches restart at every set_template command of their worker; resize_mg changes k from its time on.

Two ways lead to the sketches of an epoch. Over a table, rows are placed in the epoch in force at their time and
counted there (`with_epoch`). Over a stream, every micro-batch stores partial sketches at the finest template per worker and
time bucket (`sketch_parts`); a part belongs to no epoch yet. When they are read, buckets, not rows, are placed among
the commands known by then and folded to the template in force (`place_parts`), so late events and late commands
change nothing but the answer. Folding is exact: a coarser template's cells and registers follow from the finest ones'.

Rows without a time belong to no epoch: they keep a null epoch and are counted under it at the default template.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.formulas import (
    cms_error, hll_alpha, hll_estimate_of, hll_relative_error, mg_error,
)
from tallystream.functions.hashing import cms_row_hash, cms_slot
from tallystream.functions.numbers import epoch_micros, interval_seconds
from tallystream.operators.control import in_force
from tallystream.operators.heavy_hitters import mg_truncate
from tallystream.operators.hll import folded_register, with_registers
from tallystream.operators.keys import keyed
from tallystream.operators.ordered import join_on, nearest, running
from tallystream.staging import staged
from tallystream.templates import DEFAULT_TEMPLATE, TEMPLATES, template, template_value

FINEST = TEMPLATES[-1]
# Copies of a bucket's commands, among which the events of a hot worker and bucket are dealt.
SALTS = 8
DAY_MICROS = 86_400_000_000
# Start of the year 1, before any time of an event.
BEGINNING = -62_135_596_800_000_000
# Largest k that a resize may ask for; a summary is cut to this size before each group's own k counts.
MAX_K = 1_000


def parameter_timeline(commands: DataFrame, grain: str | None = None) -> DataFrame:
    """(worker_id, at, epoch, template, mg_k, last_k): the parameters in force from each change on, `at` in microseconds.

    Template and k change separately: set_template starts an epoch and sets both, resize_mg only k; last_k is the k that the
    epoch ends with. A worker's first entry, from `BEGINNING` on, is epoch 0 at the default template. Of several commands of a
    worker at one time the finest template and the smallest k hold, the template first. With `grain` a command takes
    effect at the next multiple of it; of those that this brings together, each is an epoch, and the last one holds. A k
    outside 2..MAX_K, and a command without a time, are ignored. Values come from scans by chunks of time.
    """
    none = lambda kind: F.lit(None).cast(kind)
    if "k" not in commands.columns:
        commands = commands.withColumn("k", none("int"))
    swaps = in_force(commands).select("worker_id", "ts", "template", none("int").alias("k"))
    sizes = commands.where((F.col("action") == "resize_mg") & F.col("k").between(2, MAX_K)).select(
        "worker_id", "ts", none("string").alias("template"), F.col("k").cast("int").alias("k"))
    at = epoch_micros(F.col("ts"))
    if grain:
        step = interval_seconds(grain) * 1_000_000
        at = F.ceil(at / step) * step
    changes = swaps.unionByName(sizes).withColumn("at", at.cast("bigint")).where(F.col("at").isNotNull())

    swapped = F.max(F.when(F.col("template").isNotNull(), F.struct("ts", "template")))
    sized = F.max(F.when(F.col("k").isNotNull(), F.struct("ts", (-F.col("k")).alias("minus"))))
    merged = changes.groupBy("worker_id", "at").agg(
        swapped.alias("swap"), sized.alias("size"), F.count_if(F.col("template").isNotNull()).alias("swaps"))
    # the resize counts unless a later swap came before the same grain
    resized = F.when(F.col("swap").isNull() | (F.col("size.ts") >= F.col("swap.ts")), -F.col("size.minus"))
    own_k = F.when(F.col("swap").isNotNull(), template_value(F.col("swap.template"), "mg_k"))
    values = merged.select(
        "worker_id", "at", F.col("swap.template").alias("set"), "swaps", F.coalesce(resized, own_k).cast("int").alias("sized"))
    first = commands.select("worker_id").distinct().select(
        "worker_id", F.lit(BEGINNING).alias("at"), F.lit(DEFAULT_TEMPLATE).alias("set"), F.lit(0).cast("bigint").alias("swaps"),
        F.lit(template(DEFAULT_TEMPLATE).mg_k).alias("sized"))
    known = running(
        first.unionByName(values), ["worker_id"], "at", sums={"_epoch": "swaps"}, latest={"template": "set", "mg_k": "sized"}, chunk=DAY_MICROS)
    last_k = F.max_by("mg_k", "at").over(Window.partitionBy("worker_id", "_epoch"))
    return known.select("worker_id", "at", F.col("_epoch").cast("int").alias("epoch"), "template", "mg_k", last_k.alias("last_k"))


def as_of(
    rows: DataFrame, worker: str, at: Column, timeline: DataFrame, names: Sequence[str], bucket: str = "1 day",
) -> DataFrame:
    """Adds `names`, the values of `timeline` (worker_id, at, names...) in force at the time `at` (microseconds) of each row.

    Every (worker, bucket of time) that has rows gets the list of the values in force in it, begun by the one that holds when
    the bucket starts. Rows meet their list by an equality on worker, bucket and a salt, so a hot worker or hour is spread; a
    small list side is broadcast by Spark's own measure. Rows without a time, or before the first entry, get nulls.
    """
    width = interval_seconds(bucket) * 1_000_000
    placed = rows.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / width)).withColumn(
        "_salt", F.pmod(F.xxhash64("_at", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    entry = F.struct(F.col("at").alias("_since"), *names)
    held = timeline.select(F.col("worker_id").alias("_worker"), "at", entry.alias("_entry"))
    present = staged(placed.where(F.col("_bucket").isNotNull()).select(F.col(worker).alias("_worker"), "_bucket").distinct(), "buckets")
    starts = present.select(
        "_worker", "_bucket", (F.col("_bucket") * width).cast("bigint").alias("at"), F.lit(None).cast(_type(held, "_entry")).alias("_entry"))
    both = held.withColumn("_bucket", F.lit(None).cast("bigint")).unionByName(starts)
    # the entry in force at the start of every bucket with rows, and the entries inside
    carried = nearest(both, ["_worker"], "at", "_entry", "_carried", 32 * width)
    begin = carried.where(F.col("_bucket").isNotNull()).select("_worker", "_bucket", F.col("_carried").alias("_entry"))
    inside = held.select("_worker", F.floor(F.col("at") / width).alias("_bucket"), "_entry")
    lists = begin.unionByName(inside).groupBy("_worker", "_bucket").agg(F.sort_array(F.collect_set("_entry")).alias("_list"))
    salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.withColumnsRenamed({"_bucket": "_b", "_salt": "_s"})
    same = placed[worker].eqNullSafe(F.col("_worker")) & (F.col("_bucket") == F.col("_b")) & (F.col("_salt") == F.col("_s"))
    met = placed.join(salted, same, "left")
    upto = F.filter("_list", lambda e: e["_since"] <= F.col("_at"))
    return met.withColumn("_entry", F.try_element_at(upto, F.lit(-1))).select(
        *rows.columns, *[F.col(f"_entry.{n}").alias(n) for n in names])


def _type(df: DataFrame, column: str):
    return df.schema[column].dataType


def with_epoch(
    events: DataFrame, worker: str, ts: str, commands: DataFrame, bucket: str = "1 day", grain: str | None = None,
) -> DataFrame:
    """Adds the epoch (0 before the first command), template and mg_k in force at each event, and last_k.

    An event without a time keeps a null epoch, and the default template and k.
    """
    timeline = staged(parameter_timeline(commands, grain), "timeline")
    placed = as_of(events, worker, epoch_micros(F.col(ts)), timeline, PARAMETERS, bucket)
    return _with_defaults(placed, events.columns, F.col(ts))


PARAMETERS = ["epoch", "template", "mg_k", "last_k"]


def _with_defaults(placed: DataFrame, columns: Sequence[str], at: Column) -> DataFrame:
    """Epoch 0 and the default template for workers without commands, a null epoch for rows without a time."""
    k = F.lit(template(DEFAULT_TEMPLATE).mg_k)
    return placed.select(
        *columns, F.when(at.isNotNull(), F.coalesce("epoch", F.lit(0))).alias("epoch"),
        F.coalesce("template", F.lit(DEFAULT_TEMPLATE)).alias("template"),
        F.coalesce("mg_k", k).alias("mg_k"), F.coalesce("last_k", k).alias("last_k"))


def estimate_by_template(registers: DataFrame, by: list[str]) -> DataFrame:
    """(by..., template, total_count, estimate) from registers (by..., template, idx, rho, n) built at
    each template's own p."""
    p = template_value(F.col("template"), "hll_p")
    m = F.pow(F.lit(2.0), p)
    alpha = _alpha(F.col("template"))
    parts = registers.groupBy(*by, "template").agg(
        F.count(F.lit(1)).alias("_used"),
        F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_inverse"),
        F.sum("n").alias("total_count"),
    )
    zeros = m - F.col("_used")
    estimate = hll_estimate_of(F.col("_inverse") + zeros, zeros, m, alpha)
    return parts.select(*by, "template", "total_count", estimate.alias("estimate"))


def _alpha(name: Column) -> Column:
    by_p = {t.hll_p: hll_alpha(t.hll_p) for t in TEMPLATES}
    p = template_value(name, "hll_p")
    chosen = F
    for precision, alpha in by_p.items():
        chosen = chosen.when(p == precision, F.lit(alpha))
    return chosen.otherwise(F.lit(hll_alpha(12)))


def own_registers(df: DataFrame, by: list[str], hash_mode: str = "md5") -> DataFrame:
    """(by..., template, idx, rho, n) of rows (by..., template, key): registers at each template's p,
    and the events behind each, which add up to the total.

    Combined map-side to 2^p rows per group at most; there is no shuffle by key.
    """
    own_p = template_value(F.col("template"), "hll_p")
    return (
        with_registers(df.select(*by, "template", "key"), "key", own_p, hash_mode)
        .groupBy(*by, "template", "idx")
        .agg(F.max("rho").alias("rho"), F.count(F.lit(1)).alias("n"))
    )


# ---- sketches of an epoch from rows ---------------------------------------------------------

BY = ("worker_id", "epoch", "template", "mg_k")


def placed_keys(
    events: DataFrame, key: str, worker: str, ts: str, commands: DataFrame, bucket: str = "1 day", grain: str | None = None,
) -> DataFrame:
    """(worker_id, epoch, template, mg_k, key): events with a key, at the parameters that their epoch ends with.

    A resize keeps what was counted, so k is the last one of the epoch.
    """
    rows = with_epoch(events.select(worker, ts, key), worker, ts, commands, bucket, grain)
    return keyed(rows.withColumn("mg_k", F.col("last_k")), key, F.col(worker).alias("worker_id"), "epoch", "template", "mg_k")


def epoch_cells(counts: DataFrame, hash_mode: str = "md5") -> DataFrame:
    """(BY..., row_id, col_id, cnt) from (BY..., key, n): Count-Min cells at each epoch's own width and depth."""
    hashes = F.array(*[cms_row_hash(F.col("key"), r, hash_mode) for r in range(FINEST.cms_depth)])
    rows = counts.select(*BY, "n", F.posexplode(hashes).alias("row_id", "_hash"))
    rows = rows.where(F.col("row_id") < template_value(F.col("template"), "cms_depth"))
    # widths are powers of two: a smaller one keeps the low bits
    column = cms_slot(F.col("_hash"), FINEST.cms_width, hash_mode).bitwiseAND(template_value(F.col("template"), "cms_width") - 1)
    return rows.select(*BY, "n", "row_id", column.alias("col_id")).groupBy(*BY, "row_id", "col_id").agg(F.sum("n").alias("cnt"))


def lookup_cells(cells: DataFrame, keys: DataFrame, hash_mode: str = "md5") -> DataFrame:
    """(worker_id, epoch, template, key, estimate, cms_error_bound) of every key of `keys` in every epoch of `cells`."""
    depth, width = (template_value(F.col("template"), f) for f in ("cms_depth", "cms_width"))
    epochs = cells.where(F.col("row_id") == 0).groupBy(*BY).agg(F.sum("cnt").alias("_total"))
    hashes = F.array(*[cms_row_hash(F.col("key"), r, hash_mode) for r in range(FINEST.cms_depth)])
    asked = keys.select("key").distinct().select("key", F.posexplode(hashes).alias("row_id", "_hash")).select(
        "key", "row_id", cms_slot(F.col("_hash"), FINEST.cms_width, hash_mode).alias("_slot"))
    # a key's cell differs by width only: one row of `asked` for each width, met by equality
    widths = F.explode(F.array(*[F.lit(w) for w in sorted({t.cms_width for t in TEMPLATES})])).alias("_width")
    slots = asked.select("key", "row_id", "_slot", widths).withColumn("col_id", F.col("_slot").bitwiseAND(F.col("_width") - 1)).drop("_slot")
    found = (
        cells.withColumn("_width", width).join(slots, ["row_id", "col_id", "_width"])
        .groupBy(*BY, "key").agg(F.count(F.lit(1)).alias("_rows"), F.min("cnt").alias("_least")))
    # cells that are zero are absent: the least is zero unless all rows were met
    every = join_on(epochs.withColumn("key", F.explode(_key_list(keys))), found, [*BY, "key"], "left")
    return every.select(
        "worker_id", "epoch", "template", "key",
        F.when(F.col("_rows") == depth, F.col("_least")).otherwise(F.lit(0)).cast("bigint").alias("estimate"),
        cms_error(width, F.col("_total")).alias("cms_error_bound"))


def _key_list(keys: DataFrame) -> Column:
    """The asked keys as one array; a question is a short list."""
    return keys.agg(F.collect_set("key")).scalar()


def epoch_frequency(
    events: DataFrame, key: str, worker: str, ts: str, commands: DataFrame, keys: DataFrame, bucket: str = "1 day",
    grain: str | None = None,
) -> DataFrame:
    """(worker_id, epoch, template, key, estimate, cms_error_bound) of a short list of keys (column key) in every epoch."""
    rows = placed_keys(events, key, worker, ts, commands, bucket, grain)
    counts = rows.groupBy(*BY, "key").agg(F.count(F.lit(1)).alias("n"))
    return lookup_cells(epoch_cells(counts), keys)


def _report(registers: DataFrame) -> DataFrame:
    """The report of each epoch from its registers (BY..., idx, rho, n)."""
    by = ["worker_id", "epoch", "mg_k"]
    value = lambda field: template_value(F.col("template"), field)
    return estimate_by_template(registers, by).select(
        "worker_id", "epoch", "template", "mg_k", "total_count",
        cms_error(value("cms_width"), F.col("total_count")).alias("cms_error_bound"),
        F.col("estimate").alias("hll_estimate"),
        hll_relative_error(value("hll_p")).alias("hll_relative_error"),
        mg_error(F.col("total_count"), F.col("mg_k")).alias("mg_error_bound"),
    )


def template_epochs(
    events: DataFrame, key: str, worker: str, ts: str, commands: DataFrame, bucket: str = "1 day", grain: str | None = None,
) -> DataFrame:
    """One row per (worker, epoch): template, k, events, bounds and distinct keys since its swap."""
    rows = placed_keys(events, key, worker, ts, commands, bucket, grain)
    return _report(own_registers(rows, ["worker_id", "epoch", "mg_k"]))


def epoch_heavy_hitters(
    events: DataFrame, key: str, worker: str, ts: str, commands: DataFrame, bucket: str = "1 day", grain: str | None = None,
) -> DataFrame:
    """(worker_id, epoch, template, mg_k, key, est): a summary per epoch, with the k in force when it ends."""
    rows = placed_keys(events, key, worker, ts, commands, bucket, grain)
    return _summaries(rows.groupBy(*BY, "key").agg(F.count(F.lit(1)).alias("n")))


def _summaries(counts: DataFrame) -> DataFrame:
    return mg_truncate(counts, MAX_K, BY, own_k=F.col("mg_k"))


# ---- partial sketches -----------------------------------------------------------------------

@dataclass(frozen=True)
class SketchParts:
    """Mergeable parts (worker_id, at, ...) at the finest template; `at` is the start of a time bucket in microseconds.

    cells: row_id, col_id, cnt; registers: idx, rho, n; candidates: key, est.
    """

    cells: DataFrame
    registers: DataFrame
    candidates: DataFrame


def sketch_parts(events: DataFrame, key: str, worker: str, ts: str, grain: str, hash_mode: str = "md5") -> SketchParts:
    """The parts of some rows. Their size is bounded by the sketches' sizes per worker and bucket of `grain`."""
    width = interval_seconds(grain) * 1_000_000
    at = (F.floor(epoch_micros(F.col(ts)) / width) * width).cast("bigint")
    rows = keyed(events, key, F.col(worker).alias("worker_id"), at.alias("at"))
    by = ["worker_id", "at"]
    counts = rows.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))
    hashes = F.array(*[cms_row_hash(F.col("key"), r, hash_mode) for r in range(FINEST.cms_depth)])
    cells = (
        counts.select(*by, "n", F.posexplode(hashes).alias("row_id", "_hash"))
        .select(*by, "n", "row_id", cms_slot(F.col("_hash"), FINEST.cms_width, hash_mode).alias("col_id"))
        .groupBy(*by, "row_id", "col_id").agg(F.sum("n").alias("cnt")))
    registers = (
        with_registers(rows, "key", FINEST.hll_p, hash_mode).groupBy(*by, "idx")
        .agg(F.max("rho").alias("rho"), F.count(F.lit(1)).alias("n")))
    return SketchParts(cells, registers, mg_truncate(counts, MAX_K, by))


def place_parts(parts: SketchParts, commands: DataFrame, grain: str, bucket: str = "1 day") -> SketchParts:
    """Parts merged per (worker_id, epoch, template, mg_k) under the commands known now, folded to each epoch's template.

    A command counts from the next multiple of `grain` on; `grain` is the one that the parts were built with.
    """
    timeline = staged(parameter_timeline(commands, grain), "timeline")

    def placed(df: DataFrame) -> DataFrame:
        rows = as_of(df, "worker_id", F.col("at"), timeline, PARAMETERS, bucket)
        return _with_defaults(rows, df.columns, F.col("at")).withColumn("mg_k", F.col("last_k"))

    value = lambda field: template_value(F.col("template"), field)
    cells = placed(parts.cells).where(F.col("row_id") < value("cms_depth")).withColumn(
        "col_id", F.col("col_id").bitwiseAND(value("cms_width") - 1))
    idx, rho = folded_register(F.lit(FINEST.hll_p) - value("hll_p"))
    registers = placed(parts.registers).select(*BY, "n", idx.alias("idx"), rho.alias("rho"))
    return SketchParts(
        cells.groupBy(*BY, "row_id", "col_id").agg(F.sum("cnt").alias("cnt")),
        registers.groupBy(*BY, "idx").agg(F.max("rho").alias("rho"), F.sum("n").alias("n")),
        placed(parts.candidates).groupBy(*BY, "key").agg(F.sum("est").alias("n")))


def parts_report(placed: SketchParts) -> DataFrame:
    """`template_epochs` from placed parts."""
    return _report(placed.registers)


def parts_frequency(placed: SketchParts, keys: DataFrame) -> DataFrame:
    """`epoch_frequency` from placed parts."""
    return lookup_cells(placed.cells, keys)


def parts_heavy_hitters(placed: SketchParts) -> DataFrame:
    """`epoch_heavy_hitters` from placed parts; estimates are low by the parts' own bounds, together at most N/k."""
    return _summaries(placed.candidates)
