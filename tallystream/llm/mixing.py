"""Operator 10: mixing sources to target weights with a time-varying curriculum.

Sizes are words. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by
weight; a target stops at `MAX_EPOCHS` times its source's size and the excess is shared again by weight.
Whole documents are taken: every document `target div size of source` times, and once more the documents of
an md5 order up to the rest of the target. That order is cut into about sqrt(n) / 4 blocks per source; the block in
which the target ends is filled greedily, largest fitting document first, so that a source misses its target
by less than a small document.

Each source has a schedule of weight over training time t in [0, 1], `1 - a + 2 a t` with a slope `a` per
weight. Its integral, `(1 - a) t + a t^2`, is the share of the target that is due by t; inverting it at a
document's place in its source's order gives the training position, and documents are range-sorted by it.

Defined results: a null text has size 0 and is never taken; null is a source of its own; repeated rows are
separate documents with the same place in the order; a null id sorts by the md5 of ''; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.llm.shared import staged, word_count

WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)  # the heavier a source, the later its words come
MAX_EPOCHS = 3


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, source_size, n_docs, weight, slope, with the code-point rank found without one global sort task."""
    per_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    in_order = staged(
        per_source.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
        .withColumn("_at", F.monotonically_increasing_id()),
        "sources")
    part = F.shiftright("_at", 33)
    sizes = in_order.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    turn = F.pmod(rank, F.lit(len(WEIGHTS))).cast("int")
    joined = in_order.withColumn("_part", part).join(before, "_part")
    return staged(joined.select(
        "source", "source_size", "n_docs",
        F.get(F.array(*map(F.lit, WEIGHTS)), turn).alias("weight"),
        F.get(F.array(*map(F.lit, SLOPES)), turn).alias("slope"),
    ), "ranked-sources")


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds `target`: shares by weight, raised until no target is above its limit.

    Each round is one aggregation over the table of sources and brings three numbers back; the level only
    rises, so rounds end when no further source reaches its limit.
    """
    limit = MAX_EPOCHS * F.col("source_size")
    level, reached = 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while total:
        at_limit = limit < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.count_if(at_limit).alias("n"),
            F.coalesce(F.sum(F.when(at_limit, limit)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row.n == reached or not row.open:
            break
        level, reached = (total - row.full) / row.open, row.n
    return sources.withColumn("target", F.when(
        limit < F.lit(level) * F.col("weight"), limit.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def _order_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def mix_plan(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: size, source_size, target, copies, taken and the training positions of the copies."""
    sized = staged(docs.select(
        F.col(row_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    sources = with_targets(ranked_sources(sized))
    goal = F.floor("target").cast("long")
    blocks = F.ceil(F.sqrt("n_docs") / 4).cast("long")
    sources = sources.select(
        F.col("source").alias("_source"), "source_size", "slope", "target", blocks.alias("blocks"),
        F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
        .alias("passes"),
        F.when(F.col("source_size") > 0, goal % F.col("source_size")).otherwise(F.lit(0)).alias("rest"))
    head = F.conv(F.substring(_order_key(F.col("doc_id")), 1, 8), 16, 10).cast("long")
    placed = staged(
        sized.join(sources, sized["source"].eqNullSafe(sources["_source"])).drop("_source")
        .withColumns({"key": _order_key(F.col("doc_id")), "block": F.shiftright(head * F.col("blocks"), 32)}),
        "placed")

    # words before each block of a source: about sqrt(n) / 4 rows of a source meet in one task
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("_rest"))
    run = Window.partitionBy("source").orderBy("block")
    before = sums.withColumn("before", F.sum("words").over(run) - F.col("words")).select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "before",
        F.when(F.col("before") + F.col("words") <= F.col("_rest"), F.lit("all"))
        .when(F.col("before") < F.col("_rest"), F.lit("part")).otherwise(F.lit("none")).alias("state"))
    rows = placed.join(
        before, placed["source"].eqNullSafe(before["_source"]) & (placed["block"] == before["_block"])
    ).drop("_source", "_block")

    whole = rows.filter("state <> 'part'").withColumn("again", (F.col("state") == "all") & (F.col("rest") > 0))
    plan = whole.unionByName(_filled(rows.filter("state = 'part'")))
    in_block = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    half = F.col("size") / 2.0
    at = plan.withColumns({
        "_all": F.col("before") + F.sum("size").over(in_block) - half,
        "_again": F.col("before") + F.sum(F.when(F.col("again"), F.col("size")).otherwise(0)).over(in_block) - half,
        "copies": (F.col("passes") + F.col("again").cast("long")) * (F.col("size") > 0).cast("long"),
    })

    def position(words_before: Column) -> Column:
        due = F.least(words_before / F.col("target"), F.lit(1.0))
        flat = 1.0 - F.col("slope")
        return 2.0 * due / (flat + F.sqrt(flat * flat + 4.0 * F.col("slope") * due))

    turns = F.filter(F.array(*[
        F.when(F.col("copies") > e, F.when(
            F.lit(e) < F.col("passes"), position(e * F.col("source_size") + F.col("_all"))
        ).otherwise(position(e * F.col("source_size") + F.col("_again"))))
        for e in range(MAX_EPOCHS)
    ]), lambda p: p.isNotNull())
    return at.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), turns.alias("positions"))


def _filled(block: DataFrame) -> DataFrame:
    """Adds `again` to the rows of the blocks in which a target ends, one block per source.

    Largest first, a document is taken if it still fits; a block has about 4 sqrt(n) of its source's rows.
    """
    fixed = ["source", "source_size", "slope", "target", "blocks", "passes", "rest", "block", "before", "state"]
    own = F.struct((-F.col("size")).alias("order"), "key", "doc_id", "size")
    grouped = block.groupBy(*fixed).agg(F.sort_array(F.collect_list(own)).alias("members"))
    start = F.struct(
        (F.col("rest") - F.col("before")).alias("left"), F.array().cast("array<boolean>").alias("picked"))

    def step(state: Column, doc: Column) -> Column:
        fits = (doc["size"] <= state["left"]) & (doc["size"] > 0)
        return F.struct(
            (state["left"] - F.when(fits, doc["size"]).otherwise(0)).alias("left"),
            F.concat(state["picked"], F.array(fits)).alias("picked"))

    picked = F.aggregate("members", start, step, lambda s: s["picked"])
    rows = grouped.withColumn("_picked", picked).select(*fixed, F.explode(F.arrays_zip("members", "_picked")).alias("m"))
    return rows.select(
        *fixed, F.col("m.members.key").alias("key"), F.col("m.members.doc_id").alias("doc_id"),
        F.col("m.members.size").alias("size"), F.col("m._picked").alias("again"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, range-sorted by training position."""
    keys = ["_id", "_source", "_size"]
    taken = mix_plan(docs).filter("copies > 0").select(
        F.col("doc_id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("size").alias("_p_size"), "positions"
    ).groupBy("_p_id", "_p_source", "_p_size").agg(F.sort_array(F.collect_list("positions")).alias("_places"))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
        word_count(F.col("text")).alias("_size"))
    same = rows["_id"].eqNullSafe(taken["_p_id"]) & rows["_source"].eqNullSafe(taken["_p_source"]) & (
        rows["_size"] == taken["_p_size"])
    # rows that repeat an id share its places one by one, in an order that does not change from run to run
    comparable = [F.col("_row")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*comparable)))
    placed = rows.join(taken, same).withColumn("_at", F.get("_places", turn - 1))
    copies = placed.select("_row", F.explode("_at").alias("_position"))
    return copies.repartitionByRange("_position").sortWithinPartitions("_position").select("_row.*")
