"""Count-Min queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.formulas import cms_delta, cms_epsilon, cms_memory_bytes, cms_size_for
from tallystream.functions.numbers import round_half_up, time_bucket
from tallystream.operators.cms import (
    CountMin, cms_accuracy, cms_build, cms_cells, cms_fold, cms_lookup, cms_merge, cms_native, cms_query,
)
from tallystream.operators.derived import drift, dyadic_nodes, inner_product, range_build, range_counts
from tallystream.plans import sql
from tallystream.plans.inputs import EVENTS_SQL, LINES_SQL, part_lines, user_events
from tallystream.session import read_table
from tallystream.templates import template

LOW, MEDIUM = template("low"), template("medium")
POINT_KEY = "42"
DRIFT_BELOW = 0.7
RARE_KEY = "7"


def _medium(lines: DataFrame, **options) -> CountMin:
    return cms_build(lines, "key", MEDIUM.cms_width, MEDIUM.cms_depth, **options)


def cms_hash_cells(spark: SparkSession, directory: str) -> DataFrame:
    """The cells of every part key."""
    parts = read_table(spark, directory, "part").select(F.col("p_partkey").cast("string").alias("key"))
    return cms_cells(parts, "key", MEDIUM.cms_width, MEDIUM.cms_depth)


def cms_hash_cells_any_width(spark: SparkSession, directory: str) -> DataFrame:
    """The same for a width that is no power of two."""
    parts = read_table(spark, directory, "part").select(F.col("p_partkey").cast("string").alias("key"))
    return cms_cells(parts, "key", 1000, 3)


def cms_table(spark: SparkSession, directory: str) -> DataFrame:
    return _medium(part_lines(spark, directory)).cells


def cms_table_direct(spark: SparkSession, directory: str) -> DataFrame:
    return _medium(part_lines(spark, directory), pre_aggregate=False).cells


def cms_table_by_group(spark: SparkSession, directory: str) -> DataFrame:
    return _medium(part_lines(spark, directory), by=["l_returnflag"]).cells


def cms_weighted_table(spark: SparkSession, directory: str) -> DataFrame:
    return _medium(part_lines(spark, directory), weight="l_quantity").cells


def freq_point(spark: SparkSession, directory: str) -> DataFrame:
    return cms_query(_medium(part_lines(spark, directory)), POINT_KEY)


def freq_point_by_group(spark: SparkSession, directory: str) -> DataFrame:
    """One user in each of a hundred groups of events; groups without the user answer 0."""
    sketch = cms_build(user_events(spark, directory), "key", MEDIUM.cms_width, MEDIUM.cms_depth, ["k"])
    return cms_query(sketch, RARE_KEY)


def freq_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """The estimate of every part, sold or not."""
    parts = read_table(spark, directory, "part").select(F.col("p_partkey").cast("string").alias("key"))
    return cms_lookup(_medium(part_lines(spark, directory)), parts)


def freq_lookup_by_group(spark: SparkSession, directory: str) -> DataFrame:
    """Estimates per return flag, by a join of keys and cells."""
    lines = part_lines(spark, directory)
    keys = lines.select("l_returnflag", "key").distinct()
    return cms_lookup(_medium(lines, by=["l_returnflag"]), keys)


def cms_fold_width(spark: SparkSession, directory: str) -> DataFrame:
    return cms_fold(_medium(part_lines(spark, directory)), LOW.cms_width).cells


def cms_merge_query(spark: SparkSession, directory: str) -> DataFrame:
    """Sketches of the returned lines and of the others, merged."""
    lines = part_lines(spark, directory)
    returned = _medium(lines.where(F.col("l_returnflag") == "R"))
    others = _medium(lines.where(F.col("l_returnflag") != "R"))
    return cms_merge(returned, others).cells


def cms_accuracy_query(spark: SparkSession, directory: str) -> DataFrame:
    return cms_accuracy(part_lines(spark, directory), "key", LOW.cms_width, LOW.cms_depth)


def cms_native_query(spark: SparkSession, directory: str) -> DataFrame:
    built = cms_native(part_lines(spark, directory), "key", MEDIUM.cms_width, MEDIUM.cms_depth, by=["l_returnflag"])
    return built.select("l_returnflag", F.octet_length("sketch").alias("sketch_bytes"))


def cms_native_check(spark: SparkSession, directory: str) -> DataFrame:
    """Size and total that Spark's own sketches say they have; the header of the value is big-endian."""
    built = cms_native(part_lines(spark, directory), "key", MEDIUM.cms_width, MEDIUM.cms_depth, by=["l_returnflag"])
    number = lambda at, size: F.conv(F.hex(F.substring("sketch", at, size)), 16, 10).cast("bigint")
    cells = F.octet_length("sketch") - 20 - 8 * number(13, 4)
    return built.select(
        "l_returnflag", number(5, 8).alias("total_count"), number(13, 4).alias("depth"), number(17, 4).alias("width"),
        (cells == 8 * number(13, 4) * number(17, 4)).cast("int").alias("whole"))


def cms_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """The smallest tables that keep targets of error and failure, one for each pair of tax and discount."""
    targets = read_table(spark, directory, "lineitem").select(
        ((F.col("l_tax") + 0.005) / 10).alias("epsilon"), (F.col("l_discount") + 0.005).alias("delta")).distinct()
    width, depth = cms_size_for(F.col("epsilon"), F.col("delta"))
    sized = targets.withColumns({"width": width, "depth": depth})
    kept = (cms_epsilon(F.col("width")) <= F.col("epsilon")) & (cms_delta(F.col("depth")) <= F.col("delta"))
    return sized.select(
        round_half_up(F.col("epsilon"), 6).alias("epsilon"), round_half_up(F.col("delta"), 6).alias("delta"), "width", "depth",
        kept.cast("int").alias("kept"), cms_memory_bytes(F.col("width"), F.col("depth")).alias("memory_bytes"))


RANGES = [(0, 9), (10, 99), (3, 57), (42, 42), (64, 127), (200, 300)]


def cms_range(spark: SparkSession, directory: str) -> DataFrame:
    """Counts of ranges of the property `k` of the events."""
    return range_counts(range_build(user_events(spark, directory), "k", 7, LOW.cms_width, LOW.cms_depth), RANGES)


def cms_inner_product(spark: SparkSession, directory: str) -> DataFrame:
    """How often a returned line and another line have the same part, by the sketches of both."""
    lines = part_lines(spark, directory)
    returned = F.col("l_returnflag") == "R"
    return inner_product(_medium(lines.where(returned)), _medium(lines.where(~returned)))


def drift_alert(spark: SparkSession, directory: str) -> DataFrame:
    """Days whose users differ from those of the day before."""
    daily = user_events(spark, directory).withColumn("day", time_bucket(F.col("ts"), "1 day"))
    found = drift(cms_build(daily, "key", LOW.cms_width, LOW.cms_depth, ["day"]), "day", "1 day", DRIFT_BELOW)
    return found.withColumn("similarity", round_half_up(F.col("similarity"), 9))


QUERIES = {
    "cms_range": cms_range,
    "cms_inner_product": cms_inner_product,
    "drift_alert": drift_alert,
    "cms_native_check": cms_native_check,
    "cms_sizes": cms_sizes,
    "cms_hash_cells": cms_hash_cells,
    "cms_hash_cells_any_width": cms_hash_cells_any_width,
    "cms_table": cms_table,
    "cms_table_direct": cms_table_direct,
    "cms_table_by_group": cms_table_by_group,
    "cms_weighted_table": cms_weighted_table,
    "freq_point": freq_point,
    "freq_point_by_group": freq_point_by_group,
    "freq_lookup": freq_lookup,
    "freq_lookup_by_group": freq_lookup_by_group,
    "cms_fold_width": cms_fold_width,
    "cms_merge": cms_merge_query,
    "cms_accuracy": cms_accuracy_query,
    "cms_native": cms_native_query,
}


def _touched(width: int, depth: int) -> str:
    return (
        "select cast(p_partkey as varchar) as key, r::int as row_id, "
        f"(md5_number_upper(cast(p_partkey as varchar) || ':' || r) % {width})::int as col_id "
        f"from part, range({depth}) t(r)"
    )


_W, _D = MEDIUM.cms_width, MEDIUM.cms_depth
_BASE = {"src": LINES_SQL, "kc": sql.counts("src")}
_TABLE = {**_BASE, "cells": sql.cells("kc", _W, _D)}
_BY = ["l_returnflag"]
_BY_TABLE = {
    "src": LINES_SQL,
    "kc": sql.counts("src", _BY),
    "cells": sql.cells("kc", _W, _D, _BY),
}
_ALL_CELLS = "select row_id, col_id, cnt from cells"

def _range_sql() -> str:
    """The nodes of each range looked up in the cells of their levels."""
    nodes = ", ".join(f"({a}, {b}, {level}, '{node}')" for a, b in RANGES for level, node in dyadic_nodes(a, b, 7))
    every = ", ".join(f"({a}, {b})" for a, b in RANGES)
    steps = {
        "nodes": (
            "select l::int as level, (k >> l)::varchar as key, count(*) as n "
            f"from ({EVENTS_SQL}), range(8) t(l) where k between 0 and 127 group by all"
        ),
        "cells": sql.cells("nodes", LOW.cms_width, LOW.cms_depth, ["level"]),
        "asked": f"select * from (values {nodes}) v(low, high, level, key)",
        "found": (
            "select low, high, a.level, a.key, min(coalesce(cnt, 0)) as least from (select *, r::int as row_id, "
            f"(md5_number_upper(key || ':' || r) % {LOW.cms_width})::int as col_id from asked, range({LOW.cms_depth}) t(r)) a "
            "left join cells c on c.level = a.level and c.row_id = a.row_id and c.col_id = a.col_id group by 1, 2, 3, 4"
        ),
        "every": f"select * from (values {every}) v(low, high)",
    }
    return sql.with_steps(
        steps, "select e.low::bigint as low, e.high::bigint as high, coalesce(sum(least), 0)::bigint as estimate "
        "from every e left join found f on f.low = e.low and f.high = e.high group by 1, 2")


_DAILY = {
    "daily": f"select date_trunc('day', ts)::timestamp as day, key, count(*) as n from ({EVENTS_SQL}) group by all",
    "cells": sql.cells("daily", LOW.cms_width, LOW.cms_depth, ["day"]),
    "norms": "select day, row_id, sum(cnt * cnt)::bigint as norm from cells group by all",
    "dots": (
        "select a.day, a.row_id, sum(a.cnt * b.cnt)::bigint as dot from cells a join cells b on b.day = a.day - interval '1 day' "
        "and b.row_id = a.row_id and b.col_id = a.col_id group by all"
    ),
    "pairs": (
        "select a.day, b.day as previous, min(coalesce(dot, 0) / sqrt(a.norm::double * b.norm::double)) as s from norms a "
        "join norms b on b.day = a.day - interval '1 day' and b.row_id = a.row_id "
        "left join dots d on d.day = a.day and d.row_id = a.row_id group by all"
    ),
}

ORACLES = {
    "cms_range": _range_sql(),
    "cms_inner_product": sql.with_steps(
        {
            "kc": f"select key, l_returnflag = 'R' as back, count(*) as n from ({LINES_SQL}) group by all",
            "a": sql.cells("(select key, n from kc where back)", _W, _D),
            "b": sql.cells("(select key, n from kc where not back)", _W, _D),
            "products": "select row_id, sum(a.cnt * b.cnt)::bigint as p from a join b using (row_id, col_id) group by 1",
        },
        f"select case when count(*) = {_D} then min(p) else 0 end as estimate from products",
    ),
    "drift_alert": sql.with_steps(
        _DAILY, f"select day, previous, {sql.rhu('s', 9)} as similarity, (s < {DRIFT_BELOW}::double)::int as alert from pairs"),
    "cms_native_check": (
        f"select l_returnflag, count(*) as total_count, {_D}::bigint as depth, {_W}::bigint as width, 1 as whole "
        "from lineitem group by 1"
    ),
    "cms_sizes": (
        "with targets as (select distinct (l_tax + 0.005::double) / 10 as epsilon, l_discount + 0.005::double as delta from lineitem), "
        f"sized as (select *, greatest(ceil({sql.E} / epsilon), 1)::int as width, greatest(ceil(ln(1.0::double / delta)), 1)::int as depth "
        f"from targets) select {sql.rhu('epsilon', 6)} as epsilon, {sql.rhu('delta', 6)} as delta, width, depth, "
        f"({sql.E} / width <= epsilon and exp(-depth) <= delta)::int as kept, (width * depth * 8)::bigint as memory_bytes from sized"
    ),
    "cms_hash_cells": _touched(_W, _D),
    "cms_hash_cells_any_width": _touched(1000, 3),
    "cms_table": sql.with_steps(_TABLE, _ALL_CELLS),
    "cms_table_direct": sql.with_steps(_TABLE, _ALL_CELLS),
    "cms_merge": sql.with_steps(_TABLE, _ALL_CELLS),
    "cms_table_by_group": sql.with_steps(_BY_TABLE, "select * from cells"),
    "cms_weighted_table": sql.with_steps(
        {
            "src": LINES_SQL,
            "kc": sql.counts("src", amount="sum(cast(l_quantity as bigint))"),
            "cells": sql.cells("kc", _W, _D),
        },
        _ALL_CELLS,
    ),
    "freq_point": sql.with_steps(
        {**_TABLE, "wanted": f"select '{POINT_KEY}' as key"}, sql.estimates("wanted", "cells", _W, _D)
    ),
    "freq_point_by_group": sql.with_steps(
        {
            "src": EVENTS_SQL,
            "kc": sql.counts("src", ["k"]),
            "cells": sql.cells("kc", _W, _D, ["k"]),
            "touched": (
                f"select k, r::int as row_id, (md5_number_upper('{RARE_KEY}:' || r) % {_W})::int as col_id "
                f"from (select distinct k from src), range({_D}) t(r)"
            ),
        },
        f"select k, '{RARE_KEY}' as key, min(coalesce(cnt, 0))::bigint as estimate "
        "from touched left join cells using (k, row_id, col_id) group by all",
    ),
    "freq_lookup": sql.with_steps(
        {**_TABLE, "wanted": "select cast(p_partkey as varchar) as key from part"},
        sql.estimates("wanted", "cells", _W, _D),
    ),
    "freq_lookup_by_group": sql.with_steps(
        {
            **_BY_TABLE,
            "touched": (
                "select l_returnflag, key, r::int as row_id, "
                f"(md5_number_upper(key || ':' || r) % {_W})::int as col_id from kc, range({_D}) t(r)"
            ),
        },
        "select l_returnflag, key, min(coalesce(cnt, 0))::bigint as estimate "
        "from touched left join cells using (l_returnflag, row_id, col_id) group by all",
    ),
    "cms_fold_width": sql.with_steps(
        {**_BASE, "cells": sql.cells("kc", LOW.cms_width, _D)}, _ALL_CELLS
    ),
    "cms_accuracy": sql.with_steps(
        {
            **_BASE,
            "cells": sql.cells("kc", LOW.cms_width, LOW.cms_depth),
            "est": sql.estimates("kc", "cells", LOW.cms_width, LOW.cms_depth),
        },
        "select key, n as true_count, estimate, estimate - n as over_count, "
        f"{sql.E} / {LOW.cms_width} * (select sum(n)::bigint from kc) as error_bound "
        "from kc join est using (key)",
    ),
}
