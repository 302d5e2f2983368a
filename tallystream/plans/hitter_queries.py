"""Heavy-hitter and window queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.formulas import mg_error, mg_memory_bytes
from tallystream.operators import heavy_hitters as hh
from tallystream.operators import percentiles as pc
from tallystream.operators import windows as win
from tallystream.operators.keys import key_counts, keyed
from tallystream.operators.ordered import TAKE_ORDERED_MAX, last_n_per_group
from tallystream.plans import sql
from tallystream.plans.inputs import (
    DIRTY_SQL, EVENTS_SQL, LINES_SQL, dirty_events, part_lines, percentile_sql, user_events,
)
from tallystream.session import read_table

K = 200
TRACKED = 10_000
WINDOW, BUCKET = "12 hours", "1 hour"
NARROW = "6 hours"


def heavy_hitters(spark: SparkSession, directory: str) -> DataFrame:
    """Summary of the part keys, with its error bound and size."""
    lines = part_lines(spark, directory)
    total = keyed(lines, "key").agg(F.count(F.lit(1))).scalar()
    return hh.mg_summary(lines, "key", K).select(
        "key", "est", mg_error(total, K).alias("error_bound"), mg_memory_bytes(K).alias("memory_bytes")
    )


def heavy_hitters_bounded(spark: SparkSession, directory: str) -> DataFrame:
    return hh.mg_summary_bounded(part_lines(spark, directory), "key", K)


def mg_merge(spark: SparkSession, directory: str) -> DataFrame:
    lines = part_lines(spark, directory)
    returned = hh.mg_summary(lines.where(F.col("l_returnflag") == "R"), "key", K)
    others = hh.mg_summary(lines.where(F.col("l_returnflag") != "R"), "key", K)
    return hh.mg_merge(returned, others, k=K)


def heavy_hitters_min(spark: SparkSession, directory: str) -> DataFrame:
    return hh.heavy_hitters(hh.mg_summary(part_lines(spark, directory), "key", K), 5)


def top_n(spark: SparkSession, directory: str) -> DataFrame:
    return hh.top_n(hh.mg_summary(part_lines(spark, directory), "key", K), 10)


def top_n_per_group(spark: SparkSession, directory: str) -> DataFrame:
    by = ["l_returnflag", "l_linestatus"]
    return hh.top_n(hh.mg_summary(part_lines(spark, directory), "key", K, by), 10, by)


def top_share(spark: SparkSession, directory: str) -> DataFrame:
    events = user_events(spark, directory)
    total = keyed(events, "key").agg(F.count(F.lit(1))).scalar()
    return hh.top_share(hh.mg_summary(events, "key", K), total, 12)


def weighted_heavy_hitters(spark: SparkSession, directory: str) -> DataFrame:
    return hh.mg_summary(part_lines(spark, directory), "key", K, weight="l_quantity")


def approx_top_k_native(spark: SparkSession, directory: str) -> DataFrame:
    return hh.approx_top_k_native(user_events(spark, directory), "key", 10)


def approx_top_k_check(spark: SparkSession, directory: str) -> DataFrame:
    """Spark's frequent items against exact counts: the promised error broken, or a clearly more frequent key left out?"""
    events = user_events(spark, directory)
    exact = key_counts(events, "key")
    slack = exact.agg(F.sum("n") * 3.5 / TRACKED).scalar()
    both = exact.join(hh.approx_top_k_native(events, "key", 10, TRACKED, exact), "key", "left").withColumn("slack", slack)
    return both.agg(
        F.count("est").alias("items"), F.sum("n").alias("total"),
        F.count_if(F.abs(F.col("est") - F.col("n")) > F.col("slack")).alias("wrong"),
        F.greatest(F.count_if(F.col("est").isNull() & (F.col("n") > F.col("slack") + _tenth(exact))), F.lit(0)).alias("missed"))


def _tenth(exact: DataFrame) -> Column:
    """The tenth largest count."""
    return exact.orderBy(F.col("n").desc()).limit(10).agg(F.min("n")).scalar()


def sliding_heavy_hitters(spark: SparkSession, directory: str) -> DataFrame:
    return win.windowed_heavy_hitters(user_events(spark, directory), "key", "ts", 20, WINDOW, BUCKET)


def resize_window(spark: SparkSession, directory: str) -> DataFrame:
    """The same buckets under another k and window length."""
    buckets = win.bucket_counts(user_events(spark, directory), "key", "ts", BUCKET)
    return win.sliding_heavy_hitters(buckets, 50, NARROW, BUCKET)


def last_n_heavy_hitters(spark: SparkSession, directory: str) -> DataFrame:
    return win.last_n_heavy_hitters(user_events(spark, directory), "key", "ts", "event_id", K, 10_000)


def last_n_heavy_hitters_by_group(spark: SparkSession, directory: str) -> DataFrame:
    events = user_events(spark, directory)
    return win.last_n_heavy_hitters(events, "key", "ts", "event_id", K, 5_000, ["event_type"])


def window_totals(spark: SparkSession, directory: str) -> DataFrame:
    return win.window_totals(user_events(spark, directory), "key", "ts", WINDOW, BUCKET)


def tumbling_report(spark: SparkSession, directory: str) -> DataFrame:
    return win.tumbling_report(user_events(spark, directory), "key", "ts", "6 hours")


def running_total(spark: SparkSession, directory: str) -> DataFrame:
    return win.running_total(user_events(spark, directory), "key", "ts", "1 day", ["event_type"])


def dirty_keys(spark: SparkSession, directory: str) -> DataFrame:
    """Null and empty keys, null groups, times and values: what each operator counts per group."""
    events, by = dirty_events(spark, directory), ["event_type"]
    spread = [F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")]
    none = F.lit(None).cast("bigint")
    parts = [
        last_n_per_group(events, by, "ts", "event_id", n).groupBy("event_type").agg(*spread)
        .select(F.lit(f"last {n}").alias("what"), "event_type", "n", "lo", "hi")
        for n in (TAKE_ORDERED_MAX, TAKE_ORDERED_MAX + 1)
    ]
    parts.append(hh.mg_summary(events, "key", K, by).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("est").alias("lo"), F.max("est").alias("hi")
    ).select(F.lit("summary").alias("what"), "event_type", "n", "lo", "hi"))
    parts.append(win.running_total(events, "key", "ts", "1 day", by).groupBy("event_type").agg(
        F.sum("n").alias("n")).select(F.lit("total").alias("what"), "event_type", "n", none.alias("lo"), none.alias("hi")))
    parts += [
        percentiles.select(
            F.lit(what).alias("what"), "event_type", F.col("samples").alias("n"),
            F.round(F.col("p50") * 100).cast("bigint").alias("lo"), F.round(F.col("p99") * 100).cast("bigint").alias("hi"))
        for what, percentiles in (
            ("rolling", pc.rolling_percentiles(events, "value", "ts", "event_id", by, 10_000)),
            ("rolling by ranks", pc.rolling_percentiles(events, "value", "ts", "event_id", by, 10_001)),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


def rolling_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    events = user_events(spark, directory)
    return pc.rolling_percentiles(events, "value", "ts", "event_id", ["event_type"])


def whole_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    return pc.exact_percentiles(user_events(spark, directory), "value", ["event_type"])


def p99_exact(spark: SparkSession, directory: str) -> DataFrame:
    return pc.exact_percentiles(read_table(spark, directory, "lineitem"), "l_extendedprice", ps=(99,))


def p99_approx(spark: SparkSession, directory: str) -> DataFrame:
    return pc.approx_percentiles(read_table(spark, directory, "lineitem"), "l_extendedprice", ps=(99,))


def heavy_hitters_bounded_check(spark: SparkSession, directory: str) -> DataFrame:
    """The bounded summary against exact counts: keys above N/k, and broken promises of each kind."""
    lines = part_lines(spark, directory)
    exact = key_counts(lines, "key")
    bound = exact.agg(F.sum("n") / K).scalar()
    both = exact.join(hh.mg_summary_bounded(lines, "key", K), "key", "left").withColumn("bound", bound)
    return both.agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") > F.col("bound")).alias("heavy"),
        F.count_if(F.col("est") > F.col("n")).alias("over"),
        F.count_if(F.col("n") - F.coalesce("est", F.lit(0)) > F.col("bound")).alias("under"))


def p99_approx_check(spark: SparkSession, directory: str) -> DataFrame:
    """Rank of the approximate p99 among all prices: further from 99 % than the summary's accuracy allows?"""
    lines = read_table(spark, directory, "lineitem")
    found = pc.approx_percentiles(lines, "l_extendedprice", ps=(99,)).select("p99").scalar()
    ranks = lines.select("l_extendedprice", found.alias("p99")).agg(
        F.count("l_extendedprice").alias("samples"),
        F.count_if(F.col("l_extendedprice") < F.col("p99")).alias("below"),
        F.count_if(F.col("l_extendedprice") <= F.col("p99")).alias("upto"))
    slack = F.col("samples") / 10_000 + 1
    off = (F.col("below") > 0.99 * F.col("samples") + slack) | (F.col("upto") < 0.99 * F.col("samples") - slack)
    return ranks.select("samples", off.cast("bigint").alias("violations"))


QUERIES = {
    "heavy_hitters": heavy_hitters,
    "heavy_hitters_bounded_check": heavy_hitters_bounded_check,
    "p99_approx_check": p99_approx_check,
    "heavy_hitters_bounded": heavy_hitters_bounded,
    "mg_merge": mg_merge,
    "heavy_hitters_min": heavy_hitters_min,
    "top_n": top_n,
    "top_n_per_group": top_n_per_group,
    "top_share": top_share,
    "weighted_heavy_hitters": weighted_heavy_hitters,
    "approx_top_k_native": approx_top_k_native,
    "approx_top_k_check": approx_top_k_check,
    "sliding_heavy_hitters": sliding_heavy_hitters,
    "resize_window": resize_window,
    "last_n_heavy_hitters": last_n_heavy_hitters,
    "last_n_heavy_hitters_by_group": last_n_heavy_hitters_by_group,
    "window_totals": window_totals,
    "dirty_keys": dirty_keys,
    "tumbling_report": tumbling_report,
    "running_total": running_total,
    "rolling_percentiles": rolling_percentiles,
    "whole_percentiles": whole_percentiles,
    "p99_exact": p99_exact,
    "p99_approx": p99_approx,
}

_LINES = {"src": LINES_SQL, "kc": sql.counts("src")}
_MG = {**_LINES, "mg": sql.summary("kc", K)}
_GROUP = ["l_returnflag", "l_linestatus"]
_RANK = "row_number() over (order by est desc, key)::int as rank"


def _sliding(k: int, hours: int) -> str:
    return sql.with_steps(
        {
            "src": f"select *, time_bucket(interval '1 hour', ts) as bucket from ({EVENTS_SQL})",
            "bc": sql.counts("src", ["bucket"]),
            "wc": (
                f"select bucket + i * interval '1 hour' - interval '{hours} hours' as window_start, "
                "bucket + i * interval '1 hour' as window_end, key, sum(n)::bigint as n "
                f"from bc, range(1, {hours + 1}) t(i) group by all"
            ),
        },
        sql.summary("wc", k, ["window_start", "window_end"]),
    )


def _recent(n: int, by: list[str]) -> str:
    part = f"partition by {', '.join(by)} " if by else ""
    return (
        f"select * from (select *, row_number() over ({part}order by ts desc, event_id desc) as rn "
        f"from ({EVENTS_SQL})) where rn <= {n}"
    )


def _percentiles(source: str, by: list[str], ps: tuple[int, ...], value: str = "value") -> str:
    columns = ", ".join(f"{percentile_sql('vals', 'samples', p)} as p{p}" for p in ps)
    keys = "".join(f"{c}, " for c in by)
    group = f" group by {', '.join(by)}" if by else ""
    return (
        f"select {keys}samples, {columns} from (select {keys}count(*) as samples, "
        f"list_sort(list({value})) as vals from {source}{group})"
    )


ORACLES = {
    "heavy_hitters_bounded_check": sql.with_steps(
        {"src": LINES_SQL, "kc": sql.counts("src")},
        f"select sum(n)::bigint as total, count(*) filter (n > (select sum(n) from kc) / {K}::double) as heavy, "
        "0::bigint as over, 0::bigint as under from kc",
    ),
    "p99_approx_check": "select count(l_extendedprice) as samples, 0::bigint as violations from lineitem",
    "heavy_hitters": sql.with_steps(
        _MG,
        f"select key, est, (select count(key) from src) / {K} as error_bound, "
        f"{K * 100}::bigint as memory_bytes from mg",
    ),
    "mg_merge": sql.with_steps(
        {
            "src": LINES_SQL,
            "r": "select * from src where l_returnflag = 'R'",
            "o": "select * from src where l_returnflag <> 'R'",
            "rc": sql.counts("r"),
            "oc": sql.counts("o"),
            "rs": sql.summary("rc", K),
            "os": sql.summary("oc", K),
            "pair": "select * from rs union all select * from os",
            "added": "select key, sum(est)::bigint as n from pair group by key",
        },
        sql.summary("added", K),
    ),
    "heavy_hitters_min": sql.with_steps(_MG, "select key, est from mg where est >= 5"),
    "top_n": sql.with_steps(
        _MG, f"select key, est, {_RANK} from mg qualify rank <= 10"
    ),
    "top_n_per_group": sql.with_steps(
        {"src": LINES_SQL, "kc": sql.counts("src", _GROUP), "mg": sql.summary("kc", K, _GROUP)},
        "select l_returnflag, l_linestatus, key, est, row_number() over (partition by l_returnflag, "
        "l_linestatus order by est desc, key)::int as rank from mg qualify rank <= 10",
    ),
    "top_share": sql.with_steps(
        {"src": EVENTS_SQL, "kc": sql.counts("src"), "mg": sql.summary("kc", K)},
        f"select key, est, {_RANK}, least(100.0::double * est / (select count(key) from src), "
        "100.0::double) as share from mg qualify rank <= 12",
    ),
    "weighted_heavy_hitters": sql.with_steps(
        {"src": LINES_SQL, "kc": sql.counts("src", amount="sum(cast(l_quantity as bigint))")},
        sql.summary("kc", K),
    ),
    "sliding_heavy_hitters": _sliding(20, 12),
    "resize_window": _sliding(50, 6),
    "last_n_heavy_hitters": sql.with_steps(
        {"src": _recent(10_000, []), "kc": sql.counts("src")}, sql.summary("kc", K)
    ),
    "last_n_heavy_hitters_by_group": sql.with_steps(
        {"src": _recent(5_000, ["event_type"]), "kc": sql.counts("src", ["event_type"])},
        sql.summary("kc", K, ["event_type"]),
    ),
    "dirty_keys": sql.with_steps(
        {
            "ev": DIRTY_SQL,
            "src": "select * from ev where key <> ''",
            "kc": sql.counts("src", ["event_type"]),
            "mg": sql.summary("kc", K, ["event_type"]),
            "timed": (
                "select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn "
                "from ev where ts is not null"
            ),
            **{
                f"recent{n}": f"select event_type, list_sort(list(value) filter (value is not null)) as vals, "
                f"count(value) as m from timed where rn <= {n} group by 1" for n in (10_000, 10_001)
            },
        },
        " union all ".join([
            *[f"select 'last {n}' as what, event_type, count(*)::bigint as n, min(event_id) as lo, max(event_id) as hi "
              f"from timed where rn <= {n} group by all" for n in (TAKE_ORDERED_MAX, TAKE_ORDERED_MAX + 1)],
            "select 'summary', event_type, count(*), min(est), max(est) from mg group by all",
            "select 'total', event_type, count(*), null, null from src where ts is not null group by all",
            *[f"select '{what}', event_type, m, coalesce(round({percentile_sql('vals', 'm', 50)} * 100), 0)::bigint, "
              f"coalesce(round({percentile_sql('vals', 'm', 99)} * 100), 0)::bigint from recent{n}"
              for what, n in (("rolling", 10_000), ("rolling by ranks", 10_001))],
        ]),
    ),
    "window_totals": sql.with_steps(
        {
            "bc": (
                "select time_bucket(interval '1 hour', ts) as bucket, count(*) as n from events group by 1"
            )
        },
        "select bucket + i * interval '1 hour' - interval '12 hours' as window_start, "
        "bucket + i * interval '1 hour' as window_end, sum(n)::bigint as window_total "
        "from bc, range(1, 13) t(i) group by all",
    ),
    "tumbling_report": sql.with_steps(
        {
            "src": f"select *, time_bucket(interval '6 hours', ts) as bucket from ({EVENTS_SQL})",
            "bc": sql.counts("src", ["bucket"]),
            "busy": "select bucket, sum(n)::bigint as n from bc group by 1",
            "top": (
                "select bucket, key as top_key, n as top_count from bc "
                "qualify row_number() over (partition by bucket order by n desc, key) = 1"
            ),
            "ticks": (
                "select unnest(generate_series(min(bucket), max(bucket), interval '6 hours')) as tick "
                "from busy"
            ),
        },
        "select tick, coalesce(n, 0) as n, top_key, top_count, "
        "(sum(coalesce(n, 0)) over (order by tick))::bigint as total_count "
        "from ticks left join busy on busy.bucket = tick left join top on top.bucket = tick",
    ),
    "running_total": sql.with_steps(
        {
            "daily": (
                "select event_type, date_trunc('day', ts)::timestamp as bucket, count(*) as n "
                "from events group by all"
            )
        },
        "select event_type, bucket, n, (sum(n) over (partition by event_type order by bucket))::bigint "
        "as total_count from daily",
    ),
    "rolling_percentiles": sql.with_steps(
        {"src": _recent(500, ["event_type"])}, _percentiles("src", ["event_type"], (50, 95, 99))
    ),
    "approx_top_k_check": (
        "select least(count(distinct user_id), 10) as items, count(user_id) as total, 0::bigint as wrong, 0::bigint as missed from events"
    ),
    "whole_percentiles": _percentiles("events", ["event_type"], (50, 95, 99)),
    "p99_exact": _percentiles("lineitem", [], (99,), "l_extendedprice"),
}
