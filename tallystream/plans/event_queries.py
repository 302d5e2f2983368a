"""Queries over event messages and generated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.numbers import round_half_up
from tallystream.plans import sql
from tallystream.plans.inputs import EVENTS_SQL, user_events
from tallystream.session import read_table
from tallystream.sources.events import event_message, parse_messages
from tallystream.sources.zipf import zipf_cdf, zipf_keys

ZIPF_ITEMS = 10_000
ZIPF_S = 1.2
SEED = 7
DRIFT_START = "2024-01-01 00:00:00"


def json_event_parse(spark: SparkSession, directory: str) -> DataFrame:
    """Every event as a message and parsed back, with `k` out of the JSON properties."""
    events = user_events(spark, directory)
    messages = events.select("event_id", "k", event_message(F.col("key"), F.col("ts")).alias("value"))
    return parse_messages(messages).select("event_id", "key", "ts", "k", "reason")


def event_quarantine(spark: SparkSession, directory: str) -> DataFrame:
    """All messages, some of them damaged, counted by verdict."""
    events = user_events(spark, directory)
    message = event_message(F.col("key"), F.col("ts"))
    damaged = (
        F.when(F.col("k") < 10, F.substring(message, 1, 9))
        .when(F.col("k") < 20, F.regexp_replace(message, '"key":"[^"]*"', '"key":42'))
        .when(F.col("k") < 30, F.regexp_replace(message, '"key":"[^"]*"', '"key":""'))
        .when(F.col("k") < 40, F.regexp_replace(message, '"key":', '"name":'))
        .when(F.col("k") < 45, F.regexp_replace(message, '"ts":[0-9.]*', '"ts":1.7e15'))
        .when(F.col("k") < 50, F.regexp_replace(message, '"ts":', '"ts":-'))
        .otherwise(message)
    )
    parsed = parse_messages(events.select(damaged.alias("value")))
    return parsed.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("distinct_keys")
    )


def event_to_json(spark: SparkSession, directory: str) -> DataFrame:
    events = user_events(spark, directory)
    return events.select("event_id", event_message(F.col("key"), F.col("ts")).alias("value"))


def zipf_cdf_query(spark: SparkSession, directory: str) -> DataFrame:
    """The cumulative distribution over all parts, ranked by their key."""
    ranks = read_table(spark, directory, "part").select((F.col("p_partkey") + 1).alias("rank"))
    cdf = zipf_cdf(ranks, "rank", ZIPF_S)
    return cdf.select("rank", round_half_up(F.col("cdf"), 9).alias("cdf"))


def zipf_events(spark: SparkSession, directory: str) -> DataFrame:
    """A Zipf key drawn for every event."""
    events = read_table(spark, directory, "events").select("event_id", "ts")
    return zipf_keys(events, "event_id", ZIPF_ITEMS, ZIPF_S, SEED).select("event_id", "key")


def zipf_drift_events(spark: SparkSession, directory: str) -> DataFrame:
    """The same with all ranks rotated anew each day."""
    events = read_table(spark, directory, "events").select("event_id", "ts")
    start = F.lit(DRIFT_START).cast("timestamp_ntz")
    drawn = zipf_keys(
        events, "event_id", ZIPF_ITEMS, ZIPF_S, SEED, ts="ts", shift_interval="1 day", start=start
    )
    return drawn.select("event_id", "key")


QUERIES = {
    "json_event_parse": json_event_parse,
    "event_quarantine": event_quarantine,
    "event_to_json": event_to_json,
    "zipf_cdf": zipf_cdf_query,
    "zipf_events": zipf_events,
    "zipf_drift_events": zipf_drift_events,
}

_MESSAGE = (
    "'{\"key\":\"' || key || '\",\"ts\":' || (epoch_us(ts) // 1000000)::bigint || '.' || "
    "lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') || '}'"
)
_DAMAGED = (
    "case when k < 10 then substr(msg, 1, 9) "
    "when k < 20 then regexp_replace(msg, '\"key\":\"[^\"]*\"', '\"key\":42') "
    "when k < 30 then regexp_replace(msg, '\"key\":\"[^\"]*\"', '\"key\":\"\"') "
    "when k < 40 then replace(msg, '\"key\":', '\"name\":') "
    "when k < 45 then regexp_replace(msg, '\"ts\":[0-9.]*', '\"ts\":1.7e15') "
    "when k < 50 then replace(msg, '\"ts\":', '\"ts\":-') else msg end"
)
_WEIGHTS = "1.0::double / pow(rank::double, 1.2::double)"


def _zipf_steps() -> dict[str, str]:
    return {
        "ranks": f"select r as rank, {_WEIGHTS} as w from range(1, {ZIPF_ITEMS + 1}) t(r)".replace(
            "pow(rank", "pow(r"
        ),
        "cdf": (
            "select rank, case when rank = max(rank) over () then 1.0::double else "
            "sum(w) over (order by rank) / sum(w) over () end as hi from ranks"
        ),
        "slices": "select rank, hi, coalesce(lag(hi) over (order by rank), 0.0::double) as lo from cdf",
        "drawn": (
            "select event_id, ts, "
            f"(md5_number_upper('{SEED}:' || event_id) >> 12)::double / 4503599627370496.0::double as u "
            "from events"
        ),
        "placed": "select event_id, ts, rank - 1 as r0 from drawn join slices on u >= lo and u < hi",
    }


ORACLES = {
    "json_event_parse": f"select event_id, key, ts, k, 'ok' as reason from ({EVENTS_SQL})",
    "event_quarantine": sql.with_steps(
        {
            "ev": EVENTS_SQL,
            "msgs": f"select k, {_MESSAGE} as msg from ev",
            "vals": f"select {_DAMAGED} as v from msgs",
            "good": "select v, json_valid(v) as ok from vals",
            "judged": (
                "select v, case when not ok then 'malformed' "
                "when json_type(v, '$.key') is null then 'missing_key' "
                "when json_type(v, '$.key') <> 'VARCHAR' then 'non_string_key' "
                "when json_extract_string(v, '$.key') = '' then 'empty_key' "
                "when not json_extract_string(v, '$.ts')::double between 0 and 253402300799 then 'bad_ts' "
                "else 'ok' end as reason from good"
            ),
        },
        "select reason, count(*) as n, count(distinct case when reason = 'ok' then "
        "json_extract_string(v, '$.key') end) as distinct_keys from judged group by reason",
    ),
    "event_to_json": f"select event_id, {_MESSAGE} as value from ({EVENTS_SQL})",
    "zipf_cdf": (
        f"select rank, {sql.rhu('case when rank = max(rank) over () then 1.0::double else '
        'sum(w) over (order by rank) / sum(w) over () end', 9)} as cdf "
        f"from (select rank, {_WEIGHTS} as w from (select p_partkey + 1 as rank from part))"
    ),
    "zipf_events": sql.with_steps(
        _zipf_steps(), "select event_id, 'item_' || (r0 + 1) as key from placed"
    ),
    "zipf_drift_events": sql.with_steps(
        {
            **_zipf_steps(),
            "rotated": (
                "select event_id, r0, date_diff('day', timestamp '2024-01-01', ts) as epoch from placed"
            ),
        },
        "select event_id, 'item_' || ((r0 + case when epoch <= 0 then 0 else "
        f"(md5_number_upper('{SEED}:' || epoch) % {ZIPF_ITEMS})::bigint end) % {ZIPF_ITEMS} + 1) as key "
        "from rotated",
    ),
}
