"""Event streams as batches, by the same operators; limits judged over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events
from .registry import query, statement, table

statement("json_props", "SELECT event_id, CAST(<<get_json_object(props, '$.k')||json_extract_string(props, '$.k')>> AS BIGINT) AS k FROM {events}")
statement(
    "events_sliding",
    "SELECT w, event_type, count(*) AS n FROM (SELECT event_type, <<date_trunc('HOUR', ts) - k * INTERVAL 1 HOUR||date_trunc('hour', ts) - k * INTERVAL 1 HOUR>> AS w FROM {events} CROSS JOIN (VALUES (0), (1), (2)) AS t(k)) x GROUP BY w, event_type",
)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# Two events in six hours and five in a day are allowed a user; those refused don't count, so each is judged after those before it.
@query(
    "rate_limit_windows",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}),
j AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS times, NULL::BIGINT AS wait FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, n, event_id, CASE WHEN wait IS NULL THEN list_append(times, us) ELSE times END, wait FROM (
    SELECT *, CASE WHEN len(short) >= 2 THEN greatest(1, ceil((short[1] + 21600000000 - us) / 1000000.0)::BIGINT) WHEN len(long) >= 5 THEN greatest(1, ceil((long[1] + 86400000000 - us) / 1000000.0)::BIGINT) END AS wait
    FROM (SELECT e.user_id, e.n, e.event_id, e.us, j.times, list_filter(j.times, lambda t: t > e.us - 21600000000) AS short, list_filter(j.times, lambda t: t > e.us - 86400000000) AS long FROM j JOIN e ON e.user_id = j.user_id AND e.n = j.n + 1)))
SELECT event_id, wait IS NULL AS allowed, wait AS retry_after FROM j WHERE n > 0""",
)
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.limits(log(spark, sf_dir), "user_id", ((21600, 2), (86400, 5))).select("event_id", "allowed", "retry_after")


@query("events_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.tumbling(log(spark, sf_dir)).withColumns({"total": F.round("total", 4), "hour": F.col("hour").cast("timestamp_ntz")})


@query(
    "events_sessions",
    """WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM {events}),
numbered AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n FROM numbered GROUP BY user_id, session""",
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(log(spark, sf_dir)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_event")})


# An answer lives a day: a user's first event asks, and then the first one a day or more after the last that asked.
@query(
    "ttl_cache",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}),
j AS (SELECT event_id, user_id, n, ts AS answered, false AS cached FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.ts - j.answered < INTERVAL 1 DAY THEN j.answered ELSE e.ts END, e.ts - j.answered < INTERVAL 1 DAY FROM j JOIN e ON e.user_id = j.user_id AND e.n = j.n + 1)
SELECT event_id, cached FROM j""",
)
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.limits(log(spark, sf_dir), "user_id", ((86400, 1),)).select("event_id", (~F.col("allowed")).alias("cached"))
