"""Notices against firms: filters with all their reasons, scores, ranks, normalisation and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import firm_name
from ..operators.sinks import insert_or_ignore, keep_columns, replace_group
from ..operators.upsert import recomputed, stale, upsert
from ..sources import federal_csv, releases
from .frames import NOTICES, NOW
from .registry import query, statement, table
from .rules import dealt

statement("source_counts", "SELECT source, count(*) AS n FROM {documents} GROUP BY source")
statement("staleness_probe", "SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS versions, min(o_orderpriority) AS version FROM {orders}")
statement(
    "next_closing_sample",
    f"WITH {NOTICES} SELECT notice_id, status, closing_ts, value FROM notices n ORDER BY CASE WHEN closing_ts < {NOW} THEN 1 ELSE 0 END, CASE WHEN closing_ts >= {NOW} THEN closing_ts END, closing_ts DESC, notice_id DESC LIMIT 50",
)

UPSERT_ORACLE = """
WITH old AS (SELECT event_id, user_id, event_type, value FROM {events} WHERE event_id % 3 <> 0),
batch AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 'corrected' ELSE event_type END AS event_type, value FROM {events} WHERE event_id % 2 = 0),
merged AS (SELECT coalesce(o.event_id, b.event_id) AS event_id, o.event_id IS NULL AS is_new, b.event_id IS NULL AS kept, o.event_type AS old_type, b.event_type AS new_type, coalesce(b.user_id, o.user_id) AS user_id, coalesce(b.value, o.value) AS value
         FROM old o FULL JOIN batch b ON o.event_id = b.event_id),
done AS (SELECT event_id, user_id, coalesce(new_type, old_type) AS event_type, value, CASE WHEN kept THEN 'kept' WHEN is_new THEN 'inserted' WHEN old_type = new_type THEN 'unchanged' ELSE 'updated' END AS action FROM merged)
"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the events are known; half come again, each from two batches of which the later counts."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    old = events.where("event_id % 3 <> 0").withColumns({"created_at": F.lit("2024-01-01"), "updated_at": F.lit("2024-01-01")})
    half = events.where("event_id % 2 = 0")
    batch = half.withColumn("pos", F.lit(0)).union(half.withColumn("event_type", F.when(F.col("event_id") % 5 == 0, "corrected").otherwise(F.col("event_type"))).withColumn("pos", F.lit(1)))
    return upsert(old, batch, ["event_id"], ["user_id", "event_type", "value"], ["pos"], F.lit("2024-02-01"))


@query("upsert_tally", UPSERT_ORACLE + "SELECT action, count(*) AS n FROM done GROUP BY action")
def upsert_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("upsert_snapshot", UPSERT_ORACLE + "SELECT event_id, user_id, event_type, value, CASE WHEN action = 'inserted' THEN '2024-02-01' ELSE '2024-01-01' END AS created_at, CASE WHEN action IN ('inserted', 'updated') THEN '2024-02-01' ELSE '2024-01-01' END AS updated_at FROM done")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(spark, sf_dir).drop("action")


@query("stale_keys", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O')")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return stale(table(spark, sf_dir, "customer").select("c_custkey"), kept, ["c_custkey"])



# Orders of a customer are releases of one record, in files by month.
@query(
    "latest_release",
    """SELECT ocid, day, status FROM (
  SELECT o_custkey AS ocid, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y%m') DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM {orders}) x WHERE n = 1""",
)
def latest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.date_format(day, "yyyyMM").alias("file"), day.cast("string").alias("release_date"), F.col("o_orderkey").alias("place"), day.alias("day"), F.col("o_orderstatus").alias("status"))
    return releases.newest(rows).select(F.col("source_id").alias("ocid"), "day", "status")


# A third of the stored instants are right already and are not given back.
LOCAL = "(ts AT TIME ZONE 'America/Toronto') AT TIME ZONE 'UTC'"


@query("closing_utc_backfill", f"SELECT event_id, {LOCAL} AS closing_utc FROM {{events}} WHERE event_id % 3 <> 0 AND (event_id % 3 = 1 OR {LOCAL} <> ts)")
def closing_utc_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").withColumn("right", F.convert_timezone(F.lit("America/Toronto"), F.lit("UTC"), ts))
    rows = rows.withColumn("closing_utc", F.when(F.col("event_id") % 3 == 0, F.col("right")).when(F.col("event_id") % 3 == 2, ts))
    return recomputed(rows, ["event_id"], {"closing_utc": F.col("right")})


REGIONS, CODED = ["Ontario", "QC, on", "Ontario, Canada", "London", "", None], ["*CNST", "*SRV", None]
CLOSING = ["1998-09-01T10:00:00", "1998-09-01T10:00:00Z", "1997-01-01", "soon", "", None, "1999-01-01 00:00:00+00:00"]
FILES = ["https://a.ca/x.pdf", "see below | http://b.ca", "none", None]


@query(
    "csv_funnel",
    f"""WITH t AS (SELECT o_orderkey % 6 IN (0, 1, 2) AS r, o_orderkey % 3 = 0 AS coded, o_orderpriority LIKE '%HIGH%' AS worded, o_orderkey % 7 AS c, o_orderkey % 4 IN (0, 1) AS files FROM {{orders}}), k AS (SELECT *, r AND (coded OR worded) AS kept FROM t)
SELECT count(*) AS total, count(*) FILTER (r) AS in_region, count(*) FILTER (kept) AS in_category, count(*) FILTER (kept AND coded) AS coded, count(*) FILTER (kept AND NOT coded) AS by_word, count(*) FILTER (kept AND c IN (0, 2)) AS naive, count(*) FILTER (kept AND c IN (1, 6)) AS aware,
  count(*) FILTER (kept AND c IN (3, 4, 5)) AS invalid, count(*) FILTER (kept AND c IN (0, 1, 6)) AS future, count(*) FILTER (kept AND c = 2) AS closed, count(*) FILTER (kept AND c IN (0, 1, 6) AND files) AS with_attachments FROM k""",
)
def csv_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values: dealt(values, "o_orderkey")
    title = F.regexp_replace("o_orderpriority", "2-HIGH", "New road, bridges")
    rows = table(spark, sf_dir, "orders").select(of(REGIONS).alias("regions"), of(CODED).alias("category"), title.alias("title"), F.lit("broadroad_x").alias("description"), of(CLOSING).alias("closing_date"), of(FILES).alias("attachments"))
    return federal_csv.funnel(rows, "Ontario", F.lit("1998-08-02 00:00:00").cast("timestamp"))


@query(
    "firm_name_normalize",
    r"""SELECT s_suppkey, regexp_replace(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) || CASE WHEN s_suppkey % 3 = 0 THEN ' construction' ELSE '' END, ' +$', '') AS name FROM {supplier}""",
)
def firm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.when(F.col("s_suppkey") % 3 == 0, " Construction Ltée. Inc.").when(F.col("s_suppkey") % 3 == 1, ", Société en nom collectif").otherwise(" (CO.)")
    return table(spark, sf_dir, "supplier").select("s_suppkey", firm_name(F.concat("s_name", ends)).alias("name"))


# Known events stay as they are; of the new ones each key comes once, in two batches that agree.
@query("links_inserted", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'new' END AS event_type FROM {events} WHERE event_id % 3 = 0 OR event_id % 2 = 0")
def links_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    new = events.where("event_id % 2 = 0").withColumn("event_type", F.lit("new"))
    return insert_or_ignore(events.where("event_id % 3 = 0"), new.union(new), ["event_id"])


# A roster is read again: places that are still there keep their verdicts, new ones have none, and those that are gone stay.
@query(
    "roster_kept",
    """SELECT c_custkey AS slug, CASE WHEN c_custkey % 4 <> 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS class FROM {customer} WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0""",
)
def roster_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("class"))
    new = rows.where("slug % 4 <> 0").select("slug", F.upper("name").alias("name"), F.lit("overwritten").alias("class"))
    return keep_columns(rows.where("slug % 3 <> 0"), new, ["slug"], ["class"])


# All scores of the firms that were scored anew are replaced, also those that the new run has no more.
@query(
    "scores_replaced",
    "SELECT l_suppkey AS firm_id, l_orderkey AS notice_id, max(l_extendedprice) + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS score FROM {lineitem} WHERE l_suppkey % 5 <> 0 OR l_orderkey % 2 = 0 GROUP BY l_suppkey, l_orderkey",
)
def scores_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm_id"), F.col("l_orderkey").alias("notice_id")).agg(F.max("l_extendedprice").alias("score"))
    new = rows.where("firm_id % 5 = 0 and notice_id % 2 = 0").withColumn("score", F.col("score") + 1)
    return replace_group(rows, new, ["firm_id"])
