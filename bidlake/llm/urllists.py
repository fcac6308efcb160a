"""URL filters as a temporal list join, with DataFrame functions only.

A list is a log of dated entries: on a day, a pattern is listed or unlisted with a category. Entries of a pattern and category become
validity intervals [day listed, day of the next entry). A capture is judged by the entries active on the day it was fetched, for its host
and each parent domain of it; the most specific pattern decides, of equal ones `allow` before others, then the category's name.

Captures are reduced to distinct (host, day) before the join, so a host with a third of the captures is one row a day; the join's keys are
those rows' domains. Keys that many rows share, such as a top-level domain or a popular host, are joined without being gathered. A capture
without a host or fetch day is kept without a match. Repeated list entries collapse; of entries of one day the delisting counts last. Null
patterns, categories and days are left out of the list. Empty lists match nothing, empty captures give no rows; urls are read whole, however
long. Columns of captures that have the name of a result column (host, matched_pattern, category, blocked) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, join_hot

#: Bytes of an entry or a verdict in memory, for the check of what is broadcast.
ENTRY_BYTES = 200


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and final dot; null if there is none. Text before '://' must be a scheme."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def domains(host: Column) -> Column:
    """The host and its parent domains, the host first: a.b.c gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) of entries (pattern, category, day, listed); valid_to is null while listed."""
    rows = entries.where("pattern is not null and category is not null and day is not null and listed is not null")
    rows = rows.select(F.lower("pattern").alias("pattern"), "category", "day", "listed").groupBy("pattern", "category", "day").agg(F.min("listed").alias("listed"))
    w = Window.partitionBy("pattern", "category").orderBy("day")
    rows = rows.withColumn("valid_to", F.lead("day").over(w))
    return rows.where("listed").select("pattern", "category", F.col("day").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with host, matched_pattern, category and blocked; a capture has url and fetch_day."""
    scratch = Scratch(captures.sparkSession, "urllists")
    rows = captures.drop("host", "matched_pattern", "category", "blocked").withColumn("host", host_of(F.col("url")))
    known = F.col("host").isNotNull() & F.col("fetch_day").isNotNull()
    asked = scratch.keep(rows.where(known).select("host", "fetch_day").distinct(), "asked", narrow=True)
    spans = scratch.keep(intervals(entries), "intervals", narrow=True)
    small = spans.count() * ENTRY_BYTES <= BROADCAST_BYTES
    asked = asked.select("host", "fetch_day", F.posexplode(domains(F.col("host"))).alias("depth", "pattern"))
    active = asked.join(F.broadcast(spans), "pattern") if small else join_hot(asked, spans, ["pattern"], ENTRY_BYTES)
    active = active.where("valid_from <= fetch_day and (valid_to is null or fetch_day < valid_to)")
    best = F.min(F.struct("depth", (F.col("category") != "allow").alias("not_allow"), "category", "pattern"))
    decided = active.groupBy("host", "fetch_day").agg(best.alias("b")).select("host", "fetch_day", F.col("b.pattern").alias("matched_pattern"), F.col("b.category").alias("category"))
    decided = scratch.keep(decided, "decided", narrow=True)
    keys = ["host", "fetch_day"]
    small = decided.count() * ENTRY_BYTES <= BROADCAST_BYTES
    hit = rows.where(known).join(F.broadcast(decided), keys, "left") if small else join_hot(rows.where(known), decided, keys, ENTRY_BYTES, "left")
    none = F.lit(None).cast("string")
    out = hit.unionByName(rows.where(~known).withColumns({"matched_pattern": none, "category": none}))
    return out.withColumn("blocked", F.coalesce(F.col("category") != "allow", F.lit(False)))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts by a rule, as the tables have no list.

    Each registered domain (last three labels) whose first page's id is even is listed on day id mod 20 as `spam` and unlisted 15 days
    later, listed again on day 30 + id mod 7 for good if the id is a multiple of 4; hosts of more labels whose first id is a multiple of 3
    are listed as `allow` from day id mod 25 on.
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.min("page_id").alias("id"))
    labels = F.split("host", r"\.")
    base = hosts.select(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".").alias("pattern"), "id").groupBy("pattern").agg(F.min("id").alias("id"))
    row = lambda df, cond, category, day, listed: df.where(cond).select("pattern", F.lit(category).alias("category"), F.expr(day).cast("int").alias("day"), F.lit(listed).alias("listed"))
    deep = hosts.where(F.size(labels) > 3).select(F.col("host").alias("pattern"), "id")
    return row(base, "id % 2 = 0", "spam", "id % 20", True).union(row(base, "id % 2 = 0", "spam", "id % 20 + 15", False)).union(row(base, "id % 4 = 0", "spam", "30 + id % 7", True)).union(row(deep, "id % 3 = 0", "allow", "id % 25", True))


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day from the page's id (the tables have none): id * 7 mod 60."""
    return pages.select("page_id", "url", ((F.col("page_id") * 7) % 60).cast("int").alias("fetch_day"))


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH hosts_all AS (
  SELECT page_id, CAST((page_id * 7) % 60 AS INTEGER) AS fetch_day,
         nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.+$', ''), '') AS host
  FROM pages),
hosts AS (SELECT host, min(page_id) AS id FROM hosts_all WHERE host IS NOT NULL GROUP BY host),
base AS (SELECT array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') AS pattern, min(id) AS id FROM hosts GROUP BY 1),
entries AS (
  SELECT pattern, 'spam' AS category, id % 20 AS day, true AS listed FROM base WHERE id % 2 = 0
  UNION ALL SELECT pattern, 'spam', id % 20 + 15, false FROM base WHERE id % 2 = 0
  UNION ALL SELECT pattern, 'spam', 30 + id % 7, true FROM base WHERE id % 4 = 0
  UNION ALL SELECT host, 'allow', id % 25, true FROM hosts WHERE len(string_split(host, '.')) > 3 AND id % 3 = 0),
days AS (SELECT pattern, category, day, bool_and(listed) AS listed FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT pattern, category, day AS valid_from, listed, lead(day) OVER (PARTITION BY pattern, category ORDER BY day) AS valid_to FROM days) WHERE listed),
asked AS (SELECT DISTINCT host, fetch_day, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM hosts_all WHERE host IS NOT NULL),
active AS (
  SELECT a.host, a.fetch_day, a.k, s.category, s.pattern,
         row_number() OVER (PARTITION BY a.host, a.fetch_day ORDER BY a.k, s.category <> 'allow', s.category, s.pattern) AS rn
  FROM asked a JOIN spans s ON s.pattern = array_to_string(list_slice(string_split(a.host, '.'), a.k, len(string_split(a.host, '.'))), '.')
   AND s.valid_from <= a.fetch_day AND (s.valid_to IS NULL OR a.fetch_day < s.valid_to))
SELECT h.page_id, h.host, h.fetch_day, v.pattern AS matched_pattern, v.category, coalesce(v.category <> 'allow', false) AS blocked
FROM hosts_all h LEFT JOIN (SELECT * FROM active WHERE rn = 1) v ON v.host = h.host AND v.fetch_day = h.fetch_day
"""
