"""Boards of firms over the test tables: gates, adjustments, fits and the first ten, by the operators; the statement is from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import band
from ..operators import boards
from .market import interactions
from .registry import other_engine, query
from .frames import INTERACTIONS
from .rules import dealt, said

TRADES, FIRM_TRADES = [["roads", "landscaping", "snow_ice_management"], ["roads"], ["roads", "landscaping"], ["bridges"], []], [["roads"], ["roads", "landscaping"], ["bridges", "roads"]]
REGIONS, WANTED = ["ON", "QC, ON", "CA", None, "AB"], [["ON"], [], ["QC", "AB"], ["MB"]]
SIZES = "['<$100K', '$100–500K', '$500K–2M', '$2–10M', '>$10M']"
SIZE = "CASE WHEN {0} < 100000 THEN '<$100K' WHEN {0} < 500000 THEN '$100–500K' WHEN {0} < 2000000 THEN '$500K–2M' WHEN {0} < 10000000 THEN '$2–10M' ELSE '>$10M' END"


@query(
    "firm_boards",
    other_engine(
        f"""WITH {INTERACTIONS},
t AS (SELECT firm_id, ocid, day, amount * 12 AS v, 100000.0 * (firm_id % 7 + 1) AS d, (ocid % 97) / 10.0 - 8 AS raw, {said(TRADES, 'ocid')} AS nt, {said(FIRM_TRADES, 'firm_id')} AS ft, {said(REGIONS, 'ocid')} AS r, {said(WANTED, 'firm_id')} AS w FROM interactions),
g AS (SELECT *, abs(list_position({SIZES}, {SIZE.format('v')}) - list_position({SIZES}, {SIZE.format('d')})) AS far, len(list_intersect(nt, ft)) AS hits FROM t),
k AS (SELECT * FROM g WHERE hits > 0 AND NOT (list_has_any(nt, ['facility_maintenance', 'landscaping', 'snow_ice_management']) AND hits / len(nt) < 0.5) AND (len(w) = 0 OR r IS NULL OR r = 'CA' OR list_has_any(string_split(replace(r, ' ', ''), ','), w)) AND NOT (ocid % 3 = 0 AND far >= 2)),
f AS (SELECT *, round(least(greatest(100 / (1 + exp(-(raw + 3.1) / 2.09)) + (2 * exp(-0.5 * ((v - d) / greatest(0.6 * d, 1)) * ((v - d) / greatest(0.6 * d, 1))) - 1) * 10 + CASE WHEN far = 0 THEN 8 WHEN far >= 2 THEN -18 ELSE 0 END, 0), 100), 1) AS fit FROM k)
SELECT firm_id, ocid AS notice_id, CAST(fit AS DOUBLE) AS fit, row_number() OVER (PARTITION BY firm_id ORDER BY fit DESC, CASE WHEN ocid % 5 <> 2 THEN day END NULLS LAST, ocid) AS place FROM f QUALIFY place <= 10"""
    ),
)
def firm_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, declared = F.col("amount") * 12, 100000.0 * (F.col("firm_id") % 7 + 1)
    rows = interactions(spark, sf_dir).select(
        "firm_id", F.col("ocid").alias("notice_id"), F.when(F.col("ocid") % 5 != 2, F.col("day")).alias("closing_date"), value.alias("value"), declared.alias("declared"), ((F.col("ocid") % 97) / 10.0 - 8).alias("raw"), dealt(TRADES, "ocid").alias("trades"),
        dealt(FIRM_TRADES, "firm_id").alias("firm_trades"), dealt(REGIONS, "ocid").alias("region"), dealt(WANTED, "firm_id").alias("wanted"), F.when(F.col("ocid") % 3 == 0, "published").otherwise("estimated_model").alias("source"), band(value).alias("size"), band(declared).alias("own_size"),
    )
    c = F.col
    rows = rows.where(boards.on_trade(c("trades"), c("firm_trades")) & boards.region_allows(c("region"), c("wanted")) & boards.published_size_allows(c("source"), c("size"), c("own_size")))
    rows = rows.withColumn("fit", boards.fit(c("raw"), c("value"), c("declared"), c("size"), c("own_size")))
    return boards.board(rows, "firm_id").select("firm_id", "notice_id", "fit", "place")
