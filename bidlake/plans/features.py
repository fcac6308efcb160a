"""Features of firms, tenders and both over the test tables, by the operators; the other engine's statements are written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as f
from ..operators.shared import kept
from .registry import lines_joined, query, table

DAY = "1999-01-01"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each firm and order, kept: won if any line was returned, the first line's amount and category."""
    raw = lines_joined(spark, sf_dir)
    at = F.struct("l_linenumber", "l_extendedprice")
    rows = raw.groupBy(F.col("l_suppkey").alias("canonical_id"), F.col("l_orderkey").alias("ocid")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("won"), F.max(F.col("o_orderdate").cast("date")).alias("date"), F.max("o_custkey").alias("buyer_id"), F.max("o_orderpriority").alias("region"),
        F.min_by("l_extendedprice", at).alias("bid_amount"), F.min_by("p_type", at).alias("category"), F.max("o_totalprice").alias("value"),
    )
    return kept(rows, "interactions")


RAW = """i AS (SELECT l_suppkey AS firm, l_orderkey AS ocid, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS won, CAST(max(o_orderdate) AS DATE) AS day, max(o_custkey) AS buyer, max(o_orderpriority) AS region,
  arg_min(l_extendedprice, (l_linenumber, l_extendedprice)) AS amount, arg_min(p_type, (l_linenumber, l_extendedprice)) AS category, max(o_totalprice) AS value, arg_min(p_name, (l_linenumber, l_extendedprice)) AS title
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2),
h AS (SELECT * FROM i WHERE day < DATE '1999-01-01')"""


@query(
    "firm_features_all",
    f"""WITH {RAW}, c AS (SELECT firm, sum(n * n) / (sum(n) * sum(n)) AS conc FROM (SELECT firm, category, CAST(count(*) AS DOUBLE) AS n FROM h GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT firm, count(*) AS n, sum(won) AS wins, count(DISTINCT category) AS cats, count(DISTINCT buyer) AS buyers, count(DISTINCT region) AS regions, median(CASE WHEN amount > 0 THEN amount END) AS med,
  stddev_pop(CASE WHEN amount > 0 THEN ln(1 + amount) END) AS spread, count(CASE WHEN amount > 0 THEN 1 END) AS paid, date_diff('day', max(day), DATE '1999-01-01') AS since, greatest(date_diff('day', min(day), DATE '1999-01-01'), 1) AS span FROM h GROUP BY 1)
SELECT s_suppkey AS canonical_id, round(coalesce(n, 0), 6)::DOUBLE AS firm_interactions, coalesce(wins, 0)::DOUBLE AS firm_wins, round(coalesce(wins / n, 0), 6)::DOUBLE AS firm_win_rate, coalesce(cats, 0)::DOUBLE AS firm_distinct_categories,
  coalesce(buyers, 0)::DOUBLE AS firm_distinct_buyers, coalesce(regions, 0)::DOUBLE AS firm_distinct_regions, round(coalesce(conc, 0), 6)::DOUBLE AS firm_category_concentration, round(coalesce(med, 0), 4)::DOUBLE AS firm_median_bid,
  round(ln(1 + coalesce(med, 0)), 6)::DOUBLE AS firm_log_median_bid, round(CASE WHEN paid > 1 THEN spread ELSE 0 END, 6)::DOUBLE AS firm_bid_spread, coalesce(since, 3650)::DOUBLE AS firm_days_since_last, coalesce(span, 0)::DOUBLE AS firm_active_days,
  round(coalesce(n / (span / 30.44), 0), 6)::DOUBLE AS firm_bids_per_month, CASE WHEN paid > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS firm_has_amounts FROM {{supplier}} LEFT JOIN m ON m.firm = s_suppkey LEFT JOIN c ON c.firm = s_suppkey""".replace("{{", "{").replace("}}", "}"),
)
def firm_features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(DAY).cast("date")
    firms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("canonical_id"))
    rows = f.firm_features(firms, f.histories(interactions(spark, sf_dir), day), day)
    return rows.select("canonical_id", *(F.round(c, 4 if c == "firm_median_bid" else 6).alias(c) for c in f.FIRM))


@query(
    "cross_features_all",
    f"""WITH {RAW}, m AS (SELECT firm, CAST(count(*) AS DOUBLE) AS n, sum(won) AS wins, median(CASE WHEN amount > 0 THEN amount END) AS med FROM h GROUP BY 1), c AS (SELECT firm, category, count(*) AS k FROM h GROUP BY 1, 2),
b AS (SELECT firm, buyer, count(*) AS k FROM h GROUP BY 1, 2), r AS (SELECT firm, region, count(*) AS k FROM h GROUP BY 1, 2), t AS (SELECT * FROM i WHERE day >= DATE '1999-01-01'),
x AS (SELECT t.firm, t.ocid, m.n, m.wins, coalesce(c.k, 0) AS ck, coalesce(b.k, 0) AS bk, coalesce(r.k, 0) AS rk, log10(CASE WHEN m.med > 0 AND t.value > 0 THEN t.value / m.med END) AS q FROM t LEFT JOIN m ON m.firm = t.firm
  LEFT JOIN c ON c.firm = t.firm AND c.category = t.category LEFT JOIN b ON b.firm = t.firm AND b.buyer = t.buyer LEFT JOIN r ON r.firm = t.firm AND r.region = t.region)
SELECT firm AS canonical_id, ocid, round(ck / coalesce(n, 1), 6)::DOUBLE AS cross_category_share, (ck > 0)::INT::DOUBLE AS cross_category_seen, bk::DOUBLE AS cross_buyer_prior_bids, least(bk, coalesce(wins, 0))::DOUBLE AS cross_buyer_prior_wins,
  (bk > 0)::INT::DOUBLE AS cross_buyer_seen, round(rk / coalesce(n, 1), 6)::DOUBLE AS cross_region_share, (rk > 0)::INT::DOUBLE AS cross_region_seen, round(coalesce(exp(-0.5 * (q / 0.75) * (q / 0.75)), 0), 6)::DOUBLE AS cross_value_fit, round(coalesce(q, 0), 6)::DOUBLE AS cross_value_ratio FROM x""",
)
def cross_features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, rows = F.lit(DAY).cast("date"), interactions(spark, sf_dir)
    pairs = rows.where(F.col("date") >= day).select("canonical_id", "ocid", "category", "buyer_id", "region", "value")
    out = f.cross_features(pairs, rows, f.histories(rows, day), day)
    return out.select("canonical_id", "ocid", *(F.round(c, 6).alias(c) for c in f.CROSS if c != "cross_embedding_similarity"))


KINDS = ("Travaux de voirie", "Services professionnels", "Biens", "Construction works and services", None)


@query(
    "tender_features_all",
    """WITH b AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS bidders FROM {lineitem} GROUP BY 1)
SELECT o_orderkey, (o_totalprice > 0)::INT::DOUBLE AS tender_has_value, CASE WHEN o_totalprice > 0 THEN round(ln(1 + o_totalprice), 6) ELSE 0.0 END AS tender_log_value, coalesce(bidders, 0)::DOUBLE AS tender_bidder_count, length(o_orderpriority)::DOUBLE AS tender_title_length,
  (o_orderkey % 5 IN (0, 3))::INT::DOUBLE AS tender_is_works, (o_orderkey % 5 IN (1, 3))::INT::DOUBLE AS tender_is_services, (o_orderkey % 5 = 2)::INT::DOUBLE AS tender_is_goods FROM {orders} LEFT JOIN b ON l_orderkey = o_orderkey""",
)
def tender_features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    bidders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("bidder_count"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % len(KINDS)).cast("int"))
    rows = table(spark, sf_dir, "orders").join(bidders, "o_orderkey", "left").select("o_orderkey", F.col("o_totalprice").alias("value"), "bidder_count", F.col("o_orderpriority").alias("title"), kind.alias("category"))
    return rows.select("o_orderkey", *f.tender_columns()).withColumn("tender_log_value", F.round("tender_log_value", 6))
