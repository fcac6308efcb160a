"""The pool of open notices, lines of cards and the register over the test tables, by the operators; the other engine's statements are from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards
from .census import PAGE_CLASS, classes
from .registry import query, table
from .rules import dealt, said

CATEGORIES, FIELDS, WAYS = ["submission", "bid_security", "insurance"], ["submission_method", None], ["email", " portal ", "fax or mail", None, ""]


@query(
    "open_pool",
    """SELECT o_orderkey AS notice_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS closing_date, CASE WHEN o_orderkey % 4 = 0 THEN 'unmapped' ELSE 'mapped' END AS mapping_status, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE lower(o_orderpriority) END AS trades,
  CASE WHEN o_totalprice > 200000 THEN '$100–500K' ELSE 'unknown' END AS scale_band, CASE WHEN o_totalprice > 200000 THEN 'published' ELSE 'unknown' END AS scale_source, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END::DOUBLE AS scale_confidence FROM {orders} WHERE o_orderstatus = 'O' AND o_orderkey % 9 <> 1""",
)
def open_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    large, none = F.col("o_totalprice") > 200000, F.lit(None).cast("string")
    notices = orders.select(
        F.col("o_orderkey").alias("notice_id"), F.lit("test").alias("source"), F.col("o_orderpriority").alias("title"), none.alias("buyer_name"), none.alias("buyer_type"), none.alias("region"), F.col("o_totalprice").alias("estimated_value"), none.alias("notice_url"),
        F.when(F.col("o_orderkey") % 9 != 1, F.col("o_orderdate").cast("timestamp")).alias("closing_utc"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"),
        F.when(large, "$100–500K").otherwise("").alias("scale_band"), F.when(large, "published").alias("scale_source"), F.when(large, 1.0).alias("scale_confidence"),
    )
    trades = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("notice_id"), F.array(F.lower("o_orderpriority")).alias("trade_slugs"), F.lit("mapped").alias("mapping_status"))
    return cards.open_pool(notices, trades).select("notice_id", "title", "closing_date", "mapping_status", F.array_join("trade_slugs", ",").alias("trades"), "scale_band", "scale_source", "scale_confidence")


@query(
    "closing_lines",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 1 THEN o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) END AS c FROM {orders}),
d AS (SELECT *, date_diff('day', DATE '1998-08-02', c::DATE) AS days, strftime(c, '%b %-d, %Y at %-I:%M %p') AS said FROM t)
SELECT o_orderkey, CASE WHEN c IS NULL THEN 'Closing date unavailable' WHEN days < 0 THEN 'Closed ' || said WHEN days < 14 THEN said || ' · closes in ' || days || CASE WHEN days = 1 THEN ' day' ELSE ' days' END ELSE said END AS line FROM d""",
)
def closing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 9 != 1, F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cards.closing_text(at, F.lit("1998-08-02").cast("date")).alias("line"))


@query(
    "card_lines",
    f"""WITH r AS (SELECT conv_id, turn, {said(CATEGORIES, 'turn')} AS cat, {said(FIELDS, 'conv_id')} AS f, nullif(trim({said(WAYS, 'turn')}), '') AS v, nullif(trim(text), '') AS text FROM {{conversations}}),
w AS (SELECT conv_id, v, min(turn) AS pos FROM r WHERE cat = 'submission' AND f IS NOT NULL AND v IS NOT NULL GROUP BY 1, 2), m AS (SELECT conv_id, string_agg(v, ' / ' ORDER BY pos) AS ways FROM w GROUP BY 1),
t AS (SELECT conv_id, arg_min(text, turn) FILTER (cat = 'submission') AS s, min(turn) FILTER (cat = 'submission') IS NOT NULL AS any_s, arg_min(text, turn) FILTER (cat = 'bid_security') AS b, min(turn) FILTER (cat = 'bid_security') IS NOT NULL AS any_b FROM r GROUP BY 1)
SELECT conv_id AS tender_id, 'Submission: ' || CASE WHEN ways IS NOT NULL THEN ways WHEN any_s THEN CASE WHEN length(s) > 80 THEN rtrim(s[1:77]) || '...' ELSE coalesce(s, 'see tender documents') END ELSE 'not identified' END AS submission,
  CASE WHEN any_b THEN 'Bid security: ' || CASE WHEN length(b) > 85 THEN rtrim(b[1:82]) || '...' ELSE coalesce(b, 'requirement identified') END END AS bid_security FROM t LEFT JOIN m USING (conv_id)""",
)
def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("tender_id"), F.col("turn").alias("pos"), F.lit("bid_phase_mandatory").alias("phase"), dealt(CATEGORIES, "turn").alias("category"), dealt(FIELDS, "conv_id").alias("check_field"), dealt(WAYS, "turn").alias("check_value"), F.col("text").alias("requirement_text"),
    )
    return cards.submission_lines(rows)


LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cards.CLASS_LABELS.items())


@query("census_register", f"WITH {PAGE_CLASS} SELECT page_id AS slug, class, CASE class {LABELS} ELSE class END AS label, confidence, platform FROM classes")
def census_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    places = classes(spark, sf_dir).select(F.col("page_id").alias("slug"), F.col("url").alias("name"), F.lit("single").alias("tier"), none.alias("area"), F.lit(1).alias("population"), "class", "confidence", "platform", none.alias("procurement_url"))
    return cards.register(places).select("slug", "class", "label", "confidence", "platform")


@query("site_counts", "SELECT (SELECT count(*) FROM {orders}) AS notices_tracked, (SELECT count(*) FROM {conversations} WHERE role <> 'system') AS requirements_verified, (SELECT count(*) FROM {conversations} WHERE role = 'system') AS fabrications_caught, (SELECT count(*) FROM {customer}) AS municipalities_mapped")
def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return cards.counts({"notices_tracked": table(spark, sf_dir, "orders"), "requirements_verified": turns.where("role <> 'system'"), "fabrications_caught": turns.where("role = 'system'"), "municipalities_mapped": table(spark, sf_dir, "customer")})
