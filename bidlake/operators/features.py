"""Histories of firms strictly before a day, and the features of a firm, a tender and both together.

interactions has canonical_id, ocid, date, won, bid_amount, buyer_id, category, region. Rows without a date, or on or after the day, are in
no history. Null or empty categories, buyers and regions are not counted; amounts count where they are above 0. Firms without a history get
the values of a cold start. Repeated rows count as they come; fold them first.

Interactions are counted, where parts are not given, to deal them in parts that do not grow with them, and read several times; give a kept table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dealt, parts_for

COLD_DAYS = 3650.0
FIRM = (
    "firm_interactions firm_wins firm_win_rate firm_distinct_categories firm_distinct_buyers firm_distinct_regions firm_category_concentration firm_median_bid firm_log_median_bid firm_bid_spread"
    " firm_days_since_last firm_active_days firm_bids_per_month firm_has_amounts"
).split()
TENDER = "tender_has_value tender_log_value tender_bidder_count tender_title_length tender_is_works tender_is_services tender_is_goods".split()
CROSS = (
    "cross_category_share cross_category_seen cross_buyer_prior_bids cross_buyer_prior_wins cross_buyer_seen cross_region_share cross_region_seen cross_value_fit cross_value_ratio cross_embedding_similarity"
).split()
NAMES = (*FIRM, *TENDER, *CROSS)


def group_of(name: str) -> str:
    head = name.split("_")[0]
    return head if head in ("firm", "tender", "cross") else "other"


def past(interactions: DataFrame, as_of: Column) -> DataFrame:
    return interactions.where(F.col("date").isNotNull() & (F.col("date") < as_of))


def competitive(interactions: DataFrame) -> DataFrame:
    """interactions on procurements with more than one bidder, with bidders; a firm's repeated rows on one are one bidder."""
    many = interactions.groupBy("ocid", "canonical_id").agg(F.lit(1).alias("_one")).groupBy("ocid").agg(F.count("*").alias("bidders")).where("bidders > 1")
    return interactions.drop("bidders").join(many, "ocid")


def eligible(interactions: DataFrame, cutoff: Column, end: Column, least: int = 5) -> DataFrame:
    """canonical_id, n_train and n_test of firms with at least `least` interactions before the cutoff, and as many from it to before the end."""
    date = F.col("date")
    n = interactions.groupBy("canonical_id").agg(F.count(F.when(date < cutoff, 1)).alias("n_train"), F.count(F.when((date >= cutoff) & (date < end), 1)).alias("n_test"))
    return n.where((F.col("n_train") >= least) & (F.col("n_test") >= least))


def key_counts(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(canonical_id, key, n) of values that are not null or empty, counted in parts parts at least before small ones are put together."""
    present = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select("canonical_id", key)
    return dealt(present, parts, "canonical_id", key).groupBy("canonical_id", key).agg(F.count("*").alias("n"))


def histories(interactions: DataFrame, as_of: Column, parts: int | None = None) -> DataFrame:
    """A row for each firm: counts, medians and spans; concentration is the sum of squared shares of its categories. parts is for key_counts."""
    rows, parts = past(interactions, as_of), parts or parts_for(interactions)
    paid = F.when(F.col("bid_amount") > 0, F.col("bid_amount").cast("double"))
    main = rows.groupBy("canonical_id").agg(
        F.count("*").alias("interactions"), F.sum(F.coalesce(F.col("won").cast("long"), F.lit(0))).alias("wins"), F.percentile(paid, F.lit(0.5)).alias("median_bid"),
        F.count(paid).alias("amounts"), F.stddev_pop(F.log1p(paid)).alias("spread"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    for key, name in (("category", "categories"), ("buyer_id", "buyers"), ("region", "regions")):
        each = key_counts(rows, key, parts).groupBy("canonical_id").agg(F.count("*").alias(name), *([(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("concentration")] if key == "category" else []))
        main = main.join(each, "canonical_id", "left")
    return main


def days_between(start: Column, end: Column) -> Column:
    return F.coalesce(F.greatest(F.datediff(end, start), F.lit(0)).cast("double"), F.lit(COLD_DAYS))


def firm_features(firms: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """canonical_id and the features of FIRM for every row of firms."""
    rows = firms.select("canonical_id").join(history, "canonical_id", "left")
    n = F.coalesce("interactions", F.lit(0)).cast("double")
    cold = n == 0
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    span = F.greatest(days_between(F.col("first_date"), as_of), F.lit(1.0))
    values = {
        "firm_interactions": n, "firm_wins": number("wins"), "firm_win_rate": F.when(cold, 0.0).otherwise(number("wins") / n), "firm_distinct_categories": number("categories"),
        "firm_distinct_buyers": number("buyers"), "firm_distinct_regions": number("regions"), "firm_category_concentration": number("concentration"), "firm_median_bid": number("median_bid"),
        "firm_log_median_bid": F.log1p(number("median_bid")), "firm_bid_spread": F.when(F.col("amounts") > 1, F.col("spread")).otherwise(0.0),
        "firm_days_since_last": F.when(cold, COLD_DAYS).otherwise(days_between(F.col("last_date"), as_of)), "firm_active_days": F.when(cold, 0.0).otherwise(span),
        "firm_bids_per_month": F.when(cold, 0.0).otherwise(n / (span / 30.44)), "firm_has_amounts": F.when(F.col("amounts") > 0, 1.0).otherwise(0.0),
    }
    return rows.select("canonical_id", *(values[name].alias(name) for name in FIRM))


def tender_columns() -> list[Column]:
    """The features of TENDER over value, bidder_count, title and category."""
    has, text = F.coalesce(F.col("value") > 0, F.lit(False)), F.lower(F.coalesce("category", F.lit("")))
    flag = lambda *words: F.when(text.rlike("|".join(words)), 1.0).otherwise(0.0)
    values = (
        F.when(has, 1.0).otherwise(0.0), F.when(has, F.log1p("value")).otherwise(0.0), F.coalesce(F.col("bidder_count").cast("double"), F.lit(0.0)), F.coalesce(F.length("title").cast("double"), F.lit(0.0)),
        flag("travaux", "works", "construction"), flag("service"), flag("bien", "approvisionnement", "goods"),
    )
    return [v.alias(name) for v, name in zip(values, TENDER, strict=True)]


def unit_dot(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either is null or has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    size = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v)))
    both = size(a) * size(b)
    return F.coalesce(F.when(both > 0, total(F.zip_with(a, b, lambda x, y: x.cast("double") * y)) / both), F.lit(0.0))


def cross_features(pairs: DataFrame, interactions: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """pairs (canonical_id, ocid, category, buyer_id, region, value, and firm_embedding and tender_embedding if there are any) with CROSS.

    A firm's counts by key are joined on the firm and the key, so no firm's history is gathered in one row.
    """
    rows, old, parts = pairs, past(interactions, as_of), parts_for(interactions)
    for key in ("category", "buyer_id", "region"):
        counts = key_counts(old, key, parts).withColumnRenamed("n", f"_{key}")
        rows = dealt(rows, parts, "canonical_id", key).join(counts, ["canonical_id", key], "left")
    known = history.select("canonical_id", F.col("interactions").alias("_n"), F.col("wins").alias("_wins"), F.col("median_bid").alias("_median"))
    rows = dealt(rows, parts, "canonical_id").join(dealt(known, parts, "canonical_id"), "canonical_id", "left")
    n = {k: F.coalesce(f"_{k}", F.lit(0)).cast("double") for k in ("category", "buyer_id", "region")}
    total = F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    seen = lambda c: F.when(c > 0, 1.0).otherwise(0.0)
    ratio = F.when((F.col("_median") > 0) & (F.col("value") > 0), F.log10(F.col("value") / F.col("_median")))
    fit = F.exp(-0.5 * F.pow(ratio / 0.75, F.lit(2.0)))
    similarity = unit_dot(F.col("firm_embedding"), F.col("tender_embedding")) if "firm_embedding" in pairs.columns else F.lit(0.0)
    values = (
        n["category"] / total, seen(n["category"]), n["buyer_id"], F.least(n["buyer_id"], F.coalesce("_wins", F.lit(0)).cast("double")), seen(n["buyer_id"]), n["region"] / total, seen(n["region"]),
        F.coalesce(fit, F.lit(0.0)), F.coalesce(ratio, F.lit(0.0)), similarity,
    )
    return rows.select(*pairs.columns, *(v.alias(name) for v, name in zip(values, CROSS, strict=True)))
