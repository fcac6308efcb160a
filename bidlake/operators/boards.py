"""The live board of a firm: gates by trade and region, adjustments after the model, an absolute fit, order and skew. Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band_distance
from .scoring import gauss_points

#: Trades of upkeep, the least similarity, points for sizes, and the curve that maps raw scores to 0..100.
UPKEEP = ("facility_maintenance", "landscaping", "snow_ice_management")
LEAST_SIMILARITY = 0.35
SAME_SIZE, OTHER_SIZE = 8.0, -18.0
FIT_CENTRE, FIT_SCALE = -3.1, 2.09
SKEWED = 0.7


def on_trade(notice: Column, firm: Column) -> Column:
    """Whether the notice has one of the firm's trades; with a trade of upkeep among its own, at least half of them must match."""
    matched = F.size(F.filter(notice, lambda s: F.array_contains(firm, s)))
    upkeep = F.arrays_overlap(notice, F.array(*(F.lit(s) for s in UPKEEP)))
    return F.coalesce((matched > 0) & ~(upkeep & (matched / F.size(notice) < 0.5)), F.lit(False))


def region_allows(region: Column, wanted: Column) -> Column:
    """An empty list, a missing region and CA let all pass; else one province must be wanted."""
    there = F.transform(F.split(region, ","), lambda x: F.trim(x))
    return F.coalesce(F.size(wanted) == 0, F.lit(True)) | F.coalesce(F.trim(region) == "", F.lit(True)) | F.array_contains(there, "CA") | F.arrays_overlap(there, wanted)


def size_points(notice: Column, declared: Column) -> Column:
    """Of two size names: a bonus if they are the same, nothing if neighbours or unknown, a penalty beyond."""
    far = band_distance(notice, declared)
    return F.when(far == 0, SAME_SIZE).when(far >= 2, OTHER_SIZE).otherwise(0.0)


def published_size_allows(source: Column, notice: Column, declared: Column) -> Column:
    """A published size two or more away from the declared one shuts a notice out; an estimate never does."""
    return ~((source == "published") & F.coalesce(band_distance(notice, declared) >= 2, F.lit(False)))


def absolute_fit(raw: Column) -> Column:
    return 100.0 / (1.0 + F.exp(-(raw - FIT_CENTRE) / FIT_SCALE))


def value_points(value: Column, declared: Column) -> Column:
    return F.when((value > 0) & (declared > 0), gauss_points(value, declared, 10.0, 0.6)).otherwise(0.0)


def fit(raw: Column, value: Column, declared: Column, notice_band: Column, declared_band: Column) -> Column:
    total = absolute_fit(raw) + value_points(value, declared) + size_points(notice_band, declared_band)
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 1)


def board(rows: DataFrame, firm: str, size: int = 10) -> DataFrame:
    """The first `size` of each firm by fit, then closing date (undated last), then notice_id, with place."""
    order = [F.desc("fit"), F.col("closing_date").asc_nulls_last(), F.col("notice_id")]
    cut = rows.withColumn("_b", F.pmod(F.xxhash64("notice_id"), F.lit(16)))
    cut = cut.withColumn("_n", F.row_number().over(Window.partitionBy(firm, "_b").orderBy(*order))).where(F.col("_n") <= size)
    return cut.withColumn("place", F.row_number().over(Window.partitionBy(firm).orderBy(*order)).cast("long")).where(F.col("place") <= size).drop("_b", "_n")


def province_skew(rows: DataFrame, by: list[str]) -> DataFrame:
    """The province with the largest share of all rows, over rows that name one of QC and ON and not the other; equal ones by name."""
    there = F.transform(F.split(F.coalesce("region", F.lit("")), ","), lambda x: F.trim(x))
    qc, on = F.array_contains(there, "QC"), F.array_contains(there, "ON")
    counted = rows.withColumn("_p", F.when(qc & ~on, "QC").when(on & ~qc, "ON")).groupBy(*by).agg(F.count("*").alias("_all"), *(F.count(F.when(F.col("_p") == p, 1)).alias(p) for p in ("ON", "QC")))
    best = F.when(F.col("QC") > F.col("ON"), "QC").when(F.col("ON") > 0, "ON")
    return counted.select(*by, best.alias("province"), (F.greatest("ON", "QC") / F.col("_all")).alias("share")).where("province is not null")


def deterministic_score(category: Column, buyer_bids: Column, region: Column) -> Column:
    """The rule-based baseline: 45 for the category's feature, up to 20 for bids with the buyer, 20 for the region's feature."""
    return 45.0 * category + 20.0 * F.least(buyer_bids, F.lit(5.0)) / 5.0 + 20.0 * region
