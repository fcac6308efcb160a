"""Past awards in current money, lookup of sizes with fallback, sizes from words in titles, and the best estimate of a notice with its source.

Medians are exact without gathering a key's amounts: counts by thousandths of a decade say in which step the middle lies, and only that step is
sorted. Small sides are broadcast only after a check of their size. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN_BAND, band, band_distance, fold
from .shared import kept, small

#: Contracts that a cell needs, amounts that are no errors, and the key sets of the lookup from specific to general.
LEAST_CELL = 12
AMOUNTS = (1e3, 2e9)
KEYS = (("slug", "buyer_type", "region"), ("slug", "buyer_type"), ("slug", "region"), ("slug",), ("buyer_type", "region"))


def quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def adjusted(awards: DataFrame, index: DataFrame, amount: str = "amount", day: str = "day") -> DataFrame:
    """awards with `adjusted`, the amount in the index's last quarter's money. index (quarter, value) is a price series of some quarters.

    Awards after the last quarter count as of it; those in a quarter without a value, before the series or without a date get null.
    """
    last = index.agg(F.max("quarter").alias("_last"), F.max_by("value", "quarter").alias("_now"))
    of = small(index.select(F.col("quarter").alias("_q"), F.col("value").alias("_then")), 32)
    rows = awards.crossJoin(F.broadcast(last)).withColumn("_q", F.when(F.col(day).isNotNull(), F.least(quarter(F.col(day)), F.col("_last"))))
    return rows.join(of, "_q", "left").withColumn("adjusted", F.col(amount) * F.col("_now") / F.col("_then")).drop("_q", "_then", "_last", "_now")


def corpus(awards: DataFrame, index: DataFrame, since: str = "2017-01-01") -> DataFrame:
    """Won awards with a plausible amount, dated and adjustable."""
    known = awards.where((F.col("won") == 1) & F.col("amount").between(*AMOUNTS) & (F.col("day") >= F.lit(since).cast("date")))
    return adjusted(known, index).where("adjusted is not null")


def _same(keys: tuple[str, ...], mark: str) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys], F.lit(True))


def medians(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """keys, n and median of the positive values of each key, null keys being keys. rows are read twice, so they should be a written table."""
    base = rows.where(F.col(value) > 0).select(*keys, F.col(value).cast("double").alias("_v"), F.floor(F.log10(value) * 1000).alias("_b"))
    steps = base.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    of_key = Window.partitionBy(*keys)
    steps = steps.withColumns({"n": F.sum("_c").over(of_key), "_before": F.coalesce(F.sum("_c").over(of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    middle = steps.where((F.col("_before") <= high) & (F.col("_before") + F.col("_c") > low)).select(*(F.col(k).alias(f"_k{k}") for k in keys), F.col("_b").alias("_kb"), "n", "_before")
    near = base.join(middle, _same(keys, "_k") & (F.col("_b") == F.col("_kb"))).withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_v")) - 1)
    return near.where((F.col("_place") == low) | (F.col("_place") == high)).groupBy(*keys, "n").agg(F.avg("_v").alias("median"))


def cells(awards: DataFrame, least: int = LEAST_CELL) -> DataFrame:
    """(level, slug, buyer_type, region, n, median) for each key set with enough contracts, and level 5 for all; slugs are not null but in the last two."""
    out, awards = [], kept(awards.select(*KEYS[0], "adjusted"), "awards")
    for level, keys in enumerate((*KEYS, ())):
        each = medians(awards.where("slug is not null") if "slug" in keys else awards, keys, "adjusted").where(F.col("n") >= (least if keys else 1))
        out.append(each.select(F.lit(level).alias("level"), *(F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in KEYS[0]), "n", "median"))
    return reduce(DataFrame.unionByName, out)


def estimates(notices: DataFrame, found: DataFrame) -> DataFrame:
    """notices (slug, buyer_type, region) with estimate and level of the most specific cell that has them; null regions match each other."""
    rows, found = notices, kept(found, "cells")
    for level, keys in enumerate((*KEYS, ())):
        cell = small(found.where(F.col("level") == level).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("median").alias(f"_m{level}")), 128)
        rows = rows.join(cell, _same(keys, "_"), "left").drop(*(f"_{k}" for k in keys))
    names = [f"_m{k}" for k in range(len(KEYS) + 1)]
    level = reduce(lambda out, k: out.when(F.col(f"_m{k}").isNotNull(), k), range(1, len(names)), F.when(F.col("_m0").isNotNull(), 0))
    return rows.withColumns({"estimate": F.coalesce(*names), "level": level}).drop(*names)


def pattern_band(title: Column, large: list[str], small: list[str], bands: tuple[str, str]) -> Column:
    """A size from patterns over the folded title, only where one kind of them is found: bands are of the large and the small kind."""
    text = F.coalesce(fold(title), F.lit(""))
    has = lambda patterns: reduce(Column.__or__, [text.rlike(p) for p in patterns], F.lit(False))
    return F.when(has(large) & ~has(small), bands[0]).when(has(small) & ~has(large), bands[1]).otherwise(UNKNOWN_BAND)


#: How far an estimate is trusted by its source; that of a cell by its level.
PUBLISHED, MODELLED, PATTERN, CELL = 1.0, 0.6, 0.35, (0.7, 0.6, 0.6, 0.5, 0.35, 0.3)


def best_estimates(notices: DataFrame, found: DataFrame, large: list[str], small_: list[str], bands: tuple[str, str]) -> DataFrame:
    """notices with band, source, confidence and level: the best there is for each.

    A published estimated_value above 0; else, for a notice with a slug, the model's value in `modelled`, if it is not null, else the most
    specific cell; else words of the title; else unknown. level is the cell's, null for other sources.
    """
    known = F.coalesce(F.col("estimated_value").try_cast("double"), F.lit(0.0))
    rows = estimates(notices.drop("estimate", "level"), found).withColumn("_pattern", pattern_band(F.col("title"), large, small_, bands))
    led = F.coalesce(F.col("slug") != "", F.lit(False))
    cases = (
        (known > 0, band(known), "published", F.lit(PUBLISHED)),
        (led & F.col("modelled").isNotNull(), band(F.col("modelled")), "estimated_model", F.lit(MODELLED)),
        (led & F.col("level").isNotNull(), band(F.col("estimate")), "estimated_model", F.element_at(F.array(*map(F.lit, CELL)), F.coalesce("level", F.lit(0)) + 1)),
        (F.col("_pattern") != UNKNOWN_BAND, F.col("_pattern"), "estimated_pattern", F.lit(PATTERN)),
    )
    pick = lambda k, other: reduce(lambda c, case: c.when(case[0], case[k]), cases[1:], F.when(cases[0][0], cases[0][k])).otherwise(other)
    level = F.when(~cases[0][0] & ~cases[1][0] & cases[2][0], F.col("level"))
    return rows.select(*(c for c in notices.columns if c not in ("band", "source", "confidence", "level")), pick(1, UNKNOWN_BAND).alias("band"), pick(2, "unknown").alias("source"), pick(3, F.lit(0.0)).alias("confidence"), level.alias("level"))


def usual(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """One row: the most frequent value, of equally frequent ones that met first by the columns of order."""
    each = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    return each.agg(F.min_by(value, F.struct(-F.col("n"), F.col("_first"))).alias(value))


def accuracy(rows: DataFrame, guess: Column, truth: Column) -> DataFrame:
    """n, exact and within_one over all rows, as shares; an unknown size is a miss."""
    hit = F.coalesce((guess == truth) & (truth != UNKNOWN_BAND), F.lit(False))
    near = F.coalesce(band_distance(guess, truth) <= 1, F.lit(False))
    share = lambda c: F.round(F.count(F.when(c, 1)) / F.count("*"), 4)
    return rows.agg(F.count("*").alias("n"), share(hit).alias("exact"), share(near).alias("within_one"))
