"""Ranking metrics over a full pool without making its pairs.

A firm's score of a notice depends on the notice's category alone, so the place of a notice is one more than the notices of better
categories, plus those of equally scored categories with a smaller id. Only a firm's own positives are placed; categories that a firm has no
score for count as 0. Ids are numbers; counts below an id are kept by blocks of ids, so no category is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

BLOCK = 4096


def counts_below(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (category, ocid), distinct, with below: how many of the pool (ocid, category) have that category and a smaller ocid."""
    block = F.floor(F.col("ocid") / BLOCK)
    known = pool.select("category", "ocid", block.alias("b"))
    sizes = known.groupBy("category", "b").agg(F.count("*").alias("n"))
    both = sizes.select("category", "b", "n").unionByName(asked.select("category", block.alias("b"), F.lit(0).cast("long").alias("n")).distinct()).groupBy("category", "b").agg(F.sum("n").alias("n"))
    before = both.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("category").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("category", "b", "before")
    rows = known.select("category", "b", "ocid", F.lit(0).alias("q")).unionByName(asked.select("category", block.alias("b"), "ocid", F.lit(1).alias("q")))
    within = F.sum(1 - F.col("q")).over(Window.partitionBy("category", "b").orderBy("ocid").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0))).where("q = 1")
    return rows.join(before, ["category", "b"]).select("category", "ocid", (F.col("before") + F.col("within")).alias("below"))


def standings(pool: DataFrame, scores: DataFrame, positives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pool and scores with categories that are never null, and positives with own score and `better`, the notices of better categories."""
    keyed = pool.select("ocid", F.concat(F.lit("c"), F.col("category").cast("string")).alias("category"))
    sizes = keyed.groupBy("category").agg(F.count("*").alias("size"))
    scored = kept(scores.select("firm_id", F.concat(F.lit("c"), F.col("category").cast("string")).alias("category"), "score").where("score > 0").join(sizes, "category"), "scored")
    mine = positives.join(keyed, "ocid").join(scored.select("firm_id", "category", F.col("score").alias("own")), ["firm_id", "category"], "left").select("firm_id", "ocid", F.coalesce("own", F.lit(0.0)).alias("own"))
    levels = scored.select("firm_id", F.col("score").alias("own"), "size").union(scored.select("firm_id", F.lit(0.0), F.lit(0).cast("long")).distinct()).groupBy("firm_id", "own").agg(F.sum("size").alias("size"))
    above = Window.partitionBy("firm_id").orderBy(F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("firm_id", "own", F.coalesce(F.sum("size").over(above), F.lit(0)).alias("better"))
    return keyed, scored, mine.join(levels, ["firm_id", "own"], "left").withColumn("better", F.coalesce("better", F.lit(0)))


def _placed(keyed: DataFrame, scored: DataFrame, mine: DataFrame) -> DataFrame:
    """mine (firm_id, ocid, own, better and others) with place; only categories of a positive's own score are joined with it, and all where that is 0."""
    every = keyed.select("ocid", F.lit("all").alias("category"))
    pairs = mine.where("own > 0").join(scored.select("firm_id", F.col("score").alias("own"), "category"), ["firm_id", "own"]).select("firm_id", "ocid", "category")
    none = mine.where("own <= 0").select("firm_id", "ocid")
    pairs = kept(pairs.union(none.join(scored.select("firm_id", "category"), "firm_id").select("firm_id", "ocid", "category")).union(none.withColumn("category", F.lit("all"))), "asked")
    below = counts_below(keyed.unionByName(every), pairs.select("category", "ocid").distinct())
    less = F.when(F.col("category") == "all", F.col("below"))
    sums = pairs.join(below, ["category", "ocid"]).groupBy("firm_id", "ocid").agg(F.sum(less).alias("all_below"), F.sum(F.when(less.isNull(), F.col("below"))).alias("level_below"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    level = F.when(F.col("own") > 0, zero("level_below")).otherwise(F.col("all_below") - zero("level_below"))
    return mine.join(sums, ["firm_id", "ocid"], "left").withColumn("place", 1 + F.col("better") + level)


def places(pool: DataFrame, scores: DataFrame, positives: DataFrame) -> DataFrame:
    """positives (firm_id, ocid) of the pool (ocid, category) with place, by score (firm_id, category, score > 0) and then ocid."""
    keyed, scored, mine = standings(pool, scores, positives)
    return _placed(keyed, scored, kept(mine, "mine")).select("firm_id", "ocid", "place")


def metrics(placed: DataFrame, k: int = 10) -> DataFrame:
    """firm_id, positives, recall at k and reciprocal rank of the first positive."""
    return placed.groupBy("firm_id").agg(F.count("*").alias("positives"), (F.count(F.when(F.col("place") <= k, 1)) / F.count("*")).alias(f"recall_{k}"), (1.0 / F.min("place")).alias("reciprocal_rank"))


def metrics_of(pool: DataFrame, scores: DataFrame, positives: DataFrame, k: int = 10) -> DataFrame:
    """metrics() of places(), for which only some positives need a place.

    A firm's positives have the order of own score and ocid, which is that of their places: its first has the reciprocal rank, and one whose
    place is at most k is among its first k and has fewer than k notices in better categories.
    """
    keyed, scored, mine = standings(pool, scores, positives)
    firm = Window.partitionBy("firm_id")
    mine = mine.withColumns({"nth": F.row_number().over(firm.orderBy(F.desc("own"), "ocid")), "positives": F.count("*").over(firm)})
    wanted = kept(mine.where((F.col("nth") == 1) | ((F.col("nth") <= k) & (F.col("better") < k))), "firsts")
    placed = _placed(keyed, scored, wanted)
    n = F.max("positives")
    return placed.groupBy("firm_id").agg(n.alias("positives"), (F.count(F.when(F.col("place") <= k, 1)) / n).alias(f"recall_{k}"), (1.0 / F.min("place")).alias("reciprocal_rank"))
