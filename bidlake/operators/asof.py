"""Histories of firms as of every day on which they bid: counts, wins, buyers, medians and spreads of amounts strictly before it.

Counts and spreads are running sums over a firm's days. A median is an order statistic of a growing set, which no frame gives cheaply: a firm's
amounts are put into a sorted list day by day. A firm with more than MOST_AMOUNTS is not taken as one: the bits of its amounts, which sort like
the amounts, are counted by day sixteen at a time in the tasks that read them, and each level of counts tells in which sixteenth-bit bucket
the wanted places of every day lie; after four levels the amount is known. A level's group has a row for each day and bucket, however many bids there are.

interactions has firm_id, day, won, amount and buyer_id. Rows without a day are in no history. Amounts that are null, not finite or not above 0
count as bids without an amount. A day's own rows are in no history of that day; repeated rows count as they come. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import kept, small

MOST_AMOUNTS, BITS = 100_000, 16


def amount_bits(c: Column) -> Column:
    """The bits of a positive double as a number that sorts like it."""

    @arrow_udf("long")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(x.to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64))

    return of(c)


def _amount_of(c: Column) -> Column:
    @arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.float64))

    return of(c)


def _listed(rows: pa.Table) -> pa.Table:
    """Medians before each day of a firm whose amounts fit one list."""
    rows = rows.sort_by("day")
    amounts: list[float] = []
    days, medians, last = [], [], None
    for day, x in zip(rows["day"].cast(pa.int32()).to_pylist(), rows["amount"].to_pylist(), strict=True):
        if day != last and amounts:
            days.append(day)
            medians.append((amounts[(len(amounts) - 1) // 2] + amounts[len(amounts) // 2]) / 2)
        last = day
        if x is not None:
            insort(amounts, x)
    firm = rows["firm_id"].combine_chunks().take(pa.array([0] * len(days), pa.int32()))
    return pa.table({"firm_id": firm, "day": pa.array(days, pa.int32()).cast(pa.date32()), "median": pa.array(medians, pa.float64())})


def _descend(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each asked place, the bucket it lies in and its place within; asks of a day come before the counts of that day."""
    rows = rows.sort_values(["day", "n"], na_position="first", kind="stable")
    buckets = np.unique(rows["bucket"].dropna().to_numpy(np.int64))
    counts, out = np.zeros(len(buckets), np.int64), []
    total, sums = 0, None
    for day, which, k, bucket, n in zip(rows["day"], rows["which"], rows["k"], rows["bucket"], rows["n"], strict=True):
        if n == n and n is not None:
            counts[np.searchsorted(buckets, int(bucket))] += int(n)
            sums = None
        else:
            sums = np.cumsum(counts) if sums is None else sums
            at = int(np.searchsorted(sums, int(k), "right"))
            out.append((day, int(which), int(k) - int(sums[at - 1] if at else 0), int(buckets[at])))
    first = rows.iloc[0]
    found = pd.DataFrame(out, columns=["day", "which", "k", "bucket"])
    found.insert(0, "firm_id", pd.Series([first["firm_id"]] * len(found), dtype=object))
    found.insert(1, "prefix", [int(first["prefix"])] * len(found))
    return found


def _hot_medians(amounts: DataFrame, asks: DataFrame, kind: str) -> DataFrame:
    """(firm_id, day, median) for amounts (firm_id, day, amount); asks has how many amounts a firm has before a day."""
    bits = kept(amounts.select("firm_id", "day", amount_bits(F.col("amount")).alias("bits")), "bits")
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.expr("(n_before - 1) div 2").alias("k")), F.struct(F.lit(1).alias("which"), F.expr("n_before div 2").alias("k"))))
    wanted = asks.where("n_before > 0").select("firm_id", "day", both.alias("q"), F.lit(0).cast("long").alias("prefix")).select("firm_id", "day", "q.which", "q.k", "prefix")
    for shift in range(64 - BITS, -1, -BITS):
        above = F.shiftright("bits", shift + BITS) if shift + BITS < 64 else F.lit(0).cast("long")
        groups = small(wanted.select("firm_id", "prefix").distinct(), 64)
        counts = bits.select("firm_id", "day", above.alias("prefix"), F.shiftright("bits", shift).bitwiseAND((1 << BITS) - 1).alias("bucket")).join(groups, ["firm_id", "prefix"], "left_semi")
        counts = counts.groupBy("firm_id", "prefix", "day", "bucket").agg(F.count("*").alias("n"))
        none = F.lit(None).cast("long")
        rows = counts.select("firm_id", "prefix", "day", F.lit(None).cast("int").alias("which"), none.alias("k"), "bucket", "n").unionByName(wanted.select("firm_id", "prefix", "day", "which", "k", none.alias("bucket"), none.alias("n")))
        found = rows.groupBy("firm_id", "prefix").applyInPandas(_descend, f"firm_id {kind}, prefix long, day date, which int, k long, bucket long")
        wanted = kept(found.select("firm_id", "day", "which", "k", F.shiftleft("prefix", BITS).bitwiseOR(F.col("bucket")).alias("prefix")), "places")
    return wanted.groupBy("firm_id", "day").agg(F.avg(_amount_of(F.col("prefix"))).alias("median"))


def histories(interactions: DataFrame) -> DataFrame:
    """firm_id, day, bids, wins, buyers, first_day, last_day, amounts, median_bid and spread (of log1p, over all) before each day of each firm."""
    amount = F.col("amount").cast("double")
    valid = (amount > 0) & (amount < float("inf"))
    rows = interactions.where("day is not null").select("firm_id", F.col("day").cast("date").alias("day"), F.coalesce(F.col("won").cast("long"), F.lit(0)).alias("won"), F.when(valid, amount).alias("amount"), "buyer_id")
    rows = kept(rows, "interactions")
    log = F.log1p("amount")
    days = rows.groupBy("firm_id", "day").agg(F.count("*").alias("n"), F.sum("won").alias("wins"), F.count("amount").alias("paid"), F.coalesce(F.sum(log), F.lit(0.0)).alias("s"), F.coalesce(F.sum(log * log), F.lit(0.0)).alias("q"))
    new = rows.where("buyer_id is not null").groupBy("firm_id", "buyer_id").agg(F.min("day").alias("day")).groupBy("firm_id", "day").agg(F.count("*").alias("new_buyers"))
    before = Window.partitionBy("firm_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    run = days.join(new, ["firm_id", "day"], "left").select(
        "firm_id", "day", total("n").alias("bids"), total("wins").alias("wins"), total(F.coalesce("new_buyers", F.lit(0))).alias("buyers"), F.min("day").over(before).alias("first_day"), F.max("day").over(before).alias("last_day"),
        total("paid").alias("amounts"), total("s").alias("s"), total("q").alias("q"),
    )
    run = kept(run, "running")
    kind = dict(rows.dtypes)["firm_id"]
    sizes = rows.groupBy("firm_id").agg(F.count("amount").alias("size"))
    hot = kept(sizes.where(F.col("size") > MOST_AMOUNTS).select("firm_id"), "hot")
    asked = rows.select("firm_id", "day", "amount")
    listed = asked.join(small(hot, 64), "firm_id", "left_anti").groupBy("firm_id").applyInArrow(_listed, f"firm_id {kind}, day date, median double")
    if hot.limit(1).count():
        heavy = small(hot, 64)
        asks = run.join(heavy, "firm_id", "left_semi").select("firm_id", "day", F.col("amounts").alias("n_before"))
        listed = listed.unionByName(_hot_medians(asked.where("amount is not null").join(heavy, "firm_id", "left_semi"), asks, kind))
    spread = F.sqrt(F.greatest(F.col("q") / F.col("amounts") - F.pow(F.col("s") / F.col("amounts"), 2), F.lit(0.0)))
    out = run.join(listed, ["firm_id", "day"], "left")
    return out.select("firm_id", "day", "bids", "wins", "buyers", "first_day", "last_day", "amounts", F.col("median").alias("median_bid"), F.when(F.col("amounts") > 0, spread).alias("spread"))
