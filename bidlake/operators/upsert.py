"""Change-detecting upserts over snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(a: Column, b: Column, kind: str, tolerance: float = 1e-9) -> Column:
    return a.eqNullSafe(b) | (F.abs(a - b) < tolerance) if kind == "double" else a.eqNullSafe(b)


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], content: list[str], order: list[str], now: Column) -> DataFrame:
    """The new snapshot with a column `action`: inserted, updated, unchanged, or kept (not in the batch).

    Of a key's rows in the batch the last by `order` counts. created_at stays; updated_at moves only where content differs, so the same
    batch once more changes nothing. Rows without a key are left out.
    """
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    fresh = batch.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    kinds = dict(old.dtypes)
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in content), "created_at", "updated_at", F.lit(True).alias("_old"))
    b = fresh.select(*keys, *(F.col(c).alias(f"new_{c}") for c in content), F.lit(True).alias("_new"))
    both = a.join(b, keys, "full_outer")
    equal = reduce(Column.__and__, [same(F.col(f"old_{c}"), F.col(f"new_{c}"), kinds[c]) for c in content])
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(equal, "unchanged").otherwise("updated")
    both = both.withColumn("action", action)
    moved = F.col("action").isin("inserted", "updated")
    return both.select(
        *keys,
        *(F.when(moved, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in content),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(moved, now).otherwise(F.col("updated_at")).alias("updated_at"),
        "action",
    )


def stale(existing: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(kept, keys, "left_anti")


def recomputed(rows: DataFrame, keys: list[str], new: dict[str, Column]) -> DataFrame:
    """keys and the new values of the columns in new, of the rows where one of them differs from what is there; nulls equal each other."""
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(v) for c, v in new.items()], F.lit(True))
    return rows.where(~same).select(*keys, *(v.alias(c) for c, v in new.items()))
