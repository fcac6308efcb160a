"""How far eight-bit vectors move a firm's ranking of tenders: errors of the cosine, shifts of rank, changed first places, reorderings that matter.

Every firm ranks every tender, so scores are a row for each of both; they are made in blocks of tenders that the firms visit. A rank is counted,
not windowed over a firm's whole list: tenders in better steps of the score, from counts a step, and those before it in its own step. Reorderings
are pairs whose order turned though their exact scores are more than factor times the firm's error apart. As no score moved by more than the
error, such a pair is no more than twice the error apart: scores are cut in cells of that width, and turned pairs of a cell and the next are
counted by merging sorted halves, without making a pair. From a factor of 2 on there are none, which is what the report is to show.

Scores are rounded to DIGITS places, so equal vectors tie however they were added up; ties go to the smaller tender_id. Null vectors and those
with null or non-finite components are left out; a zero vector scores 0, and those of another length are not scored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

BLOCK, STEPS, DIGITS, FIRST = 4096, 2048, 12, 10


def quantised(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Whole numbers of -127 to 127, halves to even, and what one of them is worth."""
    scale = (float(np.abs(v).max()) if len(v) else 0.0) / 127 or 1 / 127
    return np.clip(np.round(v / scale), -127, 127).astype(np.int8), scale


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum())
    return v / size if size else v


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by dim, block and asks: a block's tenders, then the firms that visit it."""
    at, held, ids = None, [], []
    for batch in batches:
        for dim, block, asks, name, vector in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if at != (dim, block):
                at, held, ids = (dim, block), [], []
            if not asks:
                held.append(_unit(v))
                ids.append(name)
            elif held:
                held = [np.vstack(held)]
                q, _ = quantised(v)
                exact, approx = (np.round(held[0] @ _unit(c), DIGITS) for c in (v, q.astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), batch.schema.field(3).type), pa.array(ids, batch.schema.field(3).type), pa.array(exact), pa.array(approx)], names=["firm_id", "tender_id", "exact", "approx"])


def _usable(rows: DataFrame, key: str) -> DataFrame:
    v = F.col("vector").cast("array<double>")
    return rows.select(F.col(key).cast("string").alias("name"), v.alias("vector")).where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def scores(firms: DataFrame, tenders: DataFrame) -> DataFrame:
    """(firm_id, tender_id, exact, approx) of firms (firm_id, vector) and tenders (tender_id, vector), both ids as text."""
    firms, tenders = kept(_usable(firms, "firm_id"), "firms"), _usable(tenders, "tender_id")
    n = max(1, -(-tenders.count() // BLOCK), firms.sparkSession.sparkContext.defaultParallelism)
    dim = F.size("vector").alias("dim")
    dealt = tenders.select(dim, F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("block"), F.lit(False).alias("asks"), "name", "vector")
    visits = firms.select(dim, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(True).alias("asks"), "name", "vector")
    return dealt.unionByName(visits).repartition("dim", "block").sortWithinPartitions("dim", "block", "asks").mapInArrow(_scored, "firm_id string, tender_id string, exact double, approx double")


def placed(rows: DataFrame, score: str, place: str, tie: Column) -> DataFrame:
    """rows with place, from 0, in each firm's list by score descending, then tie."""
    step = F.floor((1 - F.col(score)) * STEPS)
    rows = rows.withColumn("_step", step)
    sizes = rows.groupBy("firm_id", "_step").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("firm_id").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("firm_id", "_step").orderBy(F.desc(score), tie))
    rows = rows.withColumn("_within", within).join(sizes.select("firm_id", "_step", before.alias("_before")), ["firm_id", "_step"])
    return rows.withColumn(place, F.col("_before") + F.col("_within") - 1).drop("_step", "_within", "_before")


def turned(exact: np.ndarray, place: np.ndarray, apart: float) -> int:
    """Pairs whose first has the smaller place though the other's score is more than apart above its own."""
    e = exact[np.argsort(place, kind="stable")]
    total, width = 0, 1
    while width < len(e):
        for at in range(0, len(e) - width, 2 * width):
            left, right = e[at : at + width], e[at + width : at + 2 * width]
            total += int((len(right) - np.searchsorted(right, left + apart, "right")).sum())
        for at in range(0, len(e), 2 * width):
            e[at : at + 2 * width] = np.sort(e[at : at + 2 * width])
        width *= 2
    return total


def _cell_pairs(rows: pd.DataFrame, factor: float) -> int:
    """Turned pairs of a cell, and those of the cell and the next lower one."""
    own = rows[rows["own"]]
    of = lambda x: (x["exact"].to_numpy(float).copy(), x["approx_place"].to_numpy(np.int64))
    apart = float(rows["error"].iloc[0]) * factor
    both, lower = turned(*of(rows), apart), turned(*of(rows[~rows["own"]]), apart)
    return both - lower if len(own) else 0


def by_firm(firms: DataFrame, tenders: DataFrame, factor: float = 2.0) -> DataFrame:
    """firm_id, tenders, max_cosine_error, max_rank_shift, changed_first and reorderings of each firm."""
    rows = kept(scores(firms, tenders), "scores")
    kinds = dict(tenders.dtypes)["tender_id"]
    tie = F.col("tender_id").cast(kinds)
    rows = kept(placed(placed(rows, "exact", "exact_place", tie), "approx", "approx_place", tie), "places")
    moved = F.abs(F.col("exact_place") - F.col("approx_place"))
    facts = rows.groupBy("firm_id").agg(
        F.count("*").alias("tenders"), F.max(F.abs(F.col("exact") - F.col("approx"))).alias("max_cosine_error"), F.max(moved).alias("max_rank_shift"),
        F.max((moved > 0) & (F.least("exact_place", "approx_place") < FIRST)).alias("changed_first"),
    )
    facts = kept(facts, "facts")
    width = F.greatest(2 * F.col("max_cosine_error"), F.lit(10.0**-DIGITS)) * 1.001
    celled = rows.join(facts.select("firm_id", "max_cosine_error"), "firm_id").where("max_cosine_error > 0").withColumn("cell", F.floor(F.col("exact") / width))
    celled = celled.select("firm_id", "exact", "approx_place", F.col("max_cosine_error").alias("error"), F.explode(F.array(F.struct(F.col("cell").alias("at"), F.lit(True).alias("own")), F.struct((F.col("cell") + 1).alias("at"), F.lit(False).alias("own")))).alias("c"))
    celled = celled.select("firm_id", "exact", "approx_place", "error", "c.at", "c.own")

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"firm_id": pd.Series([key[0]], dtype=object), "n": [_cell_pairs(group, factor)]})

    turns = celled.groupBy("firm_id", "at").applyInPandas(count, "firm_id string, n long").groupBy("firm_id").agg(F.sum("n").alias("reorderings"))
    return facts.join(turns, "firm_id", "left").select(F.col("firm_id").cast(dict(firms.dtypes)["firm_id"]).alias("firm_id"), "tenders", "max_cosine_error", "max_rank_shift", "changed_first", F.coalesce("reorderings", F.lit(0)).alias("reorderings"))


def report(each: DataFrame) -> DataFrame:
    """One row over by_firm()."""
    return each.agg(
        F.count("*").alias("firms"), F.coalesce(F.max("tenders"), F.lit(0)).alias("tenders"), F.round(F.coalesce(F.max("max_cosine_error"), F.lit(0.0)), 8).alias("max_cosine_error"), F.coalesce(F.max("max_rank_shift"), F.lit(0)).alias("max_rank_shift"),
        F.round(F.coalesce(F.avg("max_rank_shift"), F.lit(0.0)), 4).alias("mean_rank_shift"), F.count(F.when(F.col("changed_first"), 1)).alias("firms_with_changed_top10"), F.coalesce(F.sum("reorderings"), F.lit(0)).alias("material_reorderings"),
    )
