"""Writes: snapshots with a pointer to the current one, inserts that ignore known keys, exports of JSON and CSV, labels read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("relevant", "marginal", "irrelevant")
BOM = "﻿"


class Snapshots:
    """Versions of a table below a folder. A version is written whole, then named in a small pointer table; readers see the last named one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def current(self) -> DataFrame | None:
        pointer = f"{self.folder}/_versions"
        if not self._exists(pointer):
            return None
        last = self.spark.read.schema("n long, name string").parquet(pointer).orderBy(F.desc("n")).first()
        return self.spark.read.parquet(f"{self.folder}/{last['name']}") if last else None

    def write(self, df: DataFrame, n: int | None = None) -> DataFrame:
        """Overwrites by a new version. n numbers it, for writers that may write one version twice; else it is one more than the last."""
        pointer = f"{self.folder}/_versions"
        if n is None:
            n = 1 + (self.spark.read.schema("n long, name string").parquet(pointer).agg(F.max("n")).first()[0] if self._exists(pointer) else 0)
        name = f"v{n:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(n, name)], "n long, name string").coalesce(1).write.mode("append").parquet(pointer)
        return self.spark.read.parquet(f"{self.folder}/{name}")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and of new the rows whose keys old does not have, each key once; rows with a null key are left out."""
    fresh = new.dropna(subset=keys).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_group(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """old with the rows of each group in new replaced by new's."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new.select(*old.columns))


def keep_columns(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """new rows, with the columns `kept` as old has them where it has the key; old rows that new lacks stay."""
    rows = new.drop(*kept).join(old.select(*keys, *kept), keys, "left").select(*old.columns)
    return rows.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields written out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def export_labels(ranked: DataFrame, path: str) -> None:
    """A ranking for labelling as one CSV with a byte order mark and an empty column `label`; arrays are joined by bars.

    A snapshot is a top list of bounded size, so it is one file.
    """
    rows = ranked.select(*(F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in ranked.dtypes)).withColumn("label", F.lit(""))
    first = rows.columns[0]
    rows.orderBy("rank").coalesce(1).withColumnRenamed(first, BOM + first).write.mode("overwrite").csv(path, header=True, escape='"')


def import_labels(spark: SparkSession, path: str, top: int) -> DataFrame:
    """(rank, label) of a labelled CSV, rank from 1 to top, labels in lower case; other labels are an error, empty ones null."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    rows = rows.toDF(*(c.replace(BOM, "").strip() for c in rows.columns))
    rows = rows.select(F.col("rank").try_cast("int").alias("rank"), F.nullif(F.lower(F.trim("label")), F.lit("")).alias("label")).where(F.col("rank").between(1, top))
    bad = [r["label"] for r in rows.where(~F.col("label").isin(*LABELS)).select("label").distinct().limit(10).collect()]
    if bad:
        raise ValueError(f"unknown labels: {', '.join(sorted(bad))}")
    return rows


def precision(labelled: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Over the first k ranks: how many are labelled, how many with each label, and the share of relevant ones among the labelled."""
    rows = labelled.where((F.col("rank") <= k) & F.col("label").isNotNull())
    counts = [F.count(F.when(F.col("label") == name, 1)).alias(name) for name in LABELS]
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("labelled"), *counts)
    return out.withColumn("precision_at_k", F.when(F.col("labelled") > 0, F.col("relevant") / F.col("labelled")))


def apply_labels(snapshot: DataFrame, rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """snapshot (rank, notice_url, label, ...) with the labels of rows (line, rank, notice_url, label), and a tally.

    Rows must be the snapshot's: as many, each rank there, each with that rank's url; else the first line that is not is named in an error. An
    empty label clears one. A snapshot is a top list, so its size is bounded; the check and the tally are each one aggregate.
    """
    n, m = snapshot.count(), rows.count()
    if n != m:
        raise ValueError(f"{m} rows for a snapshot of {n}")
    said = rows.select("line", "rank", F.coalesce(F.trim("notice_url"), F.lit("")).alias("_url"), F.col("label").alias("_label"))
    old = snapshot.select("rank", F.coalesce("notice_url", F.lit("")).alias("_known"), F.col("label").alias("_was"))
    both = said.join(old, "rank", "left")
    bad = both.where(F.col("_known").isNull() | (F.col("_known") != F.col("_url"))).agg(F.min_by(F.struct("line", "rank", "_known", "_url"), "line").alias("b")).first()["b"]
    if bad:
        raise ValueError(f"line {bad['line']}: " + (f"rank {bad['rank']} is not in this snapshot" if bad["_known"] is None else f"{bad['_url']!r} is not the url of rank {bad['rank']}, {bad['_known']!r}"))
    change = F.when(F.col("_was").eqNullSafe(F.col("_label")), "unchanged").when(F.col("_label").isNull(), "cleared").otherwise("labelled")
    found = {r["change"]: r["n"] for r in both.groupBy(change.alias("change")).agg(F.count("*").alias("n")).collect()}
    total = rows.where(F.col("label").isin(*LABELS)).count()
    out = snapshot.join(said.select("rank", "_label"), "rank", "left").withColumn("label", F.col("_label")).select(*snapshot.columns)
    return out, {k: found.get(k, 0) for k in ("labelled", "cleared", "unchanged")} | {"labelled_total": total, "rows": n}


def run_log(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows put in or in the place of those with their keys; of new rows with equal keys one stays. Null keys are keys."""
    new = new.dropDuplicates(keys)
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return old.alias("o").join(new.alias("n"), same, "left_anti").unionByName(new.select(*old.columns))


def firms_by_name(old: DataFrame, new: DataFrame, fields: list[str], token: Column) -> DataFrame:
    """Firms upserted by name: known ones get new's fields and keep firm_id and board_token, others get the next ids and a token of their own.

    old has firm_id, name, board_token and fields; of new rows with one name the last by pos counts. token is a column that mints one, as a
    random text; it is only used for firms without one. Names are trimmed, blank ones are left out.
    """
    last = new.withColumn("name", F.trim("name")).where("name != ''").groupBy("name").agg(F.max_by(F.struct(*fields), "pos").alias("_n"))
    known = old.join(last, "name", "left").select("firm_id", "name", *(F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in fields), "board_token")
    fresh = last.join(old.select("name"), "name", "left_anti").select("name", *(F.col(f"_n.{c}").alias(c) for c in fields))
    top = old.agg(F.coalesce(F.max("firm_id"), F.lit(0)).cast("long").alias("_top"))  # one row
    numbered = fresh.withColumn("_nth", F.row_number().over(Window.orderBy("name"))).join(F.broadcast(top), how="cross")  # new firms of one import
    return known.unionByName(numbered.select((F.col("_top") + F.col("_nth")).cast(dict(old.dtypes)["firm_id"]).alias("firm_id"), "name", *fields, token.alias("board_token")))


def token_key(token: Column) -> Column:
    """What a board is stored under: nothing leads back to the token."""
    return F.sha2(token.cast("string"), 256)
