"""Profiles of firms as of a day: counts, their most frequent keys, features, and the direction of their work in eight bits.

interactions are those of features (canonical_id, ocid, date, won, bid_amount, buyer_id, category, region), names has canonical_id, raw_name,
normalized_name and observations, vectors canonical_id, date and vector. Firms with fewer interactions before the day than least have none.
Of a key's counts the most frequent most_keys stay, equal ones by key; a group limit finds them before rows are shuffled, so a firm with many
buyers is never gathered. The name most observed is shown, of equal ones the smaller; firms without a name go by their id. Vectors are averaged
over those before the day that have no null, to unit length; without any the centroid is zero and empty. Empty tables give no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import features
from .divergence import quantised
from .shared import kept, parts_for

LEAST_BIDS, MOST_KEYS = 5, 200
KEYS = (("region", "regions"), ("category", "categories"), ("buyer_id", "buyers"))


def packed(c: Column) -> Column:
    """struct<centroid, scale>: an array of numbers in eight bits as base64, and what one step is worth."""

    @arrow_udf("struct<centroid:string,scale:double>")
    def of(vectors: pa.Array) -> pa.Array:
        done = [quantised(v.values.to_numpy(zero_copy_only=False).astype(np.float64)) if v.is_valid else (np.zeros(0, np.int8), 1 / 127) for v in vectors]
        return pa.StructArray.from_arrays([pa.array([base64.b64encode(q.tobytes()).decode() for q, _ in done], pa.string()), pa.array([float(s) for _, s in done], pa.float64())], names=["centroid", "scale"])

    return of(c)


def unpacked(c: Column, scale: Column) -> Column:
    """The numbers that packed() stands for."""

    @arrow_udf("array<double>")
    def of(texts: pa.Array, scales: pa.Array) -> pa.Array:
        return pa.array([None if t is None else (np.frombuffer(base64.b64decode(t), np.int8) * float(s)).tolist() for t, s in zip(texts.to_pylist(), scales.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return of(c, scale)


def top_keys(rows: DataFrame, key: str, parts: int, most: int = MOST_KEYS) -> DataFrame:
    """(canonical_id, key, n): each firm's most frequent values, counted in parts as by key_counts."""
    place = F.row_number().over(Window.partitionBy("canonical_id").orderBy(F.desc("n"), key))
    return features.key_counts(rows, key, parts).withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def unit_means(vectors: DataFrame) -> DataFrame:
    """(canonical_id, vector): the mean of a firm's vectors, to unit length."""
    good = vectors.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))))
    means = good.select("canonical_id", F.posexplode("vector").alias("k", "x")).groupBy("canonical_id", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy("canonical_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("size", size).select("canonical_id", F.when(F.col("size") > 0, F.transform("v", lambda x: x / F.col("size"))).otherwise(F.col("v")).alias("vector"))


def profiles(interactions: DataFrame, names: DataFrame, vectors: DataFrame, as_of: Column, least: int = LEAST_BIDS, most_keys: int = MOST_KEYS) -> DataFrame:
    """id, name, normalized, bids, wins, first, last, regions, categories and buyers (maps of counts), features, centroid and centroid_scale."""
    parts = parts_for(interactions)
    history = kept(features.histories(interactions, as_of).where(F.col("interactions") >= least), "histories")
    mine = features.past(interactions, as_of).join(history.select("canonical_id"), "canonical_id", "left_semi")
    shown = names.groupBy("canonical_id").agg(F.min_by(F.struct("raw_name", "normalized_name"), F.struct(-F.col("observations"), F.col("raw_name"))).alias("_name"))
    rows = history.join(shown, "canonical_id", "left")
    for key, name in KEYS:
        order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(key).cast("string").alias("key"))))
        pairs = top_keys(mine, key, parts, most_keys).groupBy("canonical_id").agg(F.map_from_entries(F.transform(order, lambda e: F.struct(e["key"], -e["less"]))).alias(name + "_map"))
        rows = rows.join(pairs, "canonical_id", "left")
    facts = features.firm_features(history, history, as_of).select("canonical_id", F.struct(*(F.round(c, 6).alias(c) for c in features.FIRM)).alias("features"))
    means = unit_means(vectors.where(F.col("date") < as_of).join(history.select("canonical_id"), "canonical_id", "left_semi"))
    rows = rows.join(facts, "canonical_id").join(means, "canonical_id", "left").withColumn("_packed", packed(F.col("vector")))
    none, own = F.create_map().cast("map<string,bigint>"), F.col("canonical_id").cast("string")
    return rows.select(
        F.col("canonical_id").alias("id"), F.coalesce("_name.raw_name", own).alias("name"), F.coalesce("_name.normalized_name", own).alias("normalized"), F.col("interactions").alias("bids"), "wins",
        F.col("first_date").alias("first"), F.col("last_date").alias("last"), *(F.coalesce(f"{n}_map", none).alias(n) for _, n in KEYS), "features", F.col("_packed.centroid").alias("centroid"), F.col("_packed.scale").alias("centroid_scale"),
    )


def name_index(rows: DataFrame) -> DataFrame:
    """normalized and the ids that answer to it."""
    return rows.groupBy("normalized").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def summary(rows: DataFrame) -> DataFrame:
    """id, name, bids, since_year, the three most frequent categories and the two most frequent regions."""
    first = lambda c, n: F.transform(F.slice(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key")))), 1, n), lambda e: e["key"])
    return rows.select("id", "name", "bids", F.year("first").cast("string").alias("since_year"), first("categories", 3).alias("categories"), first("regions", 2).alias("regions"))


def problems(firms: DataFrame, vocabularies: dict[str, list[str]], kinds: list[str]) -> DataFrame:
    """firms (name, the columns of vocabularies, value_min, value_max, past_projects array<struct<type_slug,...>>) with problems, in words.

    A name is required, listed values must be of their vocabulary, bounds in order, and projects of known kinds. Null lists are empty.
    """
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    found = [F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.lit("name is required"))]
    for column, allowed in vocabularies.items():
        unknown = F.array_except(F.coalesce(column, texts([])), texts(allowed))
        found.append(F.when(F.size(unknown) > 0, F.concat(F.lit(f"{column} has values outside the vocabulary: "), listed(unknown))))
    found.append(F.when(F.col("value_min") > F.col("value_max"), F.lit("value_min is greater than value_max")))
    slugs = F.transform(F.coalesce(F.transform("past_projects", lambda p: F.coalesce(p["type_slug"], F.lit(""))), texts([])), lambda s, i: F.when((s != "") & ~F.array_contains(texts(kinds), s), F.concat(F.lit("past_projects["), i.cast("string"), F.lit("].type_slug is outside the vocabulary: "), s)))
    return firms.withColumn("problems", F.concat(F.array_compact(F.array(*found)), F.array_compact(slugs)))
