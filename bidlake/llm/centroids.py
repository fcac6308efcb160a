"""Centroid clustering of integer vectors by partial-distance search.

Components become floor(scale * x). A pass over the table gives each dimension's variance; distances add the dimensions of largest variance
first, a STEP at a time, and a centroid is abandoned for a vector once its partial sum is strictly above the distance of the best so far, so
that ties still go to the smaller number; survivors finish all dimensions. Rows of a batch go side by side. Each round adds up sums and counts
in the tasks and then by cluster, so the driver gets one row a cluster; only the centroids, of a fixed number, go back.

Vectors that are null, of another length or with null or non-finite components are left out, and so are those with a component of more than
2^27 steps, whose squared distances a long may not hold. Rows with equal vec_ids are vectors of their own; of those with an equal vec_id hash the
smaller vector starts first, null vec_ids start last. With fewer vectors than centroids each starts one. An empty table gives no rows;
columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

STEP, ROWS, MOST = 8, 2048, 1 << 27


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of length dim that are kept, and their integer components."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim) * scale
    good = (np.abs(x) <= MOST).all(1)  # false for NaN, which nulls become
    return rows[good], np.floor(x[good]).astype(np.int64)


def _kept(dim: int, scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), dim, scale)
            if len(rows):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * len(rows) + 1, dim, dtype=np.int32)), pa.array(x.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), flat], schema=schema)

    return run


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def nearest(x: np.ndarray, centres: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller of equals, and the squared distance; dimensions are added in the given order."""
    x, centres = x[:, order], centres[:, order]
    part = np.stack([((x[:, :STEP] - c[:STEP]) ** 2).sum(1) for c in centres], 1)
    best = part.argmin(1)  # a likely one to begin with
    least = part[np.arange(len(x)), best] + ((x[:, STEP:] - centres[best, STEP:]) ** 2).sum(1)
    for k, c in enumerate(centres):
        rows = np.flatnonzero((part[:, k] <= least) & (best != k))
        total = part[rows, k]
        for at in range(STEP, x.shape[1], STEP):
            total = total + ((x[rows, at : at + STEP] - c[at : at + STEP]) ** 2).sum(1)
            on = total <= least[rows]
            rows, total = rows[on], total[on]
            if not len(rows):
                break
        won = (total < least[rows]) | (k < best[rows])
        best[rows[won]], least[rows[won]] = k, total[won]
    return best, least


def _spread(dim: int):
    """Count, sums and sums of squares of a task's rows; the squares as doubles, as they only order the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = _matrix(batch, dim).astype(np.float64)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + (x * x).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(sums), pa.array(squares)], names=["d", "n", "s", "q"])

    return run


def _summed(centres: np.ndarray, order: np.ndarray):
    """(cluster, d, n, s): a task's count and sum of each dimension of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centres.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            whole = _matrix(batch, dim)
            for at in range(0, len(whole), ROWS):
                x = whole[at : at + ROWS]
                best, _ = nearest(x, centres, order)
                counts += np.bincount(best, minlength=k)
                np.add.at(sums, best, x)
        some = np.flatnonzero(counts)
        if len(some):
            arrays = np.repeat(some, dim), np.tile(np.arange(dim), len(some)), np.repeat(counts[some], dim), sums[some].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in arrays], names=["cluster", "d", "n", "s"])

    return run


def _assigned(centres: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch, centres.shape[1])
            found = [nearest(whole[at : at + ROWS], centres, order) for at in range(0, len(whole), ROWS)]
            if found:
                best, least = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "centroids")
    kept = scratch.keep(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_kept(dim, scale), "vec_id long, x array<int>"), "kept")
    start = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = np.array([r["x"] for r in start], np.int64)
    x = kept.select("x")
    spread = x.mapInArrow(_spread(dim), "d int, n long, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    variance = {r["d"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in spread}
    order = np.array(sorted(range(dim), key=lambda d: (-variance[d], d)))
    for _ in range(rounds):
        sums = x.mapInArrow(_summed(centres, order), "cluster long, d long, n long, s long").groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        centres = centres.copy()
        for r in sums:
            centres[r["cluster"], r["d"]] = r["s"] // r["n"]
    found = scratch.keep(kept.mapInArrow(_assigned(centres, order), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    scratch.drop(kept)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    few = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """Assignment to the centroids c{n} and the centroids that follow from it."""
    return f"""
a{n} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT), k := k)) AS best
  FROM v CROSS JOIN c{n} GROUP BY r
), s{n} AS (SELECT best.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY ALL),
m{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY k),
c{n + 1} AS (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (k))"""


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM v QUALIFY k < 16),
{", ".join(map(_round, range(4)))}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.k = best.k
"""
