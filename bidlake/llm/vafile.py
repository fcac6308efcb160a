"""Exact top-k search by inner product with a vector-approximation file.

Components become floor(scale * x). Equal vectors are one class, of which the k + 1 rows with the smallest vec_ids can be results; a group limit
finds them before rows are shuffled, however many copies there are. The approximation file holds a byte a component, the number of its cell;
cells have about equal shares of the components of a sample of SAMPLE vectors (all ends are exact), so only the tightness of bounds depends on the sample.

Scan: the file is dealt in blocks, and the queries' classes visit every block, a few at a time. The cells bound every score from below and
above; a block gives back what may still be among its k + 1 best, and the k + 1st largest lower bound of all blocks removes most of that.
Reading: exact vectors of the rest are joined in the order of their upper bounds, in waves of growing size, until no unread bound reaches the
query's k + 1st exact score. Nothing is cut off: a tie with it is read as well. k + 1, as a query's own row is taken out at the end.

Vectors that are null or have null or non-finite components take no part, nor do those with a component of more than 2^27 steps, whose products a
long may not hold, or rows with a null vec_id. Vectors meet those of their own length only; an empty one scores 0. Repeated rows are rows of
their own: a copy of a query's row is a candidate, and each copy of a query is answered. An empty table gives no rows; columns other than vec_id
and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centroids import integers
from .common import Scratch, join_hot, trimmed

CELLS, SAMPLE, SAMPLE_PARTS = 256, 1024, 256
BLOCK_BYTES, CHUNK, QUERIES = 8 << 20, 2048, 128


def _packed(scale: int):
    """(vec_id, dim, least, most, vec): integer components as bytes, and their range."""
    names = ["vec_id", "dim", "least", "most", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in pc.unique(pc.list_value_length(batch.column(1))).drop_null().to_pylist():
                rows, x = integers(batch.column(1), dim, scale)
                ids = batch.column(0).take(pa.array(rows))
                x = x.astype(np.int32)
                ends = (x.min(1), x.max(1)) if dim else (np.zeros(len(rows), np.int32),) * 2
                vec = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), dim, np.int32)), pa.array(ends[0]), pa.array(ends[1]), vec], names=names)

    return run


def _vectors(column: pa.Array, kind: type, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim)


def edges_of(parts: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last value of each cell, CELLS at most; all cells together reach from least to most."""
    inner = np.quantile(parts, np.arange(1, CELLS) / CELLS, method="nearest").astype(np.int64) if len(parts) else np.zeros(0, np.int64)
    first = np.unique(np.concatenate(([least], inner[(inner > least) & (inner <= most)])))
    return first, np.append(first[1:] - 1, most)


def _celled(first: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [(np.searchsorted(first, np.frombuffer(v, np.int32), "right") - 1).astype(np.uint8).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["cls", "dim", "data"])

    return run


def bounds(queries: np.ndarray, cells: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each query with what lies in each row of cells, rounded outwards."""
    low, high = first[cells].astype(np.float64), last[cells].astype(np.float64)
    up, down = np.maximum(queries, 0).astype(np.float64), np.maximum(-queries, 0).astype(np.float64)
    slack = (up + down).sum(1, keepdims=True) * float(max(abs(int(first[0])), abs(int(last[-1])))) * 2.0**-40
    return np.floor(up @ low.T - down @ high.T - slack), np.ceil(up @ high.T - down @ low.T + slack)


def _may_win(queries: np.ndarray, cells: np.ndarray, first: np.ndarray, last: np.ndarray, most: int):
    """(query, row, lower, upper) of rows whose upper bound reaches the query's most-th largest lower bound in this block."""
    best, found = np.full((len(queries), most), -np.inf), []
    for at in range(0, len(cells), CHUNK):
        lower, upper = bounds(queries, cells[at : at + CHUNK], first, last)
        best = np.concatenate((best, lower), 1)
        best = np.partition(best, best.shape[1] - most, 1)[:, -most:]
        q, row = np.nonzero(upper >= best.min(1)[:, None])
        found.append((q, row + at, lower[q, row], upper[q, row]))
    q, row, lower, upper = (np.concatenate(c) for c in zip(*found, strict=True))
    still = upper >= best.min(1)[q]
    return q[still], row[still], lower[still], upper[still]


def _scanned(first: np.ndarray, last: np.ndarray, most: int):
    """Over rows sorted by dim, block and asks: a block's cells, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells, ids = None, [], []
        for batch in batches:
            dims, blocks, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                dim, part = int(dims[lo]), batch.slice(lo, hi - lo)
                if at != (dim, blocks[lo]):
                    at, cells, ids = (dim, blocks[lo]), [], []
                if not asks[lo]:
                    cells.append(_vectors(part.column(4), np.uint8, dim))
                    ids.append(part.column(3).to_numpy())
                    continue
                if not cells:
                    continue
                cells, ids = [np.concatenate(cells)], [np.concatenate(ids)]
                for start in range(0, hi - lo, QUERIES):
                    some = part.slice(start, QUERIES)
                    q, row, lower, upper = _may_win(_vectors(some.column(4), np.int32, dim), cells[0], first, last, most)
                    yield pa.RecordBatch.from_arrays([pa.array(some.column(3).to_numpy()[q]), pa.array(ids[0][row]), pa.array(lower.astype(np.int64)), pa.array(upper.astype(np.int64))], names=["q", "cls", "lower", "upper"])

    return trimmed(run)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = [int(np.dot(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.int32).astype(np.int64))) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.int64())], names=["q", "cls", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vafile")
    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    packed = columns.mapInArrow(_packed(scale), "vec_id long, dim int, least int, most int, vec binary").withColumn("row", F.monotonically_increasing_id())
    packed = scratch.keep(packed, "packed")
    first_rows = packed.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id", "row"))).where(F.col("place") <= k + 1)
    classes = first_rows.groupBy("vec").agg(F.min("row").alias("cls"), F.first("dim").alias("dim"), F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list(F.struct("vec_id", "row")).alias("ids"))
    classes = scratch.keep(classes, "exact")
    asked = scratch.keep(join_hot(packed.where(F.col("vec_id") % every == 0).select("vec_id", "row", "vec"), classes.select("vec", "cls"), ["vec"], 512).select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), F.col("cls").alias("q")), "asked")
    queries = scratch.keep(asked.select(F.col("q").alias("cls")).distinct().join(classes.select("cls", "dim", "vec"), "cls"), "queries")

    ends = classes.agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum(F.greatest("dim", F.lit(1))).alias("size")).first()
    few = [np.frombuffer(r["vec"], np.int32) for r in classes.orderBy(F.xxhash64("vec")).limit(SAMPLE).select("vec").collect()]
    parts = np.concatenate([v[:: max(1, len(v) // SAMPLE_PARTS)] for v in few]) if few else np.zeros(0, np.int32)
    first, last = edges_of(parts, ends["least"] or 0, ends["most"] or 0)
    blocks = max(4 * spark.sparkContext.defaultParallelism, -(-(ends["size"] or 0) // BLOCK_BYTES))
    cells = scratch.keep(classes.select("cls", "dim", "vec").mapInArrow(_celled(first), "cls long, dim int, data binary"), "cells")

    dealt = cells.select("dim", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "cls", "data")
    visits = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "cls", F.col("vec").alias("data"))
    scanned = dealt.unionByName(visits).repartition("dim", "block").sortWithinPartitions("dim", "block", "asks").mapInArrow(_scanned(first, last, k + 1), "q long, cls long, lower long, upper long")
    by_query = Window.partitionBy("q")
    enough = F.nth_value("lower", k + 1).over(by_query.orderBy(F.desc("lower"), "cls").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hopeful = scanned.withColumn("enough", enough).where("enough is null or upper >= enough").withColumn("place", F.row_number().over(by_query.orderBy(F.desc("upper"), "cls")))
    hopeful = scratch.keep(hopeful.select("q", "cls", "upper", "place"), "hopeful")

    read, wave, scores, wanted = 0, 2 * (k + 1), None, hopeful
    while wanted.limit(1).count():
        some = scratch.keep(wanted.where(F.col("place") <= read + wave).select("q", "cls"), "wave", narrow=True)
        exact = join_hot(some, classes.select("cls", "vec"), ["cls"], 512).join(queries.select(F.col("cls").alias("q"), F.col("vec").alias("query")), "q")
        new = exact.select("q", "cls", "vec", "query").mapInArrow(_scored, "q long, cls long, score long")
        scores = scratch.keep(new if scores is None else scores.unionByName(new), "scores")
        kth = F.nth_value("score", k + 1).over(by_query.orderBy(F.desc("score"), "cls").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        reached = scores.withColumn("kth", kth).groupBy("q").agg(F.first("kth").alias("kth"))
        read, wave = read + wave, 4 * wave
        wanted = scratch.keep(hopeful.where(F.col("place") > read).join(reached, "q", "left").where("kth is null or upper >= kth").select("q", "cls", "upper", "place"), "wanted", narrow=True)
    if scores is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    each = join_hot(scores, classes.select("cls", "ids"), ["cls"], 256).select("q", (-F.col("score")).alias("less"), F.explode("ids").alias("id")).select("q", "less", "id.vec_id", "id.row")
    best = each.withColumn("place", F.row_number().over(by_query.orderBy("less", "vec_id", "row"))).where(F.col("place") <= k + 1)
    best = scratch.keep(best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("less", "vec_id", "row"))).alias("best")), "best")
    answers = join_hot(asked, best, ["q"], 512)
    answers = answers.select("query_id", F.posexplode(F.slice(F.filter("best", lambda r: r["row"] != F.col("own")), 1, k)).alias("at", "r"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.less")).alias("score"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""
