"""Near-duplicate embeddings by Euclidean p-stable hashing with exact cosine checks.

Unit vectors are projected on Gaussian directions; the quantised projections of a table's PROJECTIONS directions are its bucket. At the
threshold's distance a table catches a pair with about 0.107, all TABLES together miss it with about 0.001; closer pairs are caught more
surely. Equal vectors of a label become one class first, counted with its size, so copies never meet as pairs. Buckets are dealt in blocks
of bounded size; each pair of a block is checked by its cosine in double precision, and is counted only in the first table in which it
meets, so that no pairs are written out: a block emits counts, and links enough to connect what it found.

Null, zero and empty vectors, those with null or non-finite components, and null labels link with nothing; each is its own component.
Vectors of different lengths link with nothing. Repeated rows count as vectors of their own; null vec_ids pass through unlinked. A cosine
of exactly the threshold is a link. Vectors of any length are read whole. Labels are whole numbers, or texts of such. An empty table gives no rows; columns other than vec_id, label
and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

TABLES, PROJECTIONS, BLOCK, CHUNK = 60, 10, 512, 128


@lru_cache(maxsize=4)
def projections(dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions, offsets and width, which is four times the distance of unit vectors at the threshold."""
    drawn, width = np.random.default_rng(1105 + dim), 4 * (2 - 2 * threshold) ** 0.5
    return drawn.standard_normal((dim, TABLES * PROJECTIONS)), drawn.uniform(0, width, TABLES * PROJECTIONS), width


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucket_keys(x: np.ndarray, labels: np.ndarray, threshold: float) -> np.ndarray:
    """A 64-bit key for each unit vector and table, of the label, the table and the quantised projections."""
    a, b, width = projections(x.shape[1], threshold)
    cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), TABLES, PROJECTIONS).view(np.uint64)
    h = (labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(TABLES) + np.arange(TABLES, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1])
    for k in range(PROJECTIONS):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + cells[:, :, k]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles, with a key for equal vectors of a label; null for those that link with nothing."""
    for batch in batches:
        keys, data = [], []
        labels = _column(batch, "label").to_pylist()
        for value, label, vec_id in zip(_column(batch, "embedding"), labels, _column(batch, "vec_id").to_pylist(), strict=True):
            packed = None
            if value.is_valid and label is not None and vec_id is not None and len(value) and value.values.null_count == 0:
                v = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(v).all() and v.any():
                    packed = v.tobytes()
            data.append(packed)
            keys.append(hashlib.blake2b(b"%d:" % label + packed, digest_size=16).digest() if packed else None)
        yield pa.RecordBatch.from_arrays([_column(batch, "vec_id"), _column(batch, "label"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "key", "vec"])


def _matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _hashed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, label, data = (_column(batch, c).to_pylist() for c in ("rep", "label", "vec"))
            for size in sorted({len(d) for d in data}):
                pick = [i for i, d in enumerate(data) if len(d) == size]
                for at in range(0, len(pick), 1024):
                    some = pick[at : at + 1024]
                    keys = bucket_keys(unit(_matrix([data[i] for i in some])), np.array([label[i] for i in some]), threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([rep[i] for i in some], np.int64), TABLES)), pa.array(keys.ravel())], names=["rep", "bucket"])

    return run


def _block(rep: np.ndarray, label: np.ndarray, n: np.ndarray, data: list[bytes], left: np.ndarray, right: np.ndarray, bucket: int, threshold: float):
    """(rep, links counted here, a partner or None) of the members of a block pair."""
    members = np.union1d(left, right)
    place = {m: k for k, m in enumerate(members.tolist())}
    x = unit(_matrix([data[i] for i in members.tolist()]))
    keys = bucket_keys(x, label[members], threshold)
    first = (keys == bucket).argmax(1)  # the table of this bucket
    table = int(np.bincount(first).argmax())
    same = left is right or np.array_equal(left, right)
    l, r = np.array([place[i] for i in left.tolist()]), np.array([place[i] for i in right.tolist()])  # noqa: E741
    links, root, own = np.zeros(len(members), np.int64), list(range(len(members))), label[members]
    edges: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(l), CHUNK):
        some = l[at : at + CHUNK]
        close = (x[some] @ x[r].T >= threshold) & (own[some][:, None] == own[r])
        for row, i in zip(close, some.tolist(), strict=True):
            others = r[row]
            others = others[others > i] if same else others[others != i]
            if table and len(others):
                others = others[~(keys[others, :table] == keys[i, :table]).any(1)]
            if len(others):
                links[i] += n[members[others]].sum()
                links[others] += n[members[i]]
                for j in others.tolist():
                    a, b = find(i), find(j)
                    if a != b:
                        root[a] = b
                        edges.append((i, j))
    ids = rep[members]
    return [(int(ids[k]), int(links[k]), None) for k in np.flatnonzero(links)] + [(int(ids[i]), 0, int(ids[j])) for i, j in edges]


def _compared(threshold: float):
    """Over rows sorted by bucket, i and j; a group of them has two blocks at most and may go on in the next batch."""

    def done(held: pa.Table) -> list[tuple]:
        bucket, i, j, block, rep, label, n = (held[c].to_numpy() for c in ("bucket", "i", "j", "block", "rep", "label", "n"))
        data, out = held["vec"].to_pylist(), []
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
            rows = np.arange(lo, hi)
            left, right = rows[block[lo:hi] == i[lo]], rows[block[lo:hi] == j[lo]]
            if hi - lo > 1 and len(left) and len(right):
                out += _block(rep, label, n, data, left, left if i[lo] == j[lo] else right, int(bucket[lo]), threshold)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            keys = [held[c].to_numpy() for c in ("bucket", "i", "j")]
            open_from = len(held) - 1
            while open_from and all(k[open_from - 1] == k[-1] for k in keys):
                open_from -= 1
            if open_from:
                rows, held = done(held.slice(0, open_from).combine_chunks()), held.slice(open_from).combine_chunks()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
        rows = done(held) if held is not None and len(held) else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    packed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    packed = scratch.keep(packed.mapInArrow(_packed, "vec_id long, label long, key binary, vec binary"), "packed")
    reps = packed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    reps = scratch.keep(reps, "classes")
    hashed = scratch.keep(reps.mapInArrow(_hashed(threshold), "rep long, bucket long"), "buckets")
    shared = hashed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    dealt = hashed.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep").join(reps.select("rep", "label", "n", "vec"), "rep")
    met = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_compared(threshold), "rep long, links long, other long")
    met = scratch.keep(met, "met")
    counts = met.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(scratch, met.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = reps.select("key", "rep", "n").join(counts, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    classes = scratch.keep(classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "components")
    scratch.drop(hashed, met)
    linked = packed.where("key is not null").select("vec_id", "key").join(classes, "key").select("vec_id", "n_links", "component_id")
    alone = packed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs of a label, for small tables; components by walking the links.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (SELECT r, vec_id, label, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
unit AS (SELECT r, vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM good),
links AS (SELECT a.r, b.r AS s FROM unit a JOIN unit b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) >= 0.93),
reach AS (SELECT r, r AS s FROM v UNION SELECT k.r, l.s FROM reach k JOIN links l ON l.r = k.s),
low AS (SELECT k.r, min(o.vec_id) AS component_id FROM reach k JOIN v o ON o.r = k.s GROUP BY k.r), n AS (SELECT r, count(*) AS n FROM links GROUP BY r)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN low ON low.r = v.r LEFT JOIN n ON n.r = v.r
"""
