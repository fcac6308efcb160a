"""Shared plumbing: scratch tables in the cluster's shared folder, size-checked broadcasts, joins with hot keys, connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured rows times this many bytes a row stay under BROADCAST_BYTES.
BROADCAST_BYTES = 32 << 20
FILES_A_CORE = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and Spark runs on one machine, a temporary one that is then set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="bidlake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """From now on the session hands Python workers batches of no more than size bytes (or one row, if that is longer).

    Spark reads the setting when a plan runs, which is after an operator has returned it, so it stays set; it only ever gets smaller.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)[bB]?", str(spark.conf.get(key)))
    if not now or int(now[1]) > size:
        spark.conf.set(key, str(size))


TRIM_SECONDS = 2.0
_trimmed_at = 0.0


def trim(now: bool = False) -> None:
    """Gives freed memory back to the system, every TRIM_SECONDS at most: Python workers stay for later stages, and share a machine."""
    global _trimmed_at
    if now or time.monotonic() - _trimmed_at > TRIM_SECONDS:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _trimmed_at = time.monotonic()


def trimmed(run):
    """A function over Arrow batches that trims at its end."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim(now=True)

    return body


#: Folders of the scratch tables that were made and not yet dropped, oldest first.
_made: list[tuple[SparkSession, str]] = []


@contextmanager
def dropped_after() -> Iterator[None]:
    """Scratch tables that are made inside are deleted at the end: the caller has written or collected all that reads them."""
    before = len(_made)
    try:
        yield
    finally:
        for spark, path in _made[before:]:
            delete(spark, path)
        del _made[before:]


class Scratch:
    """Parquet tables under the shared folder. keep() cuts lineage; what is lost with an executor is read again from there.

    Tables that a lazy result still reads stay until the caller's dropped_after() ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/bidlake/{label}-{uuid.uuid4().hex}"
        _made.append((spark, self.root))
        self.n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """narrow: rows of a few numbers from a light last step, which go to no more than FILES_A_CORE files a core."""
        self.n += 1
        if narrow:
            df = df.coalesce(FILES_A_CORE * self.spark.sparkContext.defaultParallelism)
        path = self.path(f"{self.n:03d}-{name}")
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: A key is hot with more rows than this and than one in HOT_SHARE of all, so no table has more than HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 1000, 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """left joined with right, where keys of left may be hot; right has few rows a key.

    Rows of hot keys stay where they are and meet right's rows of those keys, which are broadcast if their size allows; the other rows are
    shuffled by their keys. Both sides are read more than once, so they should be written tables or cheap.
    """
    spark = left.sparkSession
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    big = counts.orderBy(F.desc("_n")).limit(HOT_SHARE).collect()
    if big:
        total = left.count()
        big = [r for r in big if r["_n"] * HOT_SHARE > total]
    if not big:
        return left.join(right, keys, how)
    schema = counts.select(*keys).schema
    hot = F.broadcast(spark.createDataFrame([tuple(r[k] for k in keys) for r in big], schema))
    few = broadcast_if_small(right.join(hot, keys, "left_semi"), row_bytes)
    return left.join(hot, keys, "left_anti").join(right, keys, how).unionByName(left.join(hot, keys, "left_semi").join(few, keys, how))


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of edges (a, b): the smallest id reachable.

    Each round takes the smallest label among a node's neighbours and itself, then jumps to that label's own label; labels of a
    component become equal after about the logarithm of its diameter. Labels are written after each round.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges", narrow=True)
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels", narrow=True)
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id").select("id", F.least("component", "m").alias("m"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("m"), F.col("component").alias("far"))
        new = step.join(jump, "m", "left").select("id", F.least("m", F.coalesce("far", "m")).alias("component"), "was")
        new = scratch.keep(new, "labels", narrow=True)
        changed = new.where("component != was").limit(1).count()
        scratch.drop(labels)
        labels = new.select("id", "component")
        labels.scratch_path = new.scratch_path
        if not changed:
            scratch.drop(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
