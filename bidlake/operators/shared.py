"""Tables in the shared folder that cut lineage, and broadcasts behind a check of size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times the bytes of a row stay under this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs on one machine, a temporary one that is then set."""
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


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written under the shared folder and read again; kept_path is where, for dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bidlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.kept_path = path
    return again


def dropped(*frames: DataFrame) -> None:
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """From now on the session hands Python workers batches of at most about size bytes; it stays set, as plans run later, and only gets smaller."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)[bB]?", str(spark.conf.get(key)))
    if not now or int(now[1]) > size:
        spark.conf.set(key, str(size))


def small(df: DataFrame, row_bytes: int = 256, counted: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows, or those of counted that it holds in lists, fit BROADCAST_BYTES; else as it is, for a shuffled join."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if (df if counted is None else counted).limit(most + 1).count() <= most else df


#: Rows of a part where parts are to stay of one size as the input grows.
PART_ROWS = 400_000


def parts_for(df: DataFrame) -> int:
    """How many parts df's rows, counted, make; no fewer than the machines have cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df in n parts by keys where the session's shuffles make fewer; else as it is, as their many parts are put together by size."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
