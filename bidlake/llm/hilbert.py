"""Sharding along a Hilbert curve: metadata is quantised to a cell, rows are put in the order of the cells' curve index, and the order is
cut into runs, so each file spans a small box of the metadata and min/max statistics prune it.

Law `rows`: counts of shards differ by one at most. Equal texts are one group: all rows of a group take the smallest curve index among
them and lie side by side, so a group is parted only where a cut between two shards falls inside it: no more than shards - 1 groups are,
and a group that is larger than a shard must be. Null text has size 1 and the checksum of '' (0); null, empty and any other lang or source
are values of their own. Ties of the curve index are ordered by checksum, size, a second hash and doc_id; repeated rows take neighbouring
slots. Texts of any length are one row. An empty table gives no rows. Only doc_id, text, lang and source are read; columns of other names
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, join_hot

BITS, DIMS = 4, 3


def curve_point(index: int, bits: int = BITS, dims: int = DIMS) -> tuple[int, ...]:
    """The cell at a place of the curve: the index's bits, dealt out to the axes, are undone from a Gray code one bit plane at a time."""
    x = [0] * dims
    for b in range(bits * dims):
        x[dims - 1 - b % dims] |= (index >> b & 1) << (b // dims)
    last = x[-1] >> 1
    for i in range(dims - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= last
    plane = 2
    while plane < 1 << bits:
        low = plane - 1
        for i in range(dims - 1, -1, -1):
            if x[i] & plane:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        plane <<= 1
    return tuple(x)


def curve_table(bits: int = BITS, dims: int = DIMS) -> list[int]:
    """The curve index of each cell; a cell's number has the first axis in its highest bits. It has 2 ** (bits * dims) entries, 4096 by default."""
    table = [0] * (1 << bits * dims)
    for index in range(len(table)):
        cell = 0
        for v in curve_point(index, bits, dims):
            cell = cell << bits | v
        table[cell] = index
    return table


def ordinal(value: Column) -> Column:
    """A number for the first seven bytes of a string, in the order of strings."""
    return F.conv(F.rpad(F.hex(F.substring(value.cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def quantised(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text_hash and the axes, all in the order of their values, so min and max of a run bound them.

    Language and source are cut at quantiles of the rows (0 for null), size by its power of two (below 16 bytes 0, from 512 KiB 15).
    """
    cells = (1 << BITS) - 1
    at = F.array(*(F.lit(k / cells) for k in range(1, cells)))
    bounds = docs.select(*(F.percentile_approx(ordinal(F.col(c)), at, F.lit(1000)).alias(c) for c in ("lang", "source"))).first()

    def axis(name: str) -> Column:
        value = ordinal(F.col(name))
        below = sum(((value > b).cast("int") for b in bounds[name] or []), F.lit(0))
        return F.when(F.col(name).isNull(), 0).otherwise(below + 1).cast("int")

    body = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")
    power = F.least(F.greatest(F.floor(F.log2(size.cast("double"))) - 4, F.lit(0)), F.lit(15)).cast("int")
    return docs.select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"), axis("lang").alias("axis_lang"), axis("source").alias("axis_source"), power.alias("axis_size"))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), curve.

    Only narrow rows are sorted. The sorted rows are written once, so that the counts of their partitions and the positions derived from
    them agree even if a task is run again; one number a partition goes to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hilbert")
    table = F.array(*(F.lit(v) for v in curve_table()))
    cell = F.col("axis_lang") * 256 + F.col("axis_source") * 16 + F.col("axis_size")
    group = ["text_crc32", "size", "text_hash"]
    keyed = scratch.keep(quantised(docs).select("doc_id", *group, F.element_at(table, cell + 1).alias("own")), "cells")
    spread = keyed.groupBy(*group).agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select(*group, "low")
    spread = scratch.keep(spread, "groups", narrow=True)
    small = spread.count() * 48 <= BROADCAST_BYTES
    keyed = keyed.join(F.broadcast(spread), group, "left") if small else join_hot(keyed, spread, group, 48, "left")
    keyed = keyed.select("doc_id", *group, F.coalesce("low", "own").alias("curve"))
    order = ["curve", *group, "doc_id"]
    run = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("at"))
    run = scratch.keep(run, "sorted")
    counts = {r["part"]: r["n"] for r in run.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, before, firsts = sum(counts.values()), 0, []
    for part in sorted(counts):
        firsts += [(part, before)]
        before += counts[part]
    offsets = spark.createDataFrame(firsts, "part int, first long")  # a row for each partition of the sort
    position = F.col("first") + F.col("at")
    placed = run.join(F.broadcast(offsets), "part").withColumn("position", position)
    whole = F.expr(f"(position * {shards}L) div {max(1, total)}L")
    start = F.expr(f"(shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    placed = placed.withColumn("shard", whole).withColumn("slot", F.col("position") - start)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
