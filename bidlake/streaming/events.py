"""Streams over event logs: windows with watermarks, upserts a batch at a time, rate limits with state, and what changed between snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sinks import Snapshots
from ..operators.upsert import upsert


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.max("ts").alias("last_event"), F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "last_event", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there now, into a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_stream(batches: DataFrame, snapshots: Snapshots, keys: list[str], content: list[str], order: list[str], now: Column, checkpoint: str) -> StreamingQuery:
    """Late and corrected rows into a snapshot, a batch at a time, until all that is there now has come.

    A batch that runs again after a failure writes its version once more under the same number; as an upsert of the same rows changes
    nothing, readers see no difference.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        old = snapshots.current()
        if old is None:
            kinds = {f.name: f.dataType for f in batch.schema.fields}
            text = ", ".join(f"{c} {kinds[c].simpleString()}" for c in [*keys, *content])
            old = batch.sparkSession.createDataFrame([], f"{text}, created_at timestamp, updated_at timestamp")
        snapshots.write(upsert(old, batch, keys, content, order, now).drop("action"), batch_id + 1)

    q = batches.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def changes(before: DataFrame, after: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """keys and change (new, gone, changed) of two snapshots; null values are equal to each other."""
    a = before.select(*keys, F.struct(*content).alias("_a"), F.lit(1).alias("_old"))
    b = after.select(*keys, F.struct(*content).alias("_b"), F.lit(1).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change")).where("change is not null")


def limited(events: DataFrame, key: str, per_minute: int = 10, per_hour: int = 60, late: str = "10 minutes") -> DataFrame:
    """events (event_id, ts, key) with `allowed`: one is refused if per_minute of its key were allowed in the last minute, or per_hour in
    the last hour. Refused ones don't count. A stream keeps no more than per_hour times a key; they go once the watermark is an hour past.
    """
    schema, events = events.schema, events.withWatermark("ts", late)

    def decide(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for at in rows["ts"].astype("datetime64[us]").astype("int64"):
            times = [t for t in times if at - t < 3_600_000_000]
            ok = len(times) < per_hour and sum(at - t < 60_000_000 for t in times) < per_minute
            allowed.append(ok)
            times += [at] if ok else []
        state.update((times,))
        state.setTimeoutTimestamp(max([t // 1000 for t in times] + [state.getCurrentWatermarkMs()]) + 3_600_000)
        yield rows.assign(allowed=allowed)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", allowed boolean"
    return events.groupBy(key).applyInPandasWithState(decide, out, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def limits(events: DataFrame, key: str, rules: tuple[tuple[int, int], ...] = ((60, 10), (3600, 60))) -> DataFrame:
    """events (event_id, ts, key) that are all there, with allowed and retry_after in seconds, judged in the order of ts and event_id.

    rules are (seconds, most). An event is refused where one of them had its most allowed events within its last seconds, and may come again once
    the oldest of these is out of that window; the first rule that refuses says when. Refused ones don't count. A key's events pass through one
    task in order, which holds no more of them than the largest rule allows. A null key is a key; null times are refused with retry_after null.
    """
    longest, schema = max(s for s, _ in rules) * 1_000_000, events.schema
    names = [f.name for f in schema.fields if f.name not in ("allowed", "retry_after")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, times = (None,), []
        for batch in batches:
            allowed, retry = [], []
            for name, now in zip(batch.column("_key").to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if (name,) != at:
                    at, times = (name,), []
                wait = None
                if now is not None:
                    times = [t for t in times if t > now - longest]
                    for seconds, most in rules:
                        recent = [t for t in times if t > now - seconds * 1_000_000]
                        if len(recent) >= most:
                            wait = max(1, -((now - recent[0] - seconds * 1_000_000) // 1_000_000))
                            break
                    times += [now] if wait is None else []
                allowed.append(now is not None and wait is None)
                retry.append(wait)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(allowed, pa.bool_()), pa.array(retry, pa.int64())], names=[*names, "allowed", "retry_after"])

    rows = events.select(*names, F.col(key).cast("string").alias("_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in names) + ", allowed boolean, retry_after long"
    return rows.repartition("_key").sortWithinPartitions("_key", "_at", "event_id").mapInArrow(judge, out)


def asked_again(asks: DataFrame, key: str, seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """asks (event_id, ts, key) with `cached`: whether the key's last answer, given at its last ask that was not cached, still lives.

    A stream's state is one time a key. It goes once the watermark is past the answer's life, so keys that are not asked for leave nothing behind;
    a stream that starts again from its checkpoint knows what it knew. In a batch, limits() with one event in `seconds` says the same.
    """
    schema, asks = asks.schema, asks.withWatermark("ts", late)
    life = seconds * 1_000_000

    def answer(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        cached = []
        for now in rows["ts"].astype("datetime64[us]").astype("int64"):
            hit = last is not None and now - last < life
            cached.append(hit)
            last = last if hit else now
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(cached=cached)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", cached boolean"
    return asks.groupBy(key).applyInPandasWithState(answer, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)
