"""Streams of swath observations: bounded batches, windows with late data, near-repeat removal with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from swathline.operators import stack


def files_stream(spark: SparkSession, path: str, schema, max_bytes: str | None = None, max_files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream in batches of bounded bytes or files."""
    r = spark.readStream.schema(schema)
    if max_bytes:
        r = r.option("maxBytesPerTrigger", max_bytes)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def windowed_mean(df: DataFrame, time: str, key: str, value: str, step: str, late: str = "1 day") -> DataFrame:
    """Means by key and tumbling step; rows later than ``late`` are left out."""
    return df.withWatermark(time, late).groupBy(F.window(time, step).alias("w"), key).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("step_start"), key, value, "n")


def append_cells(df: DataFrame, path: str, checkpoint: str):
    """Append a stream to cell folders, as much as is there, then stop."""
    def write(batch: DataFrame, _: int) -> None:
        order = [c for c in ("location_id", "time") if c in batch.columns] or [c for c in batch.columns if c != "cell"]
        batch = batch.persist()
        stack.write_cells(batch, path, "append", sort=order)  # a crowded cell is several tasks'
        batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_near_repeats(df: DataFrame, keys: list[str], time: str, window_s: int, late: str = "1 day") -> DataFrame:
    """Keep a row of a group unless it is less than ``window_s`` after the last one seen; state is one time per group."""
    kinds, never = dict(df.dtypes), -(2**61)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in frames:
            pdf = pdf.sort_values(time, kind="stable")
            us = pdf[time].to_numpy(dtype="datetime64[us]").astype(np.int64)
            if not len(us):
                continue
            before = np.concatenate([[never if last is None else last], us[:-1]])
            yield pdf[us - np.maximum(before, before[0]) >= window_s * 1_000_000]
            last = int(max(before[0], us[-1]))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + window_s * 1000 + 1)

    return df.withWatermark(time, late).groupBy(*keys).applyInPandasWithState(step, out, "last_us bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_memory(df: DataFrame, name: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run all available batches into a table in memory (tests)."""
    q = (transform(df) if transform else df).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def event_time(c: Column) -> Column:
    """A time without zone as one with (streams' watermarks need it)."""
    return c.cast("timestamp")
