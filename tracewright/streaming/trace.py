"""Streaming twins of the windowed operators: the same columns from a stream of records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(stream: DataFrame, ts: str, seconds: int, start_us: int, *by: str, delay: str = "1 day") -> DataFrame:
    """Rows of right-closed windows that begin at start_us; the first instant itself falls into
    the first. Windows are of event time, so state of those that the watermark has passed goes."""
    width = seconds * 1_000_000
    # a microsecond earlier, what closes a window is inside it
    at = F.timestamp_micros(F.greatest(F.unix_micros(F.col(ts).cast("timestamp")) - 1, F.lit(start_us)))
    rows = stream.withColumn("__ts", at).withWatermark("__ts", delay)
    g = rows.groupBy(F.window("__ts", f"{seconds} seconds", startTime=f"{start_us % width} microseconds").alias("__w"), *by).agg(F.count("*").alias("n"))
    return g.select(((F.unix_micros("__w.start") - F.lit(start_us)) / width + 1).cast("long").alias("w"), *by, "n")


def monitor(stream: DataFrame, ts: str, seconds: int, failed, latency: str, delay: str = "1 minute") -> DataFrame:
    """Rates and mean latency of each window of event time, with a watermark."""
    at = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    g = at.groupBy(F.window("__ts", f"{seconds} seconds").alias("window"))
    return g.agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.avg(F.when(~failed, F.col(latency))).alias("avg_latency"))


def late_windows(stream: DataFrame, ts: str, seconds: int, start_us: int, key: str) -> DataFrame:
    """Counts of the open and the prior window of each key. As in the batch form nothing is
    dropped: a record from before the prior window counts in the prior one. Emits (key, w,
    n) of each window whenever it changes."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n_now, n_prior = state.get if state.exists else (1, 0, 0)
        touched: dict[int, int] = {}
        for b in batches:
            w = ((b["us"] - start_us + seconds * 1_000_000 - 1) // (seconds * 1_000_000)).clip(lower=1)
            for x in w.sort_values():
                x = int(x)
                if x > now:
                    n_prior, n_now, now = (n_now if x == now + 1 else 0), 0, x
                if x == now:
                    n_now += 1
                    touched[now] = n_now
                else:
                    n_prior += 1
                    touched[now - 1] = n_prior
        state.update((now, n_now, n_prior))
        yield pd.DataFrame({"key": [key[0]] * len(touched), "w": list(touched), "n": list(touched.values())})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, w long, n long", "now long, n_now long, n_prior long", "append", GroupStateTimeout.NoTimeout)


def lookback(stream: DataFrame, window: str, value: str, key: str, k: int) -> DataFrame:
    """Of each key's records, whether the value was seen in the k windows before. State is the last
    window of each key and value, so a key with many values is spread over many tasks. Windows
    must come in order."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(window).cast("long").alias("w"), F.col(value).cast("long").alias("v"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        windows = np.sort(np.concatenate([b["w"].to_numpy() for b in batches]))
        before = np.concatenate([[windows[0] if last is None else last], windows[:-1]])
        gap = windows - before
        state.update((int(windows[-1]),))
        yield pd.DataFrame({"key": key[0], "w": windows, "v": key[1], "again": (gap > 0) & (gap <= k)})

    return rows.groupBy("key", "v").applyInPandasWithState(step, "key string, w long, v long, again boolean", "w long", "append", GroupStateTimeout.NoTimeout)


def printed(stream: DataFrame, checkpoint: str, mode: str = "update", every: str = "10 seconds"):
    """A started query that prints each batch's metrics."""
    return stream.writeStream.format("console").outputMode(mode).option("truncate", False).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def kept(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds"):
    """A started query that appends finished windows' metrics as Parquet."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
