"""Windows of a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, ts: str, width_us: int, out: str = "w") -> DataFrame:
    """Number of the window, from 1: right-closed windows of one width from the first
    record, which itself belongs to the first window. The first instant is one aggregate,
    sent to all tasks as a single row."""
    start = df.agg(F.min(micros(ts)).alias("__t0"))
    return df.crossJoin(F.broadcast(start)).withColumn(out, F.greatest(F.ceil((micros(ts) - F.col("__t0")) / F.lit(float(width_us))), F.lit(1)).cast("long")).drop("__t0")
