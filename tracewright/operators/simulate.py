"""Simulated transactions: choices, loops, schedules and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.exprs import lcg


def choice(u: Column, shares: dict[str, float]) -> Column:
    """The entry whose range of the running sum holds u; the last one takes the rest."""
    names, total = list(shares), 0.0
    out = None
    for n in names[:-1]:
        total += shares[n]
        out = F.when(u < total, F.lit(n)) if out is None else out.when(u < total, F.lit(n))
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def loop_count(average: Column, u: Column) -> Column:
    """The mean's whole part, and one more as often as its fraction says."""
    return (F.floor(average) + (u < average - F.floor(average)).cast("int")).cast("int")


def schedule(rates: DataFrame, window: str, start: Column, width_us: int) -> DataFrame:
    """A row for each transaction of each window, evenly spaced: kind, window, k and at_us."""
    each = rates.where("txns > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("txns") - 1)))
    return each.withColumn("at_us", start + (F.col(window) - 1) * width_us + F.floor(F.col("k") * width_us / F.col("txns")).cast("long"))


def parameters(instances: DataFrame, key: str, edges: list[dict]) -> DataFrame:
    """Parameters in the order of edges, each made of earlier ones: kind equal (of), linear
    (of, a, b) or draw (column: a distribution's value); an equal edge with p below 1 takes
    the draw instead as often."""
    out = instances
    for k, e in enumerate(edges):
        made = e.get("draw")
        if e["kind"] == "linear":
            made = F.col(e["of"]) * e["a"] + e["b"]
        elif e["kind"] == "equal":
            made = F.when(lcg(F.col(key), 70 + k) < e.get("p", 1.0), F.col(e["of"])).otherwise(made if made is not None else F.lit(None))
        out = out.withColumn(e["name"], made)
    return out


def outcomes(df: DataFrame, key: str, latency: Column, rollback: float, deadlock: float) -> DataFrame:
    """outcome of each transaction: its latency, 0 if rolled back, -1 if it failed."""
    u = lcg(F.col(key), 90)
    return df.withColumn("outcome", F.when(u < deadlock, -1.0).when(u < deadlock + rollback, 0.0).otherwise(latency))
