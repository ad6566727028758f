"""Synthetic rows and parameters, each a function of a row's number, so that any part of a
table can be made anywhere and again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.exprs import lcg

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def seed_string(key: Column, length: Column, stream: int = 0) -> Column:
    """A string of letters and digits from an id."""
    digit = lambda i: F.substr(F.lit(DIGITS), F.floor(lcg(key * 64 + i, stream) * 62).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), length), digit), "")


def string_between(key: Column, shortest: int, longest: int, stream: int = 0) -> Column:
    """A string of letters and digits from an id, its length even between two bounds."""
    length = F.lit(shortest) + F.floor(lcg(key, stream + 1) * (longest - shortest + 1)).cast("int")
    return F.when(key.isNotNull(), seed_string(key, length, stream))


def number_column(key: Column, ndv: int, low: float, step: float, null_ratio: float = 0.0, stream: int = 0) -> Column:
    """low + i step for an i below ndv, or null."""
    v = F.floor(lcg(key, stream) * ndv) * F.lit(step) + F.lit(low)
    return F.when(lcg(key, stream + 1) >= null_ratio, v)


def string_column(key: Column, ndv: int, longest: int, null_ratio: float = 0.0, stream: int = 0) -> Column:
    """i#seed, cut to the longest, for an i below ndv."""
    i = F.floor(lcg(key, stream) * ndv).cast("long")
    text = F.substr(F.concat(i.cast("string"), F.lit("#"), seed_string(i, F.lit(longest), stream)), F.lit(1), F.lit(longest))
    return F.when(lcg(key, stream + 1) >= null_ratio, text)


def boolean_column(key: Column, true_ratio: float, stream: int = 0) -> Column:
    return lcg(key, stream) < true_ratio


def _div(number: Column, by: int) -> Column:
    """Whole division of integers, exact at any size."""
    whole = number.cast("long")
    return ((whole - F.pmod(whole, F.lit(by))) / by).cast("long") if by == 1 else F.call_function("div", whole, F.lit(by).cast("long"))


def key_columns(number: Column, ranges: list[int]) -> list[Column]:
    """Mixed-radix digits, from 1, of a row's number: every combination once."""
    out, stride = [], 1
    for r in reversed(ranges):
        out.append((F.pmod(_div(number, stride), F.lit(r)) + 1).cast("long"))
        stride *= r
    return out[::-1]


def key_ranges(tables: list[dict], sizes: dict[str, int]) -> list[tuple[str, str, int]]:
    """(table, column, range) of key columns. Columns that refer have their parent's range;
    the first own one gets what is left of the size, further ones 1. Planning over a
    schema, in the order of reference; tables: name, key, refs (column to table, column)."""
    ranges: dict[tuple[str, str], int] = {}
    for t in tables:
        refs = t["refs"]
        for c, parent in refs.items():
            ranges[t["name"], c] = ranges[parent]
        inherited = math.prod(ranges[t["name"], c] for c in t["key"] if c in refs)
        own = [c for c in t["key"] if c not in refs]
        for k, c in enumerate(own):
            ranges[t["name"], c] = max(1, round(sizes[t["name"]] / inherited)) if k == 0 else 1
    return [(t, c, r) for (t, c), r in ranges.items()]


def foreign_key(key: Column, parents: Column, stream: int = 0) -> Column:
    """A parent's number from 1."""
    return (F.floor(lcg(key, stream) * parents) + 1).cast("long")


def with_fake_columns(df: DataFrame, key: str, n: int, ndv: int = 800, low: int = 31) -> DataFrame:
    return df.withColumns({f"fake_{k}": (F.floor(lcg(F.col(key), 50 + k) * ndv) + low).cast("int") for k in range(n)})


def sampled(df: DataFrame, u: Column, cdf: DataFrame, columns: list[str], by: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """Each row with the entry of a distribution that u falls into. cdf: lo and hi of its
    entries; with by, of the distribution of its own key. Up to most entries are broadcast;
    more are dealt to steps of u and joined by equality of the step."""
    entries = cdf.select("lo", "hi", *columns, *(by or []))
    inside = (F.col("lo") <= F.col("__u")) & (F.col("__u") < F.col("hi"))
    rows = df.withColumn("__u", u)
    if by:
        return rows.join(entries, by).where(inside).drop("lo", "hi")
    if entries.count() <= most:
        return rows.join(F.broadcast(entries), inside).drop("lo", "hi")
    steps = 4096
    step = lambda c: F.floor(c * steps).cast("int")
    spread = entries.withColumn("__s", F.explode(F.sequence(step(F.col("lo")), step(F.col("hi")))))
    return rows.withColumn("__s", step(F.col("__u"))).join(spread, "__s").where(inside).drop("lo", "hi", "__s")


def uniform(u: Column, low: Column, high: Column) -> Column:
    """A value of the domain, whatever its distribution."""
    return low + u * (high - low)


def sampled_values(df: DataFrame, u: Column, w: Column, cdf: DataFrame, quantiles: DataFrame, by: list[str]) -> DataFrame:
    """v of each row from a measured distribution: a frequent value, or a place in a bucket by its
    quantiles. cdf: by, lo, hi, v (null for buckets) and bucket; quantiles: by, bucket, step
    (from 1) and v, the least value at which so many equal parts of a bucket's rows are
    reached. w in [0, 1) says which part of the bucket and where in it."""
    picked = sampled(df.withColumn("__w", w), u, cdf, ["v", "bucket"], by)
    edges = quantiles.groupBy(*by, "bucket").agg(F.sort_array(F.collect_list(F.struct("step", F.col("v").cast("double").alias("q")))).alias("__q"))
    both = picked.join(edges, [*by, "bucket"], "left")
    n = F.size("__q")
    part = F.least(F.floor(F.col("__w") * n), n - 1).cast("int")
    high = F.get("__q", part)["q"]
    low = F.when(part > 0, F.get("__q", part - 1)["q"]).otherwise(high)
    inside = low + (F.col("__w") * n - part) * (high - low)
    return both.withColumn("v", F.coalesce(F.col("v").cast("double"), inside)).drop("__w", "__u", "__q")


def partition_draws(df: DataFrame, how: Column, own: Column, u: Column, shares: DataFrame) -> DataFrame:
    """part of each row: its own partition (how = same), one of the others by their shares
    (different) or any by its share (any). shares: part and freq of every partition, of which
    there are few; the own one's share is cut out of the running sum, so nothing is drawn twice."""
    table = shares.agg(F.array_sort(F.collect_list(F.struct("part", "freq"))).alias("__t"))
    rows = df.withColumn("__own", own).withColumn("__how", how).withColumn("__r", u).crossJoin(F.broadcast(table))
    open_ = F.when(F.col("__how") == "different", F.filter("__t", lambda x: x["part"] != F.col("__own"))).otherwise(F.col("__t"))
    rows = rows.withColumn("__t", open_)
    total = F.aggregate("__t", F.lit(0.0), lambda s, x: s + x["freq"])
    # how many running sums the draw has passed
    passed = F.aggregate("__t", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, x: F.struct((a["s"] + x["freq"]).alias("s"), (a["k"] + F.when(a["s"] + x["freq"] <= F.col("__x"), 1).otherwise(0)).alias("k")), lambda a: a["k"])
    drawn = rows.withColumn("__x", F.col("__r") * total).withColumn("__k", passed)
    part = F.get("__t", F.least(F.col("__k"), F.size("__t") - 1))["part"]
    return drawn.withColumn("part", F.when(F.col("__how") == "same", F.col("__own")).otherwise(part)).drop("__own", "__how", "__r", "__t", "__x", "__k")


def varchar_values(df: DataFrame, u: Column, w: Column, cdf: DataFrame, by: list[str], longest: int, stream: int = 0) -> DataFrame:
    """A string of each row from a measured distribution: a frequent one, or i#seed with an i below
    the number of strings in its hash bucket. cdf: by, lo, hi, slot, v and ndv."""
    picked = sampled(df.withColumn("__w", w), u, cdf, ["slot", "v", "ndv"], by)
    i = F.floor(F.col("__w") * F.col("ndv")).cast("long") * 1000 + F.col("slot")
    fresh = F.substr(F.concat(i.cast("string"), F.lit("#"), seed_string(i, F.lit(longest), stream)), F.lit(1), F.lit(longest))
    return picked.withColumn("s", F.coalesce("v", fresh)).drop("__w", "__u")


def within(u: Column, low: Column, high: Column) -> Column:
    """A place in a bucket."""
    return low + u * (high - low)


def in_domain(v: Column, low, high) -> Column:
    return v.between(low, high)


def round_robin(df: DataFrame, number: Column, bucket: Column, candidates: DataFrame) -> DataFrame:
    """Each row with the next candidate of its bucket in turn. candidates: bucket, place
    (from 0) and v; a bucket without any gives null."""
    sizes = candidates.groupBy("bucket").agg((F.max("place") + 1).alias("size"))
    turned = df.withColumn("bucket", bucket).join(sizes, "bucket", "left").withColumn("place", F.pmod(number, F.col("size")))
    return turned.join(candidates.select("bucket", "place", "v"), ["bucket", "place"], "left").drop("place", "size")


def round_robin_windows(df: DataFrame, number: Column, bucket: Column, candidates: DataFrame) -> DataFrame:
    """round_robin with candidates of each window: candidates has w as well, and so has df."""
    sizes = candidates.groupBy("w", "bucket").agg((F.max("place") + 1).alias("size"))
    turned = df.withColumn("bucket", bucket).join(sizes, ["w", "bucket"], "left").withColumn("place", F.pmod(number, F.col("size")))
    return turned.join(candidates.select("w", "bucket", "place", "v"), ["w", "bucket", "place"], "left").drop("place", "size")


def measured_keep(counts: DataFrame, window: str, size: int) -> DataFrame:
    """keep of each window: how many of size candidates are used again, by the share of the
    window's rows whose value was in the window before."""
    gap = F.col(window) - F.lag(window).over(W.partitionBy("v").orderBy(window))
    rows = counts.withColumn("__g", gap).groupBy(window).agg((F.sum(F.when(F.col("__g") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("__r"))
    return rows.select(window, F.round(F.col("__r") * size).cast("int").alias("keep"))


def next_candidates(prior: DataFrame, domain: DataFrame, keep: int, size: int) -> DataFrame:
    """The candidates of a window: the first keep of the prior window and, behind them, values
    of the domain that were no candidates, up to size. prior: place and v; domain: v."""
    kept = prior.where(F.col("place") < keep).select("place", "v", F.lit(True).alias("reused"))
    order = [F.xxhash64("v"), F.col("v")]
    fresh = domain.join(prior, "v", "left_anti").orderBy(*order).limit(size - keep).withColumn("place", F.row_number().over(W.orderBy(*order)) + keep - 1)
    return kept.unionByName(fresh.select("place", "v", F.lit(False).alias("reused")))


def window_candidates(prior: DataFrame, domain: DataFrame, by: str, keep: DataFrame | int, size: int, order: Column | None = None) -> DataFrame:
    """next_candidates for each window; prior: by, place and v, at most size rows of a window;
    keep: by and keep, how many of them a window uses again, or one number for all windows.

    At most size of the domain's first values are candidates of a window already, so the fresh
    ones of any window are among its first 2 size."""
    order = [F.xxhash64("v") if order is None else order, F.col("v")]
    if isinstance(keep, int):
        keep = prior.select(by).distinct().withColumn("keep", F.lit(keep))
    kept = prior.join(keep, by).where("place < keep").select(by, "place", "v", F.lit(True).alias("reused"))
    first = domain.select("v").distinct().orderBy(*order).limit(2 * size)
    fresh = keep.crossJoin(F.broadcast(first)).join(prior, [by, "v"], "left_anti")
    fresh = fresh.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)) + F.col("keep") - 1).where(F.col("place") < size)
    return kept.unionByName(fresh.select(by, "place", "v", F.lit(False).alias("reused")))
