"""Distribution statistics of values in windows. Grouping columns come first in every
result; an empty list of them means one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.exprs import java_string_hash


def value_counts(df: DataFrame, by: list[str], v: str) -> DataFrame:
    return df.groupBy(*by, F.col(v).alias("v")).agg(F.count("*").alias("n"))


def with_totals(counts: DataFrame, by: list[str]) -> DataFrame:
    """Each value with its group's rows __t and least and greatest value __lo and __hi: one
    small aggregate, joined back."""
    return joined_totals(counts, totals(counts, by), by)


def totals(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("__t"), F.min("v").alias("__lo"), F.max("v").alias("__hi"))


def joined_totals(counts: DataFrame, t: DataFrame, by: list[str]) -> DataFrame:
    return counts.join(t, by) if by else counts.crossJoin(F.broadcast(t))


def top_values(counts: DataFrame, by: list[str], h: int) -> DataFrame:
    """The h most frequent values of each group, the smaller value first on ties, with their
    share of its rows. Each task keeps only its own first h of a group before the shuffle."""
    order = [F.desc("n"), F.col("v")]
    rows = with_totals(counts, by)
    if not by:
        rows = rows.orderBy(*order).limit(h)
    top = rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= h)
    return top.select(*by, "rank", "v", "n", (F.col("n") / F.col("__t")).alias("freq"))


def with_rank(counts: DataFrame, by: list[str], h: int) -> DataFrame:
    """rank of the h most frequent values, null of the others."""
    return counts.join(top_values(counts, by, h).select(*by, "v", "rank"), [*by, "v"], "left")


def without_top(counts: DataFrame, by: list[str], h: int) -> DataFrame:
    return counts.join(top_values(counts, by, h).select(*by, "v"), [*by, "v"], "left_anti") if h else counts


def bucket(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Number of the equal-width bucket, the ends clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - lo) / ((hi - lo + F.lit(1e-9)) / n)))).cast("int")


def bucketed(counts: DataFrame, by: list[str], n: int, h: int = 0) -> DataFrame:
    """Counts of the values behind the top h with their bucket; the buckets span all values."""
    spanned = joined_totals(without_top(counts, by, h), totals(counts, by), by)
    return spanned.withColumn("bucket", bucket(F.col("v").cast("double"), F.col("__lo"), F.col("__hi"), n))


def histogram(counts: DataFrame, by: list[str], n: int, h: int = 0) -> DataFrame:
    """ndv and freq (share of all rows of the group) of each bucket."""
    return bucketed(counts, by, n, h).groupBy(*by, "bucket").agg(F.count("*").alias("ndv"), (F.sum("n") / F.first("__t")).alias("freq"))


def string_histogram(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    """ndv and rows of each bucket of the hash of an ASCII string."""
    b = F.pmod(F.abs(java_string_hash(F.col("v"))), F.lit(n)).cast("int")
    return counts.groupBy(*by, b.alias("bucket")).agg(F.count("*").alias("ndv"), F.sum("n").alias("n"))


def bucket_quantiles(counts: DataFrame, by: list[str], n: int, q: int) -> DataFrame:
    """For each bucket the least value at which the running share of its rows reaches
    1/q, 2/q, ..., 1."""
    own = W.partitionBy(*by, "bucket")
    run = own.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    b = bucketed(counts, by, n).withColumn("__c", F.sum("n").over(run)).withColumn("__all", F.sum("n").over(own))
    steps = b.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(q)))).where(F.col("__c") * q >= F.col("step") * F.col("__all"))
    return steps.groupBy(*by, "bucket", "step").agg(F.min("v").alias("v"))


def repeat_gaps(counts: DataFrame, by: list[str], window: str) -> DataFrame:
    """gap: windows since the value was last seen; null at its first. A gap of i is just that
    it is in the window i back and in none between."""
    return counts.withColumn("gap", F.col(window) - F.lag(window).over(W.partitionBy(*by, "v").orderBy(window)))


def repeat_ratios(counts: DataFrame, by: list[str], window: str, k: int) -> DataFrame:
    """Share of a window's rows whose value was last seen 1, ..., k windows before."""
    g = repeat_gaps(counts, by, window)
    return g.groupBy(*by, window).agg(*[(F.sum(F.when(F.col("gap") == i, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"back_{i}") for i in range(1, k + 1)])


def top_overlap(top: DataFrame, by: list[str], window: str) -> DataFrame:
    """How many of a window's most frequent values were so in the window before."""
    before = top.select(*by, (F.col(window) + 1).alias(window), "v", F.lit(1).alias("__o"))
    return top.join(before, [*by, window, "v"], "left").groupBy(*by, window).agg(F.count("*").alias("n_top"), F.count("__o").alias("kept"))


def partitioned(df: DataFrame, part: Column, v: str) -> DataFrame:
    """Rows, share and distinct values of each partition."""
    total = df.agg(F.count("*").alias("t"))
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_distinct(v).alias("ndv")).crossJoin(F.broadcast(total)).select("part", "n", "ndv", (F.col("n") / F.col("t")).alias("freq"))


def varchar_distribution(counts: DataFrame, by: list[str], h: int, n: int) -> DataFrame:
    """The h most frequent strings (slot 1 to h, with v) and behind them n buckets of the hash of
    all others (slot h + 1 and on): ndv, n and share of the group's rows."""
    place = F.col("rank").cast("int")
    slot = F.when(place.isNotNull(), place).otherwise(h + 1 + F.pmod(F.abs(java_string_hash(F.col("v"))), F.lit(n)).cast("int"))
    rows = joined_totals(with_rank(counts, by, h), totals(counts, by), by).withColumn("slot", slot)
    return rows.groupBy(*by, "slot").agg(F.min(F.when(place.isNotNull(), F.col("v"))).alias("v"), F.count("*").alias("ndv"), F.sum("n").alias("n"), (F.sum("n") / F.first("__t")).alias("freq"))


def padded(top: DataFrame, by: list[str], h: int) -> DataFrame:
    """top_values with a row of frequency 0 for each of the h ranks that a group lacks."""
    ranks = top.select(*by).distinct() if by else top.sparkSession.range(1).select()
    every = ranks.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return every.join(top, [*by, "rank"], "left").select(*by, "rank", "v", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("freq", F.lit(0.0)).alias("freq"))


def nested(df: DataFrame, part: Column, v: str, n: int, h: int) -> DataFrame:
    """Of each partition its share of all rows and, within it, the h most frequent values and an
    equi-width histogram of the others: part, part_freq, slot (1 to h, then h + 1 + bucket), ndv
    and freq (share of the partition's rows)."""
    counts = value_counts(df.withColumn("part", part), ["part"], v)
    top = top_values(counts, ["part"], h).select("part", F.col("rank").cast("int").alias("slot"), F.lit(1).cast("long").alias("ndv"), "freq")
    rest = histogram(counts, ["part"], n, h).select("part", (F.col("bucket") + h + 1).alias("slot"), "ndv", "freq")
    per = counts.groupBy("part").agg(F.sum("n").alias("__n"))
    share = per.crossJoin(F.broadcast(per.agg(F.sum("__n").alias("__t")))).select("part", (F.col("__n") / F.col("__t")).alias("part_freq"))
    return top.union(rest).join(share, "part")


def dispatched(df: DataFrame, kind: Column, number: Column, text: Column, n: int, h: int) -> DataFrame:
    """Statistics of parameters of several kinds at once: df has param; numbers (kinds 0, 1, 3 and
    4) get their h most frequent values and a histogram, strings (2 and 5) theirs and hash
    buckets. param, kind, slot, ndv and freq; rows without a kind have no statistics."""
    rows = df.select("param", kind.alias("kind"), number.cast("double").alias("x"), text.alias("s")).where("kind is not null")
    by = ["param", "kind"]
    numbers = value_counts(rows.where("kind not in (2, 5)"), by, "x")
    strings = value_counts(rows.where("kind in (2, 5)"), by, "s")
    top = top_values(numbers, by, h).select(*by, F.col("rank").cast("int").alias("slot"), F.lit(1).cast("long").alias("ndv"), "freq")
    rest = histogram(numbers, by, n, h).select(*by, (F.col("bucket") + h + 1).alias("slot"), "ndv", "freq")
    return top.union(rest).union(varchar_distribution(strings, by, h, n).select(*by, "slot", "ndv", "freq"))


def reservoir(df: DataFrame, by: list[str], key: Column, size: int) -> DataFrame:
    """A uniform sample of each group: the rows with the least keyed random numbers."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(key))).where(F.col("__r") <= size).drop("__r")


def throughput(df: DataFrame, txn: str, window: str, runs: Column) -> DataFrame:
    """Transactions of each kind in each window: rows over the runs per transaction."""
    return df.groupBy(txn, window).agg(F.round(F.count("*") / runs).cast("long").alias("txns"))


def filled(rates: DataFrame, txn: str, window: str) -> DataFrame:
    """A row for each kind and window from 1 to the last, 0 where nothing ran."""
    last = rates.agg(F.max(window).alias("__m"))
    grid = rates.select(txn).distinct().crossJoin(F.broadcast(last)).select(txn, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))).alias(window))
    return grid.join(rates, [txn, window], "left").select(txn, window, F.coalesce("txns", F.lit(0)).alias("txns"))


def mix(rates: DataFrame, window: str) -> DataFrame:
    """Share of each kind in its window, and the window's total over all kinds."""
    t = F.sum("txns").over(W.partitionBy(window))
    return rates.withColumn("total", t).withColumn("share", F.when(F.col("total") > 0, F.col("txns") / F.col("total")))


def aligned(df: DataFrame, window: str, kind: str, kinds: list[str], v: str) -> DataFrame:
    """One row a window with the statistics of all parameters beside each other."""
    return df.groupBy(window).pivot(kind, kinds).agg(F.round(F.avg(v), 6))


def candidates(counts: DataFrame, window: str, k: int, cap: int, buckets: int) -> DataFrame:
    """Values of the k windows before each window, by hash bucket, the latest first and at
    most cap a bucket. Windows are spread to the k that follow, so the join is by equality."""
    w = counts.select(window).distinct()
    spread = counts.select("v", F.col(window).alias("seen"), F.explode(F.sequence(F.col(window) + 1, F.col(window) + k)).alias(window)).join(w, window, "left_semi")
    last = spread.groupBy(window, "v").agg(F.max("seen").alias("seen")).withColumn("bucket", F.pmod("v", F.lit(buckets)))
    return last.withColumn("place", F.row_number().over(W.partitionBy(window, "bucket").orderBy(F.desc("seen"), "v"))).where(F.col("place") <= cap)


def cdf(freq: DataFrame, by: list[str], order: str, p: str) -> DataFrame:
    """Running sum of p, its last value 1."""
    w = W.partitionBy(*by).orderBy(order)
    last = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order))) == 1
    return freq.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.sum(p).over(w.rowsBetween(W.unboundedPreceding, 0)))).withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum over the common refinement of two histograms of the lesser probability. Both with
    lo, hi and p; the rows of a bucket spread evenly over its width."""
    cuts = a.select(F.explode(F.array("lo", "hi")).alias("x")).union(b.select(F.explode(F.array("lo", "hi")))).distinct()
    steps = cuts.withColumn("y", F.lead("x").over(W.orderBy("x"))).where("y is not null")

    def mass(h: DataFrame, name: str) -> DataFrame:
        inside = F.broadcast(h).alias("h")
        return steps.join(inside, (F.col("h.lo") <= F.col("x")) & (F.col("y") <= F.col("h.hi"))).groupBy("x").agg(F.sum(F.col("h.p") * (F.col("y") - F.col("x")) / (F.col("h.hi") - F.col("h.lo"))).alias(name))

    return mass(a, "p").join(mass(b, "q"), "x").agg(F.sum(F.least("p", "q")).alias("similarity"))


def multi_histogram(df: DataFrame, columns: dict[str, Column], h: int) -> DataFrame:
    """The most frequent cells of several columns' buckets together."""
    order = [F.desc("n"), *map(F.col, columns)]
    cells = df.groupBy(*[c.alias(n) for n, c in columns.items()]).agg(F.count("*").alias("n")).orderBy(*order).limit(h)
    return cells.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def percentile_ranks(df: DataFrame, by: list[str], v: str, ps: list[float], steps: int = 1024) -> DataFrame:
    """The value at rank floor(p n), counted from 0, of each group.

    Rows are counted in steps between a group's least and greatest value; only the values of
    the steps that hold a wanted rank are put in order, so no task sorts a whole group."""
    values = df.select(*by, F.col(v).alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    ends = values.groupBy(*by).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.sum("n").alias("__n"))
    width = F.col("__hi").cast("double") - F.col("__lo").cast("double")
    step = F.when(width > 0, F.least(F.lit(steps - 1), F.floor((F.col("v").cast("double") - F.col("__lo").cast("double")) / width * steps))).otherwise(0)
    dealt = (values.join(ends, by) if by else values.crossJoin(F.broadcast(ends))).withColumn("__s", step.cast("int"))
    before = W.partitionBy(*by).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "__s").agg(F.sum("n").alias("__c"), F.first("__n").alias("__n")).withColumn("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("__n") * F.lit(p)).cast("long").alias("r")) for k, p in enumerate(ps)]))
    wanted = counts.select(*by, "__s", "__c", "__b", ranks.alias("__p")).where("__p.r >= __b and __p.r < __b + __c").groupBy(*by, "__s").agg(F.first("__b").alias("__b"), F.collect_list("__p").alias("__ps"))
    run = W.partitionBy(*by, "__s").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    near = dealt.join(wanted, [*by, "__s"]).withColumn("__e", F.col("__b") + F.sum("n").over(run))
    hit = near.select(*by, "v", F.explode("__ps").alias("__p"), "__e", "n").where("__p.r < __e and __p.r >= __e - n")
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("__p.k") == k, F.col("v"))).alias(f"p{round(p * 100)}") for k, p in enumerate(ps)])
