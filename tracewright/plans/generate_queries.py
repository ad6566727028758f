"""Generators and simulation over the given tables' keys and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.exprs import lcg, lcg_sql
from tracewright.operators import distribution as D
from tracewright.operators import generate as G
from tracewright.operators import simulate as S
from tracewright.plans.base import DAY_US, Tables, query, windowed_events
from tracewright.plans.distribution_queries import C_SQL, RATES, H, _counts, _rates


def order_key() -> Column:
    return F.col("o_orderkey")


@query("gen_column", f"SELECT o_orderkey, CASE WHEN {lcg_sql('o_orderkey', 2)} >= 0.1 THEN floor({lcg_sql('o_orderkey', 1)} * 50) * 2.0 + 7 END amount, {lcg_sql('o_orderkey', 5)} < 0.3 flag FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", G.number_column(order_key(), 50, 7.0, 2.0, 0.1, 1).alias("amount"), G.boolean_column(order_key(), 0.3, 5).alias("flag"))


_CHARS = "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(floor({u} * 62) AS INT) + 1, 1)"


def _varchar_sql(i: str) -> str:
    seed = " || ".join(_CHARS.format(u=lcg_sql(f"{i} * 64 + {k}", 9)) for k in range(1, 13))
    return f"substr({i} || '#' || {seed}, 1, 12)"


@query("gen_varchar", f"WITH i AS (SELECT o_orderkey, CAST(floor({lcg_sql('o_orderkey', 9)} * 40) AS BIGINT) i FROM orders) SELECT o_orderkey, {_varchar_sql('i')} s FROM i")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", G.string_column(order_key(), 40, 12, 0.0, 9).alias("s"))


@query("gen_seed_string", f"SELECT o_orderkey, substr({' || '.join(_CHARS.format(u=lcg_sql(f'o_orderkey * 64 + {k}', 15)) for k in range(1, 10))}, 1, 4 + CAST(floor({lcg_sql('o_orderkey', 16)} * 6) AS INT)) s FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", G.string_between(order_key(), 4, 9, 15).alias("s"))


@query("gen_pk", "SELECT (o_orderkey // 12) % 5000 + 1 a, (o_orderkey // 4) % 3 + 1 b, o_orderkey % 4 + 1 c FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select(*[c.alias(n) for c, n in zip(G.key_columns(order_key(), [5000, 3, 4]), "abc", strict=True)])


SCHEMA = [
    {"name": "customer", "key": ["c_custkey"], "refs": {}},
    {"name": "orders", "key": ["o_orderkey"], "refs": {"o_custkey": ("customer", "c_custkey")}},
    {"name": "lineitem", "key": ["l_orderkey", "l_linenumber"], "refs": {"l_orderkey": ("orders", "o_orderkey")}},
]


@query("key_ranges", "SELECT 'customer' table_name, 'c_custkey' column_name, count(*) AS \"range\" FROM customer UNION ALL SELECT 'orders', 'o_custkey', count(*) FROM customer UNION ALL SELECT 'orders', 'o_orderkey', count(*) FROM orders UNION ALL SELECT 'lineitem', 'l_orderkey', count(*) FROM orders UNION ALL SELECT 'lineitem', 'l_linenumber', CAST(round((SELECT count(*) FROM lineitem) / count(*)) AS BIGINT) FROM orders")
def _(t: Tables) -> DataFrame:
    sizes = {n: getattr(t, n).count() for n in ("customer", "orders", "lineitem")}
    return t.spark.createDataFrame(G.key_ranges(SCHEMA, sizes), "table_name string, column_name string, range long")


@query("gen_fk", f"SELECT o_orderkey, CAST(floor({lcg_sql('o_orderkey', 4)} * (SELECT count(*) FROM customer)) + 1 AS BIGINT) fk FROM orders")
def _(t: Tables) -> DataFrame:
    n = t.customer.agg(F.count("*").alias("n"))
    return t.orders.crossJoin(F.broadcast(n)).select("o_orderkey", G.foreign_key(order_key(), F.col("n"), 4).alias("fk"))


@query("fake_columns", f"SELECT o_orderkey, CAST(floor({lcg_sql('o_orderkey', 50)} * 800) AS INT) + 31 fake_0, CAST(floor({lcg_sql('o_orderkey', 51)} * 800) AS INT) + 31 fake_1 FROM orders")
def _(t: Tables) -> DataFrame:
    return G.with_fake_columns(t.orders.select("o_orderkey"), "o_orderkey", 2)


TOP_SQL = "q AS (SELECT l_suppkey v, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) rank FROM q), b AS (SELECT CASE WHEN rank <= 10 THEN CAST(rank AS INT) ELSE 11 + CAST(v % 5 AS INT) END slot, sum(n) n, min(v) low, max(v) high, count(*) ndv FROM r GROUP BY 1), f AS (SELECT *, n / sum(n) OVER () p FROM b), h AS (SELECT *, CASE WHEN slot = 15 THEN 1.0 ELSE sum(p) OVER (ORDER BY slot) END hi FROM f), c AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY slot), 0) lo FROM h)"


def _cdf(t: Tables) -> DataFrame:
    """Ten heavy hitters and five buckets of the rest."""
    r = D.with_rank(D.value_counts(t.lineitem, [], "l_suppkey"), [], H)
    slot = F.when(F.col("rank").isNotNull(), F.col("rank")).otherwise(11 + (F.col("v") % 5).cast("int"))
    b = r.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("ndv"))
    return D.cdf(b.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy())), [], "slot", "p")


@query("sample_cdf", f"WITH {TOP_SQL} SELECT slot, count(*) n, min(o_orderkey) first_key FROM orders JOIN c ON lo <= {lcg_sql('o_orderkey', 11)} AND {lcg_sql('o_orderkey', 11)} < hi GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return G.sampled(t.orders, lcg(order_key(), 11), _cdf(t), ["slot"]).groupBy("slot").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("gen_continuous", f"WITH {TOP_SQL} SELECT o_orderkey, slot, round(low + {lcg_sql('o_orderkey', 12)} * (high - low), 6) v FROM orders JOIN c ON lo <= {lcg_sql('o_orderkey', 11)} AND {lcg_sql('o_orderkey', 11)} < hi")
def _(t: Tables) -> DataFrame:
    return G.sampled(t.orders, lcg(order_key(), 11), _cdf(t), ["slot", "low", "high"]).select("o_orderkey", "slot", F.round(G.within(lcg(order_key(), 12), F.col("low"), F.col("high")), 6).alias("v"))


@query("gen_integer", f"WITH {TOP_SQL} SELECT o_orderkey, slot, low + CAST(floor({lcg_sql('o_orderkey', 12)} * ndv) AS BIGINT) * CASE WHEN slot > 10 THEN 5 ELSE 1 END v FROM orders JOIN c ON lo <= {lcg_sql('o_orderkey', 11)} AND {lcg_sql('o_orderkey', 11)} < hi")
def _(t: Tables) -> DataFrame:
    s = G.sampled(t.orders, lcg(order_key(), 11), _cdf(t), ["slot", "low", "ndv"])
    return s.select("o_orderkey", "slot", (F.col("low") + F.floor(lcg(order_key(), 12) * F.col("ndv")).cast("long") * F.when(F.col("slot") > 10, 5).otherwise(1)).alias("v"))


@query("gen_partition", f"WITH {TOP_SQL.replace('FROM lineitem', 'FROM lineitem WHERE l_suppkey % 4 = 1')} SELECT o_orderkey, slot FROM orders JOIN c ON lo <= {lcg_sql('o_orderkey', 13)} AND {lcg_sql('o_orderkey', 13)} < hi")
def _(t: Tables) -> DataFrame:
    r = D.with_rank(D.value_counts(t.lineitem.where("l_suppkey % 4 = 1"), [], "l_suppkey"), [], H)
    slot = F.when(F.col("rank").isNotNull(), F.col("rank")).otherwise(11 + (F.col("v") % 5).cast("int"))
    b = r.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"))
    c = D.cdf(b.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy())), [], "slot", "p")
    return G.sampled(t.orders, lcg(order_key(), 13), c, ["slot"]).select("o_orderkey", "slot")


@query("in_domain", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 150000) inside, count(*) n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(G.in_domain(F.col("o_totalprice"), 1000, 150000)).alias("inside"), F.count("*").alias("n"))


def _window_candidates(t: Tables) -> DataFrame:
    c = D.candidates(_counts(t), "w", 3, 20, 4)
    return c.select("w", F.col("bucket").cast("int").alias("bucket"), (F.col("place") - 1).alias("place"), "v")


@query("gen_seq_key", f"WITH {C_SQL}, s AS (SELECT v, w seen, unnest(range(w + 1, w + 4)) w FROM c), m AS (SELECT w, v, max(seen) seen, v % 4 bucket FROM s WHERE w IN (SELECT w FROM c) GROUP BY w, v), d AS (SELECT w, bucket, v, row_number() OVER (PARTITION BY w, bucket ORDER BY seen DESC, v) - 1 place FROM m QUALIFY place < 20), z AS (SELECT w, bucket, max(place) + 1 size FROM d GROUP BY 1, 2) SELECT event_id, e.w, CAST(event_id % 4 AS INT) bucket, d.v FROM e LEFT JOIN z ON z.w = e.w AND z.bucket = event_id % 4 LEFT JOIN d ON d.w = e.w AND d.bucket = event_id % 4 AND d.place = (event_id // 4) % size")
def _(t: Tables) -> DataFrame:
    e = windowed_events(t).select("event_id", "w")
    return G.round_robin_windows(e, F.floor(F.col("event_id") / 4), (F.col("event_id") % 4).cast("int"), _window_candidates(t)).select("event_id", "w", "bucket", "v")


@query("gen_seq_int", f"WITH {C_SQL}, k60 AS (SELECT w, v, rank - 1 place FROM k WHERE rank <= 60), g AS (SELECT w, v, n, w - lag(w) OVER (PARTITION BY v ORDER BY w) gap FROM c), q AS (SELECT w, CAST(round(sum(CASE WHEN gap = 1 THEN n ELSE 0 END) / sum(n) * 60) AS INT) keep FROM g GROUP BY w), u AS (SELECT DISTINCT user_id v FROM events), f AS (SELECT q.w, u.v, row_number() OVER (PARTITION BY q.w ORDER BY {lcg_sql('u.v', 61)}, u.v) + keep - 1 place FROM q CROSS JOIN u WHERE NOT EXISTS (SELECT 1 FROM k60 WHERE k60.w = q.w AND k60.v = u.v)) SELECT w, place, v, true reused FROM k60 JOIN q USING (w) WHERE place < keep UNION ALL SELECT w, place, v, false FROM f WHERE place < 60")
def _(t: Tables) -> DataFrame:
    c = _counts(t)
    w = D.top_values(c, ["w"], 60).select("w", (F.col("rank") - 1).alias("place"), "v")
    return G.window_candidates(w, t.events.select(F.col("user_id").alias("v")).distinct(), "w", G.measured_keep(c, "w", 60), 60, lcg(F.col("v"), 61))


@query("gen_seq_varchar")
def _(t: Tables) -> DataFrame:
    d = D.value_counts(t.part, [], "p_name")
    prior = D.top_values(d, [], 50).select((F.col("rank") - 1).alias("place"), "v")
    return G.next_candidates(prior, d.select("v"), 15, 45)


AVG = "1 + (o_custkey % 7) / 4.0"


@query("loop_counts", f"SELECT o_orderkey, CAST(floor({AVG}) + CAST({lcg_sql('o_orderkey', 21)} < {AVG} - floor({AVG}) AS INT) AS INT) rounds FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.loop_count(1 + (F.col("o_custkey") % 7) / 4.0, lcg(order_key(), 21)).alias("rounds"))


@query("branch_choice", f"SELECT branch, count(*) n FROM (SELECT CASE WHEN {lcg_sql('o_orderkey', 22)} < 0.2 THEN 'a' WHEN {lcg_sql('o_orderkey', 22)} < 0.7 THEN 'b' ELSE 'c' END branch FROM orders) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.orders.select(S.choice(lcg(order_key(), 22), {"a": 0.2, "b": 0.5, "c": 0.3}).alias("branch")).groupBy("branch").agg(F.count("*").alias("n"))


@query("txn_choice", f"{RATES}, m AS (SELECT w, event_type, sum(txns) OVER (PARTITION BY w ORDER BY event_type) / sum(txns) OVER (PARTITION BY w) hi FROM r), x AS (SELECT w, event_type, CASE WHEN row_number() OVER (PARTITION BY w ORDER BY event_type DESC) = 1 THEN 1.0 ELSE hi END hi FROM m), y AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY w ORDER BY event_type), 0) lo FROM x) SELECT e.event_id, y.event_type FROM e JOIN y ON y.w = e.w AND lo <= {lcg_sql('event_id', 23)} AND {lcg_sql('event_id', 23)} < hi")
def _(t: Tables) -> DataFrame:
    w = W.partitionBy("w").orderBy("event_type").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("txns").over(W.partitionBy("w"))
    running = _rates(t).withColumn("hi", F.sum("txns").over(w) / total)
    last = F.row_number().over(W.partitionBy("w").orderBy(F.desc("event_type"))) == 1
    c = running.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.col("hi")))
    c = c.withColumn("lo", F.coalesce(F.lag("hi").over(W.partitionBy("w").orderBy("event_type")), F.lit(0.0))).select("w", F.col("event_type").alias("chosen"), "lo", "hi")
    e = windowed_events(t).select("event_id", "w", lcg(F.col("event_id"), 23).alias("u"))
    return e.join(c, "w").where("lo <= u and u < hi").select("event_id", F.col("chosen").alias("event_type"))


@query("schedule", f"{RATES}, k AS (SELECT event_type, w, txns, unnest(range(0, txns)) k FROM r) SELECT event_type, w, CAST(k AS BIGINT) k, CAST((w - 1) * {DAY_US} + floor(k * {DAY_US} / txns) AS BIGINT) at_us FROM k")
def _(t: Tables) -> DataFrame:
    return S.schedule(_rates(t), "w", F.lit(0).cast("long"), DAY_US).select("event_type", "w", "k", "at_us")


@query("simulate_params")
def _(t: Tables) -> DataFrame:
    draw = F.floor(lcg(order_key(), 31) * 1000).cast("long")
    edges = [{"name": "p1", "kind": "draw", "draw": draw}, {"name": "p2", "kind": "linear", "of": "p1", "a": 2, "b": 5}, {"name": "p3", "kind": "equal", "of": "p1", "p": 0.75, "draw": F.floor(lcg(order_key(), 32) * 1000).cast("long")}]
    return S.parameters(t.orders.select("o_orderkey"), "o_orderkey", edges)


@query("txn_outcome")
def _(t: Tables) -> DataFrame:
    return S.outcomes(t.events.select("event_id", "value"), "event_id", F.col("value"), 0.05, 0.01)


def _measured(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Ten frequent values and 15 buckets of each event type's values, and the buckets' quantiles."""
    values = t.events.where("value is not null").select("event_type", F.col("value").cast("double").alias("value"))
    counts = D.value_counts(values, ["event_type"], "value")
    top = D.top_values(counts, ["event_type"], H).select("event_type", F.col("rank").cast("int").alias("slot"), "v", F.lit(None).cast("int").alias("bucket"), "freq")
    rest = D.histogram(counts, ["event_type"], 15, H).select("event_type", (F.col("bucket") + H + 1).alias("slot"), F.lit(None).cast("double").alias("v"), "bucket", "freq")
    return D.cdf(top.union(rest), ["event_type"], "slot", "freq"), D.bucket_quantiles(D.without_top(counts, ["event_type"], H), ["event_type"], 15, 20)


@query("gen_measured")
def _(t: Tables) -> DataFrame:
    """A value for each event from what was measured of its type."""
    cdf, quantiles = _measured(t)
    rows = t.events.select("event_id", "event_type")
    return G.sampled_values(rows, lcg(F.col("event_id"), 71), lcg(F.col("event_id"), 72), cdf, quantiles, ["event_type"]).select("event_id", "event_type", "v")


@query("fidelity_profile")
def _(t: Tables) -> DataFrame:
    """Profile, generate, profile again: per event type the rows and mean value of the trace and
    of the generated one, and their relative deviations; rows are generated as many as the
    measured rates of each window say."""
    e = windowed_events(t)
    rates = D.filled(D.throughput(e, "event_type", "w", F.lit(1)), "event_type", "w")
    made = rates.where("txns > 0").select("event_type", "w", F.explode(F.sequence(F.lit(1).cast("long"), F.col("txns"))).alias("k"))
    key = F.xxhash64("event_type", "w", "k")
    cdf, quantiles = _measured(t)
    got = G.sampled_values(made, lcg(key, 73), lcg(key, 74), cdf, quantiles, ["event_type"])
    two = got.groupBy("event_type").agg(F.count("*").alias("n_made"), F.avg("v").alias("mean_made"))
    one = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.abs(F.col(b))
    return one.join(two, "event_type").select("event_type", "n", "n_made", "mean", "mean_made", off("n_made", "n").alias("rate_deviation"), off("mean_made", "mean").alias("mean_deviation"))


@query("gen_partition_draw", f"WITH s AS (SELECT l_suppkey % 4 part, count(*) / (SELECT count(*) FROM lineitem) freq FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_custkey % 4 own, ['any', 'same', 'different'][o_orderkey % 3 + 1] how, {lcg_sql('o_orderkey', 81)} u FROM orders), x AS (SELECT o.*, s.part, sum(freq) OVER (PARTITION BY o_orderkey ORDER BY s.part) hi, sum(freq) OVER (PARTITION BY o_orderkey) t FROM o JOIN s ON how <> 'different' OR s.part <> own) SELECT o_orderkey, how, any_value(own) own, CASE WHEN how = 'same' THEN any_value(own) ELSE min(part) FILTER (WHERE hi > u * t) END part FROM x GROUP BY o_orderkey, how")
def _(t: Tables) -> DataFrame:
    shares = D.partitioned(t.lineitem, F.col("l_suppkey") % 4, "l_suppkey").select("part", "freq")
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.element_at(F.array(F.lit("any"), F.lit("same"), F.lit("different")), (k % 3).cast("int") + 1).alias("how"), (F.col("o_custkey") % 4).alias("own"))
    return G.partition_draws(rows, F.col("how"), F.col("own"), lcg(k, 81), shares)


@query("gen_varchar_measured")
def _(t: Tables) -> DataFrame:
    c = D.varchar_distribution(D.value_counts(t.part, ["p_brand"], "p_type"), ["p_brand"], H, 15)
    cdf = D.cdf(c, ["p_brand"], "slot", "freq")
    k = F.col("p_partkey")
    return G.varchar_values(t.part.select("p_partkey", "p_brand"), lcg(k, 82), lcg(k, 83), cdf, ["p_brand"], 20, 5).select("p_partkey", "p_brand", "slot", "s")


@query("gen_uniform", f"WITH b AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders) SELECT o_orderkey, round(CAST(lo AS DOUBLE) + {lcg_sql('o_orderkey', 84)} * (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)), 4) v FROM orders, b")
def _(t: Tables) -> DataFrame:
    ends = t.orders.agg(F.min("o_totalprice").cast("double").alias("lo"), F.max("o_totalprice").cast("double").alias("hi"))
    return t.orders.crossJoin(F.broadcast(ends)).select("o_orderkey", F.round(G.uniform(lcg(order_key(), 84), F.col("lo"), F.col("hi")), 4).alias("v"))


@query("gen_fidelity", f"SELECT l_returnflag, count(*) n, count(DISTINCT CAST(floor({lcg_sql('l_orderkey * 8 + l_linenumber', 41)} * 50) AS BIGINT)) ndv FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Profile of generated values, grouped by the tables' own flag."""
    v = F.floor(lcg(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 41) * 50)
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct(v).alias("ndv"))
