"""Windows, distributions and monitoring over the event trace and the line table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import distribution as D
from tracewright.plans.base import E_SQL, Tables, query, windowed_events

H, N, Q, K = 10, 15, 5, 3
R = lambda *names: [F.round(n, 6).alias(n) for n in names]
C_SQL = E_SQL + ", c AS (SELECT w, user_id v, count(*) n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, v) rank, sum(n) OVER (PARTITION BY w) t, min(v) OVER (PARTITION BY w) lo, max(v) OVER (PARTITION BY w) hi FROM c)"
BUCKET = "CAST(greatest(0, least({n} - 1, floor((v - lo) / ((hi - lo + 1e-9) / {n})))) AS INT)"
VALUES = ", v AS (SELECT event_type, round(value) v, count(*) n FROM events GROUP BY ALL), vk AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, v) rank, sum(n) OVER (PARTITION BY event_type) t, min(v) OVER (PARTITION BY event_type) lo, max(v) OVER (PARTITION BY event_type) hi FROM v)"


def _counts(t: Tables) -> DataFrame:
    return D.value_counts(windowed_events(t), ["w"], "user_id")


def _values(t: Tables) -> DataFrame:
    return D.value_counts(t.events.withColumn("value", F.round("value")), ["event_type"], "value")


@query("trace_window", f"WITH {E_SQL} SELECT w, count(*) n, min(event_id) first_event, max(event_id) last_event FROM e GROUP BY w")
def _(t: Tables) -> DataFrame:
    return windowed_events(t).groupBy("w").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("value_counts", "SELECT l_returnflag, l_suppkey v, count(*) n FROM lineitem GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return D.value_counts(t.lineitem, ["l_returnflag"], "l_suppkey")


@query("topk_freq", f"WITH {C_SQL} SELECT w, CAST(rank AS INT) rank, v, n, round(n / t, 6) freq FROM k WHERE rank <= {H}")
def _(t: Tables) -> DataFrame:
    return D.top_values(_counts(t), ["w"], H).select("w", "rank", "v", "n", *R("freq"))


@query("hist_equiwidth", f"WITH {C_SQL} SELECT w, {BUCKET.format(n=N)} bucket, count(*) ndv, round(sum(n) / any_value(t), 6) freq FROM k GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return D.histogram(_counts(t), ["w"], N).select("w", "bucket", "ndv", *R("freq"))


@query("hist_string", "WITH c AS (SELECT p_brand, p_name v, count(*) n FROM part GROUP BY ALL), h AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(v, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) x FROM c) SELECT p_brand, CAST(abs(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) % 15 AS INT) bucket, count(*) ndv, CAST(sum(n) AS BIGINT) n FROM h GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return D.string_histogram(D.value_counts(t.part, ["p_brand"], "p_name"), ["p_brand"], N)


@query("hist_quantiles", f"WITH {C_SQL}, b AS (SELECT *, {BUCKET.format(n=N)} bucket FROM k), r AS (SELECT *, sum(n) OVER (PARTITION BY w, bucket ORDER BY v) c, sum(n) OVER (PARTITION BY w, bucket) a FROM b) SELECT w, bucket, CAST(step AS INT) step, min(v) v FROM r, (SELECT unnest(range(1, {Q} + 1)) step) WHERE c * {Q} >= step * a GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return D.bucket_quantiles(_counts(t), ["w"], N, Q)


@query("repeat_ratio", f"WITH {C_SQL}, g AS (SELECT *, w - lag(w) OVER (PARTITION BY v ORDER BY w) gap FROM k WHERE rank > {H}) SELECT w, " + ", ".join(f"round(sum(CASE WHEN gap = {i} THEN n ELSE 0 END) / sum(n), 6) back_{i}" for i in range(1, K + 1)) + " FROM g GROUP BY w")
def _(t: Tables) -> DataFrame:
    return D.repeat_ratios(D.without_top(_counts(t), ["w"], H), [], "w", K).select("w", *R(*[f"back_{i}" for i in range(1, K + 1)]))


@query("repeat_ratio_str", f"WITH {E_SQL}, c AS (SELECT w, event_type v, count(*) n FROM e GROUP BY ALL), g AS (SELECT *, w - lag(w) OVER (PARTITION BY v ORDER BY w) gap FROM c) SELECT w, round(sum(CASE WHEN gap = 1 THEN n ELSE 0 END) / sum(n), 6) back_1 FROM g GROUP BY w")
def _(t: Tables) -> DataFrame:
    return D.repeat_ratios(D.value_counts(windowed_events(t), ["w"], "event_type"), [], "w", 1).select("w", *R("back_1"))


@query("hh_overlap", f"WITH {C_SQL}, h AS (SELECT w, v FROM k WHERE rank <= {H}) SELECT a.w, count(*) n_top, count(b.v) kept FROM h a LEFT JOIN h b ON b.w = a.w - 1 AND b.v = a.v GROUP BY a.w")
def _(t: Tables) -> DataFrame:
    return D.top_overlap(D.top_values(_counts(t), ["w"], H), [], "w")


@query("dist_continuous", f"WITH x AS (SELECT 1){VALUES} SELECT event_type, {BUCKET.format(n=N)} bucket, count(*) ndv, round(sum(n) / any_value(t), 6) freq FROM vk WHERE rank > {H} GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return D.histogram(_values(t), ["event_type"], N, H).select("event_type", "bucket", "ndv", *R("freq"))


@query("dist_varchar", "WITH c AS (SELECT p_brand v, count(*) n FROM part GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n DESC, v) AS INT) rank, v, n, round(n / sum(n) OVER (), 6) freq FROM c QUALIFY row_number() OVER (ORDER BY n DESC, v) <= 10")
def _(t: Tables) -> DataFrame:
    return D.top_values(D.value_counts(t.part, [], "p_brand"), [], H).select("rank", "v", "n", *R("freq"))


@query("dist_sequential", f"WITH {C_SQL}, g AS (SELECT *, {BUCKET.format(n=N)} bucket, w - lag(w) OVER (PARTITION BY v ORDER BY w) gap FROM k) SELECT w, bucket, count(*) ndv, CAST(sum(n) AS BIGINT) n, CAST(sum(CASE WHEN gap = 1 THEN n ELSE 0 END) AS BIGINT) again FROM g GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    g = D.repeat_gaps(D.bucketed(_counts(t), ["w"], N), [], "w")
    return g.groupBy("w", "bucket").agg(F.count("*").alias("ndv"), F.sum("n").alias("n"), F.sum(F.when(F.col("gap") == 1, F.col("n")).otherwise(0)).alias("again"))


@query("dist_partitioned", "SELECT l_suppkey % 4 part, count(*) n, count(DISTINCT l_suppkey) ndv, round(count(*) / (SELECT count(*) FROM lineitem), 6) freq FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.partitioned(t.lineitem, X.hash_partition(F.col("l_suppkey"), 4), "l_suppkey").select("part", "n", "ndv", *R("freq"))


@query("reservoir", f"SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {X.lcg_sql('event_id', 3)}, event_id) r FROM events) WHERE r <= 200")
def _(t: Tables) -> DataFrame:
    return D.reservoir(t.events, ["event_type"], F.struct(X.lcg(F.col("event_id"), 3), "event_id"), 200).select("event_type", "event_id")


@query("dist_full", "WITH c AS (SELECT user_id v, count(*) n FROM events GROUP BY 1), k AS (SELECT *, sum(n) OVER () t, min(v) OVER () lo, max(v) OVER () hi, row_number() OVER (ORDER BY n DESC, v) rank FROM c) SELECT " + BUCKET.format(n=N) + f" bucket, count(*) ndv, round(sum(n) / any_value(t), 6) freq FROM k WHERE rank > {H} GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.histogram(D.value_counts(t.events, [], "user_id"), [], N, H).select("bucket", "ndv", *R("freq"))


RATES = f"WITH {E_SQL}, r AS (SELECT event_type, w, CAST(round(count(*) / 2.0) AS BIGINT) txns FROM e GROUP BY ALL)"


def _rates(t: Tables) -> DataFrame:
    return D.throughput(windowed_events(t), "event_type", "w", F.lit(2.0))


@query("throughput", f"{RATES} SELECT * FROM r")
def _(t: Tables) -> DataFrame:
    return _rates(t)


@query("throughput_filled", f"{RATES} SELECT event_type, w, coalesce(txns, 0) txns FROM (SELECT DISTINCT event_type FROM r) CROSS JOIN (SELECT unnest(range(1, (SELECT max(w) FROM r) + 1)) w) LEFT JOIN r USING (event_type, w)")
def _(t: Tables) -> DataFrame:
    return D.filled(_rates(t), "event_type", "w")


@query("txn_mix", f"{RATES} SELECT event_type, w, txns, CAST(sum(txns) OVER (PARTITION BY w) AS BIGINT) total, round(txns / sum(txns) OVER (PARTITION BY w), 6) AS \"share\" FROM r")
def _(t: Tables) -> DataFrame:
    return D.mix(_rates(t), "w").select("event_type", "w", "txns", "total", *R("share"))


KINDS = ["click", "error", "purchase", "signup", "view"]


SLOTS = f"CASE WHEN rank <= {H} THEN CAST(rank AS INT) ELSE {H + 1} + CAST(abs(CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) % {N} AS INT) END"
HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(v, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) x"


@query("dist_varchar_rest", f"WITH c AS (SELECT p_brand, p_type v, count(*) n FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, v) rank, sum(n) OVER (PARTITION BY p_brand) t, {HASH} FROM c) SELECT p_brand, {SLOTS} slot, min(CASE WHEN rank <= {H} THEN v END) v, count(*) ndv, CAST(sum(n) AS BIGINT) n, round(sum(n) / any_value(t), 6) freq FROM k GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return D.varchar_distribution(D.value_counts(t.part, ["p_brand"], "p_type"), ["p_brand"], H, N).withColumn("freq", F.round("freq", 6))


@query("topk_padded", f"WITH {C_SQL}, h AS (SELECT w, rank, v, n, n / t freq FROM k WHERE rank <= 2000), g AS (SELECT w, r FROM (SELECT DISTINCT w FROM h), (SELECT unnest(range(1, 2001)) r)) SELECT g.w, CAST(r AS INT) rank, v, coalesce(n, 0) n, round(coalesce(freq, 0), 6) freq FROM g LEFT JOIN h ON h.w = g.w AND rank = r")
def _(t: Tables) -> DataFrame:
    return D.padded(D.top_values(_counts(t), ["w"], 2000), ["w"], 2000).select("w", "rank", "v", "n", *R("freq"))


@query("dist_nested", f"WITH c AS (SELECT l_suppkey % 4 part, l_partkey v, count(*) n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, v) rank, sum(n) OVER (PARTITION BY part) t, sum(n) OVER () a, min(v) OVER (PARTITION BY part) lo, max(v) OVER (PARTITION BY part) hi FROM c) SELECT part, round(any_value(t) / any_value(a), 6) part_freq, CASE WHEN rank <= {H} THEN CAST(rank AS INT) ELSE {H + 1} + {BUCKET.format(n=N)} END slot, count(*) ndv, round(sum(n) / any_value(t), 6) freq FROM k GROUP BY 1, 3")
def _(t: Tables) -> DataFrame:
    return D.nested(t.lineitem, X.hash_partition(F.col("l_suppkey"), 4), "l_partkey", N, H).select("part", "slot", "ndv", *R("part_freq", "freq"))


@query("dist_dispatch", f"WITH r AS (SELECT event_type param, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 END kind, CASE WHEN event_type = 'click' THEN round(value) ELSE user_id END x, event_type || user_id % 50 s FROM events), c AS (SELECT param, kind, CASE WHEN kind <> 2 THEN CAST(x AS DOUBLE) END y, CASE WHEN kind = 2 THEN s END v, count(*) n FROM r WHERE kind IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY param ORDER BY n DESC, y, v) rank, sum(n) OVER (PARTITION BY param) t, min(y) OVER (PARTITION BY param) lo, max(y) OVER (PARTITION BY param) hi, CASE WHEN v IS NOT NULL THEN {HASH.removesuffix(' x')} END x FROM c) SELECT param, kind, CASE WHEN kind = 2 THEN {SLOTS} WHEN rank <= {H} THEN CAST(rank AS INT) ELSE {H + 1} + {BUCKET.format(n=N).replace('(v - lo)', '(y - lo)')} END slot, count(*) ndv, round(sum(n) / any_value(t), 6) freq FROM k GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "click", 0).when(e == "view", 1).when(e == "purchase", 3).when(e == "signup", 2)
    x = F.when(e == "click", F.round("value")).otherwise(F.col("user_id"))
    text = F.concat("event_type", (F.col("user_id") % 50).cast("string"))
    return D.dispatched(t.events.withColumn("param", e), kind, x, text, N, H).select("param", "kind", "slot", "ndv", *R("freq"))


@query("window_align", f"WITH {E_SQL} SELECT w, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{k}'), 6) \"{k}\"" for k in KINDS) + " FROM e GROUP BY w")
def _(t: Tables) -> DataFrame:
    return D.aligned(windowed_events(t), "w", "event_type", KINDS, "value")


@query("candidate_merge", f"WITH {C_SQL}, s AS (SELECT v, w seen, unnest(range(w + 1, w + {K} + 1)) w FROM c), m AS (SELECT w, v, max(seen) seen, v % 4 bucket FROM s WHERE w IN (SELECT w FROM c) GROUP BY w, v) SELECT w, v, seen, bucket, CAST(p AS INT) place FROM (SELECT *, row_number() OVER (PARTITION BY w, bucket ORDER BY seen DESC, v) p FROM m) WHERE p <= 20")
def _(t: Tables) -> DataFrame:
    return D.candidates(_counts(t), "w", K, 20, 4)


def _steps(df: DataFrame, width: float) -> DataFrame:
    b = F.floor(F.col("value") / width)
    total = df.agg(F.count("*").alias("t"))
    return df.groupBy((b * width).alias("lo")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("lo", (F.col("lo") + width).alias("hi"), (F.col("n") / F.col("t")).alias("p"))


def _steps_sql(kind: str, width: float) -> str:
    return f"(SELECT floor(value / {width}) * {width} lo, floor(value / {width}) * {width} + {width} hi, count(*) / (SELECT count(*) FROM events WHERE event_type = '{kind}') p FROM events WHERE event_type = '{kind}' GROUP BY 1, 2)"


@query("dist_similarity", f"WITH a AS {_steps_sql('click', 10.0)}, b AS {_steps_sql('view', 4.0)}, x AS (SELECT lo x FROM a UNION SELECT hi FROM a UNION SELECT lo FROM b UNION SELECT hi FROM b), s AS (SELECT x, y FROM (SELECT x, lead(x) OVER (ORDER BY x) y FROM x) WHERE y IS NOT NULL), pa AS (SELECT x, sum(p * (y - x) / (hi - lo)) p FROM s JOIN a ON lo <= x AND y <= hi GROUP BY x), pb AS (SELECT x, sum(p * (y - x) / (hi - lo)) q FROM s JOIN b ON lo <= x AND y <= hi GROUP BY x) SELECT round(sum(least(p, q)), 6) similarity FROM pa JOIN pb USING (x)")
def _(t: Tables) -> DataFrame:
    e = t.events.select("event_type", "value")
    return D.similarity(_steps(e.where("event_type = 'click'"), 10.0), _steps(e.where("event_type = 'view'"), 4.0)).select(*R("similarity"))


@query("hist_cdf", f"WITH {C_SQL}, f AS (SELECT w, {BUCKET.format(n=N)} bucket, sum(n) / any_value(t) freq FROM k GROUP BY ALL), h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY w ORDER BY bucket DESC) = 1 THEN 1.0 ELSE sum(freq) OVER (PARTITION BY w ORDER BY bucket) END hi FROM f) SELECT w, bucket, round(freq, 6) freq, round(hi, 6) hi, round(coalesce(lag(hi) OVER (PARTITION BY w ORDER BY bucket), 0), 6) lo FROM h")
def _(t: Tables) -> DataFrame:
    return D.cdf(D.histogram(_counts(t), ["w"], N), ["w"], "bucket", "freq").select("w", "bucket", *R("freq", "hi", "lo"))


@query("hist_multidim", "WITH c AS (SELECT CAST(floor(l_quantity / 10) AS INT) q, CAST(floor(l_discount * 50) AS INT) d, l_returnflag f, count(*) n FROM lineitem GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, q, d, f) AS INT) rank FROM c QUALIFY rank <= 20")
def _(t: Tables) -> DataFrame:
    return D.multi_histogram(t.lineitem, {"q": F.floor(F.col("l_quantity") / 10).cast("int"), "d": F.floor(F.col("l_discount") * 50).cast("int"), "f": F.col("l_returnflag")}, 20)


PS = [0.8, 0.9, 0.95, 0.99]


@query("latency_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 r, count(*) OVER (PARTITION BY event_type) n FROM events WHERE event_type <> 'error') SELECT event_type, " + ", ".join(f"max(value) FILTER (WHERE r = floor(n * CAST({p} AS DOUBLE))) p{round(p * 100)}" for p in PS) + " FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.percentile_ranks(t.events.where("event_type <> 'error'"), ["event_type"], "value", PS)


@query("monitor_window", f"WITH {E_SQL} SELECT w, round(count(*) FILTER (WHERE event_type <> 'error') / 86400, 6) success_tps, round(count(*) FILTER (WHERE event_type = 'error') / 86400, 6) failure_tps, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) avg_latency FROM e GROUP BY w")
def _(t: Tables) -> DataFrame:
    good = F.col("event_type") != "error"
    g = windowed_events(t).groupBy("w").agg((F.count_if(good) / 86400).alias("success_tps"), (F.count_if(~good) / 86400).alias("failure_tps"), F.avg(F.when(good, F.col("value"))).alias("avg_latency"))
    return g.select("w", *R("success_tps", "failure_tps", "avg_latency"))


@query("monitor_cumulative", f"WITH {E_SQL}, f AS (SELECT w, count(*) FILTER (WHERE event_type = 'error') failures FROM e GROUP BY w) SELECT w, failures, round(avg(failures) OVER (ORDER BY w), 6) mean_failures FROM f")
def _(t: Tables) -> DataFrame:
    f = windowed_events(t).groupBy("w").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return f.withColumn("mean_failures", F.round(F.avg("failures").over(W.orderBy("w").rowsBetween(W.unboundedPreceding, 0)), 6))
