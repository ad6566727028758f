"""Sessions and dependency mining over the order trace and the event trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import mining as M
from tracewright.operators import sessions as S
from tracewright.plans.base import P_SQL, Tables, numbered_lines, order_params, query

S_SQL = "s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"session\" FROM (SELECT *, coalesce(lag(CAST(event_type IN ('purchase', 'error') AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) b FROM events))"
EQ_SQL = P_SQL + ", c AS (SELECT a.op op_a, a.idx idx_a, b.op op_b, b.idx idx_b, count(*) n FROM p a JOIN p b USING (tx_id, type, v) WHERE a.rn = 1 AND b.rn = 1 AND (a.op < b.op OR a.op = b.op AND a.idx < b.idx) GROUP BY ALL), x AS (SELECT op, count(DISTINCT tx_id) n_exec FROM p GROUP BY op), pr AS (SELECT op_a, idx_a, op_b, idx_b, n / n_exec prob FROM c JOIN x ON op = op_b WHERE n / n_exec >= 0.01)"


def _sessions(t: Tables) -> DataFrame:
    return S.sessionized(t.events, "user_id", ["ts", "event_id"], F.col("event_type").isin("purchase", "error"))


def _prob(p: DataFrame) -> DataFrame:
    return M.probabilities(M.equal_counts(p), M.exec_counts(p))


@query("sessionize", f"WITH {S_SQL} SELECT user_id, CAST(\"session\" AS BIGINT) \"session\", count(*) n_ops, arg_max(event_type, (ts, event_id)) last_op FROM s GROUP BY user_id, \"session\"")
def _(t: Tables) -> DataFrame:
    return S.session_ends(_sessions(t), "user_id", ["ts", "event_id"], "event_type")


@query("sessionize_rollback", f"WITH {S_SQL}, x AS (SELECT user_id, \"session\", count(*) n, arg_max(event_type, (ts, event_id)) l FROM s GROUP BY user_id, \"session\") SELECT l last_op, count(*) sessions, CAST(sum(n) AS BIGINT) ops FROM x GROUP BY l")
def _(t: Tables) -> DataFrame:
    e = S.session_ends(_sessions(t), "user_id", ["ts", "event_id"], "event_type")
    return e.groupBy("last_op").agg(F.count("*").alias("sessions"), F.sum("n_ops").alias("ops"))


@query("rollback_prob", f"WITH {S_SQL}, x AS (SELECT user_id, \"session\", arg_min(event_type, (ts, event_id)) f, bool_or(event_type = 'error') e FROM s GROUP BY user_id, \"session\") SELECT f first_op, round(avg(CAST(e AS INT)), 6) rollback_prob, count(*) instances FROM x GROUP BY f")
def _(t: Tables) -> DataFrame:
    e = _sessions(t).groupBy("user_id", "session").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_op"), F.bool_or(F.col("event_type") == "error").alias("e"))
    return S.rollback_rates(e, "first_op", F.col("e")).withColumn("rollback_prob", F.round("rollback_prob", 6))


@query("template_opids", f"WITH {S_SQL}, f AS (SELECT user_id, \"session\", event_type, min((ts, event_id)) m, count(*) runs FROM s GROUP BY ALL) SELECT user_id, CAST(\"session\" AS BIGINT) \"session\", event_type, runs, CAST(row_number() OVER (PARTITION BY user_id, \"session\" ORDER BY m) AS INT) op_id FROM f")
def _(t: Tables) -> DataFrame:
    return S.template_ops(_sessions(t), ["user_id", "session"], "event_type", ["ts", "event_id"])


@query("txn_templates", f"WITH {S_SQL}, x AS (SELECT string_agg(event_type, ';' ORDER BY ts, event_id) template FROM s GROUP BY user_id, \"session\") SELECT template, count(*) instances, CAST(len(string_split(template, ';')) AS INT) n_ops FROM x GROUP BY template")
def _(t: Tables) -> DataFrame:
    return S.templates(_sessions(t), ["user_id", "session"], "event_type", ["ts", "event_id"])


@query("loop_fold")
def _(t: Tables) -> DataFrame:
    return S.folded_loops(_sessions(t).select("user_id", "session", "ts", "event_id", "event_type"), ["user_id", "session"], ["ts", "event_id"], "event_type")


_TPL_SQL = S_SQL + ", x AS (SELECT user_id, \"session\", list(event_type ORDER BY ts, event_id) l, min((ts, event_id)) f FROM s GROUP BY ALL), tpl AS (SELECT array_to_string(l, ';') template, count(*) instances, row_number() OVER (ORDER BY min(f)) template_id FROM x WHERE l[-1] <> 'error' GROUP BY 1)"


def _templates(t: Tables) -> DataFrame:
    keys, order = ["user_id", "session"], ["ts", "event_id"]
    good = S.committed(_sessions(t), keys, order, F.col("event_type") == "error")
    return S.template_ids(good, keys, "event_type", order, lambda ts: F.to_date(ts))


@query("template_ids", f"WITH {_TPL_SQL} SELECT template_id, template, instances FROM tpl")
def _(t: Tables) -> DataFrame:
    return _templates(t).select("template_id", "template", "instances")


@query("rollback_blocks", f"WITH {_TPL_SQL}, px AS (SELECT array_to_string(string_split(template, ';')[1:b + 1], ';') prefix, min((template_id, b, instances)) t FROM (SELECT *, unnest(range(0, len(string_split(template, ';')))) b FROM tpl) GROUP BY 1), e AS (SELECT array_to_string(l[1:len(l) - 1], ';') prefix, count(*) n FROM x WHERE l[-1] = 'error' AND len(l) > 1 GROUP BY 1) SELECT t[1] template_id, CAST(t[2] AS INT) \"block\", n rolled_back, round(n / t[3], 6) rollback_prob FROM e JOIN px USING (prefix)")
def _(t: Tables) -> DataFrame:
    s = _sessions(t)
    ended = s.groupBy("user_id", "session").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("l")).where("l = 'error'").select("user_id", "session")
    rolled = s.join(ended, ["user_id", "session"], "left_semi").where("event_type <> 'error'")
    return S.rollback_blocks(_templates(t), rolled, ["user_id", "session"], "event_type", ["ts", "event_id"]).withColumn("rollback_prob", F.round("rollback_prob", 6))


@query("readable_sessions", f"WITH {S_SQL}, x AS (SELECT user_id, \"session\", arg_max(event_type, (ts, event_id)) l, count(*) FILTER (WHERE event_type NOT IN ('signup', 'view')) kept FROM s GROUP BY ALL) SELECT l last_op, count(*) sessions, CAST(sum(kept) AS BIGINT) statements FROM x WHERE l <> 'error' AND kept > 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = F.col("event_type")
    text = F.when(e == "signup", "select @@session.tx_read_only").when(e == "view", "SELECT 1").when(e == "click", F.concat(F.lit("select n from c where id = "), "user_id")).when(e == "error", "rollback").otherwise("commit")
    s = S.committed(_sessions(t).withColumn("sql", text), ["user_id", "session"], ["ts", "event_id"], e == "error")
    last = s.groupBy("user_id", "session").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_op"))
    kept = S.readable(s, "sql").groupBy("user_id", "session").agg(F.count("*").alias("n"))
    return kept.join(last, ["user_id", "session"]).groupBy("last_op").agg(F.count("*").alias("sessions"), F.sum("n").alias("statements"))


@query("op_shape", "WITH n AS (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) SELECT o_orderkey tx_id, 1 op, 0 shape FROM orders UNION ALL SELECT o_orderkey, 2, CASE WHEN n IS NULL THEN -1 WHEN n = 1 THEN 0 ELSE 1 END FROM orders LEFT JOIN n ON l_orderkey = o_orderkey")
def _(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("tx_id"), F.lit(1).alias("op")).union(t.lineitem.select("l_orderkey", F.lit(2)))
    return S.op_shapes(t.orders.select(F.col("o_orderkey").alias("tx_id")), runs, [1, 2])


@query("instance_cap", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) r FROM orders) WHERE r <= 100")
def _(t: Tables) -> DataFrame:
    return S.capped(t.orders, "o_orderpriority", ["o_orderdate", "o_orderkey"], 100).select("o_orderpriority", "o_orderkey")


@query("dep_equal", f"WITH {EQ_SQL} SELECT * FROM c")
def _(t: Tables) -> DataFrame:
    return M.equal_counts(order_params(t))


@query("op_exec_num", f"WITH {EQ_SQL} SELECT * FROM x")
def _(t: Tables) -> DataFrame:
    return M.exec_counts(order_params(t))


@query("op_exec_pairs", f"WITH {P_SQL}, r AS (SELECT tx_id, op, count(DISTINCT rn) n FROM p GROUP BY ALL) SELECT op, CAST(sum(CASE WHEN n > 1 THEN n * (n - 1) // 2 ELSE 1 END) AS BIGINT) n_pairs FROM r GROUP BY op")
def _(t: Tables) -> DataFrame:
    return M.exec_pairs(order_params(t))


@query("op_avg_runs", f"WITH {P_SQL}, r AS (SELECT DISTINCT tx_id, op, rn FROM p) SELECT op, round(count(*) / (SELECT count(DISTINCT tx_id) FROM p), 6) avg_runs FROM r GROUP BY op")
def _(t: Tables) -> DataFrame:
    return M.average_runs(order_params(t)).withColumn("avg_runs", F.round("avg_runs", 6))


@query("dep_equal_prob", f"WITH {EQ_SQL} SELECT op_a, idx_a, op_b, idx_b, round(prob, 6) prob FROM pr")
def _(t: Tables) -> DataFrame:
    return _prob(order_params(t)).withColumn("prob", F.round("prob", 6))


@query("dep_cdf", f"WITH {EQ_SQL} SELECT op_a, idx_a, op_b, idx_b, round(prob, 6) prob, round(sum(prob) OVER (PARTITION BY op_b, idx_b ORDER BY prob, op_a, idx_a), 6) cdf FROM pr")
def _(t: Tables) -> DataFrame:
    return M.cumulative(_prob(order_params(t))).select(*M.PAIR, F.round("prob", 6).alias("prob"), F.round("cdf", 6).alias("cdf"))


@query("identical_sets", f"WITH RECURSIVE {EQ_SQL}, g AS (SELECT op_a oa, idx_a ia, op_b ob, idx_b ib FROM pr WHERE prob >= 1 UNION SELECT op_b, idx_b, op_a, idx_a FROM pr WHERE prob >= 1), r(op, idx, so, si) AS (SELECT oa, ia, oa, ia FROM g UNION SELECT g.ob, g.ib, r.so, r.si FROM r JOIN g ON g.oa = r.op AND g.ia = r.idx) SELECT op, idx, min((so, si))[1] set_op, min((so, si))[2] set_idx FROM r GROUP BY op, idx")
def _(t: Tables) -> DataFrame:
    return M.identical_sets(_prob(order_params(t)))


def _candidates(t: Tables) -> DataFrame:
    prob = M.settled(_prob(order_params(t)))
    sets = M.identical_sets(prob).select(F.col("op").alias("op_a"), F.col("idx").alias("idx_a"), F.concat_ws("_", "set_op", "set_idx").alias("s"))
    return prob.join(F.broadcast(sets), ["op_a", "idx_a"], "left").withColumn("set_a", F.coalesce("s", F.concat_ws("_", "op_a", "idx_a"))).drop("s")


@query("dep_equal_select")
def _(t: Tables) -> DataFrame:
    return M.selected_edges(_candidates(t))


def _include(t: Tables, p: DataFrame) -> DataFrame:
    """Operation 1 returns all orders of its customer; orders of one customer share its rows."""
    keys = t.orders.select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("key"))
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.lit(1).alias("op"), F.lit(0).alias("m"), F.lit(0).alias("type"), F.col("o_orderkey").alias("v"))
    return M.include_counts(p, rows, keys)


_INC_SQL = "res AS (SELECT DISTINCT a.o_orderkey tx_id, 0 type, b.o_orderkey v FROM orders a JOIN orders b USING (o_custkey)), inc AS (SELECT 1 op_a, 0 idx_a, op op_b, idx idx_b, count(DISTINCT tx_id) n FROM p JOIN res USING (tx_id, type, v) WHERE rn = 1 AND op > 1 GROUP BY ALL)"


@query("dep_include", f"WITH {P_SQL}, {_INC_SQL} SELECT * FROM inc")
def _(t: Tables) -> DataFrame:
    return _include(t, order_params(t))


@query("dep_include_select")
def _(t: Tables) -> DataFrame:
    p = order_params(t)
    more = M.probabilities(_include(t, p), M.exec_counts(p)).withColumn("kind", F.lit("include"))
    return M.merged_edges(M.selected_edges(_candidates(t)).withColumn("kind", F.lit("equal")), more)


_LIN_SQL = P_SQL + ", q AS (SELECT a.op op_a, a.idx idx_a, b.op op_b, b.idx idx_b, a.v x, b.v y FROM p a JOIN p b USING (tx_id) WHERE a.rn = 1 AND b.rn = 1 AND a.op < b.op), en AS (SELECT op_a, idx_a, op_b, idx_b, min(x) x0, max(x) x1, arg_min(y, (x, y)) y0, arg_max(y, (x, y)) y1 FROM q GROUP BY ALL), lin AS (SELECT op_a, idx_a, op_b, idx_b, (y1 - y0) / (x1 - x0) a, y0 - (y1 - y0) / (x1 - x0) * x0 b FROM (SELECT q.op_a, q.idx_a, q.op_b, q.idx_b, any_value(x0) x0, any_value(x1) x1, any_value(y0) y0, any_value(y1) y1, bool_and(CAST(y - y0 AS HUGEINT) * (x1 - x0) = CAST(y1 - y0 AS HUGEINT) * (x - x0)) ok FROM q JOIN en USING (op_a, idx_a, op_b, idx_b) WHERE x1 > x0 GROUP BY ALL) WHERE ok)"


def _doubled(t: Tables) -> DataFrame:
    """The order trace with a third operation whose parameter is 2 o_custkey + 5."""
    more = t.by_order[0].select(F.col("o_orderkey").alias("tx_id"), F.lit(3).alias("op"), F.lit(1).alias("rn"), F.lit(0).alias("type"), F.lit(0).alias("idx"), (2 * F.col("o_custkey") + 5).alias("v"))
    return order_params(t).unionByName(more)


_LIN3_SQL = _LIN_SQL.replace(P_SQL, P_SQL[:-1] + " UNION ALL SELECT o_orderkey, 3, 1, 0, 0, 2 * o_custkey + 5 FROM orders)")


@query("dep_linear", f"WITH {_LIN3_SQL} SELECT op_a, idx_a, op_b, idx_b, round(a, 6) a, round(b, 6) b FROM lin")
def _(t: Tables) -> DataFrame:
    return M.linear_relations(_doubled(t)).select(*M.PAIR, F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _order_results(t: Tables, kind: str = "long") -> DataFrame:
    """Operation 1 reads one row: the order's customer and its total."""
    values = F.array(F.col("o_custkey").cast(kind), F.col("o_totalprice").cast(kind))
    return t.by_order[0].select(F.col("o_orderkey").alias("tx_id"), F.lit(1).alias("op"), F.lit(0).alias("type"), F.posexplode(values).alias("m", "v"))


_RES_SQL = "res AS (SELECT o_orderkey tx_id, 1 op, 0 type, 0 m, CAST(o_custkey AS {k}) v FROM orders UNION ALL SELECT o_orderkey, 1, 0, 1, CAST({t} AS {k}) FROM orders)"


@query("dep_equal_results", f"WITH {P_SQL}, {_RES_SQL.format(k='BIGINT', t='trunc(o_totalprice)')} SELECT a.op op_a, a.idx idx_a, b.op op_b, b.idx idx_b, 'parameter' source, count(*) n FROM p a JOIN p b USING (tx_id, type, v) WHERE a.rn = 1 AND b.rn = 1 AND (a.op < b.op OR a.op = b.op AND a.idx < b.idx) GROUP BY ALL UNION ALL SELECT a.op, a.m, b.op, b.idx, 'result', count(*) FROM res a JOIN p b USING (tx_id, type, v) WHERE b.rn = 1 AND a.op < b.op GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return M.equal_counts(order_params(t), _order_results(t))


@query("dep_linear_results", f"WITH {P_SQL}, {_RES_SQL.format(k='DOUBLE', t='o_totalprice')}, f AS (SELECT tx_id, 'parameter' source, op, idx, CAST(v AS DOUBLE) v FROM p WHERE rn = 1 UNION ALL SELECT o_orderkey, 'parameter', 3, 0, 2.0 * o_custkey + 5 FROM orders UNION ALL SELECT o_orderkey, 'parameter', 4, 0, 0.5 * CAST(o_totalprice AS DOUBLE) + 1.25 FROM orders UNION ALL SELECT tx_id, 'result', op, m, v FROM res), q AS (SELECT a.source, a.op op_a, a.idx idx_a, b.op op_b, b.idx idx_b, a.v x, b.v y FROM f a JOIN f b USING (tx_id) WHERE b.source = 'parameter' AND a.op < b.op), en AS (SELECT source, op_a, idx_a, op_b, idx_b, min(x) x0, max(x) x1, arg_min(y, (x, y)) y0, arg_max(y, (x, y)) y1 FROM q GROUP BY ALL) SELECT source, op_a, idx_a, op_b, idx_b, round((y1 - y0) / (x1 - x0), 6) a, round(y0 - (y1 - y0) / (x1 - x0) * x0, 4) b FROM q JOIN en USING (source, op_a, idx_a, op_b, idx_b) WHERE x1 > x0 GROUP BY source, op_a, idx_a, op_b, idx_b, x0, x1, y0, y1 HAVING bool_and(abs((y - y0) * (x1 - x0) - (y1 - y0) * (x - x0)) <= 1e-9 * (x1 - x0) * greatest(abs(y), abs(y0), abs(y1)))")
def _(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast("double") * 0.5 + 1.25
    half = t.by_order[0].select(F.col("o_orderkey").alias("tx_id"), F.lit(4).alias("op"), F.lit(1).alias("rn"), F.lit(2).alias("type"), F.lit(0).alias("idx"), price.alias("v"))
    p = _doubled(t).withColumn("v", F.col("v").cast("double")).unionByName(half)
    return M.linear_relations(p, _order_results(t, "double")).withColumns({"a": F.round("a", 6), "b": F.round("b", 4)})


@query("dep_linear_select", f"WITH {_LIN3_SQL} SELECT op_a, idx_a, op_b, idx_b, round(a, 6) a, round(b, 6) b FROM lin WHERE NOT (a = 1 AND b = 0) AND a <> 0 AND NOT (op_b = 2 AND idx_b = 0)")
def _(t: Tables) -> DataFrame:
    p = _doubled(t)
    return M.useful_linear(M.linear_relations(p), _prob(p)).select(*M.PAIR, F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("loop_logic", f"WITH {P_SQL}, d AS (SELECT op, idx, v - lag(v) OVER (PARTITION BY tx_id, op, idx ORDER BY rn) d FROM p) SELECT op, idx, min(d) increment FROM d WHERE d IS NOT NULL GROUP BY op, idx HAVING min(d) = max(d)")
def _(t: Tables) -> DataFrame:
    return M.loop_increments(order_params(t))


_PAIRS_SQL = P_SQL + ", k AS (SELECT tx_id, op, idx, v % 4 part, count(*) n FROM p GROUP BY ALL), per AS (SELECT tx_id, op, idx, sum(n) t, sum(n * (n - 1) // 2) eq FROM k GROUP BY ALL)"


def supplier_part() -> Column:
    return X.hash_partition(F.col("v"), 4)


@query("dep_part_eq", f"WITH {_PAIRS_SQL} SELECT op, idx, CAST(sum(eq) AS BIGINT) n_pairs FROM per GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return M.partition_counts(order_params(t), supplier_part(), True)


@query("dep_part_ne", f"WITH {_PAIRS_SQL} SELECT op, idx, CAST(sum(t * (t - 1) // 2 - eq) AS BIGINT) n_pairs FROM per GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return M.partition_counts(order_params(t), supplier_part(), False)


def _columns() -> Column:
    """The column of a table that a parameter stands for: the order's key and its lines' are
    one, as are the keys of customers and suppliers, which share a range."""
    return F.when(F.col("idx") == 0, "orderkey").when((F.col("op") == 1) | (F.col("idx") == 2), "partner")


@query("dep_part_links", f"WITH {P_SQL}, c AS (SELECT *, v % 4 part, CASE WHEN idx = 0 THEN 'orderkey' WHEN op = 1 OR idx = 2 THEN 'partner' END col FROM p) SELECT a.op op_a, a.idx idx_a, b.op op_b, b.idx idx_b, count(*) FILTER (WHERE a.part = b.part) n_same, count(*) FILTER (WHERE a.part <> b.part) n_other FROM c a JOIN c b USING (tx_id, col) WHERE a.rn = 1 AND a.op < b.op GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return M.partition_links(order_params(t), supplier_part(), _columns())


@query("dep_part_select")
def _(t: Tables) -> DataFrame:
    p = order_params(t)
    own = M.partition_counts(p.where(_columns().isNotNull()), supplier_part(), False)
    one = own.select(F.col("op").alias("op_a"), F.col("idx").alias("idx_a"), F.col("op").alias("op_b"), F.col("idx").alias("idx_b"), "n_pairs").where("op_a > 1")
    two = M.partition_links(p, supplier_part(), _columns()).select(*M.PAIR, F.col("n_other").alias("n_pairs"))
    rounds = p.select("op", "tx_id", "rn").distinct().groupBy("op").agg(F.count("*").alias("d1"))
    base = M.exec_pairs(p).join(rounds, "op").select(F.col("op").alias("op_b"), "n_pairs", "d1").withColumnRenamed("n_pairs", "d0")
    rate = F.col("n_pairs") / F.when(F.col("op_a") == F.col("op_b"), F.col("d0")).otherwise(F.col("d1"))
    more = one.union(two).join(base, "op_b").select(*M.PAIR, rate.alias("prob"), F.lit("part_ne").alias("kind")).where("prob >= 0.01")
    return M.merged_edges(M.selected_edges(_candidates(t)).withColumn("kind", F.lit("equal")), more)


@query("partition_cardinality", "WITH n AS (SELECT o_orderkey, count(DISTINCT l_suppkey % 4) partitions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT partitions, round(count(*) / (SELECT count(*) FROM n), 6) AS \"share\" FROM n WHERE partitions > 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = order_params(t)
    part = F.when((F.col("op") == 2) & (F.col("idx") == 2), supplier_part())
    return M.partition_cardinality(p, part).withColumn("share", F.round("share", 6))


@query("partitions_per_txn", "SELECT partitions, count(*) txns FROM (SELECT l_orderkey, count(DISTINCT l_suppkey % 4) partitions FROM lineitem GROUP BY 1) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = order_params(t).where("op = 2")
    return M.partitions_of(p, F.when((F.col("op") == 2) & (F.col("idx") == 2), supplier_part()), ["tx_id"]).withColumnRenamed("n", "txns")


@query("partitions_per_sql", f"WITH {P_SQL} SELECT partitions, count(*) n FROM (SELECT tx_id, op, rn, count(DISTINCT v % 4) partitions FROM p WHERE op = 2 AND idx > 0 GROUP BY ALL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    part = F.when((F.col("op") == 2) & (F.col("idx") > 0), supplier_part())
    return M.partitions_of(order_params(t).where("op = 2"), part, ["tx_id", "op", "rn"])


@query("partition_assign", "SELECT o_custkey % 4 h, CAST(CASE WHEN o_custkey < 200 THEN 0 WHEN o_custkey < 700 THEN 1 ELSE 2 END AS INT) r, CAST(CASE WHEN o_orderstatus IN ('O', 'P') THEN 0 WHEN o_orderstatus IN ('F') THEN 1 END AS INT) l, count(*) n FROM orders GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    return t.orders.groupBy(X.hash_partition(k, 4).alias("h"), X.range_partition(k, [200, 700]).alias("r"), X.list_partition(F.col("o_orderstatus"), [["O", "P"], ["F"]]).alias("l")).agg(F.count("*").alias("n"))


@query("stat_params", f"WITH {P_SQL}, d AS (SELECT DISTINCT type, op, idx FROM p) SELECT type, string_agg(op || '_' || idx, ',' ORDER BY op, idx) params FROM d GROUP BY type")
def _(t: Tables) -> DataFrame:
    return M.parameters_by_type(order_params(t))


@query("mask_logical_params", f"WITH {P_SQL} SELECT op, idx, count(*) n, count(v) FILTER (WHERE NOT (op = 2 AND idx = 0)) kept FROM p GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    p = order_params(t)
    m = M.masked(p, M.identical_sets(_prob(p)), M.settled(M.loop_increments(p)))
    return m.groupBy("op", "idx").agg(F.count("*").alias("n"), F.count("v").alias("kept"))


@query("simulate_loop", "SELECT o_orderkey, o_orderkey % 7 + i * (o_custkey % 3) v, CAST(i AS INT) i FROM (SELECT *, unnest(range(0, 1 + o_orderkey % 4)) i FROM orders)")
def _(t: Tables) -> DataFrame:
    rounds = t.orders.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int"))).alias("i"))
    return rounds.select("o_orderkey", (F.col("o_orderkey") % 7 + F.col("i") * (F.col("o_custkey") % 3)).alias("v"), "i")


@query("simulate_read", "SELECT o_orderkey, count(l_orderkey) n_rows, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey), '') parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    j = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


@query("simulate_rounds", "SELECT l_orderkey, count(*) rounds, max(l_linenumber) top FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return numbered_lines(t).groupBy("l_orderkey").agg(F.max("rn").cast("long").alias("rounds"), F.max("l_linenumber").alias("top"))
