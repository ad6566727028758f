"""Small cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import distribution as D
from tracewright.operators import generate as G
from tracewright.operators import mining as M
from tracewright.operators import sessions as S
from tracewright.operators import simulate as Z
from tracewright.operators import windows as Wn
from tracewright.sources import texts, traces

P = "tx_id long, op int, rn int, type int, idx int, v long"


def test_equal_probability_is_matches_over_runs(spark):
    rows = []
    for tx in range(4):
        rows += [(tx, 1, 1, 0, 0, tx), (tx, 1, 1, 0, 1, 100 + tx), (tx, 2, 1, 0, 0, 500), (tx, 2, 1, 0, 1, 600 + tx), (tx, 2, 1, 0, 2, 100 + tx if tx else 7)]
    p = spark.createDataFrame(rows, P)
    got = {tuple(r)[:4]: r.prob for r in M.probabilities(M.equal_counts(p), M.exec_counts(p)).collect()}
    assert got == {(1, 1, 2, 2): 0.75}


def test_equal_values_of_other_types_do_not_count(spark):
    p = spark.createDataFrame([(1, 1, 1, 0, 0, 5), (1, 2, 1, 1, 0, 5)], P)
    assert M.equal_counts(p).count() == 0


def test_branch_and_loop_counts(spark):
    rows = [(tx, 1, 1, 0, 0, tx) for tx in range(4)] + [(tx, 2, 1, 0, 0, tx) for tx in range(3)]
    p = spark.createDataFrame(rows, P)
    assert {r.op: r.n_exec for r in M.exec_counts(p).collect()} == {1: 4, 2: 3}
    assert {r.op: r.avg_runs for r in M.average_runs(p).collect()} == {1: 1.0, 2: 0.75}


def test_loop_increment_and_constant(spark):
    p = spark.createDataFrame([(t, 2, r, 0, i, 10 * t + 2 * r if i == 0 else 7) for t in range(3) for r in (1, 2, 3) for i in (0, 1)], P)
    assert {r.idx: r.increment for r in M.loop_increments(p).collect()} == {0: 2, 1: 0}


def test_linear_holds_in_all_rows_or_not_at_all(spark):
    rows = [(t, 1, 1, 0, 0, t) for t in range(6)] + [(t, 2, 1, 0, 0, 2 * t + 5) for t in range(6)]
    got = M.linear_relations(spark.createDataFrame(rows, P)).collect()
    assert [(r.a, r.b) for r in got] == [(2.0, 5.0)]
    rows[-3] = (3, 2, 1, 0, 0, 99)
    assert M.linear_relations(spark.createDataFrame(rows, P)).count() == 0


def test_edges_are_scanned_from_the_faintest(spark):
    c = spark.createDataFrame([(1, k, 2, 0, p, str(k)) for k, p in enumerate((0.3, 0.5, 0.6))], "op_a int, idx_a int, op_b int, idx_b int, prob double, set_a string")
    assert sorted(r.prob for r in M.selected_edges(c).collect()) == [0.3, 0.5]
    assert sorted(r.prob for r in M.selected_edges(c, descending=True).collect()) == [0.3, 0.6]


def test_faint_edges_go(spark):
    counts = spark.createDataFrame([(1, 0, 2, 0, 5)], "op_a int, idx_a int, op_b int, idx_b int, n long")
    assert M.probabilities(counts, spark.createDataFrame([(2, 1000)], "op int, n_exec long")).count() == 0


def test_masking_keeps_the_first_of_a_set(spark):
    p = spark.createDataFrame([(1, 1, 1, 0, 0, 5), (1, 2, 1, 0, 0, 5), (1, 2, 2, 0, 0, 5)], P)
    sets = spark.createDataFrame([(1, 0, 1, 0), (2, 0, 1, 0)], "op int, idx int, set_op int, set_idx int")
    loops = spark.createDataFrame([], "op int, idx int, increment long")
    assert M.masked(p, sets, loops).where("v is not null").select("op").collect()[0].op == 1


def test_loop_folding(spark):
    rows = [(1, k, s) for k, s in enumerate(["a", "b", "c", "b", "c", "d"])]
    got = S.folded_loops(spark.createDataFrame(rows, "tx long, k int, sql string"), "tx", ["k"], "sql").collect()
    assert [(r.sql, r.block, r.op_id, r.round) for r in got] == [("a", 0, 1, 1), ("b", 1, 2, 1), ("c", 1, 3, 1), ("b", 1, 2, 2), ("c", 1, 3, 2), ("d", 2, 4, 1)]


def test_percentile_rank_rule(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 11)], "v double")
    assert D.percentile_ranks(df, [], "v", [0.8]).first()[0] == 9.0


def test_windows_are_right_closed_and_the_first_record_is_in_the_first(spark):
    df = spark.createDataFrame([(s,) for s in (0, 10, 11, 20, 21)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    assert [r.w for r in Wn.tumbling(df, "ts", 10_000_000).orderBy("ts").collect()] == [1, 1, 2, 2, 3]


def test_similarity_of_a_histogram_with_itself_is_one(spark):
    h = spark.createDataFrame([(0.0, 1.0, 0.25), (1.0, 3.0, 0.75)], "lo double, hi double, p double")
    assert abs(D.similarity(h, h).first()[0] - 1) < 1e-9


def test_generated_keys_are_unique_and_in_range(spark):
    df = spark.range(60).select(*[c.alias(n) for c, n in zip(G.key_columns(F.col("id"), [5, 3, 4]), "abc", strict=True)])
    assert df.distinct().count() == 60
    assert df.agg(F.max("a"), F.max("b"), F.max("c"), F.min("a")).first()[:] == (5, 3, 4, 1)


def test_null_ratio_and_distinct_values(spark):
    r = spark.range(20_000).select(G.number_column(F.col("id"), 50, 0.0, 1.0, 0.1, 3).alias("v")).agg(F.avg(F.col("v").isNull().cast("int")), F.count_distinct("v")).first()
    assert abs(r[0] - 0.1) < 0.02 and r[1] == 50


def test_partition_rules(spark):
    df = spark.createDataFrame([(5,), (10,), (25,), (None,)], "k int")
    assert [r[0] for r in df.select(X.range_partition(F.col("k"), [10, 20])).collect()] == [0, 1, 2, None]
    assert [r[0] for r in df.select(X.list_partition(F.col("k"), [[5], [25]])).collect()] == [0, None, 1, None]


def test_java_hash(spark):
    df = spark.createDataFrame([("hello",), ("",), ("polygenelubricants",)], "s string")
    assert [r[0] for r in df.select(X.java_string_hash(F.col("s"))).collect()] == [99162322, 0, -2147483648]


def test_schedule_and_choice(spark):
    r = spark.createDataFrame([("a", 1, 4)], "kind string, w long, txns long")
    assert [x.at_us for x in Z.schedule(r, "w", F.lit(0), 100).orderBy("k").collect()] == [0, 25, 50, 75]
    assert spark.range(1).select(Z.choice(F.lit(0.95), {"a": 0.5, "b": 0.5})).first()[0] == "b"


def test_trace_lines(spark):
    lines = spark.createDataFrame([('[timestamp=17][connId=7][sql=select s from S where s = ?][para="42", x][res=1,2][res=3,4]',), ("noise",), ("[timestamp=18][connId=7][sql=i][batchpara=1][batchpara=2]",)], "value string")
    a, b = traces.parse_trace(lines).orderBy("ts_ms").collect()
    assert (a.params, a.results, a.batched) == (["42", "x"], [["1", "2"], ["3", "4"]], False)
    assert (b.params, b.batched) == (["1", "2"], True)


def test_schema_lines_and_settings(spark):
    lines = spark.createDataFrame([("Table[T; t1 integer; t2 varchar; pk(t1); fk(t1, S, s1)] ## note",), ("## only a note",)], "value string")
    got = texts.parse_schema(lines).orderBy("position").collect()
    assert [(r.table_name, r.column_name, r.type, r.in_key, r.refers_to) for r in got] == [("T", "t1", "integer", True, "S"), ("T", "t2", "varchar", False, None)]
    assert texts.read_settings("buckets = 20 # more\nother=1").buckets == 20


def test_rolled_files_and_csv(spark, tmp_path):
    (tmp_path / "t.log").write_text("new\n")
    (tmp_path / "t.log.2").write_text("old\n")
    got = traces.read_lines(spark, str(tmp_path)).orderBy(F.desc("file_seq")).collect()
    assert [r.value for r in got] == ["old", "new"]
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None), (3, "")], "k int, s string")
    texts.write_rows(df, f"{tmp_path}/rows")
    assert sorted(texts.read_rows(spark, f"{tmp_path}/rows", df.schema).collect(), key=lambda r: r.k) == df.collect()


def test_candidates_of_every_window(spark):
    from tracewright.operators import generate
    from tracewright.plans import registry

    rows = [(w, k, w * 100 + k) for w in range(1, 6) for k in range(6)]
    prior, domain = spark.createDataFrame(rows, "w int, place int, v long"), spark.range(100, 700).withColumnRenamed("id", "v")
    got = generate.window_candidates(prior, domain, "w", 2, 6).collect()
    for w in range(1, 6):
        one = generate.next_candidates(prior.where(f"w = {w}").drop("w"), domain, 2, 6).collect()
        assert sorted((x.place, x.v, x.reused) for x in got if x.w == w) == sorted(tuple(x) for x in one) and len(one) == 6
    out = registry.QUERIES["gen_seq_int"](spark, "/root/testdata/sf0.001")
    assert out.select("w").distinct().count() > 1


def test_real_numbers_are_compared_as_they_are(spark):
    rows = []
    for t, (x, y) in enumerate([(0.1, 0.3), (0.2, 0.1), (0.3, 0.45), (0.9, 0.6), (1.1, 0.8)]):
        rows += [(t, 1, 1, 1, 0, x), (t, 2, 1, 1, 0, y), (t, 2, 1, 1, 1, 0.5 * x + 0.25)]
    got = M.linear_relations(spark.createDataFrame(rows, P.replace("v long", "v double"))).collect()
    assert [(r.idx_b, round(r.a, 9), round(r.b, 9)) for r in got] == [(1, 0.5, 0.25)]


def test_results_count_beside_parameters(spark):
    p = spark.createDataFrame([(t, 1, 1, 0, 0, t) for t in range(4)] + [(t, 2, 1, 0, 0, 10 * t + 3) for t in range(4)], P)
    res = spark.createDataFrame([(t, 1, 0, 0, 10 * t + 3 if t else None) for t in range(4)] + [(t, 1, 1, 0, 5 * t) for t in range(4)], "tx_id long, op int, m int, type int, v long")
    assert {(r.source, r.idx_a): r.n for r in M.equal_counts(p, res).collect()} == {("result", 0): 3}
    # a null result rules its relation out
    assert sorted((r.source, r.idx_a, r.a, r.b) for r in M.linear_relations(p, res).collect()) == [("parameter", 0, 10.0, 3.0), ("result", 1, 2.0, 3.0)]


def test_partition_links_take_the_first_round_of_earlier_operations(spark):
    p = spark.createDataFrame([(1, 1, 1, 0, 0, 4), (1, 1, 2, 0, 0, 5), (1, 2, 1, 0, 0, 8), (1, 2, 2, 0, 0, 9), (1, 2, 3, 0, 0, 10)], P)
    got = M.partition_links(p, F.col("v") % 4, F.lit("c")).collect()
    assert [(r.op_a, r.op_b, r.n_same, r.n_other) for r in got] == [(1, 2, 1, 2)]


def test_partition_edges_replace_fainter_ones(spark):
    edge = "op_a int, idx_a int, op_b int, idx_b int, prob double, kind string"
    known = spark.createDataFrame([(1, 0, 3, 0, 0.6, "equal"), (1, 1, 3, 0, 0.3, "include")], edge)
    more = spark.createDataFrame([(2, 0, 3, 0, 0.35, "part_ne"), (2, 1, 3, 0, 0.05, "part_ne")], edge)
    got = {(r.op_a, r.idx_a, r.kind) for r in M.merged_edges(known, more).collect()}
    assert got == {(1, 0, "equal"), (2, 0, "part_ne"), (2, 1, "part_ne")}


def test_several_loops_of_a_transaction(spark):
    rows = [(1, k, s) for k, s in enumerate(["a", "b", "a", "b", "c", "d", "c", "d", "c", "a", "b", "e"])]
    got = [(r.sql, r.block, r.op_id, r.round) for r in S.folded_loops(spark.createDataFrame(rows, "tx long, k int, sql string"), "tx", ["k"], "sql").collect()]
    assert got[:9] == [("a", 1, 1, 1), ("b", 1, 2, 1), ("a", 1, 1, 2), ("b", 1, 2, 2), ("c", 3, 3, 1), ("d", 3, 4, 1), ("c", 3, 3, 2), ("d", 3, 4, 2), ("c", 3, 3, 3)]
    # what stands before the last loop's end takes part in no later one
    assert got[9:] == [("a", 4, 5, 1), ("b", 4, 6, 1), ("e", 4, 7, 1)]


def test_quoted_items_may_hold_commas(spark):
    line = '[timestamp=5][connId=1][sql=s][para="a,b",3, "x ""y"" z",,-1]'
    assert traces.parse_trace(spark.createDataFrame([(line,)], "value string")).first().params == ["a,b", "3", 'x "y" z', "", "-1"]


def test_lines_keep_their_order(spark, tmp_path):
    for name, lines in (("t.log", ["c", "d"]), ("t.log.1", ["b"]), ("t.log.2", ["a1", "a2", "a3"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = traces.read_lines(spark, str(tmp_path)).orderBy(*traces.LINE_ORDER).collect()
    assert [r.value for r in got] == ["a1", "a2", "a3", "b", "c", "d"]


def test_percentiles_against_sorting(spark):
    import random

    r = random.Random(2)
    rows = [(g, v) for g in "ab" for v in [r.choice([1.0, 2.0, r.random() * 1000, 5.0]) for _ in range(501)]] + [("a", None), ("c", 7.0)]
    got = {x.g: (x.p50, x.p99) for x in D.percentile_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.5, 0.99]).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (v[int(len(v) * 0.5)], v[int(len(v) * 0.99)])


def test_settings_of_all_kinds():
    s = texts.read_settings("top_values = 7 # most\nrollback=false\nleast_probability=0.5\nunknown=1\nwindow_delay=2 hours")
    assert (s.top_values, s.rollback, s.least_probability, s.window_delay, s.buckets) == (7, False, 0.5, "2 hours", 15)


def test_numbers_go_on_beyond_the_period(spark):
    df = spark.createDataFrame([(5,), (5 + X.M,), (5 + 2 * X.M,)], "k long").select(X.lcg(F.col("k")).alias("u"))
    assert len({r.u for r in df.collect()}) == 3


def test_values_of_a_measured_distribution(spark):
    cdf = spark.createDataFrame([("g", 0.0, 0.5, 3.0, None), ("g", 0.5, 1.0, None, 0)], "g string, lo double, hi double, v double, bucket int")
    quantiles = spark.createDataFrame([("g", 0, 1, 10.0), ("g", 0, 2, 20.0)], "g string, bucket int, step int, v double")
    df = spark.createDataFrame([("g", 0.2, 0.9), ("g", 0.7, 0.25), ("g", 0.7, 0.75)], "g string, u double, w double")
    got = G.sampled_values(df, F.col("u"), F.col("w"), cdf, quantiles, ["g"]).collect()
    assert sorted(r.v for r in got) == [3.0, 10.0, 15.0]


def test_templates_anonymous_names_and_references(spark):
    from tracewright.operators import profile, sqltext

    tables = {"region": spark.createDataFrame([], "r_key long"), "nation": spark.createDataFrame([], "n_key long, n_region long")}
    schema = profile.schema_scan(tables, {"region": ["r_key"], "nation": ["n_key"]}, {"nation": {"n_region": ("region", "r_key")}})
    ddl = {r.table_name: r for r in sqltext.rendered_ddl(schema).collect()}
    assert ddl["nation"].ddl_after_load.endswith("ALTER TABLE nation ADD FOREIGN KEY (n_region) REFERENCES region (r_key)") and ddl["region"].ddl_after_load is None
    named = sqltext.with_new_names(sqltext.anonymous_names(schema)).collect()
    new_tables = {r.table_name for r in named}
    assert all(r.parent_table in new_tables for r in named if r.parent_table) and not new_tables & {"region", "nation"}


def exchanges(df):
    """The keys of each shuffle in the plan before it runs, and of each join's."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in text.split("\n") if "Exchange" in line]


def trace_of(spark, path, orders, lines_each):
    o = spark.range(orders).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), (F.col("id") * 1.5).alias("o_totalprice"))
    numbers = {c: F.col("k").cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    li = o.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(lines_each))).alias("k"))
    li = li.withColumns({"l_partkey": F.col("l_orderkey") + F.col("k"), "l_suppkey": F.col("l_orderkey") % 5, "l_linenumber": F.col("k").cast("int"), **numbers})
    o.write.parquet(f"{path}/orders.parquet")
    li.drop("k").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_a_tasks_share_of_the_trace_stays_the_same(spark, tmp_path, monkeypatch):
    from tracewright.plans import base, registry

    where = trace_of(spark, tmp_path, 100, 3)
    monkeypatch.setattr(base, "ROWS_A_TASK", 40)
    t = base.Tables(spark, where)
    assert base.order_params(t).rdd.getNumPartitions() == 10
    # what is grouped by transaction is together already: one shuffle of each table, and the last one
    for name, shuffles in (("op_exec_pairs", 3), ("partitions_per_sql", 2)):
        assert len(exchanges(registry.QUERIES[name](spark, where))) == shuffles, name


def test_rows_are_masked_where_they_are(spark):
    p = spark.createDataFrame([(1, 1, 1, 0, 0, 5), (1, 2, 1, 0, 0, 5)], P)
    sets = spark.createDataFrame([(1, 0, 1, 0), (2, 0, 1, 0)], "op int, idx int, set_op int, set_idx int")
    loops = spark.createDataFrame([], "op int, idx int, increment long")
    assert not [x for x in exchanges(M.masked(p, sets, loops)) if "hashpartitioning" in x]


def test_pairs_of_parameters_are_not_shuffled_or_sorted(spark):
    p = spark.createDataFrame([(t, o, 1, 0, 0, o * t + 3) for t in range(20) for o in (1, 2)], P)
    df = M.linear_relations(p)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    assert [(r.a, r.b) for r in df.collect()] == [(2.0, -3.0)]


def test_repeated_rows_count_as_their_pairs(spark):
    rows = [(1, 1, 1, 0, 0, 5)] * 3 + [(1, 2, 1, 0, 1, 5)] * 4 + [(1, 2, 1, 0, 0, None), (1, 1, 1, 0, 1, None)]
    p = spark.createDataFrame(rows, P)
    df = M.equal_counts(p)
    assert [tuple(r) for r in df.collect()] == [(1, 0, 2, 1, 12)]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
