"""Profiles, type rules and text of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import profile as P
from tracewright.operators import sqltext as S
from tracewright.plans.base import Tables, query

RELATIONAL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"]}
FOREIGN = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
REFS = {
    "nation": {"n_regionkey": ("region", "r_regionkey")}, "customer": {"c_nationkey": ("nation", "n_nationkey")}, "supplier": {"s_nationkey": ("nation", "n_nationkey")},
    "orders": {"o_custkey": ("customer", "c_custkey")}, "lineitem": {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")},
}
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STRINGS = ["p_name", "p_brand", "p_type"]


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


@query("profile_table", _union([f"SELECT '{t}' table_name, count(*) n_rows FROM {t}" for t in RELATIONAL]))
def _(t: Tables) -> DataFrame:
    return P.table_profile({n: getattr(t, n) for n in RELATIONAL})


@query("profile_columns", _union([f"SELECT '{c}' column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) null_ratio, count(DISTINCT {c}) ndv, CAST(min({c}) AS DOUBLE) min_value, CAST(max({c}) AS DOUBLE) max_value FROM lineitem" for c in NUMBERS]))
def _(t: Tables) -> DataFrame:
    return P.numeric_profile(t.lineitem, NUMBERS)


@query("profile_strings", _union([f"SELECT '{c}' column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) null_ratio, count(DISTINCT {c}) ndv, round(avg(length({c})), 6) avg_len, max(length({c})) max_len FROM part" for c in STRINGS]))
def _(t: Tables) -> DataFrame:
    return P.string_profile(t.part, STRINGS).withColumn("avg_len", F.round("avg_len", 6))


@query("profile_boolean", "SELECT 'is_open' column_name, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(o_orderstatus), 6) true_ratio FROM orders UNION ALL SELECT 'is_large', round(count(*) FILTER (WHERE o_totalprice > 200000) / count(o_totalprice), 6) FROM orders")
def _(t: Tables) -> DataFrame:
    return P.boolean_profile(t.orders, {"is_open": F.col("o_orderstatus") == "O", "is_large": F.col("o_totalprice") > 200000}).withColumn("true_ratio", F.round("true_ratio", 6))


@query("profile_derived", _union([f"SELECT '{c}' column_name, round(CASE WHEN count(DISTINCT {c}) > 1 THEN (max({c}) - min({c})) / (count(DISTINCT {c}) - 1) ELSE 0 END, 6) coefficient FROM lineitem" for c in NUMBERS]))
def _(t: Tables) -> DataFrame:
    return P.derived_profile(P.numeric_profile(t.lineitem, NUMBERS)).withColumn("coefficient", F.round("coefficient", 6))


@query("profile_derived_lengths", "WITH p AS (" + _union([f"SELECT '{c}' column_name, avg(length({c})) a, max(length({c})) m FROM part" for c in STRINGS]) + ") SELECT column_name, round(CASE WHEN m / 2 > a THEN 0 ELSE 2 * a - m END, 6) min_length, round(CASE WHEN m / 2 > a THEN 2 * a ELSE m END, 6) max_length FROM p")
def _(t: Tables) -> DataFrame:
    return P.derived_lengths(P.string_profile(t.part, STRINGS)).select("column_name", F.round("min_length", 6).alias("min_length"), F.round("max_length", 6).alias("max_length"))


@query("fk_reference_scale", _union([f"SELECT '{c}' child, '{p}' parent, round((SELECT count(*) FROM {c}) / (SELECT count(*) FROM {p}), 6) AS \"scale\"" for c, p in FOREIGN]))
def _(t: Tables) -> DataFrame:
    counts = P.table_profile({n: getattr(t, n) for n in RELATIONAL})
    keys = t.spark.createDataFrame(FOREIGN, "child string, parent string")
    one = counts.select(F.col("table_name").alias("child"), F.col("n_rows").alias("c"))
    two = counts.select(F.col("table_name").alias("parent"), F.col("n_rows").alias("p"))
    return keys.join(one, "child").join(two, "parent").select("child", "parent", F.round(F.col("c") / F.col("p"), 6).alias("scale"))


@query("profile_dates", _union([f"SELECT '{c}' column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) null_ratio, count(DISTINCT {c}) ndv, CAST(epoch_ms(CAST(min({c}) AS TIMESTAMP)) AS DOUBLE) min_value, CAST(epoch_ms(CAST(max({c}) AS TIMESTAMP)) AS DOUBLE) max_value FROM {t}" for t, c in (("orders", "o_orderdate"), ("events", "ts"))]))
def _(t: Tables) -> DataFrame:
    return P.numeric_profile(t.orders, ["o_orderdate"]).unionByName(P.numeric_profile(t.events, ["ts"]))


@query("fk_scale_jitter", _union([f"SELECT '{c}' child, '{p}' parent, round((SELECT count(*) FROM {c}) / (SELECT count(*) FROM {p}) * (1 + (2 * {X.lcg_sql(str(k), 7)} - 1) * 0.02), 6) AS \"scale\"" for k, (c, p) in enumerate(FOREIGN)]))
def _(t: Tables) -> DataFrame:
    out = None
    for k, (c, p) in enumerate(FOREIGN):
        one = P.reference_scale(getattr(t, c), getattr(t, p)).select(F.lit(c).alias("child"), F.lit(p).alias("parent"), F.round(P.jittered(F.col("scale"), F.lit(k), 0.02, 7), 6).alias("scale"))
        out = one if out is None else out.union(one)
    return out


_EDGES = [(c, column, *parent) for c, columns in REFS.items() for column, parent in columns.items()]


@query("fk_integrity", _union([f"SELECT '{c}' child, '{k}' column_name, count(*) n_rows, count(*) FILTER (WHERE {k} IS NULL) n_null, count(*) FILTER (WHERE {k} NOT IN (SELECT {pk} FROM {p})) n_broken FROM {c}" for c, k, p, pk in _EDGES]))
def _(t: Tables) -> DataFrame:
    """Whether the declared references hold in the rows of all tables."""
    out = None
    for c, k, p, pk in _EDGES:
        one = P.broken_references(getattr(t, c), k, getattr(t, p), pk).select(F.lit(c).alias("child"), F.lit(k).alias("column_name"), "n_rows", "n_null", "n_broken")
        out = one if out is None else out.union(one)
    return out


@query("fk_topo_order", "WITH RECURSIVE f(c, p) AS (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in FOREIGN) + "), n(t) AS (VALUES " + ", ".join(f"('{x}')" for x in RELATIONAL) + "), r(t, level) AS (SELECT t, 0 FROM n WHERE t NOT IN (SELECT c FROM f) UNION ALL SELECT f.c, r.level + 1 FROM r JOIN f ON f.p = r.t) SELECT r.t table_name, max(level) AS level, (SELECT count(*) FROM lineitem) * 0 + any_value(c.n) n_rows FROM r JOIN (" + _union([f"SELECT '{x}' t, count(*) n FROM {x}" for x in RELATIONAL]) + ") c ON c.t = r.t GROUP BY r.t")
def _(t: Tables) -> DataFrame:
    counts = P.table_profile({n: getattr(t, n) for n in RELATIONAL})
    edges = t.spark.createDataFrame(FOREIGN, "child string, parent string")
    return P.topological_levels(counts.select("table_name"), edges).join(counts, "table_name")


@query("schema_scan")
def _(t: Tables) -> DataFrame:
    return P.schema_scan({n: getattr(t, n) for n in RELATIONAL}, KEYS, REFS)


@query("type_unify", "SELECT DISTINCT o_orderpriority native_type, CASE WHEN o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%URGENT%' THEN 'integer' ELSE NULL END logical_type FROM (SELECT CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 'bigint HIGH' WHEN o_orderpriority LIKE '%URGENT%' THEN 'tinyint URGENT' ELSE o_orderpriority END o_orderpriority FROM orders)")
def _(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    native = F.when(p.contains("HIGH"), "bigint HIGH").when(p.contains("URGENT"), "tinyint URGENT").otherwise(p)
    return t.orders.select(native.alias("native_type")).distinct().select("native_type", X.logical_type(F.col("native_type")).alias("logical_type"))


@query("partition_ddl_parse", "SELECT n_name table_name, CASE n_nationkey % 3 WHEN 0 THEN 'HASH' WHEN 1 THEN 'RANGE' ELSE 'LIST' END rule, 'k' || n_regionkey AS \"key\", CASE n_nationkey % 3 WHEN 0 THEN CAST(n_nationkey + 2 AS VARCHAR) WHEN 1 THEN (n_nationkey * 10) || ',' || (n_nationkey * 20) ELSE n_nationkey || ',' || (n_nationkey + 1) END params FROM nation")
def _(t: Tables) -> DataFrame:
    k, key = F.col("n_nationkey"), F.concat(F.lit("`k"), F.col("n_regionkey"), F.lit("`"))
    ddl = (
        F.when(k % 3 == 0, F.concat(F.lit("PARTITION BY HASH ("), key, F.lit(") PARTITIONS "), k + 2))
        .when(k % 3 == 1, F.concat(F.lit("PARTITION BY RANGE ("), key, F.lit(") (PARTITION p0 VALUES LESS THAN ("), k * 10, F.lit("), PARTITION p1 VALUES LESS THAN ("), k * 20, F.lit("))")))
        .otherwise(F.concat(F.lit("PARTITION BY LIST ("), key, F.lit(") (PARTITION p0 VALUES IN ("), k, F.lit("), PARTITION p1 VALUES IN ("), k + 1, F.lit("))")))
    )
    return S.partition_ddl(t.nation.select(F.col("n_name").alias("table_name"), ddl.alias("ddl")))


_TEXT = "'select  o_totalprice from orders where o_orderkey = ' || o_orderkey || ' and  o_orderstatus = ''' || o_orderstatus || ''' and o_custkey between ' || o_custkey || ' and ' || (o_custkey + 9)"


def statements(t: Tables) -> DataFrame:
    """A literal statement for each order."""
    lit = F.lit
    sql = F.concat(lit("select  o_totalprice from orders where o_orderkey = "), "o_orderkey", lit(" and  o_orderstatus = '"), "o_orderstatus", lit("' and o_custkey between "), "o_custkey", lit(" and "), F.col("o_custkey") + 9)
    return t.orders.select("o_orderkey", sql.alias("sql"))


@query("sql_normalize", f"SELECT o_orderkey, regexp_replace(trim({_TEXT}), '\\s+', ' ', 'g') \"sql\" FROM orders")
def _(t: Tables) -> DataFrame:
    return statements(t).select("o_orderkey", S.normalized(F.col("sql")).alias("sql"))


@query("between_rewrite", "SELECT o_orderkey, 'select o_totalprice from orders where o_orderkey = ' || o_orderkey || ' and o_orderstatus = ''' || o_orderstatus || ''' and o_custkey >= ' || o_custkey || ' and o_custkey <= ' || (o_custkey + 9) \"sql\" FROM orders")
def _(t: Tables) -> DataFrame:
    return statements(t).select("o_orderkey", S.without_between(S.normalized(F.col("sql"))).alias("sql"))


@query("sql_parameterize", "SELECT 'select o_totalprice from orders where o_orderkey = ? and o_orderstatus = ? and o_custkey >= ? and o_custkey <= ?' template, count(*) n, count(DISTINCT o_orderkey) distinct_first, CAST(sum(o_custkey) AS BIGINT) third_sum FROM orders")
def _(t: Tables) -> DataFrame:
    p = S.parameterized(statements(t).withColumn("sql", S.without_between(S.normalized(F.col("sql")))))
    return p.groupBy("template").agg(F.count("*").alias("n"), F.count_distinct(F.get("literals", F.lit(0))).alias("distinct_first"), F.sum(F.get("literals", F.lit(2)).cast("long")).alias("third_sum"))


@query("predicate_extract", "SELECT column_name, op, count(*) n FROM orders, (VALUES ('o_orderkey', '='), ('o_orderstatus', '='), ('o_custkey', '>='), ('o_custkey', '<=')) v(column_name, op) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    s = statements(t).withColumn("sql", S.without_between(S.normalized(F.col("sql"))))
    return S.predicates(s).groupBy("column_name", "op").agg(F.count("*").alias("n"))


@query("sql_verb", "SELECT CASE event_type WHEN 'click' THEN 'update' WHEN 'view' THEN 'select' WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'rollback' ELSE 'commit' END verb, count(*) n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = F.col("event_type")
    text = F.when(e == "click", F.concat(F.lit("UPDATE u SET n = n + 1 WHERE id = "), "user_id")).when(e == "view", " select * from v").when(e == "signup", "insert into u values (1)").when(e == "error", "rollback").otherwise("COMMIT")
    return t.events.select(S.verb(text).alias("verb")).groupBy("verb").agg(F.count("*").alias("n"))


@query("single_row_class", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT) single_row, count(*) n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    used = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("o_orderkey"), F.lit("o_custkey"))).otherwise(F.array(F.lit("o_custkey")))
    return t.orders.select("o_orderpriority", S.single_row(used, ["o_orderkey"]).alias("one")).groupBy("o_orderpriority").agg(F.count_if("one").alias("single_row"), F.count("*").alias("n"))


@query("ts_to_millis", "SELECT event_id, epoch_us(ts) // 1000 ms FROM events")
def _(t: Tables) -> DataFrame:
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return t.events.select("event_id", S.text_to_millis(text).alias("ms"))


@query("null_default", "SELECT count(*) FILTER (WHERE v = 0) zeros, count(*) FILTER (WHERE s = '') empties, count(*) FILTER (WHERE NOT b) falses FROM (SELECT coalesce(nullif(l_linenumber, 1), 0) v, coalesce(nullif(l_returnflag, 'R'), '') s, coalesce(nullif(l_discount > 0.05, true), false) b FROM lineitem)")
def _(t: Tables) -> DataFrame:
    v = X.null_default(F.nullif(F.col("l_linenumber"), F.lit(1)), "integer")
    s = X.null_default(F.nullif(F.col("l_returnflag"), F.lit("R")), "varchar")
    b = X.null_default(F.nullif(F.col("l_discount") > 0.05, F.lit(True)), "boolean")
    return t.lineitem.agg(F.count_if(v == 0).alias("zeros"), F.count_if(s == "").alias("empties"), F.count_if(~b).alias("falses"))


@query("dist_kind", "SELECT category, is_key, type, CASE WHEN category = 1 THEN CASE WHEN type IN (1, 2, 3) THEN 0 WHEN type = 0 THEN CASE WHEN is_key THEN 0 ELSE 1 END WHEN type = 4 THEN 2 END WHEN category = 2 THEN CASE WHEN is_key AND type = 0 THEN 3 WHEN type IN (1, 2, 3) THEN 0 WHEN type = 0 THEN 4 WHEN type = 4 THEN 5 END END kind, count(*) n FROM (SELECT CAST(o_orderkey % 3 AS INT) category, o_orderkey % 2 = 0 is_key, CAST(o_custkey % 6 AS INT) type FROM orders) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    d = t.orders.select((F.col("o_orderkey") % 3).cast("int").alias("category"), (F.col("o_orderkey") % 2 == 0).alias("is_key"), (F.col("o_custkey") % 6).cast("int").alias("type"))
    return d.withColumn("kind", S.distribution_kind(F.col("category"), F.col("is_key"), F.col("type"))).groupBy("category", "is_key", "type", "kind").agg(F.count("*").alias("n"))


@query("select_star_expand", "WITH c AS (SELECT 'orders' t, column_name c, row_number() OVER (ORDER BY column_index) - 1 p FROM duckdb_columns() WHERE table_name = 'orders' UNION ALL SELECT 'region', column_name, row_number() OVER (ORDER BY column_index) - 1 FROM duckdb_columns() WHERE table_name = 'region'), i AS (SELECT o_orderkey, ['orders', 'region', 'orders'][o_orderkey % 3 + 1] t, o_orderkey % 3 k FROM orders) SELECT o_orderkey, c.t table_name, CAST(c.p AS INT) position, c.c column_name, CAST(NULL AS VARCHAR) type FROM i JOIN c USING (t) WHERE k < 2 UNION ALL SELECT o_orderkey, 'orders', 0, 'o_totalprice * 2', 'decimal' FROM i WHERE k = 2")
def _(t: Tables) -> DataFrame:
    items = F.element_at(F.array(F.lit("*"), F.lit("region.*"), F.lit("o_totalprice * 2##decimal")), (F.col("o_orderkey") % 3).cast("int") + 1)
    return S.star_expanded(t.orders.select("o_orderkey", F.lit("orders").alias("table_name"), items.alias("item")), {n: getattr(t, n) for n in ("orders", "region")})


@query("sql_writes", "SELECT o_orderkey, 'update' verb, 'stock' table_name, 0 position, 'n' column_name, 'n - ' || o_custkey AS \"value\", '-' own_op FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'update', 'stock', 1, 's', '''a, ' || o_orderstatus || '''', NULL FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'insert', 'log', 0, 'k', '' || o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'insert', 'log', 1, 'v', '''x,' || o_orderstatus || '''', NULL FROM orders WHERE o_orderkey % 2 = 1")
def _(t: Tables) -> DataFrame:
    p, k, st = F.lit, F.col("o_orderkey"), F.col("o_orderstatus")
    update = F.concat(p("UPDATE stock SET n = n - "), "o_custkey", p(", s = 'a, "), st, p("' WHERE id = "), k)
    insert = F.concat(p("insert into log (k, v) values ("), k, p(", 'x,"), st, p("')"))
    return S.writes(t.orders.select("o_orderkey", F.when(k % 2 == 0, update).otherwise(insert).alias("sql"))).drop("sql")


@query("sql_literals", "SELECT o_orderkey, 'select a from t where b = ? and c = ? and d = ? and e > ?' template, '-' || o_custkey l0, o_orderstatus l1, '0xFF' l2, CAST(o_custkey AS VARCHAR) || '.5' l3 FROM orders")
def _(t: Tables) -> DataFrame:
    p = F.lit
    sql = F.concat(p("select a from t where b = -"), "o_custkey", p(' and c = "'), "o_orderstatus", p('" and d = 0xFF and e > '), "o_custkey", p(".5"))
    out = S.parameterized(t.orders.select("o_orderkey", sql.alias("sql")))
    return out.select("o_orderkey", "template", *[F.get("literals", F.lit(k)).alias(f"l{k}") for k in range(4)])


@query("returns_one_row", "SELECT CAST(o_orderkey % 6 AS INT) kind, count(*) FILTER (WHERE o_orderkey % 6 IN (0, 1, 2)) one_row, count(*) n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    heads = ["select * from o where k = ", "SELECT a from o where b > 3 limit 1 -- ", "select count(*) from o where b = ", "select * from o where b = ", "select * from o, p where k = ", "select b, sum(c) from o group by b -- "]
    kind = (F.col("o_orderkey") % 6).cast("int")
    text = F.trim(F.regexp_replace(F.concat(F.element_at(F.array(*map(F.lit, heads)), kind + 1), "o_orderkey"), " -- .*$", ""))
    return t.orders.select(kind.alias("kind"), S.returns_one_row(text, ["k"]).alias("one")).groupBy("kind").agg(F.count_if("one").alias("one_row"), F.count("*").alias("n"))


@query("anonymize_sql", "SELECT o_orderkey, 'select  aaa from bbb where ccc = ' || o_orderkey || ' and  ddd = ''' || o_orderstatus || ''' and eee between ' || o_custkey || ' and ' || (o_custkey + 9) \"sql\" FROM orders")
def _(t: Tables) -> DataFrame:
    names = {"o_totalprice": "aaa", "orders": "bbb", "o_orderkey": "ccc", "o_orderstatus": "ddd", "o_custkey": "eee"}
    return statements(t).select("o_orderkey", S.renamed(F.col("sql"), names).alias("sql"))


@query("anonymize_schema")
def _(t: Tables) -> DataFrame:
    return S.anonymous_names(P.schema_scan({n: getattr(t, n) for n in RELATIONAL}, KEYS, REFS))


@query("ddl_render")
def _(t: Tables) -> DataFrame:
    return S.rendered_ddl(P.schema_scan({n: getattr(t, n) for n in RELATIONAL}, KEYS, REFS))


@query("ddl_render_anonymous")
def _(t: Tables) -> DataFrame:
    named = S.anonymous_names(P.schema_scan({n: getattr(t, n) for n in RELATIONAL}, KEYS, REFS))
    return S.rendered_ddl(S.with_new_names(named))
