"""Sources, sinks and streams over text and files made of the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tracewright.operators.windows import micros
from tracewright.plans.base import DAY_US, E_SQL, Tables, query, windowed_events
from tracewright.sources import texts, traces
from tracewright.streaming import trace as stream


def _folder(t: Tables, name: str) -> str:
    """A new path in the shared folder that the cluster names; only a local session, as in tests,
    may leave it out and gets a folder of its own."""
    root = t.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = t.spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _trace_lines(t: Tables) -> DataFrame:
    value = F.format_string('[timestamp=%d][connId=%d][sql=select v from e where id = ?][para=%d, "%s"][res=%d,%s][res=0,x]', F.floor(micros("ts") / 1000), "user_id", "event_id", "event_type", F.col("event_id") % 7, "event_type")
    return t.events.select(value.alias("value"))


@query("trace_parse", "SELECT epoch_us(ts) // 1000 ts_ms, user_id conn_id, 'select v from e where id = ?' \"sql\", CAST(event_id AS VARCHAR) p0, event_type p1, 2 n_results, CAST(event_id % 7 AS VARCHAR) r0 FROM events")
def _(t: Tables) -> DataFrame:
    p = traces.parse_trace(_trace_lines(t))
    return p.select("ts_ms", "conn_id", "sql", F.get("params", F.lit(0)).alias("p0"), F.get("params", F.lit(1)).alias("p1"), F.size("results").alias("n_results"), F.get(F.get("results", F.lit(0)), F.lit(0)).alias("r0"))


@query("trace_parse_general", "WITH s AS (SELECT user_id conn_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) stmt_no, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) txn_no FROM events) SELECT conn_id, CAST(txn_no AS BIGINT) txn_no, stmt_no, event_type \"sql\", event_id % 4 n_results FROM s")
def _(t: Tables) -> DataFrame:
    kinds = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int"))).alias("k")
    e = t.events.select("event_id", "user_id", "event_type", kinds)
    value = F.concat_ws("\t", F.when(F.col("k") == 0, "stmt").otherwise("res"), "user_id", (F.col("event_id") % 3).cast("string"), "event_type")
    return traces.parse_general_log(e.select("event_id", "k", value.alias("value")), ["event_id", "k"])


@query("running_log_parse", "SELECT l_orderkey tx_id, 'order' txn, 2 op_id, 3 n_params, CAST(l_partkey AS VARCHAR) p1, l_linenumber % 3 n_results FROM lineitem")
def _(t: Tables) -> DataFrame:
    res = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.when(i <= F.col("l_linenumber") % 3, F.lit("1, 2")).otherwise("")), "# ")
    value = F.concat(F.lit("log; "), "l_orderkey", F.lit("; order; 2; "), "l_orderkey", F.lit(", "), "l_partkey", F.lit(", "), "l_suppkey", F.lit("; "), res)
    p = traces.parse_running_log(t.lineitem.select(value.alias("value")))
    return p.select("tx_id", "txn", "op_id", F.size("params").alias("n_params"), F.get("params", F.lit(1)).alias("p1"), F.size("results").alias("n_results"))


@query("running_log_first", "SELECT l_orderkey tx_id, count(*) n FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 500) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The report that keeps the first ids only, of a log of all lines."""
    value = F.concat(F.lit("log; "), "l_orderkey", F.lit("; order; 2; "), "l_partkey", F.lit("; "))
    return traces.first_ids(traces.parse_running_log(t.lineitem.select(value.alias("value"))), 500).groupBy("tx_id").agg(F.count("*").alias("n"))


@query("access_log_parse", "SELECT epoch_us(ts) // 1000 ts_ms, event_type txn, CAST(event_id % 5 AS INT) op_id, 'a,' || user_id p0, CAST(event_id AS VARCHAR) p1 FROM events")
def _(t: Tables) -> DataFrame:
    value = F.concat(F.lit("log; "), F.floor(micros("ts") / 1000), F.lit("; "), "event_type", F.lit("; "), F.col("event_id") % 5, F.lit('; "a,'), "user_id", F.lit('", '), "event_id")
    p = traces.parse_access_log(t.events.select(value.alias("value")))
    return p.select("ts_ms", "txn", "op_id", F.get("params", F.lit(0)).alias("p0"), F.get("params", F.lit(1)).alias("p1"))


@query("trace_parse_numbered", "SELECT user_id * 10 + event_id % 3 tx_id, epoch_us(ts) // 1000 ts_ms, event_type p0, min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id * 10 + event_id % 3) tx_start FROM events")
def _(t: Tables) -> DataFrame:
    tx = F.col("user_id") * 10 + F.col("event_id") % 3
    value = F.format_string("[timestamp=%d][connId=%d][txnId=%d][sql=select v from e where t = ?][para=%s]", F.floor(micros("ts") / 1000), "user_id", tx, "event_type")
    p = traces.parse_numbered(t.events.select(value.alias("value"))).select("tx_id", "ts_ms", F.get("params", F.lit(0)).alias("p0"))
    return traces.ordered_transactions(p, "tx_id", ["ts_ms", "p0"])


@query("schema_text", "SELECT 'T' || p_partkey table_name, k position, ['k', 'r', p_brand][k + 1] column_name, ['integer', 'integer', 'varchar'][k + 1] type, k = 0 in_key, CASE WHEN k = 1 THEN 'region' END refers_to FROM part, (SELECT unnest([0, 1, 2]) k)")
def _(t: Tables) -> DataFrame:
    value = F.concat(F.lit("Table[T"), "p_partkey", F.lit("; k integer; r integer; "), "p_brand", F.lit(" varchar; pk(k); fk(r, region, r_regionkey)] ## of part "), "p_partkey")
    return texts.parse_schema(t.part.select(value.alias("value")))


@query("template_text", "SELECT 'tx' || p_partkey txn, p_size / 100.0 ratio, p_size % 2 = 0 prepared, CAST(op AS INT) op_id, b AS \"block\", b = 'multiple' AND p_size % 3 = 0 batch, CAST(CASE WHEN op = 4 THEN 1 ELSE 0 END AS BIGINT) branch_no, x AS \"sql\" FROM part, (VALUES (1, 'plain', 'select a from t where k = ?'), (2, 'multiple', 'insert into u values (?)'), (3, 'branch', 'update t set a = ?'), (4, 'branch', 'delete from t where k = ?')) v(op, b, x)")
def _(t: Tables) -> DataFrame:
    p = F.lit
    parts = [p("select a from t where k = ?"), F.when(F.col("p_size") % 3 == 0, "multiple [batch]").otherwise("multiple"), p("insert into u values (?)"), p("endmultiple"), p("branch"), p("update t set a = ?"), p("separator"), p("delete from t where k = ?"), p("endbranch"), p("endtx")]
    head = F.concat(p("TX[tx"), "p_partkey", p(", "), F.format_number(F.col("p_size") / 100, 2), p(", "), (F.col("p_size") % 2 == 0).cast("string"), p("]"))
    lines = t.part.select("p_partkey", F.posexplode(F.array(head, *parts)).alias("k", "value"))
    return texts.parse_templates(lines, ["p_partkey", "k"], "p_partkey").withColumn("branch_no", F.col("branch_no").cast("long"))


@query("proc_params", "SELECT 'p' || s_suppkey proc, k position, ['supplier', 'nation'][k + 1] table_name, ['s_suppkey', 'k' || s_nationkey][k + 1] column_name FROM supplier, (SELECT unnest([0, 1]) k)")
def _(t: Tables) -> DataFrame:
    value = F.concat(F.lit("p"), "s_suppkey", F.lit("(a: supplier.s_suppkey, b: nation.k"), "s_nationkey", F.lit(")"))
    return texts.parse_procedures(t.supplier.select(value.alias("value")))


@query("snapshot_roundtrip", "SELECT p_brand, count(*) n, CAST(sum(p_size) AS BIGINT) size FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    df = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
    df.write.parquet(path := _folder(t, "snapshot"))
    return t.spark.read.schema(df.schema).parquet(path)


@query("csv_roundtrip", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size END size FROM part")
def _(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    texts.write_rows(df, path := _folder(t, "rows"))
    return texts.read_rows(t.spark, path, df.schema)


def _drained(t: Tables, df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives over all files there are, written as Parquet. In update mode the last
    row of each of the keys counts."""
    path = _folder(t, "streamed")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is tried again overwrites its own folder
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/n={number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", _folder(t, "stream")).trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.schema(StructType([*df.schema.fields, StructField("__batch", IntegerType())])).parquet(f"{path}/n=*")
    if not keys:
        return out.drop("__batch")
    values = [c for c in df.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("v")).select(*keys, "v.*")


def _event_files(t: Tables, files: int | None = None) -> DataFrame:
    """The events as a stream of files, so many of them at a time."""
    windowed_events(t).repartition(8, "event_id").write.parquet(path := _folder(t, "events"))
    reader = t.spark.readStream.schema(t.spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


@query("stream_trace_window", f"WITH {E_SQL} SELECT w, event_type, count(*) n FROM e GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    start = t.events.agg(F.min(micros("ts"))).first()[0] or 0
    counts = stream.window_counts(_event_files(t, 3).drop("w"), "ts", DAY_US // 1_000_000, start, "event_type", delay="60 days")
    return _drained(t, counts, "update", ["w", "event_type"])


@query("stream_monitor", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 start_s, count(*) FILTER (WHERE event_type <> 'error') succeeded, count(*) FILTER (WHERE event_type = 'error') failed, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) avg_latency FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    m = stream.monitor(_event_files(t, 3), "ts", 86_400, F.col("event_type") == "error", "value", "60 days")
    m = m.select(F.unix_seconds(F.col("window.start")).alias("start_s"), "succeeded", "failed", "avg_latency")
    return _drained(t, m, "update", ["start_s"]).withColumn("avg_latency", F.round("avg_latency", 6))


@query("late_policy")
def _(t: Tables) -> DataFrame:
    start = t.events.agg(F.min(micros("ts"))).first()[0] or 0
    return _drained(t, stream.late_windows(_event_files(t), "ts", DAY_US // 1_000_000, start, "event_type"), "append")


@query("stateful_lookback", f"WITH {E_SQL}, d AS (SELECT event_type, w, user_id v, row_number() OVER (PARTITION BY event_type, w, user_id) r FROM e), f AS (SELECT *, w - lag(w) OVER (PARTITION BY event_type, v ORDER BY w) gap FROM d WHERE r = 1) SELECT event_type \"key\", w, count(*) n, count(*) FILTER (WHERE gap <= 3) again FROM f GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    out = _drained(t, stream.lookback(_event_files(t), "w", "user_id", "event_type", 3), "append")
    one = out.groupBy("key", "w", "v").agg(F.bool_or("again").alias("again"))
    return one.groupBy("key", "w").agg(F.count("*").alias("n"), F.count_if("again").alias("again"))
