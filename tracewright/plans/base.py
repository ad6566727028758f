"""Tables, trace views and registration of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Orders and their lines in a task of the order trace.
ROWS_A_TASK = 400_000


class Tables:
    """The tables of a folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def by_order(self) -> tuple[DataFrame, DataFrame]:
        """orders and lineitem dealt alike by the order's key, in parts of so many rows that a
        task's share doesn't grow with the tables. What is grouped by transaction further on finds
        its rows together and needs no shuffle. The counts come from the files' footers."""
        o, li = self.orders, self.lineitem
        n = max(self.spark.sparkContext.defaultParallelism, -(-(o.count() + li.count()) // ROWS_A_TASK))
        return o.repartition(n, "o_orderkey"), li.repartition(n, "l_orderkey")


def query(name: str, sql: str | None = None):
    """Register a function of Tables, with the SQL that gives the same rows."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return put


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_PARAMS = ["o_orderkey", "o_custkey"]
LINE_PARAMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def numbered_lines(t: Tables) -> DataFrame:
    """Lines of an order as the rounds of a loop, numbered from 1."""
    return t.by_order[1].withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def order_params(t: Tables) -> DataFrame:
    """Orders as transactions: operation 1 is the order, operation 2 the loop of its lines.
    tx_id, op, rn, idx, type and v of each statement parameter."""

    def long(df: DataFrame, tx: str, op: int, rn, names: list[str]) -> DataFrame:
        items = F.array(*[F.col(n).cast("long") for n in names])
        return df.select(F.col(tx).alias("tx_id"), F.lit(op).alias("op"), rn.cast("int").alias("rn"), F.lit(0).alias("type"), F.posexplode(items).alias("idx", "v"))

    return long(t.by_order[0], "o_orderkey", 1, F.lit(1), ORDER_PARAMS).unionByName(long(numbered_lines(t), "l_orderkey", 2, F.col("rn"), LINE_PARAMS))


def _long_sql(source: str, tx: str, op: int, rn: str, names: list[str]) -> list[str]:
    return [f"SELECT {tx} tx_id, {op} op, CAST({rn} AS INT) rn, 0 type, {k} idx, CAST({n} AS BIGINT) v FROM {source}" for k, n in enumerate(names)]


#: The same as CTEs l (numbered lines) and p (parameters).
P_SQL = (
    f"l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) rn FROM lineitem), p AS ("
    + " UNION ALL ".join(_long_sql("orders", "o_orderkey", 1, "1", ORDER_PARAMS) + _long_sql("l", "l_orderkey", 2, "rn", LINE_PARAMS))
    + ")"
)

DAY_US = 86_400_000_000


def windowed_events(t: Tables) -> DataFrame:
    """events with w, the number of the day-long window (from 1, right-closed, from the first event)."""
    from tracewright.operators.windows import tumbling

    return tumbling(t.events, "ts", DAY_US)


E_SQL = (
    "t0 AS (SELECT min(ts) m FROM events), "
    f"e AS (SELECT events.*, CAST(greatest(ceil((epoch_us(ts) - epoch_us(m)) / {DAY_US}.0), 1) AS BIGINT) w FROM events, t0)"
)
