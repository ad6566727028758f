"""Traces and running logs as text. Readers give a DataFrame of lines; parsers take its
column value apart with built-in functions, so both files and streams of lines work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Columns that put the lines of read_lines in the order in which they were written.
LINE_ORDER = ["file_age", "file_path", "block", "line"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place. Of rolled files (name.1, name.2, ...) the one with
    the highest number is the oldest: file_seq is that number, file_age orders by it. block is the
    part of the file that a task reads, and line grows within it."""
    seq = F.regexp_extract(F.col("_metadata.file_path"), r"\.(\d+)$", 1)
    lines = spark.read.text(path).select("value", F.when(seq == "", 0).otherwise(seq.cast("int")).alias("file_seq"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    return lines.select("value", "file_seq", (-F.col("file_seq")).alias("file_age"), "file_path", "block", F.monotonically_increasing_id().alias("line"))


def _group(name: str, line: str = "value") -> Column:
    return F.regexp_extract(line, rf"\[{name}=(.*?)\](?=\[|$)", 1)


def _every(name: str, line: str = "value") -> Column:
    return F.regexp_extract_all(line, F.lit(rf"\[{name}=(.*?)\](?=\[|$)"), F.lit(1))


def _values(text: Column) -> Column:
    """Items between commas, spaces and double quotes around them off; commas inside of quotes
    are part of an item, and two quotes there stand for one."""
    items = F.regexp_extract_all(text, F.lit(r'(?:^|,)\s*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(items, lambda x: F.trim(x))
    return F.transform(plain, lambda x: F.when(x.rlike('^".*"$') & (F.length(x) > 1), F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), '""', '"')).otherwise(F.regexp_replace(x, '^"|"$', "")))


def parse_trace(lines: DataFrame) -> DataFrame:
    """ts_ms, conn_id, sql, batched, params (of all groups, a batch has several) and results
    (a row for each group) of lines [timestamp=..][connId=..][sql=..][para=..]..[res=..]..;
    lines without time or connection go."""
    keep = [c for c in lines.columns if c != "value"]
    out = lines.select(
        *keep,
        F.try_to_number(_group("timestamp"), F.lit("9999999999999999")).cast("long").alias("ts_ms"), F.try_to_number(_group("connId"), F.lit("9999999999999999")).cast("long").alias("conn_id"),
        _group("sql").alias("sql"), F.col("value").contains("[batchpara=").alias("batched"),
        F.flatten(F.transform(_every("(?:batch)?para"), _values)).alias("params"), F.transform(_every("res"), _values).alias("results"),
    )
    return out.where("ts_ms is not null and conn_id is not null")


def parse_numbered(lines: DataFrame) -> DataFrame:
    """parse_trace of an older log in which each line names its transaction, [txnId=..]: tx_id as
    well, so no sessions have to be told; lines without one go."""
    tx = F.try_to_number(_group("txnId"), F.lit("9999999999999999")).cast("long")
    return parse_trace(lines.withColumn("tx_id", tx)).where("tx_id is not null")


def ordered_transactions(df: DataFrame, tx: str, order: list[str]) -> DataFrame:
    """Statements with tx_start, the time of their transaction's first one; ordered by it, then by
    transaction and order, as a trace in memory is read."""
    first = df.groupBy(tx).agg(F.min(order[0]).alias("tx_start"))
    return df.join(first, tx).orderBy("tx_start", tx, *order)


def parse_access_log(lines: DataFrame) -> DataFrame:
    """ts_ms, txn, op_id and params of lines mark; time; transaction; operation; p1, p2; lines
    whose time is no number go."""
    p = F.transform(F.split("value", ";"), lambda x: F.trim(x))
    ts = F.try_to_number(F.get(p, F.lit(1)), F.lit("9999999999999999")).cast("long")
    out = lines.select(ts.alias("ts_ms"), F.get(p, F.lit(2)).alias("txn"), F.get(p, F.lit(3)).cast("int").alias("op_id"), _values(F.get(p, F.lit(4))).alias("params"))
    return out.where("ts_ms is not null")


def parse_general_log(lines: DataFrame, order: list[str]) -> DataFrame:
    """Statements of a general log in which rows of results follow theirs: kind stmt or res,
    conn_id, start_ts and text. A statement with start_ts 0 begins a transaction; results are
    attached to the last statement of their connection."""
    parts = lines.select(*order, F.split("value", "\t").alias("p")).select(*order, F.get("p", F.lit(0)).alias("kind"), F.get("p", F.lit(1)).cast("long").alias("conn_id"), F.get("p", F.lit(2)).cast("long").alias("start_ts"), F.get("p", F.lit(3)).alias("text"))
    w = W.partitionBy("conn_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    stmt = F.col("kind") == "stmt"
    numbered = parts.withColumn("stmt_no", F.sum(stmt.cast("int")).over(w)).withColumn("txn_no", F.sum((stmt & (F.col("start_ts") == 0)).cast("int")).over(w))
    return numbered.groupBy("conn_id", "txn_no", "stmt_no").agg(F.max(F.when(stmt, F.col("text"))).alias("sql"), F.count_if(F.col("kind") == "res").alias("n_results"))


def parse_running_log(lines: DataFrame) -> DataFrame:
    """tx_id, txn, op_id, params and results of lines of fields separated by semicolons:
    mark; id; transaction; operation; p1, p2; r1, r2# r1, r2."""
    p = F.transform(F.split("value", ";"), lambda x: F.trim(x))
    rows = F.split(F.get(p, F.lit(5)), "#")
    return lines.select(
        F.get(p, F.lit(1)).cast("long").alias("tx_id"), F.get(p, F.lit(2)).alias("txn"), F.get(p, F.lit(3)).cast("int").alias("op_id"),
        _values(F.get(p, F.lit(4))).alias("params"), F.filter(F.transform(rows, _values), lambda r: F.get(r, F.lit(0)) != "").alias("results"),
    )


def first_ids(log: DataFrame, n: int = 100_000) -> DataFrame:
    """The rows of the n least transaction ids."""
    ids = log.select("tx_id").distinct().orderBy("tx_id").limit(n)
    return log.join(ids, "tx_id", "left_semi")
