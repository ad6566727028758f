"""Schemas, templates, procedures and settings from text, and sinks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_schema(lines: DataFrame) -> DataFrame:
    """table_name, position, column_name, type, in_key and refers_to of lines
    Table[T; c1 integer; c2 decimal; pk(c1); fk(c2, S, s1)]; what follows ## is a comment."""
    text = F.trim(F.regexp_replace("value", "##.*$", ""))
    body = lines.select(F.regexp_extract(text, r"(?i)^table\[(.*)\]$", 1).alias("b")).where("b <> ''")
    parts = body.select(F.transform(F.split("b", ";"), lambda x: F.trim(x)).alias("p"))
    own = F.filter(F.slice("p", F.lit(2), F.size("p")), lambda x: ~x.rlike(r"(?i)^(pk|fk)\("))
    key = F.flatten(F.transform(F.filter("p", lambda x: x.rlike(r"(?i)^pk\(")), lambda x: F.split(F.regexp_extract(x, r"\((.*)\)", 1), r"\s*,\s*")))
    refs = F.transform(F.filter("p", lambda x: x.rlike(r"(?i)^fk\(")), lambda x: F.split(F.regexp_extract(x, r"\((.*)\)", 1), r"\s*,\s*"))
    rows = parts.select(F.get("p", F.lit(0)).alias("table_name"), key.alias("key"), refs.alias("refs"), F.posexplode(own).alias("position", "c"))
    name = F.get(F.split("c", r"\s+"), F.lit(0))
    mine = F.filter("refs", lambda r: F.array_contains(F.split(r[0], "#"), name))
    return rows.select("table_name", "position", name.alias("column_name"), F.lower(F.get(F.split("c", r"\s+"), F.lit(1))).alias("type"), F.array_contains("key", name).alias("in_key"), F.get(F.get(mine, F.lit(0)), F.lit(1)).alias("refers_to"))


def parse_templates(lines: DataFrame, order: list[str], file: str | None = None) -> DataFrame:
    """txn, ratio (null if open), prepared, op_id, block (plain, multiple or branch), batch,
    branch_no and sql of the statements of templates TX[name, ratio, prepared] ... endtx. lines:
    value and the order columns; file is the column that tells template files apart, each of
    which is one task's work."""
    own = [file] if file else []
    w = W.partitionBy(*own).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    t = F.lower(F.trim("value"))
    is_tx = t.startswith("tx[")
    parts = F.transform(F.split(F.regexp_extract("value", r"\[(.*)\]", 1), ","), lambda x: F.trim(x))
    head = F.struct(F.get(parts, F.lit(0)).alias("name"), F.try_to_number(F.get(parts, F.lit(1)), F.lit("999.999999")).cast("double").alias("ratio"), (F.lower(F.get(parts, F.lit(2))) == "true").alias("prepared"))
    marked = lines.where("trim(value) <> ''").withColumn("tx_no", F.sum(is_tx.cast("int")).over(run)).withColumn("head", F.last(F.when(is_tx, head), True).over(run))
    per = W.partitionBy(*own, "tx_no").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    depth = lambda a, b: F.sum(F.when(t.startswith(a), 1).when(t == b, -1).otherwise(0)).over(per)
    d = marked.withColumn("m", depth("multiple", "endmultiple")).withColumn("b", depth("branch", "endbranch")).withColumn("branch_no", F.sum((t == "separator").cast("int")).over(per))
    d = d.withColumn("batch", F.last(F.when(t.startswith("multiple"), t.rlike(r"\bbatch\b")), True).over(per))
    stmts = d.where(t.rlike(r"^(select|insert|update|delete|replace|call)\b"))
    op = F.row_number().over(W.partitionBy(*own, "tx_no").orderBy(*order))
    block = F.when(F.col("m") > 0, "multiple").when(F.col("b") > 0, "branch").otherwise("plain")
    batch = (F.col("m") > 0) & F.coalesce("batch", F.lit(False))
    return stmts.select(F.col("head.name").alias("txn"), F.col("head.ratio").alias("ratio"), F.coalesce("head.prepared", F.lit(False)).alias("prepared"), op.alias("op_id"), block.alias("block"), batch.alias("batch"), F.when(F.col("b") > 0, F.col("branch_no")).otherwise(0).alias("branch_no"), F.trim("value").alias("sql"))


def parse_procedures(lines: DataFrame) -> DataFrame:
    """proc, position, table_name and column_name of lines proc(p1: t.c, p2: t.c)."""
    args = F.split(F.regexp_extract("value", r"\((.*)\)", 1), r"\s*,\s*")
    rows = lines.select(F.regexp_extract("value", r"^\s*(\w+)\s*\(", 1).alias("proc"), F.posexplode(args).alias("position", "a")).where("proc <> ''")
    return rows.select("proc", "position", F.regexp_extract("a", r":\s*(\w+)\.", 1).alias("table_name"), F.regexp_extract("a", r"\.(\w+)", 1).alias("column_name"))


@dataclass
class Settings:
    """Settings with their defaults; read_settings takes key=value lines. What each steers is the
    parameter of that meaning in the operators: plans.workflow hands them over."""

    window_seconds: int = 1
    window_delay: str = "1 day"
    top_values: int = 10
    buckets: int = 15
    quantiles: int = 5
    lookback: int = 3
    candidates: int = 20
    sample_size: int = 1_000
    partitions: int = 4
    least_probability: float = 0.01
    strong_probability: float = 0.7
    linear_slack: float = 1e-9
    instance_cap: int = 10_000
    log_ids: int = 100_000
    scale_factor: float = 1.0
    scale_jitter: float = 0.02
    fake_columns: int = 0
    files_per_trigger: int = 100
    rollback: bool = True


def read_settings(text: str) -> Settings:
    """Lines key=value; # begins a comment, unknown keys are left out, true and false are words."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    pairs = (line.split("#")[0].partition("=") for line in text.splitlines())
    value = lambda k, v: v.lower() == "true" if kinds[k] is bool else kinds[k](v)
    return Settings(**{k.strip(): value(k.strip(), v.strip()) for k, eq, v in pairs if eq and k.strip() in kinds})


def write_snapshot(parts: dict[str, DataFrame], path: str) -> None:
    """Named results (profile, logic, distributions, names) as Parquet, a folder each."""
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_rows(df: DataFrame, path: str) -> None:
    """Rows as comma-separated files with a mark for null and quotes where needed."""
    df.write.csv(path, header=True, nullValue="\\N", quoteAll=False, escape='"', emptyValue='""')


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, nullValue="\\N", escape='"', emptyValue="")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of MySQL, TiDB, PostgreSQL or Oracle, read in ranges of an integer key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()
