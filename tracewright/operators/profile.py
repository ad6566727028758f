"""Column, table and key profiles, each from one aggregation over one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n_rows."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _stacked(df: DataFrame, columns: list[str], stats: dict) -> DataFrame:
    """One aggregation of all statistics of all columns, then a row for each column."""
    wide = df.agg(*[f(F.col(c)).alias(f"{c}__{s}") for c in columns for s, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def _value_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """column_name, k (the value as text, null for nulls), v (its measure) and n (rows): one row
    for each column and value, counted in tasks first, so rows aren't copied for each column
    through the shuffle."""
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("k"), m.alias("v")) for c, m in columns.items()])
    return df.select(F.explode(items).alias("i")).groupBy("i.column_name", "i.k").agg(F.first("i.v").alias("v"), F.count("*").alias("n"))


def _number(df: DataFrame, c: str) -> Column:
    """A column as a double; dates and timestamps as milliseconds since 1970."""
    kind = df.schema[c].dataType.simpleString()
    if kind == "date":
        return F.unix_date(c).cast("double") * 86_400_000
    return F.unix_millis(F.col(c).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.col(c).cast("double")


def numeric_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """null_ratio, ndv, min_value and max_value (as doubles, milliseconds for dates and times) of
    each column; approximate counts distinct values by a sketch instead of a shuffle of them."""
    if approximate:
        wide = df.select(*[_number(df, c).alias(c) for c in columns])
        return _stacked(wide, columns, {"null_ratio": lambda c: F.avg(c.isNull().cast("double")), "ndv": F.approx_count_distinct, "min_value": F.min, "max_value": F.max})
    counts = _value_counts(df, {c: _number(df, c) for c in columns})
    nulls = F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)) / F.sum("n")
    return counts.groupBy("column_name").agg(nulls.alias("null_ratio"), F.count("k").alias("ndv"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))


def string_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """null_ratio, ndv, avg_len and max_len (in characters) of each column."""
    counts = _value_counts(df, {c: F.length(c).cast("long") for c in columns})
    full = F.col("k").isNotNull()
    nulls = F.sum(F.when(full, 0).otherwise(F.col("n"))) / F.sum("n")
    length = F.sum(F.col("v") * F.col("n")) / F.sum(F.when(full, F.col("n")))
    return counts.groupBy("column_name").agg(nulls.alias("null_ratio"), F.count("k").alias("ndv"), length.alias("avg_len"), F.max("v").alias("max_len"))


def boolean_profile(df: DataFrame, columns: dict) -> DataFrame:
    """true_ratio over the values that aren't null, of named conditions."""
    wide = df.select(*[e.alias(n) for n, e in columns.items()])
    return _stacked(wide, list(columns), {"true_ratio": lambda c: F.count_if(c) / F.count(c)})


def derived_profile(numbers: DataFrame) -> DataFrame:
    """coefficient: the step between values of a column if they were evenly spaced."""
    return numbers.select("column_name", F.when(F.col("ndv") > 1, (F.col("max_value") - F.col("min_value")) / (F.col("ndv") - 1)).otherwise(0.0).alias("coefficient"))


def derived_lengths(strings: DataFrame) -> DataFrame:
    """Bounds for generated lengths with the profile's mean: [0, 2 avg] if the mean is below
    half the largest, else [2 avg - max, max]."""
    low = F.col("max_len") / 2 > F.col("avg_len")
    return strings.select(
        "column_name",
        F.when(low, 0.0).otherwise(2 * F.col("avg_len") - F.col("max_len")).alias("min_length"),
        F.when(low, 2 * F.col("avg_len")).otherwise(F.col("max_len").cast("double")).alias("max_length"),
    )


def reference_scale(child: DataFrame, parent: DataFrame) -> DataFrame:
    """How many child rows there are to a parent row."""
    return child.agg(F.count("*").alias("c")).crossJoin(parent.agg(F.count("*").alias("p"))).select((F.col("c") / F.col("p")).alias("scale"))


def jittered(scale: Column, key: Column, ratio: float = 0.02, stream: int = 0) -> Column:
    """A scale moved by up to ratio of itself either way, the same for the same key."""
    from tracewright.functions.exprs import lcg

    return scale * (1 + (2 * lcg(key, stream) - 1) * ratio)


def schema_scan(tables: dict[str, DataFrame], keys: dict[str, list[str]], refs: dict[str, dict[str, tuple[str, str]]] | None = None) -> DataFrame:
    """table_name, position, column_name, native and logical type, whether it is part of the
    declared primary key, and the table and column it refers to (null if none), in column order.
    refs: of each table, its referring columns."""
    from tracewright.functions.exprs import logical_type

    spark, refs = next(iter(tables.values())).sparkSession, refs or {}
    rows = [(t, k, f.name, f.dataType.simpleString(), f.name in keys.get(t, []), *refs.get(t, {}).get(f.name, (None, None))) for t, df in tables.items() for k, f in enumerate(df.schema.fields)]
    schema = "table_name string, position int, column_name string, native_type string, in_key boolean, parent_table string, parent_column string"
    return spark.createDataFrame(rows, schema).withColumn("logical_type", logical_type(F.col("native_type")))


def broken_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """n_rows of child, n_null without a value and n_broken whose value no row of parent has."""
    rows = child.groupBy(F.col(column).alias("__k")).agg(F.count("*").alias("n"))
    there = parent.select(F.col(key).alias("__k"), F.lit(True).alias("__p")).distinct()
    counted = rows.join(there, "__k", "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counted.agg(total(F.lit(True)).alias("n_rows"), total(F.col("__k").isNull()).alias("n_null"), total(F.col("__k").isNotNull() & F.col("__p").isNull()).alias("n_broken"))


def topological_levels(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_name, level): 0 for tables that refer to none, else one more than the
    deepest table referred to. Tables on a cycle get none. edges: child, parent. Planning over
    a schema, whose tables are few."""
    parents: dict[str, set[str]] = {r.table_name: set() for r in names.collect()}
    for r in edges.collect():
        parents.setdefault(r.child, set()).add(r.parent)
    level: dict[str, int] = {}
    while ready := [t for t, up in parents.items() if t not in level and up <= level.keys()]:
        level |= {t: max((level[x] + 1 for x in parents[t]), default=0) for t in ready}
    return names.sparkSession.createDataFrame(list(level.items()), "table_name string, level int")
