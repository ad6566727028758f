"""Text of statements: normal form, literals, predicates, names. Spark itself parses and
runs SQL; these take the text of traced statements apart with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Strings in single or double quotes, hex and decimal numbers, a sign if nothing is before it to
#: take it from.
LITERAL = r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|\b0[xX][0-9a-fA-F]+\b|(?:(?<=[=<>(,+*/%] {0,8})-)?\b\d+(?:\.\d+)?\b"""


def normalized(sql: Column) -> Column:
    return F.regexp_replace(F.trim(sql), r"\s+", " ")


def without_between(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?i)(\S+) between (\S+) and (\S+)", "$1 >= $2 and $1 <= $3")


def parameterized(df: DataFrame, sql: str = "sql") -> DataFrame:
    """template (literals as ?) and literals (in order, quotes off)."""
    found = F.transform(F.regexp_extract_all(sql, F.lit(LITERAL), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^'|'$", ""), '^"|"$', ""))
    return df.withColumn("literals", found).withColumn("template", F.regexp_replace(sql, LITERAL, "?"))


def writes(df: DataFrame, sql: str = "sql") -> DataFrame:
    """A row for each column that an INSERT, REPLACE or UPDATE writes: the other columns of df,
    verb, table_name, column_name and value (its expression), own_op (the operator by which an
    update works the column's old value over, null if it doesn't) and position."""
    text = normalized(F.col(sql))
    v = verb(text)
    into = F.split(F.regexp_extract(text, r"(?i)\binto \w+ ?\(([^)]*)\)", 1), r"\s*,\s*")
    values = F.regexp_extract_all(F.regexp_extract(text, r"(?i)\bvalues ?\((.*)\)", 1), F.lit(r"""(?:^|,)\s*('(?:[^']|'')*'|[^,]*)"""), F.lit(1))
    put = F.zip_with(into, values, lambda c, x: F.struct(F.trim(c).alias("c"), F.trim(x).alias("x")))
    sets = F.regexp_extract_all(F.regexp_extract(text, r"(?i)\bset (.*?)(?: where |$)", 1), F.lit(r"""(?:^|,)\s*(\w+\s*=\s*(?:'(?:[^']|'')*'|[^,'])*)"""), F.lit(1))
    set_ = F.transform(sets, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("c"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("x")))
    table = F.regexp_extract(text, r"(?i)^(?:insert into|replace into|update) (\w+)", 1)
    rows = df.select("*", v.alias("verb"), table.alias("table_name"), F.posexplode(F.when(v == "update", set_).when(v.isin("insert", "replace"), put)).alias("position", "__w"))
    own = F.regexp_extract("__w.x", r"^(\w+)\s*([-+*/%])", 2)
    mine = F.regexp_extract("__w.x", r"^(\w+)\s*[-+*/%]", 1) == F.col("__w.c")
    return rows.withColumns({"column_name": F.col("__w.c"), "value": F.col("__w.x"), "own_op": F.when(mine, own)}).drop("__w")


def verb(sql: Column) -> Column:
    return F.lower(F.regexp_extract(sql, r"^\s*(\w+)", 1))


def predicates(df: DataFrame, sql: str = "sql") -> DataFrame:
    """A row for each comparison of the where clause: column_name and op."""
    where = F.regexp_extract(sql, r"(?i)\bwhere\b(.*?)(?:\border by\b|\bgroup by\b|\blimit\b|$)", 1)
    parts = F.split(where, r"(?i)\s+and\s+")
    return df.select(F.explode(parts).alias("p")).select(F.regexp_extract("p", r"(\w+)\s*(<=|>=|<>|!=|=|<|>)", 1).alias("column_name"), F.regexp_extract("p", r"(<=|>=|<>|!=|=|<|>)", 1).alias("op")).where("op <> ''")


def single_row(used: Column, key: list[str]) -> Column:
    """Whether the compared columns cover the key."""
    return F.size(F.array_except(F.array(*map(F.lit, key)), used)) == 0


def returns_one_row(sql: Column, key: list[str]) -> Column:
    """Whether a SELECT gives one row at most: LIMIT 1, an aggregate without groups, or equality
    of all key columns in a read of one table."""
    text = F.lower(normalized(sql))
    source = F.regexp_extract(text, r"\bfrom (.*?)(?: where | group by | order by | limit |$)", 1)
    one_table = ~source.rlike(r",|\bjoin\b")
    where = F.regexp_extract(text, r"\bwhere (.*?)(?: group by | order by | limit |$)", 1)
    used = F.regexp_extract_all(where, F.lit(r"(\w+) ?= ?"), F.lit(1))
    aggregate = text.rlike(r"^select (?:count|sum|avg|min|max) ?\(") & ~text.contains(" group by ")
    return text.startswith("select") & (text.rlike(r" limit 1$") | aggregate | one_table & single_row(used, key) & ~where.rlike(r"\bor\b"))


def text_to_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a timestamp's text; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(text))


def distribution_kind(category: Column, is_key: Column, kind: Column) -> Column:
    """0 continuous, 1 integer, 2 varchar; sequential 3 key, 4 integer, 5 varchar; else null."""
    alone = F.when(kind.isin(1, 2, 3) | (kind == 0) & is_key, 0).when(kind == 0, 1).when(kind == 4, 2)
    following = F.when((kind == 0) & is_key, 3).when(kind.isin(1, 2, 3), 0).when(kind == 0, 4).when(kind == 4, 5)
    return F.when(category == 1, alone).when(category == 2, following)


def star_expanded(items: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Select items (the other columns, table_name and item) by position, with * and t.* as the
    table's columns, and type from hints expr##type (null without)."""
    columns = items.sparkSession.createDataFrame([(t, k, c) for t, df in tables.items() for k, c in enumerate(df.columns)], "table_name string, position int, column_name string")
    other = [c for c in items.columns if c not in ("table_name", "item")]
    star = F.col("item").rlike(r"^(\w+\.)?\*$")
    of = F.when(F.col("item") == "*", F.col("table_name")).otherwise(F.regexp_extract("item", r"^(\w+)\.", 1))
    wide = items.where(star).withColumn("table_name", of).join(columns, "table_name").select(*other, "table_name", "position", "column_name", F.lit(None).cast("string").alias("type"))
    plain = items.where(~star).select(*other, "table_name", F.lit(0), F.substring_index("item", "##", 1), F.when(F.col("item").contains("##"), F.substring_index("item", "##", -1)))
    return wide.union(plain)


def partition_ddl(df: DataFrame) -> DataFrame:
    """rule, key and params of PARTITION BY clauses; several params joined by commas."""
    rule = F.upper(F.regexp_extract("ddl", r"(?i)partition by (hash|range|list)", 1))
    key = F.regexp_extract("ddl", r"(?i)partition by \w+ ?\(`?(\w+)`?\)", 1)
    n = F.regexp_extract("ddl", r"(?i)partitions (\d+)", 1)
    bounds = F.array_join(F.regexp_extract_all("ddl", F.lit(r"(?i)(?:less than|in) ?\(([^)]*)\)"), F.lit(1)), ",")
    return df.select("table_name", rule.alias("rule"), key.alias("key"), F.when(rule == "HASH", n).otherwise(bounds).alias("params"))


def renamed(sql: Column, names: dict[str, str]) -> Column:
    """Identifiers replaced by a map; everything between them stays."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    words, between = F.split(sql, r"\W+", -1), F.split(sql, r"\w+", -1)
    new = F.transform(words, lambda w: F.coalesce(F.element_at(known, F.lower(w)), w))
    # a text that begins with a word begins with an empty gap
    return F.array_join(F.zip_with(between, new, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))), "")


def anonymous_names(schema: DataFrame, seed: int = 7) -> DataFrame:
    """new_table (A-Z) and new_column (a-z) for each column of a schema: names of the same
    length (at least three), each once, dealt in an order shuffled by the seed."""

    def letters(number: Column, size: Column, first: int) -> Column:
        digit = lambda i: F.char(F.pmod(F.floor(number / F.pow(F.lit(26.0), i.cast("double"))).cast("long"), F.lit(26)).cast("int") + first)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(3)) - 1), digit), "")

    def dealt(names: DataFrame, name: str, first: int) -> DataFrame:
        place = F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), F.col(name)), name))
        return names.select(name, letters(place, F.length(name), first).alias(f"new_{name.split('_')[0]}"))

    tables = dealt(schema.select("table_name").distinct(), "table_name", 65)
    columns = dealt(schema.select("column_name").distinct(), "column_name", 97)
    out = schema.join(tables, "table_name").join(columns, "column_name")
    if "parent_table" not in schema.columns:
        return out
    parents = tables.select(F.col("table_name").alias("parent_table"), F.col("new_table").alias("new_parent_table"))
    keys = columns.select(F.col("column_name").alias("parent_column"), F.col("new_column").alias("new_parent_column"))
    return out.join(parents, "parent_table", "left").join(keys, "parent_column", "left")


def with_new_names(named: DataFrame) -> DataFrame:
    """The schema of anonymous_names under its new names, to be rendered in their place."""
    new = {"table_name": "new_table", "column_name": "new_column", "parent_table": "new_parent_table", "parent_column": "new_parent_column"}
    return named.select(*[F.col(new.get(c, c)).alias(c) for c in named.columns if not c.startswith("new_")])


def rendered_ddl(schema: DataFrame) -> DataFrame:
    """A CREATE TABLE statement for each table of a scanned schema, with its primary key, and the
    statements that add its foreign keys and their indexes once rows are loaded (null if it has
    none)."""
    item = F.concat_ws(" ", "column_name", F.upper("native_type"))
    refs = [F.col(c) if c in schema.columns else F.lit(None).cast("string") for c in ("parent_table", "parent_column")]
    row = F.struct("position", item.alias("item"), "column_name", "in_key", refs[0].alias("pt"), refs[1].alias("pc"))
    rows = schema.groupBy("table_name").agg(F.array_sort(F.collect_list(row)).alias("c"))
    key = F.array_join(F.transform(F.filter("c", lambda x: x["in_key"]), lambda x: x["column_name"]), ", ")
    body = F.array_join(F.transform("c", lambda x: x["item"]), ", ")
    tail = F.when(key != "", F.concat(F.lit(", PRIMARY KEY ("), key, F.lit(")"))).otherwise("")
    t = F.col("table_name")
    foreign = F.transform(F.filter("c", lambda x: x["pt"].isNotNull()), lambda x: F.concat(
        F.lit("CREATE INDEX "), t, F.lit("_"), x["column_name"], F.lit(" ON "), t, F.lit(" ("), x["column_name"], F.lit("); ALTER TABLE "), t, F.lit(" ADD FOREIGN KEY ("), x["column_name"], F.lit(") REFERENCES "), x["pt"], F.lit(" ("), x["pc"], F.lit(")")))
    later = F.when(F.size(foreign) > 0, F.array_join(foreign, "; "))
    return rows.select("table_name", F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" ("), body, tail, F.lit(")")).alias("ddl"), later.alias("ddl_after_load"))
