"""From single statements to sessions, templates and shapes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionized(df: DataFrame, conn: str, order: list[str], ends: Column) -> DataFrame:
    """session: number, from 0 for each connection, of the transaction a statement is in.
    A statement for which ends is true closes its transaction."""
    w = W.partitionBy(conn).orderBy(*order)
    before = F.lag(ends.cast("int"), 1, 0).over(w)
    return df.withColumn("__b", before).withColumn("session", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def session_ends(df: DataFrame, conn: str, order: list[str], last: str) -> DataFrame:
    """n_ops and the last statement's kind of each session."""
    return df.groupBy(conn, "session").agg(F.count("*").alias("n_ops"), F.max_by(last, F.struct(*order)).alias("last_op"))


def template_ops(df: DataFrame, keys: list[str], sql: str, order: list[str]) -> DataFrame:
    """op_id: dense number, from 1, of each distinct statement text of a transaction in the
    order in which it is first seen."""
    first = df.groupBy(*keys, sql).agg(F.min(F.struct(*order)).alias("__f"), F.count("*").alias("runs"))
    return first.withColumn("op_id", F.row_number().over(W.partitionBy(*keys).orderBy("__f"))).drop("__f")


def templates(df: DataFrame, keys: list[str], sql: str, order: list[str]) -> DataFrame:
    """Each distinct ordered list of statement texts with its instances, numbered by the
    instances' first key."""
    lists = df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, sql))), lambda x: x[sql]), ";").alias("template"))
    return lists.groupBy("template").agg(F.count("*").alias("instances"), F.min(F.struct(*keys)).alias("__f")).withColumn("n_ops", F.size(F.split("template", ";"))).drop("__f")


def op_shapes(instances: DataFrame, runs: DataFrame, ops: list[int]) -> DataFrame:
    """shape of each operation of each transaction: -1 not run, 0 once, 1 as a loop.
    instances: tx_id; runs: tx_id and op, a row for each run."""
    every = instances.select("tx_id", F.explode(F.array(*map(F.lit, ops))).alias("op"))
    n = runs.groupBy("tx_id", "op").agg(F.count("*").alias("n"))
    return every.join(n, ["tx_id", "op"], "left").select("tx_id", "op", F.when(F.col("n").isNull(), -1).when(F.col("n") == 1, 0).otherwise(1).alias("shape"))


def capped(df: DataFrame, template: str, order: list[str], cap: int) -> DataFrame:
    """The first instances of each template."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(template).orderBy(*order))).where(F.col("__r") <= cap).drop("__r")


def folded_loops(df: DataFrame, tx: str | list[str], order: list[str], sql: str) -> DataFrame:
    """Statements of a transaction with its loops folded: block (even numbers for plain
    statements, odd ones for loops, in their order), op_id and round of each.

    At the repeat of a statement that stands in no loop yet, all from its first run on becomes
    a loop's body; statements of the body that follow are rounds of it, and each run of its head
    starts a round, also later on. A statement that isn't in the body ends the round. What
    stands before a loop's end takes part in no later loop, so loops don't nest. tx: one key,
    called tx_id in the result, or a list of keys, which keep their names."""
    keys = [tx] if isinstance(tx, str) else tx
    names = ["tx_id"] if isinstance(tx, str) else keys
    rows = df.select(*[F.col(k).cast("long").alias(n) if isinstance(tx, str) else F.col(k) for k, n in zip(keys, names, strict=True)], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(sql).alias("sql"))
    dealt = rows.repartition(*names).sortWithinPartitions(*names, *[f"__o{i}" for i in range(len(order))]).select(*names, "sql")
    width = len(names)

    def run(batches):
        key, texts = None, []

        def block(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * (width + 4)
            kinds = [*kinds_of_keys, pa.string(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*names, "sql", "block", "op_id", "round"])

        for b in batches:
            kinds_of_keys, done = [b.column(k).type for k in range(width)], []
            for row in zip(*(b.column(k).to_pylist() for k in range(width + 1)), strict=True):
                if row[:-1] != key:
                    done += [(*key, *x) for x in _folded(texts)] if key is not None else []
                    key, texts = row[:-1], []
                texts.append(row[-1])
            yield block(done)
        if key is not None:
            yield block([(*key, *x) for x in _folded(texts)])

    head = ", ".join(f"{n} {dealt.schema[n].dataType.simpleString()}" for n in names)
    return dealt.mapInArrow(run, f"{head}, sql string, block int, op_id int, round int")


def _folded(texts: list[str]) -> list[tuple[str, int, int, int]]:
    """(sql, block, op_id, round) of one transaction's statements."""
    block, op, rounds = [0] * len(texts), [0] * len(texts), [1] * len(texts)
    tail: dict[str, int] = {}  # statements behind the last loop: where they ran first
    body: dict[str, int] = {}  # the last loop's statements: their op_ids
    head, inside, loops, ops, turn = None, False, 0, 0, 0
    for k, s in enumerate(texts):
        if s == head or inside and s in body:
            turn += s == head
            block[k], op[k], rounds[k], inside = 2 * loops - 1, body[s], turn, True
            continue
        inside = s in tail
        if inside:
            start, loops, head, turn = tail[s], loops + 1, s, 2
            body = {texts[i]: op[i] for i in range(start, k) if tail.get(texts[i], -1) >= start}
            for i in range(start, k):
                if texts[i] in body and block[i] == 2 * (loops - 1):
                    block[i] = 2 * loops - 1
            block[k], op[k], rounds[k], tail = 2 * loops - 1, body[s], turn, {}
        else:
            ops += 1
            tail[s] = k
            block[k], op[k] = 2 * loops, ops
    return list(zip(texts, block, op, rounds, strict=True))


def readable(df: DataFrame, sql: str) -> DataFrame:
    """Statements less the reads that name no table: of variables (select @@...) or constants."""
    text = F.lower(F.trim(F.col(sql)))
    return df.where(~(text.startswith("select") & (text.rlike(r"^select\s+@@") | ~text.rlike(r"\sfrom\s"))))


def committed(df: DataFrame, keys: list[str], order: list[str], rolled_back: Column) -> DataFrame:
    """Statements of the transactions whose last one isn't a rollback."""
    last = df.groupBy(*keys).agg(F.max_by(rolled_back, F.struct(*order)).alias("__r"))
    return df.join(last.where("__r").select(*keys), keys, "left_anti")


def numbered(df: DataFrame, order: list[str], coarse: Column) -> DataFrame:
    """number, from 1, of each row in order; coarse is a step function of the order's first
    column. Rows are numbered step by step; only the steps' counts meet in one task."""
    rows = df.withColumn("__s", coarse)
    before = F.sum("__n").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1))
    steps = rows.groupBy("__s").agg(F.count("*").alias("__n")).withColumn("__b", F.coalesce(before, F.lit(0)))
    own = F.row_number().over(W.partitionBy("__s").orderBy(*order))
    return rows.withColumn("__k", own).join(steps, "__s").withColumn("number", F.col("__k") + F.col("__b")).drop("__s", "__n", "__b", "__k")


def template_ids(df: DataFrame, keys: list[str], sql: str, order: list[str], coarse) -> DataFrame:
    """template_id of each distinct ordered list of statement texts in the order in which the
    lists are first seen, with its text, instances and first statement's place. coarse: a
    function from the place's first column to a step of it."""
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, sql))).alias("__l"))
    text = F.array_join(F.transform("__l", lambda x: x[sql]), ";")
    seen = lists.select(text.alias("template"), F.get("__l", F.lit(0)).alias("__f")).groupBy("template").agg(F.count("*").alias("instances"), F.min("__f").alias("__f"))
    flat = seen.select("template", "instances", *[F.col("__f")[c].alias(c) for c in order])
    return numbered(flat, [*order, "template"], coarse(F.col(order[0]))).withColumnRenamed("number", "template_id")


def rollback_blocks(templates: DataFrame, rolled: DataFrame, keys: list[str], sql: str, order: list[str]) -> DataFrame:
    """Rolled-back transactions by the template they were on the way of, and the block (number
    of the last statement, from 0) at which they ended, with their share of the template's
    instances. rolled: their statements without the rollback. Prefixes of templates are joined
    by equality; of several templates the first seen counts."""
    lists = rolled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, sql))).alias("__l"))
    ended = lists.groupBy(F.array_join(F.transform("__l", lambda x: x[sql]), ";").alias("prefix")).agg(F.count("*").alias("rolled_back"))
    parts = F.split("template", ";")
    steps = templates.select("template_id", "template", "instances", F.posexplode(parts).alias("block", "__p")).drop("__p")
    steps = steps.withColumn("prefix", F.expr("array_join(slice(split(template, ';'), 1, block + 1), ';')"))
    first = steps.groupBy("prefix").agg(F.min(F.struct("template_id", "block", "instances")).alias("t"))
    return ended.join(first, "prefix").select("t.template_id", "t.block", "rolled_back", (F.col("rolled_back") / F.col("t.instances")).alias("rollback_prob"))


def rollback_rates(sessions: DataFrame, kind: str, rolled_back: Column) -> DataFrame:
    """Share of sessions of each kind that were rolled back."""
    return sessions.groupBy(kind).agg(F.avg(rolled_back.cast("double")).alias("rollback_prob"), F.count("*").alias("instances"))
