"""Dependencies between statement parameters, from parameters in long form: tx_id, op,
rn (round of a loop, from 1), idx, type and v."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["op_a", "idx_a", "op_b", "idx_b"]
_PAIR_OF = ["a.op op_a", "a.idx idx_a", "b.op op_b", "b.idx idx_b"]


def settled(small: DataFrame) -> DataFrame:
    """A table with a row for each parameter or pair of parameters of the templates, counted once
    and kept, where several steps read it."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def equal_counts(p: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Transactions in which parameter b equals the earlier parameter a, first rounds only.
    Parameters of one transaction, type and value are listed with their counts, so the size
    follows the matches, repeated rows aren't paired one by one, and nothing is shuffled if p is
    dealt by transaction.

    With results (tx_id, op, m, type, v: the columns of single-row results of earlier
    operations) the edges from them are counted too, with m as idx_a, and source tells both
    kinds apart."""
    rows = p.where("rn = 1").select("tx_id", "type", "v", "op", "idx", F.lit("parameter").alias("source"))
    if results is not None:
        rows = rows.union(results.select("tx_id", "type", "v", "op", "m", F.lit("result")))
    value = ["tx_id", "type", "v"]
    n = rows.dropna(subset=value).groupBy(*value, "op", "idx", "source").agg(F.count("*").alias("n"))
    lists = n.groupBy(*value).agg(F.collect_list(F.struct("source", "op", "idx", "n")).alias("ps")).where("size(ps) > 1")
    pairs = _pairs(lists, "a.source = 'result' and a.op < b.op or a.source = 'parameter' and (a.op < b.op or a.op = b.op and a.idx < b.idx)")
    keys = [*PAIR] if results is None else [*PAIR, "source"]
    both = pairs.selectExpr("a.source", *_PAIR_OF, "a.n * b.n n")
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def _pairs(lists: DataFrame, earlier: str) -> DataFrame:
    """a and b of each two in a list ps for which earlier holds, b being a parameter."""
    one = lists.select("ps", F.explode("ps").alias("b")).where("b.source = 'parameter'")
    return one.select("b", F.explode("ps").alias("a")).where(earlier)


def exec_counts(p: DataFrame) -> DataFrame:
    """Transactions that run each operation; a loop counts once."""
    return p.groupBy("op").agg(F.count_distinct("tx_id").alias("n_exec"))


def exec_pairs(p: DataFrame) -> DataFrame:
    """The same, a loop of n rounds counting as its n (n - 1) / 2 pairs."""
    runs = p.select("tx_id", "op", "rn").distinct().groupBy("tx_id", "op").agg(F.count("*").alias("n"))
    return runs.groupBy("op").agg(F.sum(F.when(F.col("n") > 1, F.expr("n * (n - 1) div 2")).otherwise(1)).alias("n_pairs"))


def average_runs(p: DataFrame) -> DataFrame:
    """Runs of each operation per transaction of the trace."""
    runs = p.select("tx_id", "op", "rn").distinct()
    total = p.agg(F.count_distinct("tx_id").alias("t"))
    return runs.groupBy("op").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("op", (F.col("n") / F.col("t")).alias("avg_runs"))


def probabilities(counts: DataFrame, n_exec: DataFrame, least: float = 0.01) -> DataFrame:
    """Counts over the runs of the dependent operation; faint ones go."""
    n = n_exec.select(F.col("op").alias("op_b"), "n_exec")
    more = [c for c in ("source",) if c in counts.columns]
    return counts.join(n, "op_b").select(*PAIR, *more, (F.col("n") / F.col("n_exec")).alias("prob")).where(F.col("prob") >= least)


def identical_sets(prob: DataFrame) -> DataFrame:
    """(op, idx, set_op, set_idx): parameters that always agree, with the first of their set.
    Labels spread over the certain pairs until none changes; nodes are a template's
    parameters, so the table is tiny however long the trace is."""
    node = lambda s: F.struct(F.col(f"op_{s}").alias("op"), F.col(f"idx_{s}").alias("idx"))
    sure = prob.where("prob >= 1")
    edges = [(tuple(r.a), tuple(r.b)) for r in sure.select(node("a").alias("a"), node("b").alias("b")).collect()]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    rows = [(*k, *v) for k, v in label.items()]
    return prob.sparkSession.createDataFrame(rows, "op int, idx int, set_op int, set_idx int")


def selected_edges(candidates: DataFrame, descending: bool = False) -> DataFrame:
    """The edges of each parameter that are kept: of each identical set one candidate, then
    from the start that gives the greatest sum the candidates, in order of probability,
    that keep the sum at 1 or below. candidates: op_a, idx_a, op_b, idx_b, prob, set_a."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["prob", "op_a", "idx_a"], ascending=[not descending, True, True]).drop_duplicates("set_a", keep="first")
        best: list[int] = []
        best_sum, probs = -1.0, rows["prob"].tolist()
        for start in range(len(probs)):
            took, total = [], 0.0
            for k in range(start, len(probs)):
                if total + probs[k] <= 1 + 1e-9:
                    took.append(k)
                    total += probs[k]
            if total > best_sum + 1e-12:
                best, best_sum = took, total
        return rows.iloc[best][[*PAIR, "prob"]]

    return candidates.groupBy("op_b", "idx_b").applyInPandas(choose, "op_a int, idx_a int, op_b int, idx_b int, prob double")


def include_counts(p: DataFrame, results: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Transactions in which a parameter's value is in column m of the many-row result of an
    earlier operation. results: tx_id, op, m, type and v, a row for each result row. Where many
    transactions read the same rows, keys (tx_id and key) says which, and results has key
    instead of tx_id, so shared rows are never copied to each transaction."""
    by = "tx_id" if keys is None else "key"
    r = results.select(by, F.col("op").alias("op_a"), F.col("m").alias("idx_a"), "type", "v").distinct()
    b = p.where("rn = 1").select("tx_id", "type", "v", F.col("op").alias("op_b"), F.col("idx").alias("idx_b"))
    b = b if keys is None else b.join(keys, "tx_id")
    return b.join(r, [by, "type", "v"]).where("op_a < op_b").groupBy(*PAIR).agg(F.count_distinct("tx_id").alias("n"))


def merged_edges(known: DataFrame, more: DataFrame) -> DataFrame:
    """Edges of several kinds of each parameter: those of more are added while the sum stays
    at 1 or below. Each that is left over replaces one known edge, the faintest first, if the
    sum allows: an equal edge if it is at least twice as likely; a partition edge also takes
    the place of another kind's edge that is no likelier. Both with op_b, idx_b, op_a, idx_a,
    prob and kind."""
    keys = [*PAIR, "prob", "kind"]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["prob", "op_a", "idx_a"])
        kept = rows[~rows.new].to_dict("records")
        total, added, left = sum(e["prob"] for e in kept), [], []
        for e in rows[rows.new].to_dict("records"):
            if total + e["prob"] <= 1 + 1e-8:
                added.append(e)
                total += e["prob"]
            else:
                left.append(e)
        for e in left:
            for k, old in enumerate(kept):
                likely = e["prob"] >= 2 * old["prob"] if old["kind"] == "equal" else e["kind"].startswith("part") and e["prob"] >= old["prob"]
                if likely and total - old["prob"] + e["prob"] <= 1 + 1e-8:
                    kept[k] = e
                    total += e["prob"] - old["prob"]
                    break
        return pd.DataFrame(kept + added, columns=keys)

    both = known.select(*keys, F.lit(False).alias("new")).union(more.select(*keys, F.lit(True)))
    return both.groupBy("op_b", "idx_b").applyInPandas(merge, "op_a int, idx_a int, op_b int, idx_b int, prob double, kind string")


def linear_relations(p: DataFrame, results: DataFrame | None = None, slack: float = 1e-9) -> DataFrame:
    """(a, b) of y = a x + b between an earlier numeric value x and a later parameter y that
    holds in all transactions, first rounds only. x is a parameter or, with results (tx_id, op,
    m, type, v of single-row results), also a column of a result; then source tells both apart,
    and a null result rules the relation out.

    A transaction's values stand in one row, so no pair is joined. Two anchors, the least and
    the greatest x, fix the line; the rest is a check by cross products, exact for integers,
    and for other numbers within slack of the size of y. The anchors are one row for each pair of
    the templates' parameters and are sent to all tasks: first x, then y. All three passes keep
    sums of fixed size for each pair in a task, and neither sort nor shuffle the pairs."""
    first = p.where("tx_id is not null and rn = 1 and type in (0, 1, 2, 3)").select("tx_id", F.lit("parameter").alias("source"), "op", "idx", "v")
    exact = "int" in p.schema["v"].dataType.simpleString()
    if results is not None:
        first = first.union(results.where("type in (0, 1, 2, 3)").select("tx_id", F.lit("result"), "op", "m", "v"))
        exact = exact and "int" in results.schema["v"].dataType.simpleString()
    v = F.col("v") if exact else F.col("v").cast("double").alias("v")
    rows = first.groupBy("tx_id").agg(F.collect_list(F.struct("source", "op", "idx", v)).alias("ps"))
    keys = PAIR if results is None else [*PAIR, "source"]
    pairs = _pairs(rows, "a.op < b.op").selectExpr("a.source", *_PAIR_OF, "a.v x", "b.v y").select(*keys, "x", "y")
    known = pairs.where("x is not null and y is not null")
    span = settled(known.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1")).where("x1 > x0"))
    at = lambda c: F.when(F.col("x") == F.col(c), F.col("y"))
    ends = settled(known.join(F.broadcast(span), keys).groupBy(*keys, "x0", "x1").agg(F.min(at("x0")).alias("y0"), F.max(at("x1")).alias("y1")))
    d = lambda c: F.col(c).cast("decimal(20,0)" if exact else "double")
    left, right = (d("y") - d("y0")) * (d("x1") - d("x0")), (d("y1") - d("y0")) * (d("x") - d("x0"))
    near = left == right if exact else F.abs(left - right) <= F.lit(slack) * (F.col("x1") - F.col("x0")) * F.greatest(F.abs("y"), F.abs("y0"), F.abs("y1"))
    checked = pairs.join(F.broadcast(ends), keys).groupBy(*keys, "x0", "x1", "y0", "y1").agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("ok"))
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return checked.where("ok").select(*keys, slope.alias("a"), (F.col("y0") - slope * F.col("x0")).alias("b"))


def useful_linear(linear: DataFrame, prob: DataFrame, strong: float = 0.7) -> DataFrame:
    """Linear edges that aren't plain equality or constant, of parameters without a strong
    equal edge."""
    has = prob.where(F.col("prob") >= strong).select("op_b", "idx_b").distinct()
    return linear.where("not (a = 1 and b = 0) and a <> 0").join(has, ["op_b", "idx_b"], "left_anti")


def loop_increments(p: DataFrame) -> DataFrame:
    """(op, idx, increment) of loop parameters that change by one constant from round to
    round in all looped transactions; 0 for those that stay the same."""
    w = W.partitionBy("tx_id", "op", "idx").orderBy("rn")
    steps = p.withColumn("d", F.col("v") - F.lag("v").over(w)).where("d is not null")
    one = steps.groupBy("tx_id", "op", "idx").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return one.groupBy("op", "idx").agg(F.min("lo").alias("increment"), F.max("hi").alias("hi")).where("increment = hi").drop("hi")


def partition_counts(p: DataFrame, part: Column, same: bool) -> DataFrame:
    """Pairs of rounds of parameters of one column in the same (or in different) partition:
    within a loop, of each round with the earlier ones. From the counts of each partition in
    a transaction, so no pair of rounds is ever made."""
    n = p.groupBy("tx_id", "op", "idx", part.alias("part")).agg(F.count("*").alias("n"))
    per = n.groupBy("tx_id", "op", "idx").agg(F.sum("n").alias("t"), F.sum(F.expr("n * (n - 1) div 2")).alias("eq"))
    pairs = F.expr("t * (t - 1) div 2")
    return per.groupBy("op", "idx").agg(F.sum(F.col("eq") if same else pairs - F.col("eq")).alias("n_pairs"))


def partition_links(p: DataFrame, part: Column, column: Column) -> DataFrame:
    """Rounds of a parameter whose value is in the same (n_same) and in another (n_other)
    partition than the first round of a parameter of an earlier operation; both must stand for
    the same column of a table, and column is null for those without partitions. From the
    counts of each partition in a transaction, listed by column, so rounds aren't joined."""
    rows = p.withColumn("col", column).withColumn("part", part).where("tx_id is not null and col is not null and part is not null")
    n = rows.groupBy("tx_id", "col", "op", "idx", "part").agg(F.count("*").alias("n"), F.count_if(F.col("rn") == 1).alias("n1"))
    lists = n.groupBy("tx_id", "col").agg(F.collect_list(F.struct(F.lit("parameter").alias("source"), "op", "idx", "part", "n", "n1")).alias("ps")).where("size(ps) > 1")
    both = _pairs(lists, "a.op < b.op and a.n1 > 0").selectExpr(*_PAIR_OF, "a.n1 * b.n n", "a.part = b.part same")
    return both.groupBy(*PAIR).agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("n_same"), F.sum(F.when(F.col("same"), 0).otherwise(F.col("n"))).alias("n_other"))


def partition_cardinality(p: DataFrame, part: Column) -> DataFrame:
    """Share of transactions that touch so many partitions; those that touch none count in
    the whole only."""
    per = p.groupBy("tx_id").agg(F.count_distinct(part).alias("partitions"))
    total = per.agg(F.count("*").alias("t"))
    return per.where("partitions > 0").groupBy("partitions").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("partitions", (F.col("n") / F.col("t")).alias("share"))


def partitions_of(p: DataFrame, part: Column, unit: list[str]) -> DataFrame:
    """How many units (transactions: tx_id; statements: tx_id, op and rn) touch so many partitions;
    part is null for values without one, and units without any aren't counted."""
    per = p.where(part.isNotNull()).groupBy(*unit).agg(F.count_distinct(part).alias("partitions"))
    return per.groupBy("partitions").agg(F.count("*").alias("n"))


def parameters_by_type(p: DataFrame) -> DataFrame:
    """The parameters of each type that need statistics, as one text in order."""
    one = p.select("type", "op", "idx").distinct()
    return one.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op", "idx"))), lambda x: F.concat_ws("_", x["op"].cast("string"), x["idx"].cast("string"))), ",").alias("params"))


def masked(p: DataFrame, sets: DataFrame, loops: DataFrame) -> DataFrame:
    """v null where the value follows from logic: members of an identical set but the first,
    and loop parameters after the first round. Both lists have a row for each parameter of the
    templates, however long the trace is, and go to all tasks: a join by op and idx would bring
    all rows of a parameter to one task."""
    later = sets.where("op <> set_op or idx <> set_idx").select("op", "idx", F.lit(True).alias("__s"))
    loop = loops.select("op", "idx", F.lit(True).alias("__l"))
    out = p.join(F.broadcast(later), ["op", "idx"], "left").join(F.broadcast(loop), ["op", "idx"], "left")
    return out.withColumn("v", F.when(F.col("__s").isNull() & (F.col("__l").isNull() | (F.col("rn") == 1)), F.col("v"))).drop("__s", "__l")


def cumulative(prob: DataFrame) -> DataFrame:
    """Running sum of a parameter's edge probabilities, in their order."""
    w = W.partitionBy("op_b", "idx_b").orderBy("prob", "op_a", "idx_a").rowsBetween(W.unboundedPreceding, 0)
    return prob.withColumn("cdf", F.sum("prob").over(w))
