"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import salted_join, written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of links (a, b); comp is the component's least node.

    Each round gives a node the least label among its own and its neighbours', then the
    label of its label, so that chains shrink to their half at least; it ends when
    nothing changes. A round's labels are written, which cuts the lineage. A node with very
    many neighbours, or a label of very many nodes, is dealt over several tasks."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("b"), "comp"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("other"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "other").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = written(salted_join(least, jump, "comp", "node").select("node", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")
        if labels.where("comp < was").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
