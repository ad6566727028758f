"""All characteristics of a workload in one go, steered by settings, kept and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import distribution as D
from tracewright.operators import mining as M
from tracewright.operators import profile as P
from tracewright.operators.windows import tumbling
from tracewright.plans.base import E_SQL, Tables, order_params, query
from tracewright.plans.source_queries import _folder
from tracewright.sources.texts import Settings, read_settings, read_snapshot, write_snapshot

#: The settings of the registered query.
TEXT = """
window_seconds = 86400   # a day
top_values = 5
buckets = 8
quantiles = 4
least_probability = 0.02
"""


def characteristics(t: Tables, s: Settings) -> dict[str, DataFrame]:
    """profile, logic, rates, top, histogram and quantiles of the trace under the settings."""
    p, e = order_params(t), tumbling(t.events, "ts", s.window_seconds * 1_000_000)
    counts = D.value_counts(e, ["w"], "user_id")
    return {
        "profile": P.numeric_profile(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"]),
        "logic": M.probabilities(M.equal_counts(p), M.exec_counts(p), s.least_probability),
        "rates": D.throughput(e, "event_type", "w", F.lit(1)),
        "top": D.top_values(counts, ["w"], s.top_values),
        "histogram": D.histogram(counts, ["w"], s.buckets, s.top_values),
        "quantiles": D.bucket_quantiles(counts, ["w"], s.buckets, s.quantiles),
    }


_BUCKET = "CAST(greatest(0, least(7, floor((v - lo) / ((hi - lo + 1e-9) / 8)))) AS INT)"


@query("snapshot_characteristics", f"WITH {E_SQL}, c AS (SELECT w, user_id v, count(*) n FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, v) rank, sum(n) OVER (PARTITION BY w) t, min(v) OVER (PARTITION BY w) lo, max(v) OVER (PARTITION BY w) hi FROM c) SELECT w, CAST(rank AS INT) slot, v, round(n / t, 6) freq FROM k WHERE rank <= 5 UNION ALL SELECT w, 6 + {_BUCKET}, NULL, round(sum(n) / any_value(t), 6) FROM k WHERE rank > 5 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    parts = characteristics(t, read_settings(TEXT))
    write_snapshot(parts, path := _folder(t, "characteristics"))
    kept = read_snapshot(t.spark, path, list(parts))
    top = kept["top"].select("w", F.col("rank").cast("int").alias("slot"), "v", F.round("freq", 6).alias("freq"))
    rest = kept["histogram"].select("w", (F.col("bucket") + 6).alias("slot"), F.lit(None).cast("long").alias("v"), F.round("freq", 6).alias("freq"))
    return top.union(rest)
