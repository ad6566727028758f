"""Benchmark decontamination by a prefix-filtered set join (operator 7), in DataFrame
operations only.

A window of an item holds shingles of three words (of all its words if it has fewer).
A document holds the window only if it holds every one of them, so the join needs one
necessary token of each window: its rarest over all documents. A window with a shingle
that no document has is dropped at once. A match gives the place where the window would
have to start; it must fit between the ends of the document, and then the words
themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import document_columns, written

WINDOW, SHINGLE = 10, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of characters that aren't part of a word.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _hashed(words: Column) -> Column:
    # lower() maps words that are equal without regard to A-Z to equal words, and is quick
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _shingles(hashes: Column, size: int) -> Column:
    n = F.size(hashes)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + j) for j in range(size)]))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, wt (the window's lower-case words, joined by spaces) and len."""
    n = F.size("__w")
    items = benchmark.select("item_id", words_of(F.translate(F.col("text"), UPPER, LOWER)).alias("__w")).where(n > 0)
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    w = items.select("item_id", "__w", F.explode(starts).alias("__i")).select("item_id", F.slice("__w", F.col("__i"), F.lit(WINDOW)).alias("w"))
    return w.select("item_id", F.concat_ws(" ", "w").alias("wt"), F.size("w").alias("len"), "w")


def hit_windows(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, windows). rows: doc_id, th (hash of the text) and n_words of each row
    of docs. hits: doc_id, th, start, len and wt of the windows that occur. windows:
    item_id and wt. Tables of windows and of candidate documents are broadcast up to
    broadcast_rows rows, and joined by shuffle beyond."""

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    windows = written(item_windows(benchmark), "windows")
    distinct = windows.select("wt", "len", "w").dropDuplicates(["wt"])
    sizes = sorted(r[0] for r in distinct.select(F.least("len", F.lit(SHINGLE))).distinct().collect())
    tokens = None
    for s in sizes:
        own = distinct.where(F.least("len", F.lit(SHINGLE)) == s)
        own = own.select("wt", "len", F.posexplode(_shingles(_hashed(F.col("w")), s)).alias("k", "h"))
        tokens = own if tokens is None else tokens.unionByName(own)
    if tokens is None:
        tokens = distinct.select("wt", "len", F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")).where("false")
    tokens = written(tokens, "window-tokens")

    # a first entry of each document passes the join too, so one scan gives all rows' lengths
    mark = F.lit(0).cast("long")
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), _hashed(words_of(F.col("text"))).alias("__h"))
    arrays = [F.transform(_shingles(F.col("__h"), s), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for s in sizes]
    first = F.array(F.struct(F.lit(-1).alias("pos"), mark.alias("h")))
    found = src.select("doc_id", "th", F.size("__h").cast("long").alias("n_words"), F.explode(F.concat(first, *arrays)).alias("__t"))
    wanted = tokens.select("h").union(docs.sparkSession.range(1).select(mark.alias("h"))).distinct()
    seen = written(found.select("doc_id", "th", "n_words", "__t.pos", "__t.h").join(small(wanted), "h", "left_semi"), "seen-tokens")

    rows = seen.where("pos = -1").select("doc_id", "th", "n_words")
    frequency = seen.where("pos >= 0").groupBy("h").agg(F.count("*").alias("df"))
    prefix = (
        tokens.join(frequency, "h", "left").groupBy("wt", "len")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "k", "h")).alias("rare")).where("rare.df > 0")
        .select("wt", "len", "rare.k", "rare.h")
    )
    prefix = written(prefix, "window-prefixes")
    start = (F.col("pos") - F.col("k")).alias("start")
    candidates = seen.where("pos >= 0").join(small(prefix), "h").where("pos >= k and pos - k + len <= n_words")
    by_document = written(candidates.groupBy("doc_id", "th").agg(F.collect_set(F.struct(start, "len", "wt")).alias("c")), "candidates")

    keys = by_document.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(small(keys), same, "left_semi")
    texts = texts.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", words_of(F.col("text")).alias("__w"))
    both = texts.join(by_document.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "c"), same)
    equal = F.filter("c", lambda c: F.translate(F.concat_ws(" ", F.slice(F.col("__w"), c["start"] + 1, c["len"])), UPPER, LOWER) == c["wt"])
    hits = both.select("doc_id", "th", F.explode(equal).alias("x")).select("doc_id", "th", "x.start", "x.len", "x.wt")
    return rows, hits, windows.select("item_id", "wt")


def op7_decontam(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    Null and empty texts have no words; items without words have no window. Rows that
    repeat id and text get equal results, rows with one id and other texts their own;
    null ids count as one id. Items without id join with no name in items_sha256, but
    count. An empty benchmark leaves every document clean."""
    rows, hits, windows = hit_windows(docs, benchmark, **params)
    hits = written(hits, "window-hits")
    end = F.col("start") + F.col("len")
    before = W.partitionBy("doc_id", "th").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("doc_id", "th", "start", "len").distinct()
    fresh = spans.select("doc_id", "th", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), "start"))).alias("n"))
    n_hit = fresh.groupBy("doc_id", "th").agg(F.sum("n").alias("n_hit"))
    named = hits.select("doc_id", "th", "wt").distinct().join(windows, "wt").select("doc_id", "th", "item_id").distinct()
    items = named.groupBy("doc_id", "th").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    both = n_hit.join(items, n_hit.doc_id.eqNullSafe(items.doc_id) & (n_hit.th == items.th)).select(n_hit.doc_id.alias("__d"), n_hit.th.alias("__t"), "n_hit", "n_items", "ids")
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    _, hits, _ = hit_windows(docs, benchmark, **params)
    dirty = hits.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct()
    src = document_columns(docs).withColumn("__h", F.xxhash64("text"))
    kept = src.join(dirty, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")), "left_anti")
    return document_columns(kept)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') t FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') t FROM dw) JOIN bw USING (n, t)),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
