"""Quality by co-training (operator 1).

Two naive Bayes classifiers look at separate views of a document: its text (its words, and
shares of symbols, capitals, digits, repeated and distinct words) and its metadata (language,
source, length). They start from labelled rows. In each round every unlabelled document that
one view is sure of becomes a pseudo-label for the other view, and both are counted anew over
all documents. At the end each view's log odds are calibrated by a logistic curve on labelled
rows that were counted in no model, and the calibrated views are added.

Words are hashed to WORD_BINS features, whatever the size of the corpus, so the text model is
a table of fixed size; tasks count their own documents before the shuffle. Metadata are counted
by their values themselves: documents of equal metadata are one row of a table that grows with
the number of sources, and it is joined back with frequent values dealt over several tasks.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import held_out, in_slices, salted_join, written
from tracewright.llm.shingles import word_hashes

TEXT_BINS, WORD_BINS = 16, 1 << 16
TEXT_FEATURES = 8
#: Labelled rows by the remainder of crc32(doc_id) by 5: 0 is held out, 1 calibrates, others are counted.
CALIBRATES = 1
_ASCII = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in (("symbol", b"#$%&*+/<=>@[\\]^_`{|}~"), ("bang", b"!?"), ("digit", b"0123456789"), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))))}


def text_bins(text: str | None) -> list[int]:
    """The bins of the text features; texts without words have bin 15 of each."""
    words = (text or "").split()
    if not words:
        return [TEXT_BINS - 1] * TEXT_FEATURES
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = {k: int(np.count_nonzero(v[b])) for k, v in _ASCII.items()}
    letters = max(1, n["upper"] + n["lower"])
    values = [
        40 * n["symbol"] / len(b),
        15 * n["upper"] / letters,
        12 * len(set(words)) / len(words),
        30 * sum(map(operator.eq, words, words[1:])) / len(words),
        len(b) / len(words),
        30 * n["digit"] / len(b),
        2 * math.log2(1 + len(words) / (1 + text.count("\n"))),
        10 * n["bang"] / len(words),
    ]
    return [min(TEXT_BINS - 2, int(v)) for v in values]


def word_bins(text: str | None) -> np.ndarray:
    """The bins of the distinct words of a text, A-Z in lower case."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(words % np.uint64(WORD_BINS)).astype(np.int32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and size (log of the length) of each row, and the bins of its text:
    shape and words."""
    size = F.floor(F.log2(1 + F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0)))).cast("int")
    src = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), size.alias("size"), F.col("text").alias("__text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in in_slices(batches):
            texts = b.column(4).to_pylist()
            cols = [pa.array([text_bins(t) for t in texts], pa.list_(pa.int32())), pa.array([word_bins(t) for t in texts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(4)], *cols], ["doc_id", "lang", "source", "size", "shape", "words"])

    return src.mapInArrow(run, f"doc_id {kind}, lang string, source string, size int, shape array<int>, words array<int>")


def _bayes(n: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Weights of the bins from their counts in the two classes."""
    n = n + smooth
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


class TextModel:
    """Naive Bayes over shape and words. Words of a text agree with each other, so the sum of
    their weights is divided by the root of their number."""

    def __init__(self, shape: np.ndarray, words: np.ndarray, prior: float):
        self.shape, self.words, self.prior = shape, words, prior

    def odds(self, shape: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        s = np.stack(shape.to_pylist()) if len(shape) else np.zeros((0, TEXT_FEATURES), int)
        sizes = np.diff(words.offsets.to_numpy())
        ends = np.cumsum([0, *sizes])
        run = np.concatenate([[0.0], np.cumsum(self.words[words.flatten().to_numpy()])])
        w = (run[ends[1:]] - run[ends[:-1]]) / np.sqrt(np.maximum(sizes, 1))
        return self.prior + self.shape[np.arange(TEXT_FEATURES), s].sum(1), w


def _text_model(rows: DataFrame, label: str) -> TextModel | None:
    """From all rows whose label isn't null; None if a class is empty. Each task sends the sums
    of its own rows, so the shuffle has at most as many rows a task as there are bins."""
    wide = TEXT_FEATURES * TEXT_BINS

    def count(batches):
        n = np.zeros((2, wide + WORD_BINS + 1), np.int64)
        for b in batches:
            y = b.column(0).to_numpy()
            shape, words = b.column(1), b.column(2)
            for c in (0, 1):
                mine = pa.array(y == c)
                s = np.stack(shape.filter(mine).to_pylist()) if (y == c).any() else np.zeros((0, TEXT_FEATURES), int)
                n[c, :wide] += np.bincount((s + TEXT_BINS * np.arange(TEXT_FEATURES)).ravel(), minlength=wide)
                n[c, wide:-1] += np.bincount(words.filter(mine).flatten().to_numpy(), minlength=WORD_BINS)
                n[c, -1] += len(s)
        bins = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n[0, bins]), pa.array(n[1, bins])], ["bin", "bad", "good"])

    known = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), "shape", "words")
    found = known.mapInArrow(count, "bin long, bad long, good long").groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    n = np.zeros((2, wide + WORD_BINS + 1))
    for r in found:
        n[:, r.bin] = r.bad, r.good
    if not n[:, -1].all():
        return None
    shape = np.stack([_bayes(n[:, k : k + TEXT_BINS]) for k in range(0, wide, TEXT_BINS)])
    return TextModel(shape, _bayes(n[:, wide:-1]), math.log(n[1, -1] / n[0, -1]))


def _meta_odds(rows: DataFrame, label: str, smooth: float = 1.0) -> DataFrame | None:
    """lang, source, size and meta (log odds of good quality) of each combination that occurs;
    None if a class is empty. A value's counts are those of all rows with a label."""
    known = F.col(label)
    cells = written(rows.groupBy(*META).agg(F.count_if(known == 1).alias("good"), F.count_if(known == 0).alias("bad")), "quality-cells")
    total = cells.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), *[F.count_distinct(c) for c in META]).first()
    good, bad, *ndv = total
    if not good or not bad:
        return None
    odds = F.lit(math.log(good / bad))
    for c, n in zip(META, ndv, strict=True):
        per = cells.groupBy(c).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        w = F.log((F.col("g") + smooth) / (good + smooth * n)) - F.log((F.col("b") + smooth) / (bad + smooth * n))
        cells = cells.join(per.select(c, w.alias(f"w_{c}")), c)
        odds = odds + F.col(f"w_{c}")
    return cells.select(*META, odds.alias("meta"))


META = ["lang", "source", "size"]


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a little ridge on the slopes."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-9, *[1e-3] * (a.shape[1] - 1)])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * b
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(ridge)
        step = np.clip(np.linalg.solve(h, g), -3, 3)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _with_text(rows: DataFrame, model: TextModel | None) -> DataFrame:
    """rows with the text view's log odds by shape and by words in place of the bins."""
    kinds = rows.drop("shape", "words").schema

    def run(batches):
        for b in batches:
            names = [n for n in b.schema.names if n not in ("shape", "words")]
            zero = np.zeros(b.num_rows)
            s, w = (zero, zero) if model is None else model.odds(b.column("shape"), b.column("words"))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(s), pa.array(w)], [*names, "by_shape", "by_words"])

    return rows.mapInArrow(run, kinds.simpleString()[7:-1] + ", by_shape double, by_words double")


def _with_meta(rows: DataFrame, odds: DataFrame | None) -> DataFrame:
    if odds is None:
        return rows.withColumn("meta", F.lit(0.0))
    return salted_join(rows, odds, META, "doc_id")


def op1_cotrain(docs: DataFrame, labels: DataFrame, rounds: int = 3, sure: float = 0.97, max_calibration: int = 20_000) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (probability of good quality),
    predicted (1 if score >= 0.5) and keep (the same as a boolean) of every row.

    Rows of the held-out fold give no labels, and a fifth of the labels (CALIBRATES) is kept for
    the curves, which are fitted on at most max_calibration of them, in the order of a hash of
    doc_id; counts cover all rows. Several labels of an id count as the least. Null texts have
    bins of their own, null metadata are an empty value; rows are scored one by one, repeated
    ones alike. Without labels of both kinds, counted and kept, the score is 0.5 for all rows;
    an empty table gives no rows."""
    rated = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("__y"))
    calibrates = F.crc32(F.col("doc_id").cast("string")) % 5 == CALIBRATES
    # one plan at every size: the bins meet the labels in a shuffle, also where few labels could be sent to all
    rows = features(docs).join(rated.where(~held_out()).hint("merge"), "doc_id", "left")
    rows = written(rows.withColumns({"__kept": F.when(calibrates, F.col("__y")), "__y": F.when(~calibrates, F.col("__y"))}), "quality-features")
    text, meta = _text_model(rows, "__y"), _meta_odds(rows, "__y")
    limit = math.log(sure / (1 - sure))
    surely = lambda z: F.when(z >= limit, 1).when(z <= -limit, 0)
    for _ in range(rounds if text and meta else 0):
        # each view learns from the labels and from what the other is sure of
        by_meta = _with_meta(rows, meta).withColumn("__t", F.coalesce("__y", surely(F.col("meta"))))
        by_text = _with_text(rows, text).withColumn("__t", F.coalesce("__y", surely(F.col("by_shape") + F.col("by_words"))))
        text, meta = _text_model(by_meta, "__t") or text, _meta_odds(by_text, "__t") or meta
    scored = _with_meta(_with_text(rows, text), meta).select("doc_id", "__kept", "by_shape", "by_words", "meta")
    views = {"text": ["by_shape", "by_words"], "meta": ["meta"]}
    curves, prior = {v: np.zeros(1 + len(c)) for v, c in views.items()}, 0.0
    if text and meta:
        scored = written(scored, "quality-odds")
        sample = scored.where("__kept is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_calibration).toPandas()
        y = sample["__kept"].to_numpy(float)
        if 0 < y.sum() < len(y):
            curves = {v: _curve(sample[c].to_numpy(float), y) for v, c in views.items()}
            prior = math.log(y.sum() / (len(y) - y.sum()))
    z = {}
    for v, names in views.items():
        z[v] = F.lit(float(curves[v][0]))
        for b, c in zip(curves[v][1:], names, strict=True):
            z[v] = z[v] + F.lit(float(b)) * F.col(c)
    p = lambda x: 1 / (1 + F.exp(-x))
    out = scored.select("doc_id", held_out().alias("held_out"), p(z["text"]).alias("text_score"), p(z["meta"]).alias("meta_score"), p(z["text"] + z["meta"] - F.lit(prior)).alias("score"))
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("keep"))
