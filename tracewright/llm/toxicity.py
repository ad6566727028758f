"""Toxicity by a weighted lexicon (operator 3).

Text is folded first: lower case, accents and zero-width marks dropped, homoglyphs
of other scripts, digits and look-alike symbols put on one letter, everything else
on a space. One Aho-Corasick automaton then finds the terms, which are word
beginnings, so a term also catches the words that grow from it. Hits inside an
exception phrase don't count. The weights of the rest, alone and per word of text,
go through a logistic curve.

The lexicon, the exceptions and the curve are learned from at most `max_train`
labelled rows, taken in the order of a hash of doc_id; everything else covers all rows.
What comes to the driver while learning is bounded by that sample alone.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import document_columns, held_out, in_slices, tidy, written

# Letters of other scripts and the Latin letters they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "đ": "d",
}
# Digits and symbols written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class _Fold(dict):
    """For str.translate: the folded form of a code point, worked out once."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf"):
            out = ""
        else:
            base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(x) != "Mn")
            base = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) for x in base)
            # l, 1 and i stand for each other
            out = base.replace("l", "i") if base.isalnum() else " "
        self[cp] = out
        return out


FOLD = _Fold()


def fold(text: str | None) -> str:
    return (text or "").translate(FOLD)


@dataclass
class Lexicon:
    """terms: folded word beginnings and their weights. exceptions: folded phrases in
    which a term is harmless. curve: of the score, on (1, log weight, log weight a 1000 words)."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)


def automaton(lexicon: Lexicon):
    a = ahocorasick.Automaton()
    for t, w in lexicon.terms.items():
        a.add_word(" " + t, (w, len(t) + 1))
    for p in lexicon.exceptions:
        a.add_word(f" {p} ", (0.0, len(p) + 2))
    if len(a):
        a.make_automaton()
    return a


def weigh(folded: str, a) -> tuple[int, float]:
    """Hits and their weight, of the longest term at each word, outside exception phrases."""
    if not len(a):
        return 0, 0.0
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (w, n) in a.iter(f" {folded} "):
        start = end - n + 1
        if w == 0.0:
            spared.append((start, end))
        elif n > best.get(start, (0, 0.0))[0]:
            best[start] = (n, w)
    if spared and best:
        best = {s: x for s, x in best.items() if not any(lo <= s and s + x[0] <= hi + 1 for lo, hi in spared)}
    return len(best), sum(w for _, w in best.values())


def _features(weight: float, n_words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), math.log1p(1000.0 * weight / (n_words + 20.0))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * b * [0, 1, 1] / 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag([1e-9, ridge / 10, ridge / 10])
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in b)


def _prefixes(folded: str, lo: int = 3, hi: int = 12) -> set[str]:
    """Beginnings of lo to hi letters of each word, and the word, however long."""
    words = set(folded.split())
    return {w[:k] for w in words for k in range(lo, min(hi, len(w)) + 1)} | {w for w in words if len(w) > hi}


def _contexts(folded: str) -> dict[str, str]:
    """The word before each word, at its first place."""
    words = folded.split()
    return dict(zip(reversed(words), reversed(["", *words[:-1]]), strict=True))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, chance: float = 1e-5, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon from labelled rows outside the held-out fold.

    Candidates are all words and word beginnings of toxic sample texts with more support than
    they get by chance with this probability, after varying words (else copies of one text would make
    terms of all its words). The greedy choice takes the one that explains most toxic
    texts, those already explained counting less each time, less a fine for clean texts
    that hold it; of equals the longest. Rows without id, text or label, and ids with
    several labels (the largest counts), don't disturb it; without any toxic row the
    lexicon is empty."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    # at most max_train rows of two numbers, so a broadcast of known size
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic")
    rows = written(rows, "toxicity-sample")

    def toxic_prefixes(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                n.update(_prefixes(fold(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    totals = {r.toxic > 0: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic:
        return Lexicon(exceptions=tuple(fold(x).strip() for x in exceptions))
    least = max(2, math.ceil(math.log(1 / chance) / math.log(1 / min(0.5, n_toxic / (n_toxic + n_clean)))))
    found = rows.where("toxic > 0").select("text").mapInArrow(tidy(toxic_prefixes), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= min(least, 3))
    support = {r.term: r.n for r in found.orderBy(F.desc("n"), "term").collect()}
    candidates = list(support)
    index = {t: k for k, t in enumerate(candidates)}

    def clean_counts(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                n.update({index[p] for p in _prefixes(fold(t)) if p in index})
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["k", "n"])

    clean = np.zeros(len(candidates))
    for r in rows.where("toxic <= 0").select("text").mapInArrow(tidy(clean_counts), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        clean[r.k] = r.n
    fine = 5.0 * n_toxic / max(1, n_clean)
    # what clean texts hold as often goes; the rest is a small list
    rare = np.flatnonzero(np.array([support[t] for t in candidates]) - fine * clean >= min(least, 3)) if candidates else []
    candidates, clean = [candidates[k] for k in rare], clean[rare]
    index = {t: k for k, t in enumerate(candidates)}

    def incidence(batches):
        for b in batches:
            out: list[list[bytes]] = [[], [], []]
            for t in b.column(0).to_pylist():
                before = _contexts(fold(t))
                has, many = {}, Counter()
                for w in before:
                    for p in _prefixes(w):
                        if (k := index.get(p)) is not None:
                            has[k] = w
                            many[k] += 1
                out[0].append(np.array(list(has), np.int32).tobytes())
                out[1].append(np.array([zlib.crc32(before[w].encode()) & 0xFFFF for w in has.values()], np.int32).tobytes())
                out[2].append(np.array([many[k] for k in has], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["ids", "after", "grown"])

    of: list[np.ndarray] = []
    places: dict[int, set[int]] = {}
    words, gain = np.zeros(len(candidates)), np.zeros(len(candidates))
    docs_of: dict[int, list[int]] = {}
    for r in rows.where("toxic > 0").select("text").mapInArrow(tidy(incidence), "ids binary, after binary, grown binary").collect():
        ids, after, grown = (np.frombuffer(x, np.int32) for x in (r.ids, r.after, r.grown))
        words[ids] += grown
        gain[ids] += 1
        for k, w in zip(ids.tolist(), after.tolist(), strict=True):
            places.setdefault(k, set()).add(w)
            docs_of.setdefault(k, []).append(len(of))
        of.append(ids)
    total = gain.copy()
    length = np.array([len(t) for t in candidates])
    varied = np.array([len(places.get(k, ())) >= 0.2 * total[k] for k in range(len(candidates))], dtype=bool)
    # a stem that many words grow from needs fewer texts
    open_ = varied & ((total - fine * clean >= least) | (clean == 0) & (total >= 3) & (words >= 2 * least))
    weight, terms = np.ones(len(of)), {}
    while open_.any():
        worth = np.where(open_, gain - fine * clean, -np.inf)
        if (best := worth.max()) < max(1.0, 0.002 * n_toxic):
            break
        k = int(max(np.flatnonzero(worth >= 0.98 * best), key=lambda j: (length[j], gain[j])))
        open_[k] = False
        # beginnings and continuations of a term bring nothing new
        for j in np.flatnonzero(open_):
            open_[j] = not (candidates[j].startswith(candidates[k]) or candidates[k].startswith(candidates[j]))
        terms[candidates[k]] = round(max(0.1, math.log((total[k] + 0.5) / (n_toxic + 1) / ((clean[k] + 0.5) / (n_clean + 1)))), 4)
        for d in docs_of[k]:
            gain[of[d]] -= 0.3 * weight[d]
            weight[d] *= 0.7
    lexicon = Lexicon(terms, tuple(fold(x).strip() for x in exceptions))
    if any(clean[index[t]] for t in terms):
        lexicon.exceptions += _harmless(rows, terms)

    def measured(batches):
        a = automaton(lexicon)
        for b in batches:
            w, n = [], []
            for t in b.column(0).to_pylist():
                f = fold(t)
                w.append(weigh(f, a)[1])
                n.append(len(f.split()))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), pa.array(n, pa.int64()), b.column(1).cast(pa.int32())], ["w", "n", "y"])

    got = rows.mapInArrow(tidy(measured), "w double, n long, y int").collect()
    x = np.array([_features(r.w, r.n) for r in got])
    y = np.array([float(r.y > 0) for r in got])
    if 0 < y.sum() < len(y):
        lexicon.curve = _curve(x, y)
    return lexicon


def _harmless(rows: DataFrame, terms: dict[str, float], least: int = 3, share: float = 0.9) -> tuple[str, ...]:
    """Word pairs around a term that stand in clean sample texts and hardly in toxic ones."""
    a = automaton(Lexicon(terms))

    def pairs(batches):
        for b in batches:
            n: Counter = Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, mine = fold(t).split(), set()
                for k, w in enumerate(words):
                    if weigh(w, a)[0]:
                        mine |= {" ".join(words[max(0, k - 1) : k + 1]), " ".join(words[k : k + 2])}
                n.update((p, int(y > 0)) for p in mine if " " in p)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n], pa.string()), pa.array([y for _, y in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["p", "y", "n"])

    found = rows.mapInArrow(tidy(pairs), "p string, y int, n long").groupBy("p").agg(F.sum(F.expr("if(y = 0, n, 0)")).alias("c"), F.sum("n").alias("n"))
    return tuple(r.p for r in found.where((F.col("c") >= least) & (F.col("c") >= share * F.col("n"))).orderBy(F.desc("c"), "p").collect())


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns in keep) with n_words, n_hits, weight, score and predicted of each row.

    A null or empty text has no words and the curve's least score. Rows are scored one
    by one, so repeated rows and null ids get their own results."""
    keep = keep or ["doc_id"]
    src = docs.select(*keep, F.col("text").alias("__text"))
    schema = src.select(*keep).schema.simpleString()[7:-1]

    def run(batches):
        a, (c0, c1, c2) = automaton(lexicon), lexicon.curve
        for b in in_slices(batches):
            n_words, n_hits, weight, p = [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                f = fold(t)
                h, w = weigh(f, a)
                n = len(f.split())
                _, x1, x2 = _features(w, n)
                n_words.append(n), n_hits.append(h), weight.append(w)
                p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * x1 + c2 * x2)))) if lexicon.terms else 0.0)
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            cols += [pa.array(n_words, pa.int64()), pa.array(n_hits, pa.int64()), pa.array(weight, pa.float64()), pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_words", "n_hits", "weight", "score", "predicted"])

    return src.mapInArrow(tidy(run), f"{schema}, n_words long, n_hits long, weight double, score double, predicted int")


def op3_toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, with n_words, n_hits and weight.

    Null and empty texts have no words and the curve's least score; without any toxic label
    outside the held-out fold every score is 0. Rows that repeat, and rows without id, are each
    scored; an empty table gives no rows. Other columns of both tables are left alone."""
    scored = score(docs, learn(docs, labels, **params))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_words", "n_hits", "weight")


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that aren't predicted toxic, with the columns of documents. Rows without
    text or id, and rows that repeat, are judged like all others."""
    scored = score(document_columns(docs), learn(docs, labels, **params), keep=["doc_id", "text", "lang", "source", "n_chars"])
    return document_columns(scored.where("predicted = 0"))
