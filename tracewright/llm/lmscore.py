"""Cross-entropy difference of two n-gram models (operator 6).

Target and background model share one vocabulary, the words of all documents, and one form:
a bigram model interpolated with a unigram model, which is smoothed by one count for each
word; a vocabulary of fewer than 2^16 words leaves the rest to words never seen. The
background is counted over all documents, the target over those whose label says good
quality. A token's loss is minus the log of its probability in bits; a document's score is
the mean over its tokens of target loss less background loss, so the lower, the more it is
like the target.

Words and pairs of words stand as 64-bit hashes, and nothing is folded further. The range
of hashes is cut into fragments, more of them the longer the texts:

1. Blocks of documents send their distinct words and pairs, with their counts in the block, to
   the fragments; a word that a third of all tokens are comes once from each block.
2. A fragment adds up the counts and hands them back to each block in the order in which they
   came, so no word or pair has to be named again.
3. Back in its block, the counts meet its documents, which a pass of its own over the texts
   sends there as places in a list of the block's words, and losses are added up by document.

Within its fragment a hash is told apart by 48 bits, so two of a million share one in about
one of 500 fragments. Only the sums of counts and the size of the vocabulary are known to all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import in_slices, written
from tracewright.llm.ngramjoin import Fragments, from_planes, planes
from tracewright.llm.shingles import fingerprint, joined_hashes, word_hashes

#: Least vocabulary as a power of 2, weight of the bigram model, tokens of a block of documents.
WORD_BITS, WEIGHT, BLOCK = 16, 0.7, 1 << 20


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass").lower())


def _slots(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, and of each token with the one before; the first token follows
    a value of its own, 0."""
    words = _words(text)
    if not len(words):
        return words.astype(np.int64), words.astype(np.int64)
    pairs = joined_hashes(np.concatenate([np.zeros(1, np.uint64), words]), 2)
    return words.view(np.int64), pairs.view(np.int64)


def _contexts(words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), words[:-1] + 1]) if len(words) else words


def _blocks(batches):
    """Keys and flags of documents of some BLOCK tokens together, and the words of each."""
    keys: list[int] = []
    good: list[bool] = []
    parts: list[np.ndarray] = []
    size = 0
    for b in in_slices(batches):
        for k, g, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            words = _words(text)
            if len(words):
                keys.append(k), good.append(g), parts.append(words)
                size += len(words)
                if size >= BLOCK:
                    yield np.array(keys, np.int64), np.array(good, bool), parts
                    keys, good, parts, size = [], [], [], 0
    if parts:
        yield np.array(keys, np.int64), np.array(good, bool), parts


def _edges(cut: Fragments, hashes: np.ndarray) -> list[int]:
    """Where each fragment's part of sorted hashes begins, and the end."""
    return [0, *np.searchsorted(hashes, np.array([cut.low(k) for k in range(1, cut.n)], np.uint64)), len(hashes)]


def totals_of(keyed: DataFrame, fragments: int) -> tuple[int, int, int, int, int]:
    """Tokens of all documents and of the good ones, documents with words and good ones among
    them, and distinct words. Words are counted where their hashes meet."""

    def run(batches):
        cut = Fragments(fragments)
        for _, good, parts in _blocks(batches):
            n = np.array(list(map(len, parts)))
            values = np.unique(np.concatenate(parts))
            edges = _edges(cut, values)
            mine = [k for k in range(fragments) if edges[k] < edges[k + 1]]
            sums = np.zeros((4, len(mine)), np.int64)
            sums[:, 0] = n.sum(), n[good].sum(), len(n), good.sum()
            cols = [pa.array(mine, pa.int32()), pa.array([cut.pack(k, values[edges[k] : edges[k + 1]]) for k in mine], pa.binary()), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(cols, ["frag", "words", "n", "t", "d", "g"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        distinct = len(np.unique(_six(b"".join(rows.words))))
        return pd.DataFrame({c: [rows[c].sum()] for c in "ntdg"} | {"v": [distinct]})

    rows = keyed.mapInArrow(run, "frag int, words binary, n long, t long, d long, g long")
    found = rows.groupBy("frag").applyInPandas(count, "n long, t long, d long, g long, v long")
    return tuple(found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "ntdgv"]).first())


_ROW = "frag int, block binary, kind int, x binary, y binary, z binary, u binary"
_NAMES = ["frag", "block", "kind", "x", "y", "z", "u"]


def _pair_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it, 0 at the beginning of a text."""
    seq = np.insert(words, starts, 0)
    return np.delete(joined_hashes(seq, 2), starts[1:] + np.arange(len(starts) - 1))


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n[:-1])]).astype(np.int64)


def _block_key(keys: np.ndarray, good: np.ndarray) -> bytes:
    return fingerprint(np.concatenate([keys, good.astype(np.int64)]))


def _block_rows(cut: Fragments, keys: np.ndarray, good: np.ndarray, parts: list[np.ndarray]) -> list[tuple]:
    """Kind 0, one for each fragment: distinct words and their counts (tokens, good tokens, and
    those of them with no token behind), distinct pairs and their counts, both by hash."""
    n = np.array(list(map(len, parts)))
    words = np.concatenate(parts)
    flag = good[np.repeat(np.arange(len(n)), n)]
    starts = _starts(n)
    last = np.zeros(len(words), bool)
    last[starts + n - 1] = True
    values, at = np.unique(words, return_inverse=True)
    pairs, of = np.unique(_pair_hashes(words, starts), return_inverse=True)
    many = [np.bincount(at, w, len(values)).astype(np.int64) for w in (None, flag, last, last & flag)]
    pair_n = [np.bincount(of, w, len(pairs)).astype(np.int64) for w in (None, flag)]
    block, p, w, rows = _block_key(keys, good), _edges(cut, pairs), _edges(cut, values), []
    for f in range(cut.n):
        if p[f] < p[f + 1] or w[f] < w[f + 1]:
            ws, ps = slice(w[f], w[f + 1]), slice(p[f], p[f + 1])
            rows.append((f, block, 0, cut.pack(f, values[ws]), b"".join(planes(c[ws]) for c in many), cut.pack(f, pairs[ps]), b"".join(planes(c[ps]) for c in pair_n)))
    return rows


def _documents_row(keys: np.ndarray, good: np.ndarray, parts: list[np.ndarray]) -> tuple:
    """Kind 1, one a block: keys of the documents, their tokens' number, the distinct words,
    frequent ones first, and each token's place in them."""
    values, at, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    order = np.argsort(-many, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return -1, _block_key(keys, good), 1, keys.tobytes(), planes(np.array(list(map(len, parts)))), values[order].tobytes(), planes(rank[at])


def _arrays(data: bytes, n: int) -> list[np.ndarray]:
    size = len(data) // n
    return [from_planes(data[k * size : (k + 1) * size]) for k in range(n)]


def _summed(items: list[np.ndarray], counts: list[list[np.ndarray]]) -> list[bytes]:
    """For each row the sums over all rows of the counts of its items, as 8 bytes each."""
    of = np.unique(np.concatenate(items), return_inverse=True)[1]
    sums = [np.bincount(of, np.concatenate(c))[of].astype("<i8") for c in zip(*counts, strict=True)]
    ends = np.cumsum([0, *map(len, items)])
    # byte by byte, so that high zeros compress away
    return [b"".join(s[lo:hi].view(np.uint8).reshape(-1, 8).T.tobytes() for s in sums) for lo, hi in zip(ends, ends[1:], strict=False)]


def _six(data: bytes) -> np.ndarray:
    return np.pad(np.frombuffer(data, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel()


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """A fragment: its counts over all blocks, to each block in the order of its words and pairs."""
    words = _summed([_six(x) for x in rows.x], [_arrays(y, 4) for y in rows.y])
    pairs = _summed([_six(z) for z in rows.z], [_arrays(u, 2) for u in rows.u])
    return pd.DataFrame({"frag": rows.frag, "block": rows.block, "kind": 0, "x": b"", "y": words, "z": b"", "u": pairs})


def _joined(parts, n: int) -> list[np.ndarray]:
    """The n arrays of 8 byte counts of which each part has a piece."""
    pieces = []
    for data in parts:
        size = len(data) // (8 * n)
        pieces.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(n, 8, size).transpose(0, 2, 1)).view("<i8").reshape(n, size))
    return list(np.concatenate(pieces, axis=1))


def _losses(pairs: np.ndarray, contexts: np.ndarray, words: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    return -np.log2(WEIGHT * pairs / np.maximum(contexts, 1) + (1 - WEIGHT) * (words + 1) / (total + vocabulary))


def _scored(rows: pd.DataFrame, totals: tuple[int, int, int, int, int]) -> pd.DataFrame:
    """key, c (1), n (tokens), t and b (sums of target and background losses) of a block's documents."""
    background, target, starts, good_starts, vocabulary = totals
    rows = rows.drop_duplicates(["frag", "kind"]).sort_values("frag")
    if set(rows.kind) != {0, 1}:
        raise ValueError("the table gave other rows when it was read again")
    own, block = rows[rows.kind == 0], rows[rows.kind == 1].iloc[0]
    b, t, last_b, last_t = _joined(own.y, 4)
    pair_b, pair_t = _joined(own.u, 2)
    context_b, context_t = np.append(starts, b - last_b), np.append(good_starts, t - last_t)
    keys, n = np.frombuffer(block.x, np.int64), from_planes(block.y)
    values, place = np.frombuffer(block.z, np.uint64), from_planes(block.u)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at, first = rank[place], _starts(n)
    before = np.concatenate([[0], at[:-1] + 1])
    before[first] = 0
    of = np.unique(_pair_hashes(values[place], first), return_inverse=True)[1]
    doc = np.repeat(np.arange(len(n)), n)
    sums = {}
    for name, counts in (("t", (pair_t, context_t, t, target)), ("b", (pair_b, context_b, b, background))):
        sums[name] = np.bincount(doc, _losses(counts[0][of], counts[1][before], counts[2][at], counts[3], vocabulary))
    return pd.DataFrame({"key": keys, "c": 1, "n": n} | sums)


def op6_lm_score(docs: DataFrame, labels: DataFrame, fragment_chars: int = 4_000_000, broadcast_rows: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row.

    Words are runs of other than white space, A-Z in lower case. Texts without words, null
    ones among them, have no tokens and null losses. Several labels of an id count once if
    one is good; without any good label the target knows nothing and all its tokens have
    the same loss. Rows that repeat are counted and scored as often as they stand. docs must
    be a stable table, as files are: blocks are told apart by what they hold."""
    src = docs.select("doc_id", F.col("text").alias("__text")).withColumn("__key", F.xxhash64("doc_id", "__text"))
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id", F.lit(True).alias("__good")).distinct()
    few = good.count() <= broadcast_rows
    keyed = src.where("__text is not null").join(F.broadcast(good) if few else good, "doc_id", "left").select("__key", F.coalesce("__good", F.lit(False)).alias("__good"), "__text")
    # the passes below must see the same rows in the same order
    keyed = keyed if few else written(keyed, "lm-texts")
    fragments = max(8, 1 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // fragment_chars)

    totals = totals_of(keyed, fragments)
    totals = (*totals[:4], max(totals[4], 1 << WORD_BITS))

    def sender(make):
        def send(batches):
            kinds = [pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
            for block in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*make(block), strict=True), kinds, strict=True)], _NAMES)

        return send

    counted = keyed.mapInArrow(sender(lambda block: _block_rows(Fragments(fragments), *block)), _ROW).groupBy("frag").applyInPandas(_counted, _ROW)
    both = counted.union(keyed.mapInArrow(sender(lambda block: [_documents_row(*block)]), _ROW))
    sums = both.groupBy("block").applyInPandas(lambda rows: _scored(rows, totals), "key long, c long, n long, t double, b double")
    # rows that repeat share a key: their sums and n grow alike
    scores = written(sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in "cntb"]), "lm-scores")
    t, b = F.col("t") / F.col("n"), F.col("b") / F.col("n")
    n_tokens = F.coalesce(F.expr("n div c"), F.lit(0)).cast("long").alias("n_tokens")
    return src.select("doc_id", "__key").join(scores, F.col("__key") == F.col("key"), "left").select("doc_id", n_tokens, t.alias("target_loss"), b.alias("background_loss"), (t - b).alias("score"))
