"""Similarity join of documents on word n-grams by vertical partitioning (operator 8).

A document's set is its distinct 5-word shingles, as 64-bit hashes; equal sets are one
node of the graph of links. The range of n-grams is cut into fragments at even steps,
and each fragment's task sees the segments that fall into it, of all sets:

1. It counts its n-grams, drops those that one set alone has and hands back the rest
   with their counts. An n-gram that many sets of one batch have is counted in the batch
   and sent once, so no task collects the holders of a frequent n-gram.
2. Back with its set, the n-grams are put in order of rarity. Two sets that reach the
   threshold share one of the first n - ceil(t n) + 1 n-grams of either; a set whose
   first ones are all its own can have no partner and is done.
3. Candidates share a first n-gram. In the first rounds each set is compared with one
   leader only, then with the leaders of all its n-grams, always leaving out pairs that
   the links found so far have joined to one component; the last round compares the holders
   of n-grams that are still held in several components, of which one at least must have the
   n-gram among its first seventh. So a group of near copies takes about as many pairs as it
   has members, and no link between components is missed.
4. Overlaps of candidates are counted per fragment, and the counts summed per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import shingles
from tracewright.llm.common import DOC_COLUMNS, document_columns, give_back, in_slices, salted_join, tidy, written
from tracewright.llm.components import components

THRESHOLD = 75  # per cent
#: Bytes of text whose n-grams one fragment's task gets on the mean, and of a batch.
FRAGMENT_BYTES = BATCH_BYTES = 4 << 20
#: So many sets of a batch make an n-gram frequent there.
FREQUENT = 64
#: Bits by which n-grams of one fragment are told apart.
BITS = 48
#: Mean n-grams of the longest set in a fragment in which overlaps of candidates are counted.
SEGMENT = 4096
#: Most candidates whose sets' fingerprints are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 500_000
#: Most dropped documents whose keys are broadcast; more are joined by shuffle.
BROADCAST_DROPS = 1_000_000
#: 64-bit words of a set's parity sketch.
SKETCH = 8


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and fp (128 bits of the set; null for an empty
    one) of each row."""
    src = docs.select("doc_id", F.xxhash64("text").alias("__th"), F.col("text").alias("__text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in in_slices(batches):
            sets = shingles.shingle_sets(b.column(2).to_pylist())
            fps = [shingles.fingerprint(s) if len(s) else None for s in sets]
            cols = [b.column(0), b.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n_shingles", "fp"])

    return src.mapInArrow(tidy(run), f"doc_id {kind}, th long, n_shingles long, fp binary")


class Fragments:
    """Even steps of the range of n-grams, and n-grams in a fragment as six bytes each."""

    def __init__(self, n: int):
        self.n = n
        self.step = -(-(1 << 64) // n)
        self.shift = np.uint64(max(0, self.step.bit_length() - BITS))

    def low(self, k: int) -> np.uint64:
        return np.uint64(min(k * self.step, (1 << 64) - 1))

    def pack(self, k: int, tokens: np.ndarray) -> bytes:
        return ((tokens - self.low(k)) >> self.shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

    def unpack(self, k: int, data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
        return (wide.view("<u8").ravel() << self.shift) + self.low(k)

    def whole(self, tokens: np.ndarray) -> np.ndarray:
        """Sorted tokens as they come back from unpack."""
        cut = [0, *np.searchsorted(tokens, [self.low(k) for k in range(1, self.n)]), len(tokens)]
        return np.concatenate([((tokens[lo:hi] - self.low(k) >> self.shift) << self.shift) + self.low(k) for k, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False))])


_ROW = "frag int, batch binary, kind int, tokens binary, who binary, freq binary"


def _batch_rows(sets: dict[bytes, np.ndarray], cut: Fragments) -> list[tuple]:
    fps, arrays = list(sets), list(sets.values())
    sizes = np.array([len(a) for a in arrays], np.int32)
    tokens, who = np.concatenate(arrays), np.repeat(np.arange(len(fps), dtype=np.int32), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    count = np.diff(np.concatenate([first, [len(tokens)]]))
    often = count >= FREQUENT
    is_often = np.repeat(often, count)
    key = shingles.fingerprint(np.frombuffer(b"".join(fps), np.uint8))
    hot, hot_n = tokens[first[often]], count[often]
    mine, my_who = tokens[is_often], who[is_often]
    tokens, who = tokens[~is_often], who[~is_often]
    edges = np.array([cut.low(k) for k in range(1, cut.n)], np.uint64)
    p, h = [0, *np.searchsorted(tokens, edges), len(tokens)], [0, *np.searchsorted(hot, edges), len(hot)]
    rows = []
    for f in range(cut.n):
        if p[f] < p[f + 1] or h[f] < h[f + 1]:
            # by holder, so that holders are small steps; frequent ones behind
            t, w = tokens[p[f] : p[f + 1]], who[p[f] : p[f + 1]]
            order = np.argsort(w, kind="stable")
            rows.append((f, key, 0, cut.pack(f, t[order]) + cut.pack(f, hot[h[f] : h[f + 1]]), _steps(w[order]), planes(hot_n[h[f] : h[f + 1]])))
    # equal sets of several batches: the fragment of a set's fingerprint says whose it is
    home: dict[int, list[int]] = {}
    for k, fp in enumerate(fps):
        home.setdefault(int.from_bytes(fp[:4], "big") % cut.n, []).append(k)
    rows += [(f, key, 3, b"".join(fps[k] for k in ks), np.array(ks, "<i4").tobytes(), b"") for f, ks in home.items()]
    again = cut.whole(mine) if len(mine) else mine
    rows.append((int.from_bytes(key[:4], "big") % cut.n, key, 1, b"".join(fps) + sizes.tobytes(), again.tobytes(), my_who.tobytes()))
    return rows


def planes(x: np.ndarray) -> bytes:
    """Numbers under 2^32, byte by byte of all of them, so that high zeros compress away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _steps(who: np.ndarray) -> bytes:
    return planes(np.diff(who, prepend=0))


def _holders(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data))


def _segments(docs: DataFrame, fragments: int) -> DataFrame:
    """Rows for each batch of documents and fragment that has n-grams of it: kind 0 has
    n-grams and their holders, then frequent n-grams and their counts; kind 1 (one a batch)
    the fingerprints and sizes, with the holders of frequent n-grams; kind 3 the
    fingerprints that are compared in this fragment, and their places. All are sparse: what
    a batch sends is in proportion to its text, whatever the number of fragments."""

    def run(batches):
        cut = Fragments(fragments)
        kinds = [pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        sets: dict[bytes, np.ndarray] = {}
        size = 0

        def out():
            rows = _batch_rows(sets, cut)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["frag", "batch", "kind", "tokens", "who", "freq"])

        for b in in_slices(batches):
            for s in shingles.shingle_sets(b.column(0).to_pylist()):
                if len(s):
                    sets.setdefault(shingles.fingerprint(s), s)
            size += b.column(0).nbytes
            if size >= BATCH_BYTES and sets:
                yield out()
                sets, size = {}, 0
        if sets:
            yield out()

    return docs.select("text").mapInArrow(tidy(run), _ROW)


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """A fragment: its n-grams that several sets have, by batch, with their counts. Rows of
    kind 1 pass. Kind 0 goes out with freq for the plain n-grams, kind 2 for frequent ones,
    kind 4 with the places of sets that the batch of least key stands for. Batches that hold
    the same count once."""
    rows = rows.drop_duplicates(["batch", "kind"])
    meta, own = rows[rows.kind == 1], rows[rows.kind == 0]
    out = [tuple(r) for r in meta.itertuples(index=False)]
    owner: dict[bytes, bytes] = {}
    homes = rows[rows.kind == 3]
    for key, fps in zip(homes.batch, homes.tokens, strict=True):
        for k in range(0, len(fps), 16):
            fp = fps[k : k + 16]
            owner[fp] = min(key, owner.get(fp, key))
    for key, fps, places in zip(homes.batch, homes.tokens, homes.who, strict=True):
        other = [places[k // 4 : k // 4 + 4] for k in range(0, len(fps), 16) if owner[fps[k : k + 16]] != key]
        if other:
            out.append((0, key, 4, b"", b"".join(other), b""))
    # six bytes an n-gram are compared as they are
    tokens = [np.pad(np.frombuffer(x, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel() for x in own.tokens]
    hot_n = [from_planes(x) for x in own.freq]
    if tokens:
        every = np.concatenate(tokens)
        weight = np.concatenate([np.concatenate([np.ones(len(t) - len(n), np.int64), n]) for t, n in zip(tokens, hot_n, strict=True)])
        del tokens
        order = np.argsort(every, kind="stable")
        every = every[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        total = np.minimum(np.add.reduceat(weight[order], np.flatnonzero(new)), (1 << 31) - 1)
        df = np.empty(len(every), np.int32)
        df[order] = total[np.cumsum(new) - 1]
        at = 0
        for frag, key, raw, who, n in zip(own.frag, own.batch, own.tokens, own.who, hot_n, strict=True):
            six, size = np.frombuffer(raw, np.uint8).reshape(-1, 6), len(raw) // 6 - len(n)
            d = df[at : at + len(six)]
            at += len(six)
            keep = d[:size] > 1
            if keep.any():
                out.append((frag, key, 0, six[:size][keep].tobytes(), _steps(_holders(who)[keep]), planes(d[:size][keep])))
            if len(n):
                out.append((frag, key, 2, six[size:].tobytes(), b"", planes(d[size:])))
    return pd.DataFrame(out, columns=["frag", "batch", "kind", "tokens", "who", "freq"])


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (THRESHOLD * n + 99) // 100 + 1


def _ordered(cut: Fragments, rows: pd.DataFrame) -> pd.DataFrame:
    """A batch: each set that may have a partner, with the n-grams it shares in the order
    of rarity; own is the number of those that it has alone, p that of first n-grams left."""
    meta = rows[rows.kind == 1].iloc[0]
    n_sets = len(meta.tokens) // 20
    fps = [meta.tokens[16 * k : 16 * k + 16] for k in range(n_sets)]
    sizes = np.frombuffer(meta.tokens, np.int32, n_sets, 16 * n_sets).astype(np.int64)
    plain, often = rows[rows.kind == 0], rows[rows.kind == 2]
    tokens = [cut.unpack(f, x) for f, x in zip(plain.frag, plain.tokens, strict=True)]
    who = [_holders(x) for x in plain.who]
    df = [from_planes(x) for x in plain.freq]
    if len(often):
        hot = np.concatenate([cut.unpack(f, x) for f, x in zip(often.frag, often.tokens, strict=True)])
        hot_df = np.concatenate([from_planes(x) for x in often.freq])
        order = np.argsort(hot)
        mine = np.frombuffer(meta.who, np.uint64)
        tokens.append(mine)
        who.append(np.frombuffer(meta.freq, np.int32).astype(np.int64))
        df.append(hot_df[order][np.searchsorted(hot[order], mine)])
    out = []
    if tokens:
        t, w, d = np.concatenate(tokens), np.concatenate(who), np.concatenate(df)
        shared = np.bincount(w, minlength=n_sets)
        left = prefix_length(sizes) - (sizes - shared)
        for x in rows[rows.kind == 4].who:
            left[np.frombuffer(x, "<i4")] = 0
        may = left[w] > 0
        t, w, d = t[may], w[may], d[may]
        order = np.lexsort((t, d, w))
        t, w = t[order], w[order]
        edges = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1), len(w)] if len(w) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            k = w[lo]
            out.append((fps[k], int(sizes[k]), int(sizes[k] - shared[k]), int(left[k]), t[lo:hi].view(np.int64), sketch(t[lo:hi])))
    return pd.DataFrame(out, columns=["fp", "n", "own", "p", "tokens", "sketch"])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of how many n-grams fall on each of 512 bits. The bits in which two sketches
    differ are no more than the n-grams that one of the two sets has alone."""
    bits = (tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def shared_sets(docs: DataFrame) -> DataFrame:
    """id (a number of its own), fp, n, own, p, tokens and sketch of the distinct sets that may
    have a partner."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(8, math.ceil(n_bytes / FRAGMENT_BYTES))
    counted = _segments(docs, fragments).groupBy("frag").applyInPandas(_counted, _ROW)
    cut = Fragments(fragments)

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return _ordered(cut, rows)
        finally:
            give_back()

    sets = counted.groupBy("batch").applyInPandas(ordered, "fp binary, n int, own int, p int, tokens array<long>, sketch array<long>")
    return written(sets.withColumn("id", F.monotonically_increasing_id()), "shared-sets")


def _cut(held: DataFrame) -> DataFrame:
    """id, parts, g and seg: the n-grams of each set by fragment, of which there are parts."""

    def run(batches):
        for b in batches:
            ids, parts, g, seg = [], [], [], []
            for k, n, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = tokens.values.to_numpy()
                at = np.zeros(len(t), np.int64) if n == 1 else ((t / 2.0**64 + 0.5) * n).astype(np.int64)
                order = np.argsort(at, kind="stable")
                edges = [0, *(np.flatnonzero(np.diff(at[order])) + 1), len(t)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if lo < hi:
                        ids.append(k), parts.append(n), g.append(int(at[order[lo]])), seg.append(t[order[lo:hi]])
            cols = [pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(g, pa.int32()), pa.array(seg, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "parts", "g", "seg"])

    return held.select("id", "parts", "tokens").mapInArrow(tidy(run), "id long, parts int, g int, seg array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold: for those whose sketches leave
    it within reach, overlaps are counted in each fragment by itself and summed per pair. The
    larger of two sets says how many fragments there are, so none of their parts is long."""
    slim = sets.select("id", F.struct("n", "own", "sketch").alias("s"))
    near = pairs.join(slim.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    near = near.join(slim.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").where(_alike("x", "y"))
    parts = F.ceil(F.greatest("x.n", "y.n") / F.lit(SEGMENT)).cast("int").alias("parts")
    near = written(near.select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), parts), "alike")
    ends = near.select(F.explode(F.array("a", "b")).alias("id"), "parts").distinct()
    if near.count() <= BROADCAST_PAIRS:
        # 12 bytes a set; the arrays of sets without candidates stay where they are
        ends = F.broadcast(ends)
    held = _cut(sets.join(ends, "id"))
    left, right = (held.select(F.col("id").alias(s), "parts", "g", F.col("seg").alias("s" + s)) for s in "ab")
    counted = near.join(left, ["a", "parts"]).join(right, ["b", "parts", "g"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o"))
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(f"100 * o >= {THRESHOLD} * (na + nb - o)").select("a", "b")


def _near(a: str, b: str) -> str:
    """Sizes, and places of the first common n-gram, that leave the threshold within reach."""
    most = f"least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    return f"100 * least({a}.n, {b}.n) >= {THRESHOLD} * greatest({a}.n, {b}.n) and 100 * {most} >= {THRESHOLD} * ({a}.n + {b}.n - {most})"


def _alike(a: str, b: str) -> str:
    """Sketches that leave the threshold within reach: the n-grams that either has alone are
    at most what the sizes allow."""
    differ = " + ".join(f"bit_count({a}.sketch[{k}] ^ {b}.sketch[{k}])" for k in range(SKETCH))
    return f"{100 + THRESHOLD} * ({a}.own + {b}.own + {differ}) <= {100 - THRESHOLD} * ({a}.n + {b}.n)"


def _leaders(at: DataFrame) -> DataFrame:
    """Of each n-gram held in several components: the holders of least and greatest component,
    and as lead the one that has it foremost for its size."""
    member = F.struct("comp", "id", "n", "pos")
    foremost = F.struct((F.col("pos") * 16 / F.col("n")).cast("int").alias("rank"), "id", "comp", "n", "pos")
    found = at.groupBy("token").agg(F.min(member).alias("x"), F.max(member).alias("y"), F.min(foremost).alias("lead"))
    return found.where("x.comp < y.comp")


def set_components(docs: DataFrame) -> DataFrame:
    """(fp, comp) of the sets with links; comp is the fp of one of the component's sets."""
    sets = shared_sets(docs)
    exploded = sets.select("id", "n", F.posexplode(F.slice("tokens", F.lit(1), F.col("p"))).alias("k", "token"), (F.col("own") + F.col("k")).alias("pos")).drop("k")
    several = exploded.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    open_rows = written(exploded.join(several, "token", "left_semi"), "first-ngrams")
    comps = links = None
    for what in ("one", "leaders", "rest"):
        # an n-gram whose holders are in one component has no more to tell
        if comps is None:
            at = open_rows.withColumn("comp", F.col("id"))
            leaders = _leaders(at)
        else:
            at = written(open_rows.join(comps.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "open-ngrams")
            leaders = _leaders(at)
            if what == "leaders":
                leaders = written(leaders, "leaders")
        if what == "one":
            best = F.struct("lead.rank", "lead.id", "lead.n", "lead.pos")
            other = F.struct(F.lit(99).alias("rank"), "x.id", "x.n", "x.pos")
            both = at.alias("a").join(leaders.select("token", F.explode(F.array(best, other)).alias("b")), "token").where("a.id <> b.id").where(_near("a", "b"))
            both = both.groupBy(F.col("a.id").alias("p")).agg(F.min(F.struct("b.rank", "b.id")).alias("b")).select("p", F.col("b.id").alias("q"))
        elif what == "leaders":
            shape = [F.struct(f"{s}.id", f"{s}.comp", f"{s}.n", f"{s}.pos") for s in ("x", "y", "lead")]
            to = leaders.select("token", F.explode(F.array_distinct(F.array(*shape))).alias("b"))
            both = at.alias("a").join(to, "token").where("a.comp <> b.comp").where(_near("a", "b"))
            both = both.select(F.col("a.id").alias("p"), F.col("b.id").alias("q"))
        else:
            # the places of the first common n-gram add up to a seventh of both sizes at most
            front = "{0}.pos * (100 + {1}) <= {0}.n * (100 - {1})"
            at = at.join(leaders.select("token"), "token", "left_semi").join(sets.select("id", "own", "sketch"), "id")
            both = at.alias("a").where(front.format("a", THRESHOLD)).join(at.alias("b"), "token").where("a.comp <> b.comp")
            both = both.where(f"a.id < b.id or not ({front.format('b', THRESHOLD)})").where(_near("a", "b")).where(_alike("a", "b"))
            both = both.select(F.col("a.id").alias("p"), F.col("b.id").alias("q"))
        pairs = written(both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "candidates")
        if pairs.isEmpty():
            continue
        found = written(_linked(pairs, sets), "found")
        links = found if links is None else links.union(found)
        comps = components(links)
    if comps is None:
        return sets.select("fp", F.col("fp").alias("comp")).where("false")
    named = sets.select(F.col("id").alias("node"), "fp")
    tops = named.select(F.col("node").alias("comp"), F.col("fp").alias("top"))
    return salted_join(comps.join(named, "node"), tops, "comp", "node").select("fp", F.col("top").alias("comp"))


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, comp (null for empty sets) and component_id of every row."""
    rows = written(document_sets(docs), "document-sets")
    comps = set_components(docs)
    same = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("d"), F.count("*").alias("c"))
    of = same.join(comps, "fp", "left").where("c > 1 or comp is not null").select("fp", F.coalesce("comp", "fp").alias("comp"), "d")
    of = written(of, "set-components")
    least = of.groupBy("comp").agg(F.min("d").alias("component_id"))
    of = salted_join(of.select("fp", "comp"), least, "comp", "fp").select("fp", "comp", "component_id")
    # rows without a set have a key each, which no set has
    key = F.coalesce("fp", F.encode(F.xxhash64("doc_id", "th").cast("string"), "utf-8"))
    out = salted_join(rows.withColumn("fp", key).withColumn("own", F.when(F.col("n_shingles") > 0, F.col("fp"))), of, "fp", "doc_id", "th")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("comp", "own").alias("comp"), component)


def op8_ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null and empty texts have empty sets, which have no links: their component is their
    own id. Rows with equal sets are linked, whatever their ids; rows without id take
    part, and a component of such rows alone has none. docs must be a stable table, as
    files are: batches are told apart by what they hold."""
    return _placed(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the least id (rows without id come last), of those
    the one with the least hash of its text, of these the least in its other columns. Rows
    of one id with texts of different components are judged apart. Rows without words stay
    all."""
    rows = written(_placed(docs).where("n_shingles > 0"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    best = rows.groupBy("comp").agg(F.min(order).alias("best"))
    gone = salted_join(rows.select("comp", "doc_id", "th"), best, "comp", "doc_id", "th").where(~order.eqNullSafe(F.col("best")))
    gone = written(gone.select("doc_id", "th").distinct(), "gone")
    often = rows.groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "th")

    def keyed(keys: DataFrame) -> tuple[DataFrame, Column]:
        keys = keys.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_DROPS else keys
        return keys, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t"))

    keys, same = keyed(gone)
    kept = document_columns(docs).withColumn("__th", F.xxhash64("text")).join(keys, same, "left_anti")
    again, same = keyed(often)
    if not again.isEmpty():
        other = kept.join(again, same, "left_anti")
        one = kept.join(again, same, "left_semi").groupBy("doc_id", "__th").agg(F.min(F.struct(*DOC_COLUMNS)).alias("r")).select("r.*", "__th")
        kept = other.unionByName(one)
    return document_columns(kept)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
e AS (SELECT a.doc_id x, b.doc_id y FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.x, r.c FROM r JOIN e ON e.y = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = w.doc_id) component_id FROM w LEFT JOIN n USING (doc_id)
"""
