"""Approximate nearest neighbours over stable projections (operator 10).

Vectors are put on a sphere, so that the largest inner product is the least distance:
a stored vector x becomes (x, sqrt(R^2 - |x|^2)) and a query, scaled to the length R, (q, 0).
Gaussian projections, which are 2-stable, to a few dimensions keep distances in
distribution: the squared projected distance over the true one follows chi-square.

The top of a kd-tree over the projections, fitted on a bounded sample, deals every vector to
one cell, and a cell of many vectors to several blocks by a hash of vec_id, so that one
frequent vector spreads over many. Each block has its part of the tree, built once. A query
first searches the cell nearest to it, which gives a bound for its k-th distance, and then
those cells whose boxes the chi-square test can't rule out by that bound.

In a block, a query opens leaves in the order of their projected distance and verifies
projected neighbours, nearest first, by inner product until the chi-square test holds: a
vector nearer than the k-th found would have shown a projection nearer than the next one
with at least the probability `confidence`. The best of all blocks are taken per query in
the shuffle.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.common import written

DIMS, LEAF, CONFIDENCE, SEED = 24, 64, 0.95, 20_240_501
#: Vectors on which the top of the tree is fitted, and its most cells. Larger tables have more
#: blocks a cell.
SAMPLE, CELLS = 20_000, 1024


@functools.cache
def projection(width: int, dims: int = DIMS) -> np.ndarray:
    """The same Gaussian matrix in every task."""
    return np.random.default_rng(SEED).standard_normal((width, dims))


def lifted(x: np.ndarray, r2: float) -> np.ndarray:
    """Projections of vectors of at most the squared length r2, put on its sphere."""
    up = np.sqrt(np.maximum(r2 - np.einsum("ij,ij->i", x, x), 0))
    a = projection(x.shape[1] + 1)
    return x @ a[:-1] + up[:, None] * a[-1]


def chi_square_cdf(x: np.ndarray, k: int) -> np.ndarray:
    """For even k: 1 - exp(-x/2) times the first k/2 terms of the exponential series."""
    h = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, k // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


@functools.cache
def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return high


class KdTree:
    """Leaves of a balanced kd-tree, each with the box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        parts, done = [np.arange(len(points))], []
        while parts:
            p = parts.pop()
            if len(p) <= leaf:
                done.append(p)
                continue
            own = points[p]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            half = len(p) // 2
            order = np.argpartition(own[:, axis], half)
            parts += [p[order[:half]], p[order[half:]]]
        self.order = np.concatenate(done)
        self.bounds = np.cumsum([0, *map(len, done)])
        self.low = np.array([points[p].min(0) for p in done])
        self.high = np.array([points[p].max(0) for p in done])


class Cells:
    """The top of the tree: splits of a sample's projections until there are about n cells. Every
    vector falls into one of them."""

    def __init__(self, points: np.ndarray, n: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, places of both sides or -1 - cell
        self.n = 0

        def split(own: np.ndarray, want: int) -> int:
            span = own.max(0) - own.min(0) if len(own) > 1 else np.zeros(1)
            if want < 2 or not span.max() > 0:
                self.n += 1
                return -self.n
            axis = int(np.argmax(span))
            value = float(np.median(own[:, axis]))
            left = own[:, axis] < value
            if not left.any():
                value = float(own[own[:, axis] > value, axis].min())
                left = own[:, axis] < value
            k = len(self.nodes)
            self.nodes.append((axis, value, 0, 0))
            self.nodes[k] = (axis, value, split(own[left], want // 2), split(own[~left], want - want // 2))
            return k

        self.root = split(points, n) if len(points) else -1
        self.n = max(self.n, 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            k, rows = todo.pop()
            if k < 0:
                cell[rows] = -1 - k
            elif len(rows):
                axis, value, low, high = self.nodes[k]
                left = points[rows, axis] < value
                todo += [(low, rows[left]), (high, rows[~left])]
        return cell


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each query to each box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        gap = np.maximum(low[None, :, k] - q[:, None, k], 0) + np.maximum(q[:, None, k] - high[None, :, k], 0)
        out += gap * gap
    return out


class Block:
    """Rows of one block: distinct vectors, the ids of each, and the tree over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, r2: float | None = None):
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        self.ids, self.keep = ids[order], keep
        self.starts = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
        self.x = distinct.astype(np.float64)
        self.r2 = float(np.einsum("ij,ij->i", self.x, self.x).max()) if r2 is None else r2
        points = lifted(self.x, self.r2)
        self.tree = KdTree(points)
        self.points, self.xo = points[self.tree.order].astype(np.float32), self.x[self.tree.order].astype(np.float32)
        self.verified = 0  # vectors whose inner product was taken

    def nearest(self, query_id: int, q: np.ndarray, confidence: float = CONFIDENCE, bound: float = -math.inf) -> list[tuple[float, int]]:
        """(score, vec_id) of the nearest rows; bound: a score that the k-th nearest reaches at
        least, as other blocks say."""
        length = math.sqrt(self.r2)
        unit = q / math.sqrt(q @ q)
        near = (length * unit @ projection(len(q) + 1)[:-1]).astype(np.float32)
        unit = unit.astype(np.float32)
        reach, k, tree = chi_square_quantile(confidence, DIMS), self.keep + 1, self.tree
        kth = bound / math.sqrt(q @ q)

        def stop() -> float:
            return reach * max(2 * self.r2 - 2 * length * kth, 1e-12 * self.r2) if kth > -math.inf else math.inf

        boxes = box_distances(near[None], tree.low, tree.high)[0]
        leaves = np.argsort(boxes, kind="stable")
        boxes = boxes[leaves]
        scores, rows, open_rows, open_d, at, step = [], [], np.zeros(0, np.int64), np.zeros(0, np.float32), 0, 4
        best = np.full(k, -math.inf, np.float32)
        last = False
        while not last:
            if at < len(leaves) and boxes[at] < stop():
                took = leaves[at : at + step]
                part = np.concatenate([np.arange(tree.bounds[j], tree.bounds[j + 1]) for j in took])
                gap = self.points[part] - near
                open_rows, open_d = np.concatenate([open_rows, part]), np.concatenate([open_d, np.einsum("ij,ij->i", gap, gap)])
                at += step
                step = at
            last = at >= len(leaves) or boxes[at] >= stop()
            # projected neighbours up to the next leaf's box are complete: verify them, nearest first
            due = open_d < min(math.inf if last else boxes[at], stop())
            mine = np.flatnonzero(due)
            mine = mine[np.argsort(open_d[mine])]
            lo, take = 0, 2 * k
            while lo < len(mine) and open_d[mine[lo]] < stop():
                chunk = open_rows[mine[lo : lo + take]]
                scores.append(self.xo[chunk] @ unit)
                rows.append(chunk)
                self.verified += len(chunk)
                best = np.partition(np.concatenate([best, scores[-1]]), len(chunk))[-k:]
                kth = max(kth, float(best.min()) - 1e-6 * length)
                lo, take = lo + take, 2 * take
            open_rows, open_d = open_rows[~due], open_d[~due]
        if not rows:
            return []
        s, part = np.concatenate(scores), np.concatenate(rows)
        if len(s) > 2 * k:
            # these products are rounded; what is near the cut is worked out again below
            cut = np.partition(s, len(s) - k)[len(s) - k]
            part = part[s >= cut - 1e-5 * length]
        found = []
        for row in tree.order[part]:
            score = math.fsum((self.x[row] * q).tolist())
            own = self.ids[self.starts[row] : self.starts[row + 1]][: self.keep + 1]
            found += [(score, int(i)) for i in own if i != query_id]
        found.sort(key=lambda t: (-t[0], t[1]))
        return found[: self.keep]


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: an id, a common width, and
    finite components that aren't all zero. One row of each id, the least vector."""
    e = F.col("embedding")
    fine = df.select("vec_id", e.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(e, lambda v: v != 0)
    )
    return fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _searched(dealt: DataFrame, wanted: DataFrame, asked: DataFrame, keep: int, query_rows: int, r2: dict[int, float], confidence: float) -> DataFrame:
    """query_id, vec_id and score of the nearest in each block to the queries that want it; wanted
    has block, vec_id and bound. Blocks meet about query_rows queries at a time."""
    many = wanted.groupBy("block").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
    left = dealt.join(many, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "embedding")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    right = wanted.join(many, "block").select("block", part, "vec_id", "bound").join(asked.select("vec_id", "embedding"), "vec_id")

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(v) and len(q):
            x = np.stack(v["embedding"].to_numpy())
            b = Block(v["vec_id"].to_numpy(np.int64), x, keep, r2[x.shape[1]])
            for i, e, bound in zip(q["vec_id"].tolist(), q["embedding"], q["bound"].tolist(), strict=True):
                out += [(i, j, s) for s, j in b.nearest(i, np.asarray(e, np.float64), confidence, bound)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, keep: int = 20, block_rows: int = 16_384, query_rows: int = 8192, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest vectors, itself left out.

    Each vector is in one block of about block_rows; a block meets those queries that the
    chi-square test sends to it, some query_rows at a time, so no task's memory grows with
    the input. Vectors of another width than the query's take no part in its search; only the
    most frequent width has cells, those of others are one cell each."""
    rows = written(usable(vectors).withColumn("width", F.size("embedding")), "vectors")
    asked = written(usable(queries).withColumn("width", F.size("embedding")), "queries")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    found = rows.groupBy("width").agg(F.max(norm).alias("r2"), F.count("*").alias("n")).collect()
    r2 = {r.width: r.r2 * (1 + 1e-12) for r in found}
    main, n = max(((r.width, r.n) for r in found), key=lambda x: (x[1], x[0]), default=(0, 0))
    sample = rows.where(F.col("width") == main).orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    points = lifted(np.stack(sample.to_numpy()).astype(np.float64), r2[main]) if n else np.zeros((0, DIMS))
    cells = Cells(points, min(CELLS, math.ceil(n / block_rows)))

    def place(batches):
        for b in batches:
            cell = np.full(b.num_rows, cells.n, np.int32)
            width = b.column(2).to_numpy()
            mine = np.flatnonzero(width == main)
            shown = [None] * b.num_rows
            if len(mine):
                x = b.column(1).take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), main)
                p = lifted(x, r2[main])
                cell[mine] = cells.of(p)
                for k, row in zip(mine, p, strict=True):
                    shown[k] = row
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell), pa.array(shown, pa.list_(pa.float64()))], ["vec_id", "embedding", "width", "cell", "p"])

    schema = "vec_id long, embedding array<double>, width int, cell int, p array<double>"
    placed = written(rows.select("vec_id", "embedding", "width").mapInArrow(place, schema), "placed-vectors")
    sides = [f(F.col("p")[k]).alias(f"{s}{k}") for s, f in (("l", F.min), ("h", F.max)) for k in range(DIMS)]
    stats = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), *sides).collect()
    blocks = {(r.width, r.cell): math.ceil(r.n / block_rows) for r in stats}
    stats = [r for r in stats if r.width == main]
    low, high = (np.array([[r[f"{s}{k}"] for k in range(DIMS)] for r in stats]) for s in "lh")
    reach = chi_square_quantile(confidence, DIMS)

    def names(width: int, cell: int) -> list[str]:
        return [f"{width}-{cell}-{k}" for k in range(blocks.get((width, cell), 0))]

    def sent(batches, first: bool):
        """The blocks that a query goes to: first those of its nearest cell, then those of others."""
        for b in batches:
            width, bounds, out = b.column(2).to_pylist(), b.column(3).to_pylist(), []
            for v, w, bound in zip(b.column(1), width, bounds, strict=True):
                if w != main:
                    out.append(names(w, cells.n) if first else [])
                    continue
                q = v.values.to_numpy()
                size, length = math.sqrt(q @ q), math.sqrt(r2[main])
                d = box_distances((q * (length / size) @ projection(main + 1)[:-1])[None], low, high)[0]
                own = int(np.argmin(d))
                if first:
                    mine = [own]
                else:
                    stop = reach * max(2 * r2[main] - 2 * length * bound / size, 1e-12 * r2[main]) if bound > -math.inf else math.inf
                    mine = [k for k in np.flatnonzero(d < stop) if k != own]
                out.append([x for k in mine for x in names(main, stats[k].cell)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(out, pa.list_(pa.string()))], ["vec_id", "bound", "blocks"])

    def wanted(asked: DataFrame, first: bool) -> DataFrame:
        to = asked.select("vec_id", "embedding", "width", "bound").mapInArrow(lambda b: sent(b, first), "vec_id long, bound double, blocks array<string>")
        return written(to.select("vec_id", "bound", F.explode("blocks").alias("block")), "wanted")

    # a row for each cell, of which there are a fixed number, and for each width
    per = vectors.sparkSession.createDataFrame([(*k, v) for k, v in blocks.items()], "width int, cell int, many int")
    sub = F.pmod(F.xxhash64("vec_id"), F.col("many"))
    dealt = placed.drop("p").join(F.broadcast(per), ["width", "cell"]).select(F.concat_ws("-", "width", "cell", sub).alias("block"), "vec_id", "embedding")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)

    early = _searched(dealt, wanted(asked.withColumn("bound", F.lit(-math.inf)), True), asked, keep, query_rows, r2, confidence)
    if len(stats) > 1:
        early = written(ranked(early).drop("rank"), "near-cells")
        kth = early.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("kth"), F.count("*").alias("c"))
        bound = F.when(F.col("c") >= keep, F.col("kth")).otherwise(F.lit(-math.inf))
        later = asked.join(kth, "vec_id", "left").withColumn("bound", F.coalesce(bound, F.lit(-math.inf)))
        early = early.union(_searched(dealt, wanted(later, False), asked, keep, query_rows, r2, confidence))
    return ranked(early).select("query_id", "rank", "vec_id", "score")


def op10_ann(embeddings: DataFrame, **params) -> DataFrame:
    """The 20 nearest of each row whose vec_id is divisible by 20.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no
    part, nor do rows without id; of rows with the same id the least vector counts. Ties
    go to the smaller vec_id. An empty table gives no rows."""
    rows = embeddings.select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"), **params)
