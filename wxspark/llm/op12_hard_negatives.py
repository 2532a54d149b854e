"""Hard-negative mining: a vantage-point tree over norm-augmented vectors, searched nearest first inside distance annuli.

1. Components become whole numbers (floor of `scale` times the component), so scores, the inner products, are exact.
2. Each row x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared length, and each query q gets 0 there. Then
   |q - x|^2 = |q|^2 + M - 2 * score: the highest score is the nearest row, and a window of scores is an annulus.
3. The upper part of the tree is fitted on at most SAMPLE rows and has at most 2^DEPTH leaves, the shards. Every row is
   dealt to a shard; the distances of all of its rows to the vantage points above give each shard's exact bounds. Shards are cut into
   chunks of bounded size, and in its task a chunk grows the lower part of the tree over its own rows.
4. A query first goes to its FIRST nearest shards that meet its annulus. The score of the k-th row that is found there is a
   bound, with which it goes on to the other shards that can still hold a better one. In a chunk leaves are visited in the
   order of their least distance, those beyond the annulus or the bound never. Results are exact, not approximate.
5. Queries and chunks meet in cells of (shard, chunk, block of queries), so neither many anchors near one shard nor one vector that a
   third of all rows share make a large task.

Positives and negatives are two such searches: the first for rows of the anchor's label, without a window, the second, for each
positive score, for rows of other labels inside the window.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part, nor do rows whose
squared length in whole numbers reaches 2^62, as their scores don't fit; a shorter vector counts as if zeros followed, an
empty one as zeros; equal scores go by vec_id; repeated rows of a vec_id are rows each: a repeated anchor gives its rows again, and
the other rows of its vec_id are others; an anchor without positives, or a positive without rows in its window, gives no
rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil, inf, log2, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wxspark.llm.common import drop, written

#: Rows that the upper part of the tree is fitted on, rows a shard aims at, levels of the upper part.
SAMPLE, SHARD, DEPTH = 4096, 4096, 8
#: Rows and queries of a cell, numbers in its matrix of rows, rows of a leaf, shards that a query visits first.
CHUNK, QUERIES, NUMBERS, LEAF, FIRST = 4096, 4096, 1 << 22, 64, 2
#: The contract's numbers: scale, anchors are ids divisible by EVERY, positives and negatives, window in percent of the positive's score.
SCALE, EVERY, POSITIVES, NEGATIVES, WINDOW = 256, 100, 5, 10, (30, 90)
#: Squared lengths from which a row takes no part, and up to which sums of doubles are exact; share of the largest length that rounding may take.
TOO_LONG, EXACT, SLACK = 2.0**62, 2**53, 1e-7

ROW = "shard int, chunk int, row long, vec_id long, label long, v array<long>"
FOUND = "anchor_id long, copy int, wanted long, score long, vec_id long, own boolean"
QUERY = "anchor_id long, copy int, label long, wanted long, bound long, v array<long>"


class Space(NamedTuple):
    """What distances depend on: the number of components and the largest squared length."""

    dims: int
    longest: int

    def matrix(self, lists: pa.Array) -> np.ndarray:
        """The vectors as rows of one matrix, zeros behind the shorter ones; doubles where their sums are exact."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), self.dims), np.float64 if self.longest < EXACT else np.int64)
        out[np.arange(self.dims)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return (rows @ query).astype(np.int64)

    def squares(self, rows: np.ndarray) -> np.ndarray:
        return (rows * rows).sum(axis=1)

    def last(self, rows: np.ndarray) -> np.ndarray:
        """The coordinate that norm augmentation adds."""
        return np.sqrt(np.maximum(self.longest - self.squares(rows), 0).astype(float))

    def distances(self, rows: np.ndarray, last: np.ndarray, point: np.ndarray, at: float) -> np.ndarray:
        gap = (rows - point).astype(float)
        return np.sqrt((gap * gap).sum(axis=1) + (last - at) ** 2)

    def radius(self, square: int, score: float) -> float:
        """The distance from a query of this squared length to rows of this score."""
        return inf if score == -inf else sqrt(max(0.0, float(square) + self.longest - 2.0 * score))

    @property
    def slack(self) -> float:
        return SLACK * (1 + sqrt(self.longest))


class Tree:
    """Vantage points, and for each leaf the bounds of its distances to those above it."""

    def __init__(self, space: Space, rows: np.ndarray, leaf: int, depth: int):
        self.space, last = space, space.last(rows)
        self.points, self.nodes, self.leaves = [], [], []  # nodes: (point, radius, near, far), negative numbers are leaves
        paths: list[list[tuple[int, float, float]]] = []

        def grow(at: np.ndarray, path: list[tuple[int, np.ndarray]], level: int) -> int:
            if len(at) > leaf and level < depth:
                seed = at[0]
                top = at[np.argmax(space.distances(rows[at], last[at], rows[seed], last[seed]))]
                far = space.distances(rows[at], last[at], rows[top], last[top])
                radius = float(np.median(far))
                inner = far <= radius if (far > radius).any() else far < radius
                if inner.any() and not inner.all():
                    radius = float(far[inner].max())
                    number, node = len(self.points), len(self.nodes)
                    self.points.append(top)
                    self.nodes.append(None)
                    below = [grow(at[side], [*((p, d[side]) for p, d in path), (number, far[side])], level + 1) for side in (inner, ~inner)]
                    self.nodes[node] = (number, radius, *below)
                    return node
            self.leaves.append(at)
            paths.append([(p, float(d.min(initial=inf)), float(d.max(initial=0))) for p, d in path])
            return -len(self.leaves)

        self.root = grow(np.arange(len(rows)), [], 0)
        self.last = last[self.points]
        self.points = rows[self.points].reshape(len(self.points), space.dims)
        self.above = [[p for p, _, _ in path] for path in paths]
        self.bounded([[(lo, hi) for _, lo, hi in path] for path in paths])

    def bounded(self, bounds: list[list[tuple[float, float]]]) -> None:
        """Sets the bounds of each leaf, in the order of the vantage points above it."""
        width = max(1, *map(len, self.above), 1)
        self.at, self.lo, self.hi = np.zeros((len(bounds), width), int), np.zeros((len(bounds), width)), np.full((len(bounds), width), inf)
        for i, (above, own) in enumerate(zip(self.above, bounds)):
            for j, (p, (lo, hi)) in enumerate(zip(above, own)):
                self.at[i, j], self.lo[i, j], self.hi[i, j] = p, lo, hi

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of each row, and its distances to the vantage points above."""
        last, leaf, path = self.space.last(rows), np.zeros(len(rows), np.int32), [[] for _ in rows]
        below = [(self.root, np.arange(len(rows)))]
        while below:
            node, at = below.pop()
            if node < 0:
                leaf[at] = -node - 1
                continue
            point, radius, near, far = self.nodes[node]
            d = self.space.distances(rows[at], last[at], self.points[point], self.last[point])
            for i, x in zip(at.tolist(), d.tolist()):
                path[i].append(x)
            below += [(near, at[d <= radius]), (far, at[d > radius])]
        return leaf, path

    def ranges(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance that a row of each leaf may have from the query."""
        if not len(self.points):
            return np.zeros(len(self.at)), np.full(len(self.at), inf)
        d = self.space.distances(self.points, self.last, query, 0.0)[self.at]
        return np.maximum(d - self.hi, self.lo - d).max(axis=1).clip(0), (d + self.hi).min(axis=1)


def window(wanted: int | None) -> tuple[float, float]:
    """The least and the largest score that is searched for: all, or what the positive's score allows."""
    return (-inf, inf) if wanted is None else (-(-WINDOW[0] * wanted // 100), WINDOW[1] * wanted // 100)


def usable(rows: DataFrame) -> DataFrame:
    """row, vec_id, label, v of the rows that take part, written; `row` tells repeated ones apart."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(SCALE * c).cast("long"))
    square = F.aggregate(x, F.lit(0.0), lambda total, c: total + F.floor(SCALE * c).cast("double") * F.floor(SCALE * c).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(whole).where(square < TOO_LONG)
    return written(kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), label.cast("long").alias("label"), v.alias("v")))


class Index(NamedTuple):
    space: Space
    tree: Tree
    rows: DataFrame
    chunks: DataFrame


def index(rows: DataFrame) -> Index | None:
    """The upper tree and all rows dealt to its leaves, written; None where there are no rows."""
    # squared lengths of whole numbers, as decimals: any that takes part is exact
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda total, c: (total + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    n, dims, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return None
    space = Space(max(1, dims), int(longest))
    most = max(64, min(SAMPLE, NUMBERS // space.dims))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(most).select("v").toArrow()
    depth = min(DEPTH, max(0, ceil(log2(n / SHARD))))
    tree = Tree(space, space.matrix(sample["v"]), max(1, most >> DEPTH), depth)

    def deal(batches):
        for batch in batches:
            leaf, path = tree.place(space.matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(path, pa.list_(pa.float64()))], names=["row", "vec_id", "label", "v", "shard", "path"])

    dealt = written(rows.select("row", "vec_id", "label", "v").mapInArrow(deal, "row long, vec_id long, label long, v array<long>, shard int, path array<double>"))
    ends = [f(F.get("path", F.lit(i))).alias(f"{name}{i}") for i in range(depth) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    shards = dealt.groupBy("shard").agg(F.count("*").alias("n"), *ends).collect()  # at most 2^DEPTH rows
    known = {s.shard: [(s[f"lo{i}"], s[f"hi{i}"]) for i in range(len(tree.above[s.shard]))] for s in shards}
    nothing = (inf, -inf)  # a leaf without rows is met by no query
    tree.bounded([known.get(i, [nothing] * len(above)) for i, above in enumerate(tree.above)])
    size = max(1, min(CHUNK, NUMBERS // space.dims))
    chunks = rows.sparkSession.createDataFrame([(s.shard, ceil(s.n / size)) for s in shards], "shard int, chunks int")
    return Index(space, tree, dealt.drop("path"), chunks)


def visits(queries: DataFrame, found: Index, first: bool) -> DataFrame:
    """Queries and the shards they go to: the nearest ones, or all others that their bound leaves."""
    space, tree = found.space, found.tree

    def run(batches):
        for batch in batches:
            wanted, bound = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            take, shard = [], []
            for i, (q, own) in enumerate(zip(space.matrix(batch.column(5)), wanted)):
                lo, hi = window(own)
                if lo > hi:
                    continue
                square, (near, far) = int(q @ q), tree.ranges(q)
                floor = max(lo, -inf if bound[i] is None else bound[i])
                met = (near <= space.radius(square, lo) + space.slack) & (far >= (0 if hi == inf else space.radius(square, hi)) - space.slack)
                order = np.argsort(near, kind="stable")
                order = order[met[order]]
                own = order[:FIRST] if first else order[FIRST:][near[order[FIRST:]] <= space.radius(square, floor) + space.slack]
                take += [i] * len(own)
                shard += own.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.take(pa.array(take, pa.int64())).columns), pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    return queries.mapInArrow(run, f"{QUERY}, shard int")


def nearest(tree: Tree, rows: np.ndarray, ids: np.ndarray, fit: np.ndarray, query: np.ndarray, wanted: int | None, bound: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a chunk that fit and lie in the annulus: places and scores. Leaves are visited nearest first, 1, 2, 4 ... at a time."""
    space, (lo, hi) = tree.space, window(wanted)
    square, (near, far) = int(query @ query), tree.ranges(query)
    floor, inner = max(lo, -inf if bound is None else bound), 0.0 if hi == inf else space.radius(square, hi) - space.slack
    order, at, step = np.argsort(near, kind="stable"), 0, 1
    best, score = np.zeros(0, int), np.zeros(0, np.int64)
    while at < len(order):
        outer = space.radius(square, floor) + space.slack
        some = order[at : at + step]
        if near[some[0]] > outer:
            break
        some = some[(near[some] <= outer) & (far[some] >= inner)]
        if len(some):
            own = np.concatenate([tree.leaves[x] for x in some])
            own = own[fit[own]]
            s = space.scores(rows[own], query)
            keep = (s >= floor) & (s <= hi)
            best, score = np.concatenate([best, own[keep]]), np.concatenate([score, s[keep]])
            if len(best) >= k:
                first = np.lexsort((ids[best], -score))[:k]
                best, score = best[first], score[first]
                floor = max(floor, int(score[-1]))
        at, step = at + step, 2 * step
    return best, score


def searched(visited: DataFrame, found: Index, k: int, same: bool) -> DataFrame:
    """The k best rows of each query in each cell that it visits."""
    space = found.space
    queries = visited.withColumn("_q", F.xxhash64("anchor_id", "copy", "wanted"))
    blocks = queries.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")).join(found.chunks, "shard")
    cell = ["shard", "chunk", "block"]
    left = queries.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod("_q", F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = found.rows.join(F.broadcast(blocks), "shard").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(asked) and len(held):
            rows, ids, labels = space.matrix(held["v"]), held["vec_id"].to_numpy(), held["label"].to_numpy()
            tree, match = Tree(space, rows, LEAF, 64), {}
            for q, anchor, copy, label, wanted, bound in zip(space.matrix(asked["v"]), *(asked[c].to_pylist() for c in ("anchor_id", "copy", "label", "wanted", "bound"))):
                if label not in match:
                    match[label] = labels == label if same else labels != label
                best, score = nearest(tree, rows, ids, match[label], q, wanted, bound, k)
                out += [(anchor, copy, wanted, int(s), int(ids[i]), bool(ids[i] == anchor and (rows[i] == q).all())) for i, s in zip(best.tolist(), score.tolist())]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, kinds)], names=["anchor_id", "copy", "wanted", "score", "vec_id", "own"])

    left, right = left.select("anchor_id", "copy", "label", "wanted", "bound", "v", *cell), right.select("row", "vec_id", "label", "v", *cell)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, FOUND)


def search(queries: DataFrame, found: Index, k: int, same: bool) -> DataFrame:
    """The k best rows of each query, with their place from 1; written."""
    query = ["anchor_id", "copy", "wanted"]

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(W.partitionBy(*query).orderBy(F.col("score").desc(), "vec_id", "own"))).where(F.col("place") <= k)

    near = written(best(searched(visits(queries, found, True), found, k, same)))
    kth = near.where(F.col("place") == k).select("anchor_id", "copy", "wanted", F.col("score").alias("kth"))
    match = F.col("q.anchor_id").eqNullSafe(F.col("b.anchor_id")) & (F.col("q.copy") == F.col("b.copy")) & F.col("q.wanted").eqNullSafe(F.col("b.wanted"))
    bounded = queries.alias("q").join(kth.alias("b"), match, "left").select("q.anchor_id", "q.copy", "q.label", "q.wanted", F.col("kth").alias("bound"), "q.v")
    out = written(best(near.drop("place").unionByName(searched(visits(bounded, found, False), found, k, same))))
    drop(near)
    return out


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(embeddings)
    found = index(rows)
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if found is None:
        return embeddings.sparkSession.createDataFrame([], kinds)
    copy = F.row_number().over(W.partitionBy("vec_id").orderBy("label", "v", "row"))
    nothing = F.lit(None).cast("long")
    anchors = written(rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("anchor_id"), copy.alias("copy"), "label", nothing.alias("wanted"), nothing.alias("bound"), "v"))
    near = search(anchors, found, POSITIVES + 1, True)
    # the anchor itself is among them once, if it is near enough
    itself = F.min(F.when(F.col("own"), F.col("place"))).over(W.partitionBy("anchor_id", "copy"))
    others = near.withColumn("_itself", itself).where(F.col("_itself").isNull() | (F.col("place") != F.col("_itself")))
    order = F.row_number().over(W.partitionBy("anchor_id", "copy").orderBy("place"))
    positives = written(others.withColumn("_at", order).where(F.col("_at") <= POSITIVES).select("anchor_id", "copy", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = positives.select("anchor_id", "copy", F.col("positive_score").alias("wanted")).distinct()
    queries = written(anchors.drop("wanted").join(wanted, ["anchor_id", "copy"]).select("anchor_id", "copy", "label", "wanted", "bound", "v"))
    far = search(queries, found, NEGATIVES, False)
    out = written(
        positives.join(far.select("anchor_id", "copy", F.col("wanted").alias("positive_score"), F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "copy", "positive_score"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
    drop(rows, anchors, near, positives, queries, far, found.rows)
    return out


#: The contract's query, all pairs of an anchor and a row.
SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""
