"""Exact inner-product search by branch and bound in a ball tree of each shard.

Vectors are dealt into shards that lie close together: a bounded sample gives the
centres, every vector goes to the nearest one, and a crowded cell is dealt again
by a hash.  Each shard's exact radius bounds the inner product of a query with all
that it holds by ``q . centre + |q| * radius``.  A query visits the shard with the
largest bound first, then a few, then all that may still hold one of its best;
after each round its k-th best score so far is shared with every shard yet to be
visited.  In a shard a ball tree is opened in the same way, for many queries at a
time: a node is opened for those queries whose bound there reaches their k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.runtime import cut, ready

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class SearchSpec:
    """Sizes that keep a task's share bounded; none changes a result."""

    shard: int = 16_384  # vectors, about
    block: int = 16_384  # queries that visit a shard together
    sample: int = 8_192  # vectors that the centres are taken from
    rounds: tuple[int, ...] = (1, 8)  # of a query's shards, in the order of their bounds, those visited by the end of each round but the last
    leaf: int = 64
    scale: int = 1024


class BallTree:
    """Balls around halves of halves of the points; the points of a node stand next to each other."""

    def __init__(self, points: np.ndarray, leaf: int = 64) -> None:
        self.order = np.arange(len(points))
        self.nodes: list[list[int]] = []  # first and last place, children or -1
        self.opened = 0  # leaves times queries, for reports
        centres, radii = [], []
        todo = [(0, len(points), -1, 0)] if len(points) else []
        while todo:
            a, b, parent, side = todo.pop()
            at, mine = len(self.nodes), points[self.order[a:b]]
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            self.nodes.append([a, b, -1, -1])
            centre = mine.mean(axis=0)
            off = mine - centre
            gaps = np.sqrt((off * off).sum(axis=1))
            centres.append(centre)
            radii.append(gaps.max())
            if b - a > leaf and radii[-1] > 0:
                far = off[gaps.argmax()]
                self.order[a:b] = self.order[a:b][np.argsort(off @ far, kind="stable")]
                half = (a + b) // 2
                todo += [(half, b, at, 1), (a, half, at, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.points = points[self.order]

    def search(self, best: Best, ids: np.ndarray) -> None:
        """Opens for each query the nodes that may hold one of its best; ``ids`` stand in the tree's order."""
        if not self.nodes:
            return
        bounds = upper_bounds(best.queries, self.centres, self.radii)
        todo = [(0, np.arange(len(best.queries)))]
        while todo:
            at, rows = todo.pop()
            rows = rows[bounds[rows, at] >= best.least[rows]]
            if not len(rows):
                continue
            a, b, left, right = self.nodes[at]
            if left < 0:
                self.opened += len(rows) * (b - a)
                best.offer(rows, best.queries[rows] @ self.points[a:b].T, ids[a:b])
            elif bounds[rows, left].sum() >= bounds[rows, right].sum():  # the likelier child comes first
                todo += [(right, rows), (left, rows)]
            else:
                todo += [(left, rows), (right, rows)]


class Best:
    """The ``k`` best of each query so far: scores as floats that hold whole numbers exactly, equal ones in the order of ids."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> None:
        self.queries, self.own, self.k = queries, own, k
        self.least = least.astype(np.float64)
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), _HIGH, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores[self.own[rows][:, None] == ids] = -np.inf
        good = (scores >= self.least[rows][:, None]) & (scores > -np.inf)
        hit = good.any(axis=1)
        if not hit.any():
            return
        rows, scores, good = rows[hit], scores[hit], good[hit]
        scores = np.concatenate([self.scores[rows], np.where(good, scores, -np.inf)], axis=1)
        names = np.concatenate([self.ids[rows], np.broadcast_to(ids, good.shape)], axis=1)
        top = np.lexsort((names, -scores), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
        self.least[rows] = np.maximum(self.least[rows], self.scores[rows, -1])


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Of each query with each ball, rounded up; what is not a number bounds nothing."""
    with np.errstate(all="ignore"):
        size = np.sqrt((queries * queries).sum(axis=1))[:, None]
        bounds = queries @ centres.T + size * radii
        bounds += 1e-9 * (np.abs(queries) @ np.abs(centres).T + size * radii) + 1e-6 * (1 + size)
    return np.where(np.isnan(bounds), np.inf, bounds)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 1))


def _whole(x: np.ndarray) -> list[int]:
    return [int(c) for c in x]


def _clamped(score: int) -> int:
    return min(_HIGH, max(_LOW, score))


def _exactly(points: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """Scores and ids of the best of a few vectors, in whole numbers of any size."""
    q = _whole(query)
    found = [(_clamped(sum(a * b for a, b in zip(_whole(p), q, strict=True))), int(i)) for p, i in zip(points, ids, strict=True) if i != own]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def search_shard(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, leaf: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score) of at least those of the ``k`` best that reach ``least``.

    Floats hold all sums exactly as long as no component is too large; the few
    vectors with larger ones are multiplied in whole numbers of any size.
    """
    most = np.sqrt(2.0**53 / max(1, points.shape[1]))
    plain, simple = np.abs(points).max(axis=1, initial=0) < most, np.abs(queries).max(axis=1, initial=0) < most
    tree = BallTree(points[plain], leaf)
    best = Best(queries[simple], own[simple], least[simple], k)
    tree.search(best, ids[plain][tree.order])
    for q, scores, names in zip(best.own, best.scores, best.ids, strict=True):
        for s, i in zip(scores, names, strict=True):
            if s > -np.inf:
                yield int(q), int(i), int(s)
    for at in np.nonzero(~simple)[0]:
        for s, i in _exactly(points, ids, queries[at], own[at], k):
            yield int(own[at]), i, s
    if not plain.all():
        for at in np.nonzero(simple)[0]:
            for s, i in _exactly(points[~plain], ids[~plain], queries[at], own[at], k):
                yield int(own[at]), i, s


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, spec: SearchSpec = SearchSpec(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest integer inner products of each query with all other vectors.

    Components are taken as ``floor(scale * x)``.  Queries are the rows whose id
    is divisible by ``every``.  Returns ``query_id``, ``rank`` from 1, ``id_col``
    and ``score``; equal scores rank the smaller id first, and a query with fewer
    than ``k`` others gets them all.

    A vector takes no part if it, its id or a component is null, if a component
    is not finite, or if it is empty; vectors of different lengths don't meet.
    Rows with one id are one vector, the smallest of theirs.  Any finite value
    counts: products are exact, and a score beyond a long is the nearest long.
    """
    ready(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = rows.where(F.expr(sound)).groupBy("id").agg(F.min("v").alias("v"))
    # from 2^52 on every double is whole; one that scaling would make infinite stays as it is, since its products are beyond a long anyway
    scaled = f"case when abs(x) < 1e12 then cast(floor(x * {spec.scale}D) as double) when abs(x) < 1e300 then x * {spec.scale}D else x end"
    rows = rows.withColumn("v", F.expr(f"transform(v, x -> {scaled})"))
    rows = cut(rows.withColumn("dim", F.size("v")))
    parts = []
    for size in rows.groupBy("dim").agg(F.count("*").alias("n")).collect():
        parts.append(_search(rows.where(F.col("dim") == size.dim).drop("dim"), size.n, k, every, spec))
    found = parts[0] if parts else rows.select(F.col("id").alias("query_id"), "id", F.col("id").alias("score")).limit(0)
    for more in parts[1:]:
        found = found.union(more)
    return _ranked(found, k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _centres(rows: DataFrame, n: int, spec: SearchSpec) -> np.ndarray:
    """Means of a sample's leaves: about one for each shard, and no more than a quarter of the sample."""
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(spec.sample).toPandas()
    points = _matrix(picked["v"])
    with np.errstate(all="ignore"):
        tree = BallTree(points, max(4, -(-len(points) * spec.shard // max(1, n))))
    return np.array([tree.centres[i] for i, (_, _, left, _) in enumerate(tree.nodes) if left < 0])


def _search(rows: DataFrame, n: int, k: int, every: int, spec: SearchSpec) -> DataFrame:
    """``query_id``, ``id`` and ``score`` with each query's best among them."""
    context = rows.sparkSession.sparkContext
    centres = context.broadcast(_centres(rows, n, spec))  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, middle = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1), centres.value
            with np.errstate(all="ignore"):
                gaps = np.nan_to_num((middle * middle).sum(axis=1) - 2 * points @ middle.T, nan=np.inf) if batch.num_rows else np.zeros((0, 1))
                cell = gaps.argmin(axis=1)
                gap = np.nan_to_num(np.sqrt(((points - middle[cell]) ** 2).sum(axis=1)), nan=np.inf) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(gap, pa.float64())], ["id", "v", "cell", "gap"])

    dealt = cut(rows.mapInArrow(place, "id long, v array<double>, cell int, gap double"))
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / spec.shard).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # as many rows as centres
    facts = dealt.groupBy("cell", "part").agg(F.max("gap").alias("radius")).orderBy("cell", "part").toPandas()  # a row for each shard
    shards = context.broadcast((centres.value[facts["cell"].to_numpy(np.int64)], facts["radius"].to_numpy(np.float64)))
    names = rows.sparkSession.createDataFrame([(int(c), int(p), i) for i, (c, p) in enumerate(zip(facts["cell"], facts["part"], strict=True))], "cell int, part int, shard int")
    data = dealt.join(F.broadcast(names), ["cell", "part"]).select("shard", "id", "v")
    queries = rows.where(F.col("id") % every == 0)
    found, first = None, 0
    for last in (*spec.rounds, len(facts)):
        if first >= len(facts):
            break
        asked = queries.withColumn("least", F.lit(_LOW))
        if found is not None:
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            asked = queries.join(kth, "id", "left").withColumn("least", F.coalesce("kth", F.lit(_LOW))).drop("kth")
        more = _visit(data, cut(asked.mapInArrow(_choose(shards, first, last), "shard int, id long, v array<double>, least long")), k, spec)
        found = cut(_ranked(more if found is None else found.drop("rank").union(more), k))
        first = last
    return found.drop("rank")


def _choose(shards, first: int, last: int):
    """Rows for the visits of each query to its shards from the ``first`` to before the ``last``, by bound, that may hold one of its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, radii = shards.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = upper_bounds(np.array(batch.column(1).to_pylist(), np.float64), middle, radii)
            order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
            least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            rows, at = np.nonzero(np.take_along_axis(bounds, order, 1) >= least[:, None])
            for a in range(0, len(rows), 4096):
                take = pa.array(rows[a : a + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(order[rows[a : a + 4096], at[a : a + 4096]], pa.int32()), *[batch.column(i).take(take) for i in range(3)]], ["shard", "id", "v", "least"])

    return run


def _visit(data: DataFrame, visits: DataFrame, k: int, spec: SearchSpec) -> DataFrame:
    """What the queries find in the shards they visit; a shard that more than ``block`` queries visit is copied for each block of them."""
    blocks = cut(visits.groupBy("shard").agg(F.ceil(F.count("*") / spec.block).cast("int").alias("blocks")))
    left = data.join(F.broadcast(blocks), "shard").select("shard", "id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))  # a row for each shard
    right = visits.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def visit(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        out = search_shard(_matrix(points["v"]), points["id"].to_numpy(np.int64), _matrix(asked["v"]), asked["id"].to_numpy(np.int64), asked["least"].to_numpy(), k, spec.leaf)
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(visit, "query_id long, id long, score long")
