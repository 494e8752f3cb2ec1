"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits vectors by their projection on a random direction at the median,
and a band around the median goes to both sides.  The upper splits of all trees
are fitted on a bounded sample and sent to every task; all vectors are routed
through them.  Vectors that share a leaf are split further in the same way where
they stand, until few are left, and compared with each other.  Pairs found in any
tree are verified in double precision and united into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import connected_components
from quire.llm.runtime import cut, ready


#: Vectors of a node that are tried as middles of a large group.
PROBES = 256


@dataclass(frozen=True)
class ForestSpec:
    """Trees, the width of their overlaps, and the bound of the sample that fits the upper splits."""

    trees: int = 10  # most; each three levels of splits take one more, from three on, and none are needed where nothing is split
    overlap: float = 0.12  # share of a node's vectors, nearest to the median, that go to both sides
    sample: int = 20_000  # vectors, chosen by a hash, that fit the upper splits
    sample_leaf: int = 50  # sampled vectors in a node that is split, at least
    leaf: int = 2_048  # vectors of a label that are compared with each other without further splits
    seed: int = 17
    dense: int = 256  # near copies, beyond which a group is compared apart
    chunk: int = 4_096  # vectors of such a group that are compared with as many in one place
    group: float = 0.93  # least length of the mean of unit vectors in a large group of near copies
    reach: float = 0.9  # least cosine of a group's vectors with its centre


def _split(points: np.ndarray, overlap: float, rng: np.random.Generator) -> tuple[np.ndarray, float, float] | None:
    """A direction and the band's ends; None where no split makes both sides smaller."""
    for _ in range(4):
        a, b = points[rng.choice(len(points), 2, replace=False)]
        way = rng.normal(size=points.shape[1]) if rng.random() < 0.3 else a - b
        size = np.linalg.norm(way)
        if size < 1e-9:
            continue
        way = way / size
        low, high = np.quantile(points @ way, [0.5 - overlap / 2, 0.5 + overlap / 2])
        spots = points @ way
        if (spots <= high).sum() < len(points) and (spots >= low).sum() < len(points):
            return way, float(low), float(high)
    return None


def levels(rows: float, spec: ForestSpec) -> int:
    """Splits that a label of so many rows goes through."""
    return max(0, int(np.ceil(np.log2(max(1.0, rows / spec.leaf)))))


def grow(sample: np.ndarray, spec: ForestSpec, most: int = 0) -> list[list]:
    """The upper splits of every tree: nodes (direction, band, left, right), leaves by number.

    ``most`` is how many rows the largest label has.  A split parts a few in a
    hundred of the links, so the trees grow in number with the levels.
    """
    depth = levels(most, spec)
    each = most / max(1, len(sample))  # rows of the largest label that a sampled vector stands for
    forest = []
    for t in range(min(spec.trees, 3 + depth // 3) if depth else 1):
        rng, nodes = np.random.default_rng((spec.seed, t)), []

        def build(points: np.ndarray) -> int:
            at = len(nodes)
            nodes.append(None)
            found = _split(points, spec.overlap, rng) if len(points) > spec.sample_leaf and len(points) * each > spec.leaf else None
            if found:
                spots = points @ found[0]
                nodes[at] = (*found, build(points[spots <= found[2]]), build(points[spots >= found[1]]))
            return at

        build(sample)
        forest.append(nodes)
    return forest


def dense_centres(forest: list[list], sample: np.ndarray, spec: ForestSpec, rows: int) -> np.ndarray:
    """Centres of groups of near copies that stand for more than ``dense`` rows, no two within ``reach``."""
    each, found = max(1.0, rows / max(1, len(sample))), []
    for nodes in forest[:2]:
        for _, at in route(nodes, sample):
            todo = [np.sort(at)]
            while todo:
                at = todo.pop()
                if len(at) * each <= spec.dense / 4 or len(at) < 4:
                    continue
                mean = sample[at].mean(axis=0)
                if np.linalg.norm(mean) >= spec.group:
                    found.append((len(at), mean / np.linalg.norm(mean)))
                    continue
                # a group may share its leaf with others: of some vectors, take those around the one with the most near it
                tried = sample[at[:PROBES]] @ sample[at].T >= spec.reach  # the sample stands in the order of a hash
                some = tried[tried.sum(axis=1).argmax()]
                mean = sample[at[some]].mean(axis=0)
                if some.sum() * each > spec.dense / 4 and some.sum() >= 4 and np.linalg.norm(mean) >= spec.group:
                    found.append((int(some.sum()), mean / np.linalg.norm(mean)))
                    todo.append(at[~some])
    kept: list[np.ndarray] = []
    for _, centre in sorted(found, key=lambda x: -x[0]):
        if (not kept or (np.array(kept) @ centre).max() < spec.reach) and (sample @ centre >= spec.reach).sum() * each > spec.dense:
            kept.append(centre)
    return np.array(kept).reshape(len(kept), sample.shape[1] if sample.ndim == 2 else 0)


def groups_of(points: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """The place of the nearest centre within reach, or -1."""
    if not len(centres) or not len(points):
        return np.full(len(points), -1)
    near = points @ centres.T
    return np.where(near.max(axis=1) >= reach, near.argmax(axis=1), -1)


def route(nodes: list, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf of a tree that some points reach, and the places of those points."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if not nodes or nodes[at] is None:
            yield at, rows
            continue
        way, low, high, left, right = nodes[at]
        spots = points[rows] @ way
        todo += [(left, rows[spots <= high]), (right, rows[spots >= low])]


def near_pairs(points: np.ndarray, least: float, spec: ForestSpec, rng: np.random.Generator, block: int = 1024, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of pairs of unit vectors with a product of ``least`` or more that meet in a leaf, but of those in one ``group`` (-1: in none)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        split = _split(points[rows], spec.overlap, rng) if len(rows) > spec.leaf else None
        if split:
            spots = points[rows] @ split[0]
            todo += [rows[spots <= split[2]], rows[spots >= split[1]]]
            continue
        for a in range(0, len(rows), block):
            for b in range(a, len(rows), block):
                i, j = np.nonzero(points[rows[a : a + block]] @ points[rows[b : b + block]].T >= least)
                i, j = rows[a + i], rows[b + j]
                good = i < j if group is None else (i < j) & ((group[i] < 0) | (group[i] != group[j]))
                found.append((i[good], j[good]))
    pairs = np.unique(np.concatenate([np.stack(f, axis=1) for f in found] or [np.zeros((0, 2), np.int64)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _unit(vectors: pa.Array | list) -> np.ndarray:
    """Vectors of one length, scaled first by their largest component so that squares neither overflow nor vanish."""
    x = np.array(list(vectors), np.float64)
    if not len(x):
        return np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def link_embeddings(vectors: DataFrame, least: float = 0.93, spec: ForestSpec = ForestSpec(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine is ``least`` or more.

    Returns a row for each row of ``vectors``: ``id_col``, ``n_links`` (rows
    linked directly), ``component_id`` (smallest id reachable) and ``kept``
    (whether that is the row's own id).  A null label, and a vector that is null,
    empty, zero or holds a null, NaN or infinite component, links with nothing;
    vectors of different lengths aren't compared.  Rows with a null id take no
    part and give null, zero links, and not kept.

    Equal vectors of a label are folded into one class before the search; its
    rows are linked with each other, since their cosine is one.
    """
    spark = ready(vectors.sparkSession)
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # vectors move as they came
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    sound = "id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("v", F.when(F.coalesce(F.expr(sound), F.lit(False)), F.expr(f"transform(v, x -> cast(x + 0.0D as {kind}))")))
    mark = rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "label", "v")})
    classes = mark.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.select("h1", "h2", "rep", "copies", F.xxhash64("label").alias("side"), F.size("v").alias("dim"), "v"))
    sizes = [(r.dim, r["count"]) for r in classes.groupBy("dim").count().collect()]
    pairs, crowds = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "a long, b long, n long")
    for dim, n in sizes:
        some = classes.where(F.col("dim") == dim)
        picked = _unit(some.orderBy(F.xxhash64("rep"), "rep").limit(spec.sample).select("v").toArrow().column(0).to_pylist())
        most = some.groupBy("side").count().agg(F.max("count")).first()[0]
        forest = grow(picked, spec, most)
        centres = dense_centres(forest, picked, spec, n)
        pairs = pairs.union(_meet(some.select("rep", "side", "v"), forest, centres, least, spec, kind))
        if len(centres):
            crowds = crowds.union(_crowds(some.select("rep", "side", "copies", "v"), centres, least, spec, kind))
    pairs, crowds = cut(pairs.distinct()), cut(crowds)
    named = connected_components(pairs.union(crowds.where("b is not null").select("a", "b")))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    weights = classes.select(F.col("rep").alias("other"), "copies")
    more = ends.join(weights, "other").groupBy("rep").agg(F.sum("copies").alias("n")).union(crowds.where("b is null").select("a", "n"))
    more = more.groupBy("rep").agg(F.sum("n").alias("linked"))
    facts = classes.select("h1", "h2", "rep", "copies").join(more, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
    facts = cut(facts.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    # rows outside the search have no class; a key of their own spares them from meeting in one task
    keys = [F.when(F.col("v").isNull(), F.xxhash64("id", F.lit(7))).otherwise(F.col("h1")).alias("h1"), F.when(F.col("v").isNotNull(), F.col("h2")).otherwise(F.lit(0)).alias("h2")]
    out = mark.select("id", F.col("v").isNotNull().alias("sound"), *keys).join(facts.withColumn("match", F.lit(True)), ["h1", "h2"], "left")
    ours = F.col("sound") & F.coalesce("match", F.lit(False))
    component = F.when(ours, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(ours, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _meet(classes: DataFrame, forest: list, centres: np.ndarray, least: float, spec: ForestSpec, kind: str) -> DataFrame:
    """Pairs of classes that share a leaf of some tree, are near enough, and are not both of one large group."""
    shared = classes.sparkSession.sparkContext.broadcast((forest, centres))  # bounded by the sample

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, middle = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(2).to_pylist())
            group = pa.array(groups_of(unit, middle, spec.reach), pa.int32())
            for t, nodes in enumerate(trees):
                for leaf, rows in route(nodes, unit):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(take), pa.array([t * 1_000_000 + leaf] * len(rows), pa.int64()), batch.column(0).take(take), group.take(take), batch.column(2).take(take)], ["side", "leaf", "rep", "crowd", "v"])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        unit, ids, group = _unit(pdf["v"].to_list()), pdf["rep"].to_numpy(), pdf["crowd"].to_numpy()
        order = np.argsort(ids, kind="stable")
        unit, ids, group = unit[order], ids[order], group[order]
        i, j = near_pairs(unit, least, spec, np.random.default_rng((spec.seed, abs(int(key[1])))), group=group)
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    leaves = classes.mapInArrow(spread, f"side long, leaf long, rep long, crowd int, v array<{kind}>")
    return leaves.groupBy("side", "leaf").applyInPandas(compare, "a long, b long")


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) with the same components as all pairs that ``near`` marks, rows and columns being different things."""
    rows, columns, out = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool), []
    for start in range(near.shape[0]):
        if not rows[start]:
            continue
        rows[start], todo = False, [(True, start)]
        while todo:
            of_rows, x = todo.pop()
            fresh = np.nonzero(near[x] & columns if of_rows else near[:, x] & rows)[0]
            (columns if of_rows else rows)[fresh] = False
            out += [(x, int(y)) if of_rows else (int(y), x) for y in fresh]
            todo += [(not of_rows, int(y)) for y in fresh]
    return out


def _crowds(classes: DataFrame, centres: np.ndarray, least: float, spec: ForestSpec, kind: str) -> DataFrame:
    """Of the vectors in large groups: ``a``, null and ``n``, the rows that its links reach there; and links ``a``, ``b`` that connect them."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(3).to_pylist())
            group = groups_of(unit, shared.value, spec.reach)
            inside = pa.array(np.nonzero(group >= 0)[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(inside) for i in range(3)], pa.array(group[group >= 0], pa.int32()), batch.column(3).take(inside)], ["rep", "side", "copies", "crowd", "v"])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        unit, ids, copies, own = _unit(pdf["v"].to_list()), pdf["rep"].to_numpy(), pdf["copies"].to_numpy(np.int64), pdf["own"].to_numpy()
        left, right = np.nonzero(own == key[2])[0], np.nonzero(own == key[3])[0]
        near = unit[left] @ unit[right].T >= least
        out = []
        if key[2] == key[3]:
            np.fill_diagonal(near, False)
        else:
            out += [(int(b), None, int(n)) for b, n in zip(ids[right], copies[left] @ near, strict=True) if n]
        out += [(int(a), None, int(n)) for a, n in zip(ids[left], near @ copies[right], strict=True) if n]
        out += [(int(ids[left[i]]), int(ids[right[j]]), 0) for i, j in spanning(near) if ids[left[i]] != ids[right[j]]]
        return pd.DataFrame({"a": [x[0] for x in out], "b": pd.array([x[1] for x in out], "Int64"), "n": [x[2] for x in out]})

    found = cut(classes.mapInArrow(place, f"rep long, side long, copies long, crowd int, v array<{kind}>"))
    sizes = found.groupBy("side", "crowd").agg(F.ceil(F.count("*") / spec.chunk).cast("int").alias("chunks"))
    dealt = found.join(sizes, ["side", "crowd"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    return dealt.groupBy("side", "crowd", "one", "two").applyInPandas(compare, "a long, b long, n long")
