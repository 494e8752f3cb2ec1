"""Connected components by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import cut


def _mark(star: DataFrame) -> tuple:
    """Two edge sets with the same mark are taken as equal."""
    return tuple(star.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def _of_few(star: DataFrame) -> DataFrame:
    """The same labels for edges that the driver can hold; sixteen bytes each."""
    table = star.toArrow()
    nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("hi", "lo")]), return_inverse=True)
    hi, lo = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[hi] != label[lo]).any():
        one, two = label[hi], label[lo]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))  # labels are roots here, which hang under a smaller neighbour
        while (label != label[label]).any():
            label = label[label]
    return star.sparkSession.createDataFrame(pa.table({"node": nodes, "component": nodes[label]}), "node long, component long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100, few: int = 0) -> DataFrame:
    """Labels every node that has an edge with the smallest node it reaches.

    ``edges`` holds undirected links of two long columns; loops, repeated edges
    and edges with a null end are ignored.  Returns ``node`` and ``component``.

    Each round hangs every node's larger neighbours under its smallest one, then
    does the same among smaller neighbours; the number of edges never grows and
    rounds grow with the logarithm of the longest chain.  Grouped minima combine
    before the shuffle, and the joins are plain equi-joins that adaptive
    execution can split, so that a hub does not land in one task.  Up to ``few``
    edges are labelled on the driver instead, which spares the rounds' stages; of
    more, no part of the graph is brought to the driver.
    """
    star = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    star = cut(star.where("_a is not null and _b is not null and hi <> lo").select("hi", "lo").distinct())
    mark = _mark(star)
    if 0 < mark[0] <= few:
        return _of_few(star)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select("u", "m"))
        star = cut(small.distinct())
        before, mark = mark, _mark(star)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(star.select("lo", "lo").distinct())
