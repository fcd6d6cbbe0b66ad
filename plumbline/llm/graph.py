"""Connected components by contraction, in joins and grouped minima, until the edges left are few enough for the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_core, cut

#: So many edges are folded at once on the driver, 2 MB of ids; more are contracted by joins first, however many they are.
FEW = 1 << 17


class Forest:
    """Which of the numbers below ``n`` already hang together."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _folded(pairs: DataFrame) -> DataFrame:
    """(node, root) of ``FEW`` edges at most, without nulls; root is the smallest id."""
    rows = pairs.toArrow()
    nodes, ends = np.unique(np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()]), return_inverse=True)
    forest = Forest(len(nodes))
    for a, b in ends.reshape(2, -1).T.tolist():
        forest.join(a, b)
    roots = nodes[np.array([forest.top(i) for i in range(len(nodes))], dtype=np.int64)]
    found = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())})
    return cut(pairs.sparkSession.createDataFrame(found, "node long, root long").coalesce(1), "labels")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns ``u`` and ``v``; returns one row (``node``, ``root``) for each node of an edge.

    Every round gives each node a rank and moves it onto the lowest ranked node beside it (itself included), and on
    to where that one moves. Edges follow, loops and repeats go. Ranks are the ids in the first round, which folds stars
    around a smallest id at once, and random ones in the others: those halve a chain in expectation whatever its
    ids, so the rounds grow with the logarithm of the longest path. Nodes without an edge are absent. Loops, repeated
    and reversed edges and nulls are allowed and add nothing. Rounds end where ``FEW`` edges or fewer are left.
    """
    u, v = F.col("u"), F.col("v")
    pairs = edges.where(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    pairs = cut(by_core(pairs), "edges")
    many = pairs.count()
    if many <= FEW:
        return _folded(pairs)
    labels = cut(by_core(pairs.select(u.alias("node")).union(pairs.select(v)).distinct().withColumn("root", F.col("node"))), "labels")
    step = 0
    while many > FEW:
        rank = lambda c: F.xxhash64(F.lit(step), c) if step else c  # noqa: E731, B023
        both = pairs.union(pairs.select("v", "u"))
        near = both.groupBy("u").agg(F.min(F.struct(rank(v).alias("r"), v.alias("v"))).alias("m"))
        own = F.struct(rank(u).alias("r"), u.alias("v"))
        once = cut(by_core(near.select("u", F.least("m", own)["v"].alias("to"))), "moved")
        moved = once.join(once.select(u.alias("to"), F.col("to").alias("then")), "to").select("u", F.col("then").alias("to"))
        moved = cut(by_core(moved), "moved")
        labels = _moved(labels, moved.withColumnRenamed("u", "root"))
        a, b = moved.select(u, F.col("to").alias("a")), moved.select(u.alias("v"), F.col("to").alias("b"))
        pairs = (
            pairs.join(a, "u").join(b, "v").where("a != b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
        pairs = cut(by_core(pairs), "edges")
        many, step = pairs.count(), step + 1
    return _moved(labels, _folded(pairs).select(F.col("node").alias("root"), F.col("root").alias("to"))) if many else labels


def _moved(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """``labels`` (node, root) with every root that ``moved`` (root, to) names at its new place."""
    return cut(by_core(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))), "labels")


def further(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of more edges: ``roots`` is its earlier result, ``edges`` joins roots (or nodes absent there)."""
    found = components(edges)
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(by_core(moved.unionByName(found.join(roots.select("node"), "node", "left_anti"))), "labels")
