"""Approximate nearest neighbours (10): NN-descent builds a graph by Spark joins, queries walk it greedily.

Vectors that are equal are one node of the graph; the ids behind it come back with the results. Building starts
from ``TREES`` random-projection trees: global cuts deal the nodes to cells, a task cuts on to leaves of ``LEAF``, and
in a leaf all are compared. A round of descent gathers at every node the vectors of its neighbours, forward and
backward, compares all of them with each other (they are neighbours of neighbours), and hands each the best it met; the
nearest ``K`` of old and new stay. Rounds go on until fewer than ``SETTLED`` of the edges are new. A query enters at the
node it is itself, if it is one, and at the nearest of about 2 sqrt(n) entry nodes. It holds the best nodes found so
far, takes the neighbours of those not yet expanded by a join with the graph (both ways of its edges), and stops when it
holds none of that kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, shuffle_parts, small_batches, table

#: Neighbours of a node, trees to start from, rows of a leaf, neighbours that each hands on from a leaf or a list.
K, TREES, LEAF, HANDS = 32, 6, 64, 5
#: Rows that global cuts leave in a cell in the mean; a task cuts at most so many at once.
CELL = 4096
#: The share of new edges in a round below which the graph is done.
SETTLED = 0.03
#: Backward neighbours that a node compares in a round (others have their turn elsewhere: an edge is in two lists).
BACKWARD = 16
#: Nodes that a query holds, nodes it expands in a step, entry nodes it starts from.
HOLD, EXPAND, ENTER = 256, 96, 8


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector that isn't null, empty, zero, nor holds null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)


def nodes(vectors: DataFrame, keep: int) -> DataFrame:
    """(node, v, u, ids): equal vectors as one, by the smallest id; ids holds the ``keep`` smallest.

    Nearest ids among equal vectors are the smallest ones, so ``keep`` of them are all that a result can hold.
    u is the unit vector in single precision.
    """
    keyed = vectors.groupBy("vec_id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2")).agg(F.first("v").alias("v"))
    # a task hands on the smallest ids of a group alone, so that a group of copies is never gathered
    whole = _least(keyed, ["h", "h2"], ["vec_id"], keep).groupBy("h", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    rows = whole.select(F.get("ids", F.lit(0)).alias("node"), "v", "ids")
    return _with_units(rows, "v", "u", "node long, v array<double>, ids array<long>")


def _with_units(rows: DataFrame, of: str, to: str, schema: str) -> DataFrame:
    """``rows`` (of ``schema``) with the unit vectors of a column; scaled first, so that nothing over- or underflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _scaled(_matrix(b.column(b.schema.get_field_index(of))))
            u = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32) if len(b) else v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(u), pa.list_(pa.float32()))], names=[*b.schema.names, to])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"{schema}, {to} array<float>")


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / np.abs(v).max(axis=1, keepdims=True) if len(v) else v


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    if not len(column):
        return np.zeros((0, 0), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _least(rows: DataFrame, of: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps no more of a group in any task, before the shuffle too."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def _top(found: DataFrame, k: int) -> DataFrame:
    """(a, near): the k nearest b of each a, as an array of (d, r, b, old), nearest first; from rows (a, b, d, old).

    d is the cosine in single precision, negative so that the nearest sorts first; r is a hash of the pair, so that
    nodes at one distance are not the same ones in every list. A pair met more than once counts once.
    """
    once = found.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("old").alias("old")).withColumn("r", F.xxhash64("a", "b"))
    return _least(once, ["a"], ["d", "r"], k).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "r", "b", "old"))).alias("near"))


def _nearest(ids: np.ndarray, u: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d): the ``take`` nearest of each row among all."""
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    take = min(take, len(ids) - 1)
    best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
    return np.repeat(ids, take), ids[best].reshape(-1), -np.take_along_axis(sims, best, axis=1).reshape(-1)


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else [[], [], []], (np.int64, np.int64, np.float32), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b", "d"])


def _leaves(u: np.ndarray, rng: np.random.Generator, most: int = LEAF) -> Iterator[np.ndarray]:
    """Row numbers, cut at the median along random directions until a leaf holds ``most``."""
    todo = [np.arange(len(u))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            yield own
            continue
        # along the difference of two rows: a direction in which these rows do differ
        x, y = rng.choice(len(own), 2, replace=False)
        order = own[np.argsort(u[own] @ (u[own[x]] - u[own[y]]), kind="stable")]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]


def _start(units: DataFrame, n: int, dim: int, trees: int, parts: int) -> DataFrame:
    """(a, b, d): neighbours within the leaves of ``trees`` trees.

    A tree's first cuts are at the global medians along random directions, one for each halving of ``n`` down to ``CELL``.
    """
    depth = max(0, math.ceil(math.log2(max(1, n) / CELL)))
    directions = np.random.default_rng(7).standard_normal((trees, depth + 1, dim)).astype(np.float32)
    flat = directions.reshape(-1, dim).T

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_matrix(b.column(0)).reshape(len(b), dim) @ flat), pa.list_(pa.float32()))], names=["p"])

    medians = np.zeros((trees, depth + 1), np.float32)
    if depth:
        spots = units.select("u").mapInArrow(along, "p array<float>")
        told = spots.agg(*[F.percentile_approx(F.get("p", F.lit(i)), 0.5, 1000).alias(f"m{i}") for i in range(flat.shape[1])]).first()
        medians = np.array(told, np.float32).reshape(trees, depth + 1)
    weights = 1 << np.arange(depth, dtype=np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            at = (_matrix(b.column(1)).reshape(n, dim) @ flat).reshape(n, trees, depth + 1)
            cells = (at[:, :, :depth] > medians[None, :, :depth]) @ weights if depth else np.zeros((n, trees), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column(0).to_numpy(), trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(cells.reshape(-1)), pa.array(at[:, :, depth].reshape(-1)), b.column(1).take(pa.array(np.repeat(np.arange(n), trees)))],
                names=["node", "turn", "cell", "at", "u"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(8)
        turns, ids, u = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, dim), np.float32)

        def made() -> pa.RecordBatch:
            out = []
            for turn in np.unique(turns):
                own = np.flatnonzero(turns == turn)
                out += [_nearest(ids[own[leaf]], u[own[leaf]], HANDS) for leaf in _leaves(u[own], rng) if len(leaf) > 1]
            return _batch(out)

        for b in batches:
            turns = np.concatenate([turns, b.column(1).to_numpy()])
            ids = np.concatenate([ids, b.column(0).to_numpy()])
            u = np.concatenate([u, _matrix(b.column(2)).reshape(len(b), dim)])
            if len(ids) >= 2 * CELL:
                yield made()
                turns, ids, u = turns[:0], ids[:0], u[:0]
        if len(ids):
            yield made()

    # all trees at once: a range partition holds a stretch of cells, ordered along one more direction inside a cell
    every = units.mapInArrow(project, "node long, turn int, cell long, at float, u array<float>")
    parts = max(parts, trees, n * trees // (2 * CELL))
    placed = every.repartitionByRange(parts, "turn", "cell", "at", "node").sortWithinPartitions("turn", "cell", "at", "node")
    return placed.select("node", "turn", "u").mapInArrow(run, "a long, b long, d float")


def build(units: DataFrame, dim: int, k: int = K, settled: float = SETTLED) -> DataFrame:
    """(a, near): the graph over ``units`` (node, u): each node's k nearest as found, an array of (d, r, b, old), d falling with the cosine."""
    n = units.count()
    met = _start(units, n, dim, TREES, shuffle_parts(units.sparkSession)).withColumn("old", F.lit(False))
    graph = cut(_top(met, k), "graph")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            rows = lists.flatten()
            ids = rows.field(0).to_numpy()
            u = np.frombuffer(b"".join(rows.field(1).to_pylist()), np.float32).reshape(len(ids), -1)
            ends = np.cumsum(sizes)
            yield _batch([_nearest(ids[e - m : e], u[e - m : e], HANDS) for e, m in zip(ends, sizes, strict=True) if m > 1])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in _matrix(b.column(1))], pa.binary())], names=["b", "u"])

    vectors = cut(units.mapInArrow(packed, "b long, u binary"), "vectors")
    step = 0
    while True:
        edges = graph.select("a", F.explode("near").alias("x")).select("a", "x.b", "x.d", F.lit(True).alias("old"))
        back = _backward(edges, F.xxhash64(F.lit(step), "a", "b"))
        around = edges.select("a", "b").union(back).union(units.select("node", "node")).distinct()
        met = around.join(vectors, "b").groupBy("a").agg(F.collect_list(F.struct("b", "u")).alias("x"))
        small_batches(units.sparkSession)
        found = met.select("x").mapInArrow(compare, "a long, b long, d float").withColumn("old", F.lit(False))
        graph = cut(_top(edges.union(found), k), "graph")
        told = graph.agg(F.sum(F.size(F.filter("near", lambda x: ~x["old"]))), F.sum(F.size("near"))).first()
        step += 1
        if (told[0] or 0) <= settled * (told[1] or 0):
            return graph


def _backward(edges: DataFrame, order: Column | str) -> DataFrame:
    """(a, b): up to ``BACKWARD`` nodes that have an edge to a."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col(order) if isinstance(order, str) else order).alias("o"))
    return _least(turned, ["a"], ["o", "b"], BACKWARD).select("a", "b")


def _scored(rows: DataFrame) -> DataFrame:
    """(q, score, ids) of rows (q, qv, v, ids): the cosine of the vectors as given, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _scaled(_matrix(b.column(1))), _scaled(_matrix(b.column(2)))
            s = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), b.column(3)], names=["q", "score", "ids"])

    return rows.select("q", "qv", "v", "ids").mapInArrow(run, "q long, score double, ids array<long>")


def walk(queries: DataFrame, graph: DataFrame, units: DataFrame, hold: int = HOLD, expand: int = EXPAND) -> DataFrame:
    """(q, node): the nodes that greedy search holds in the end for each of ``queries`` (q, qu, own).

    qu is the unit vector, own the node that the query is itself, or null. Entry nodes are those with the lowest hash.
    """
    # about 2 sqrt(n) of them: what the driver holds and sends is 50 MB of 64 dimensions for 10^10 vectors
    found = units.select("node", "u").orderBy(F.xxhash64("node"), "node").limit(64 + 2 * math.isqrt(units.count())).collect()
    ids, entries = np.array([r["node"] for r in found], np.int64), np.array([r["u"] for r in found], np.float32)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = []
            for u, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                start = ([], [], []) if own is None else ([-1.0], [own], [False])
                other = np.flatnonzero(ids != own) if own is not None else np.arange(len(ids))
                u = np.array(u, np.float32)
                near = other[np.argsort(-(entries[other] @ u), kind="stable")[:ENTER]]
                x.append(_merged(u, tuple(np.array(c, t) for c, t in zip(start, (float, np.int64, bool), strict=True)), ids[near], entries[near], hold))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, HELD)], names=["q", "qu", "x"])

    def step(key: tuple, own: pa.Table, met: pa.Table) -> pa.Table:
        """What a query holds, with the nodes met that it didn't hold."""
        x = own.column("x").combine_chunks().flatten()
        d, node, done = (x.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        done[np.flatnonzero(~done)[:expand]] = True
        u = np.array(own.column("qu")[0].as_py(), np.float32)
        new = _matrix(met.column("u").combine_chunks()) if met.num_rows else np.zeros((0, len(u)), np.float32)
        out = _merged(u, (d, node, done), met.column("node").to_numpy(), new, hold)
        return pa.table([own.column("q"), own.column("qu"), pa.array([out], HELD)], names=["q", "qu", "x"])

    shape = "q long, qu array<float>, x array<struct<d:double,node:long,done:boolean>>"
    small_batches(queries.sparkSession)
    held = cut(queries.select("q", "qu", "own").mapInArrow(enter, shape), "pool")
    edges = graph.select("a", F.explode("near").alias("x")).select("a", "x.b", "x.d")
    targets = cut(edges.select("a", "b").union(_backward(edges, "d")).distinct(), "targets")
    while True:
        fresh = F.slice(F.filter("x", lambda r: ~r["done"]), 1, expand)
        ahead = held.select("q", F.explode(fresh).alias("r")).select("q", F.col("r.node").alias("a"))
        if ahead.isEmpty():
            return held.select("q", F.explode("x").alias("r")).select("q", "r.node")
        # a node once and only if it isn't held, before vectors are sent
        known = held.select("q", F.explode("x").alias("r")).select("q", "r.node")
        met = ahead.join(targets, "a").select("q", F.col("b").alias("node")).distinct().join(known, ["q", "node"], "left_anti")
        met = met.join(units.select("node", "u"), "node").select(F.col("q").alias("p"), "node", "u")
        active = held.where(F.exists("x", lambda r: ~r["done"]))
        moved = active.groupBy("q").cogroup(met.groupBy("p")).applyInArrow(step, shape)
        held = cut(held.where(~F.exists("x", lambda r: ~r["done"])).unionByName(moved), "pool")


HELD = pa.list_(pa.struct([("d", pa.float64()), ("node", pa.int64()), ("done", pa.bool_())]))
_NOTHING = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)


def _merged(u: np.ndarray, held: tuple, ids: np.ndarray, vectors: np.ndarray, most: int) -> list[dict]:
    """The ``most`` nearest of what was held and of new nodes, nearest first; d is the negative cosine."""
    d = np.concatenate([held[0], -(vectors @ u).astype(np.float64)]) if len(ids) else held[0]
    node, done = np.concatenate([held[1], ids]), np.concatenate([held[2], np.zeros(len(ids), bool)])
    order = np.lexsort((node, d))[:most]
    return [{"d": float(d[i]), "node": int(node[i]), "done": bool(done[i])} for i in order]


def search(vectors: DataFrame, is_query: Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found for each row of ``vectors`` that ``is_query`` (of vec_id) picks.

    Nearness is the cosine of the vectors as given; the query's own row is no result, ties go to the smaller id.
    Null ids and unusable vectors take no part; repeated ids count once for equal vectors. With few rows every
    query gets what there is. Vectors of another length than the most frequent are an error. Other columns, whatever
    their names, play no part; there is no text, so very long ones don't arise.
    """
    rows = usable(vectors, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("n")).count().collect()
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(r['n'] for r in dims)}")
    every = cut(nodes(rows, top + 1), "nodes")
    if not dims:
        return every.select(F.col("node").alias("query_id"), F.lit(1).alias("rank"), F.col("node").alias("vec_id"), F.lit(0.0).alias("score"))
    units = every.select("node", "u")
    graph = build(units, dims[0]["n"])
    asked = rows.where(is_query).select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), F.xxhash64("v").alias("h")).dropDuplicates(["q", "h"])
    own = every.select(F.xxhash64("v").alias("h"), F.col("node").alias("own"), F.col("v").alias("w"))
    asked = asked.join(own, "h", "left").where(F.col("w").isNull() | (F.col("w") == F.col("qv"))).select("q", "qv", "own")
    asked = cut(_with_units(asked, "qv", "qu", "q long, qv array<double>, own long"), "asked")
    held = walk(asked.select("q", "qu", "own"), graph, units)
    exact = _scored(held.join(asked.select("q", "qv"), "q").join(every.select("node", "v", "ids"), "node"))
    exact = exact.select("q", F.explode("ids").alias("vec_id"), "score").where("vec_id != q")
    best = exact.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("d"), "vec_id"))), 1, top).alias("x"))
    out = best.select(F.col("q").alias("query_id"), F.posexplode("x").alias("i", "r"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.d")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 5 nearest of every row of ``embeddings`` whose vec_id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
