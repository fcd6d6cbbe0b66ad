"""Best-fit packing (2) of documents into sequences of fixed length, under conflicts.

A document longer than a sequence is cut into full sequences and a rest; every piece is placed. Two pieces
conflict if they share a source or a duplicate cluster, and never share a bin. Pieces are placed longest first.
Bins stand in order of the room they have left and carry a bitmap of their sources and one of their clusters;
the search starts at the tightest bin that is large enough and goes on from successor to successor until one is
compatible, else a bin is opened.

Pieces are dealt to shards by a hash of their document's key, piece and number among equal rows, about ``SHARD``
each, and a shard is packed by one task, so no bin, source, cluster or set of repeated rows is ever gathered as a whole.
Fewer pieces a shard would leave more rests.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut as cut_off
from plumbline.llm.common import table

CAPACITY = 2048
#: Pieces that a shard holds in the mean; a task's memory and time follow from it.
SHARD = 4096
#: Repeats of a row that one task deals out.
REPEATS = 65536

KEPT = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64()}
PACKED = "doc_id long, piece int, start long, length long, bin_id string, place int"


class Bins:
    """The bins of one shard, in order of residual room; ties go to the bin opened first."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (room left, number)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a piece with these bits (0: conflicts with nothing); returns its bin and its place there."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.filled)
            for to in (self.sources, self.clusters, self.filled):
                to.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self.filled[number] += 1
        if room > length:
            insort(self.order, (room - length, number))
        return number, self.filled[number] - 1


def pack_shard(pieces: Iterable[tuple[int, object, object]], capacity: int) -> Iterator[tuple[int, int]]:
    """(bin, place) of each piece (length, source, cluster), in the order given: longest first."""
    bins, sources, clusters = Bins(capacity), {}, {}
    bit = lambda known, x: 0 if x is None else 1 << known.setdefault(x, len(known))
    for length, source, cluster in pieces:
        yield bins.place(length, bit(sources, source), bit(clusters, cluster))


def pack(docs: DataFrame, length: Column, cluster: Column, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, source): where it starts in its document, its length,
    its bin and its place there.

    ``length`` counts a document's tokens and ``cluster`` names its duplicates. A null or zero length takes one
    place, so that no row is lost. A null source or cluster conflicts with nothing. Pieces of equal length go by
    doc_id (null first), piece, source and cluster; rows that agree in all of them get the places in turn. An
    empty table gives no rows; other columns, whatever their names, play no part. A very long text is many pieces.
    """
    if capacity < 1:
        raise ValueError("a sequence has room for one token at least")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        cluster.cast("string").alias("cluster"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(1)).cast("long").alias("tokens"),
    )
    # repeated rows are counted before they are dealt out, a stretch of numbers at a time
    rows = cut_off(rows.groupBy("doc_id", "source", "cluster", "tokens").agg(F.count("*").alias("n")), "counted")
    total = rows.agg(F.sum(F.col("n") * F.ceil(F.col("tokens") / capacity))).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    many = rows.where(F.col("n") > REPEATS).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS))).alias("low"))
    spread = rows.where(F.col("n") <= REPEATS).withColumn("low", F.lit(0).cast("long")).unionByName(many.repartition("doc_id", "cluster", "low"))
    number = F.explode(F.sequence("low", F.least(F.col("low") + REPEATS, "n") - 1))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / capacity) - 1))
    cut = spread.select("*", number.alias("number")).select("*", piece.alias("piece"))
    cut = cut.select(
        F.pmod(F.xxhash64("doc_id", "cluster", "piece", "number"), F.lit(shards)).alias("shard"), "doc_id", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("length"), "source", "cluster",
    )

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")]
        rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start"))
        placed = list(pack_shard(zip(*(rows[c].to_pylist() for c in ("length", "source", "cluster")), strict=True), capacity))
        name = key[0].as_py()
        made = [pa.array([f"{name}-{b}" for b, _ in placed], pa.string()), pa.array([p for _, p in placed], pa.int32())]
        return pa.table([*(rows[c].cast(k) for c, k in KEPT.items()), *made], names=[*KEPT, "bin_id", "place"])

    return cut.groupBy("shard").applyInArrow(run, PACKED)


def words(text: str = "text") -> Column:
    """The words of a text, as its length."""
    return F.regexp_count(F.col(text), F.lit(r"\S+"))


def same_text(text: str = "text") -> Column:
    """Names the cluster of texts that agree but for case and white space; null for a null text."""
    return F.md5(F.regexp_replace(F.lower(F.trim(F.col(text))), r"\s+", " "))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document in sequences of 2,048 words, no two of a source or of copies in one."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), words(), same_text())
