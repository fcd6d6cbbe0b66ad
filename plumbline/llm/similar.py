"""Near-duplicates by the Jaccard similarity of word shingles, for operator 8 where two differing bits are too few.

Texts of equal shingle sets are one set. Operator 8's own links come first: each set has the fingerprint of its shingles,
and fingerprints of two bits' difference at most meet by the exact blocks and pivot distance tables of ``simhash.links``.
Those links are held against the sets themselves and contracted. Similar sets may differ in more bits than any exact
block allows (ten of 64 on average at 0.8), so what they leave apart is sought in bands: min-hashes are filed in
``BANDS`` bands of ``ROWS``; two sets of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS, which is
0.9999 at 0.8 and nearer to one above. Bands whose sets hang together by then take no further part.
Sets that share a band are compared on their shingles themselves, so no link is a guess. In a band the sets of
lowest hash lead, and all others not yet connected to them are compared with them; leaders go, and the band is done
when what is left hangs together. The rounds take four times as many leaders each. So a group of copies costs rows
in proportion to its size; only sets that share bands and are not alike cost a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.common import by_core, cut, small_batches
from plumbline.llm.graph import components, further

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted; none without words. Words as in ``simhash.fingerprint``."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], dtype=np.uint64))


def _sid(own: np.ndarray) -> int:
    """What a set is known by; 0 for the empty one."""
    return xxhash.xxh64_intdigest(own.tobytes(), 1) if len(own) else 0


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each band; sets of no shingle have none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.min([((_SEEDS[0][:, None] ^ own[i : i + 1024]) * _SEEDS[1][:, None]).min(axis=1) for i in range(0, len(own), 1024)], axis=0).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)], dtype=np.uint64).view(np.int64)


def _filed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, sid, n, fp, bands) of every row; th tells texts apart, n counts the set, fp is its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), shingle) for x in b.column(2)]
            sid = np.array([_sid(x) for x in sets], dtype=np.uint64).view(np.int64)
            n = pa.array([len(x) for x in sets], pa.int32())
            prints = np.array([simhash.majority(x.astype(">u8")) for x in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sid, pa.int64()), n, pa.array(prints, pa.int64()), keys], names=["doc_id", "th", "sid", "n", "fp", "bands"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, sid long, n int, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sid, own): the shingles of the sets that ``wanted`` (th, sid) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(x.as_py(), shingle).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["sid", "own"])

    small_batches(docs.sparkSession)
    source = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    met = source.join(wanted, "th").select("sid", "text").dropDuplicates(["sid"])
    return met.mapInArrow(run, "sid long, own binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (u, v, ru, rv) whose sets have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both >= least * (len(x) + len(y) - both))
            yield b.filter(pa.array(hit, pa.bool_())).select(["u", "v", "ru", "rv"])

    small_batches(pairs.sparkSession)
    rows = pairs.join(sets.select(F.col("sid").alias("u"), F.col("own").alias("x")), "u").join(sets.select(F.col("sid").alias("v"), F.col("own").alias("y")), "v")
    return rows.select("u", "v", "ru", "rv", "x", "y").mapInArrow(run, "u long, v long, ru long, rv long")


def _linked(distinct: DataFrame) -> DataFrame:
    """(u, v) of sets (sid, fp) whose fingerprints operator 8 links: one set for each fingerprint, and every other one of its with that."""
    heads = cut(by_core(distinct.groupBy("fp").agg(F.min("sid").alias("head"))), "heads")
    met = simhash.links(heads.select("fp")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    ends = lambda fp, end: heads.select(F.col("fp").alias(fp), F.col("head").alias(end))
    across = met.join(ends("a", "x"), "a").join(ends("b", "y"), "b").select("x", "y")
    within = distinct.join(heads, "fp").where(F.col("sid") != F.col("head")).select(F.col("sid").alias("x"), F.col("head").alias("y"))
    return across.union(within).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def similar(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``, which has doc_id and text.

    Texts whose sets of shingles have a Jaccard similarity of at least ``least`` are linked; component_id is the
    smallest doc_id that links reach. A text of fewer words than a shingle is one shingle; null and wordless texts
    are alike. Null ids, repeated rows, empty tables, other columns and very long texts as in ``simhash.near_duplicates``.
    """
    filed = cut(_filed(docs, shingle), "filed")
    distinct = cut(by_core(filed.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min("th").alias("th"), F.min("fp").alias("fp"))), "distinct")
    linked = cut(by_core(_linked(distinct.select("sid", "fp"))), "linked")
    each = filed.select("sid", "n", "bands").dropDuplicates(["sid"]).select("sid", "n", F.explode("bands").alias("k"))
    each = cut(by_core(each), "bands")
    shared = cut(by_core(each.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")), "shared")
    left = cut(by_core(each.join(shared, "k").select("k", "sid", "n")), "left")
    wanted = left.select("sid").union(linked.select("u")).union(linked.select("v")).distinct()
    sets = cut(_sets(docs, distinct.join(wanted, "sid", "left_semi").select("th", "sid"), shingle), "sets")
    edges = cut(_alike(linked.select("u", "v", F.col("u").alias("ru"), F.col("v").alias("rv")), sets, least), "alike")
    roots = components(edges.select("u", "v"))
    named = left.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lead = F.min(F.struct(F.xxhash64("sid").alias("r"), "sid", "n", "root")).alias("lead")
    leads = cut(by_core(named.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), lead).where("lo != hi").select("k", "lead")), "leads")
    left = cut(by_core(named.join(leads, "k").where(F.col("sid") != F.col("lead.sid"))), "left")
    close = (F.col("n") >= F.lit(least) * F.col("lead.n")) & (F.col("lead.n") >= F.lit(least) * F.col("n"))
    u, v = F.least("sid", "lead.sid").alias("u"), F.greatest("sid", "lead.sid").alias("v")
    ends = (F.col("root").alias("ru"), F.col("lead.root").alias("rv"))
    first = left.where(F.col("root") != F.col("lead.root")).where(close).select(u, v, *ends).dropDuplicates(["u", "v"])
    new = cut(_alike(first, sets, least).select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "alike")
    roots, many = further(roots, new), 1
    left = left.select("k", "sid", "n")
    while True:
        named = left.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        split = cut(by_core(named.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("k")), "split")
        left = cut(by_core(named.join(split, "k")), "left")
        if left.isEmpty():
            break
        many *= 4
        order = Window.partitionBy("k").orderBy(F.xxhash64("sid"), "sid")
        placed = cut(left.withColumn("place", F.row_number().over(order)), "placed")
        ahead = placed.where(F.col("place") <= many).select("k", F.struct("sid", "n", "root", "place").alias("lead"))
        pairs = placed.join(ahead, "k").where((F.col("place") > F.col("lead.place")) & (F.col("root") != F.col("lead.root"))).where(close)
        pairs = pairs.select(u, v, F.col("root").alias("ru"), F.col("lead.root").alias("rv")).dropDuplicates(["u", "v"])
        new = cut(_alike(pairs, sets, least).select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "alike")
        left = placed.where(F.col("place") > many).select("k", "sid", "n")
        if not new.isEmpty():
            roots = further(roots, new)
    rooted = distinct.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least_id = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return filed.select("doc_id", "sid").join(rooted.join(least_id, "root").select("sid", "component_id"), "sid").select("doc_id", "component_id")
