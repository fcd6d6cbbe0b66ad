"""SimHash near-dedup (8): fingerprints of word shingles, linked through pivot distance tables.

Fingerprints within two bits differ in two bytes at most. So each is filed once under every choice of six of
its eight bytes (28 keys), and two that link meet under at least one key. Within a key the fingerprints' table
of Hamming distances to ``PIVOTS`` reference fingerprints discards a pair as soon as one coordinate differs by
more than the bound (the triangle inequality), and the survivors are verified bit by bit. Fingerprints under
one key differ in 16 bits only, so no key holds more than 65,536 of them however many documents are alike.
Equal texts are one fingerprint before any of this, and a key gives a spanning forest of its links, never all
its pairs; so rows grow with distinct fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import by_core, cut, own_names, small_batches, table
from plumbline.llm.graph import Forest, components

SHINGLE = 3
BITS = 2
PIVOTS = 16
#: Above this many fingerprints under one key they are compared in sorted windows instead of offset by offset.
WINDOWED = 48
#: A key keeps six of eight bytes.
KEPT = [sum(0xFF << (8 * b) for b in kept) for kept in combinations(range(8), 6)]


def pivot_values(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(n)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 without words. Bytes split and lower-case by ASCII rules alone."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, 42) for g in grams], dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes (unsigned, big-endian); 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[i : i + 16384].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row: fp is the fingerprint's bits as a signed long. Null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(prints ^ p) for p in pivots], axis=1).astype(np.int8)


def _close(prints: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs (i, j) link: pivot coordinates discard, the bits verify."""
    keep = np.arange(len(i))
    for p in range(0, rows.shape[1], 4):
        keep = keep[(np.abs(rows[i[keep], p : p + 4] - rows[j[keep], p : p + 4]) <= bits).all(axis=1)]
        if not len(keep):
            return keep
    return keep[np.bitwise_count(prints[i[keep]] ^ prints[j[keep]]) <= bits]


def links_within(prints: np.ndarray, starts: np.ndarray, bits: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run; run r is ``prints[starts[r]:starts[r + 1]]``."""
    if not len(prints):
        return prints, prints
    rows = _distances(prints, pivots)
    lengths = np.diff(starts)
    left = np.repeat(starts[1:], lengths) - np.arange(len(prints))  # rows up to the end of the own run
    small = np.repeat(lengths <= WINDOWED, lengths)
    a, b = [], []
    for d in range(1, int(lengths[lengths <= WINDOWED].max(initial=0))):
        i = np.flatnonzero(small & (left > d))
        if not len(i):
            break
        hit = i[_close(prints, rows, i, i + d, bits)]
        a.append(hit)
        b.append(hit + d)
    for r in np.flatnonzero(lengths > WINDOWED):
        own = np.arange(starts[r], starts[r + 1])
        own = own[np.argsort(rows[own, 0], kind="stable")]
        first, forest = rows[own, 0].astype(np.int16), Forest(len(own))
        for i in range(len(own) - 1):
            end = int(np.searchsorted(first, first[i] + bits, side="right"))
            for at in range(i + 1, end, 4096):
                j = np.arange(at, min(end, at + 4096))
                hits = j[_close(prints, rows, np.full(len(j), own[i]), own[j], bits)]
                new = [int(x) for x in hits if forest.join(i, int(x))]
                if new:
                    a.append(np.full(len(new), own[i]))
                    b.append(own[new])
    if not a:
        return prints[:0], prints[:0]
    i, j = np.concatenate(a), np.concatenate(b)
    # small runs: only the links that a forest needs
    forest, need = Forest(0), []
    near: dict[int, int] = {}
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        for n in (x, y):
            if n not in near:
                near[n] = len(forest.up)
                forest.up.append(near[n])
        if forest.join(near[x], near[y]):
            need.append(k)
    return prints[i[need]], prints[j[need]]


def links(prints: DataFrame, bits: int = BITS, pivots: int = PIVOTS) -> DataFrame:
    """(u, v) that connect exactly the fingerprints (distinct, column ``fp``) whose chains of links do.

    Exact for ``bits`` of two at most: six kept bytes stand for two that may differ.
    """
    if not 0 <= bits <= 2:
        raise ValueError("links of more than two bits need other keys")
    references = pivot_values(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate([[0], new, [len(fp)]])
            many = np.repeat(np.diff(starts) > 1, np.diff(starts))
            lengths = np.diff(starts)
            lengths = lengths[lengths > 1]
            u, v = links_within(fp[many].view(np.uint64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), bits, references)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held = [np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64)]
        for b in batches:
            t, k, fp = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True))
            if not len(t):
                continue
            last = int(np.flatnonzero((t != t[-1]) | (k != k[-1])).max(initial=-1)) + 1
            held = [t[last:], k[last:], fp[last:]]
            if last:
                yield out(t[:last], k[:last], fp[:last])
        if len(held[0]):
            yield out(*held)

    fp = F.col("fp")
    keys = F.explode(F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(KEPT)]))
    filed = prints.select(fp, keys.alias("x")).select("x.t", "x.k", "fp")
    return filed.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(run, "u long, v long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id that links reach, the own one included. Null doc_ids keep their rows
    and count for no minimum (a component of null ids alone has null). Repeated rows stay repeated. An empty
    table gives no rows. Other columns of ``docs``, whatever their names, play no part. A very long text is read whole,
    in one row.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = cut(by_core(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), "distinct")
    roots = components(links(distinct.select("fp"), bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component; columns as they are, whatever their names.

    ``found`` has (doc_id, component_id) of every row, by default those of ``near_duplicates``. Rows that repeat both
    doc_id and text stay once, and so does the text of a component whose ids are all null.
    """
    found = near_duplicates(docs) if found is None else found
    (doc,) = own_names(docs, "doc")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(doc)).distinct()
    met = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(doc)), "left_semi")
    return met.dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: (doc_id, fingerprint, component_id) of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return by_core(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
