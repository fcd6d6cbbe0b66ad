"""Media columns (1): payloads stored as 8-bit samples, in content-defined chunks.

A payload is wrapped as an 8-bit mono WAV file. A rolling gear hash over its bytes places the cuts, so equal
passages give equal chunks wherever they stand. Distinct chunks, by digest, are the store; a document keeps the
ordered list of its digests. Reading joins the lists to the store, puts each file together again, verifies its
digest against the one taken when it was written, and computes features from the samples read back.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, small_batches, table

UNIT = 64
RATE = 8000
HEADER = 44
#: Bytes of a chunk: least, mean (a power of two) beyond the least, most.
LEAST, MEAN, MOST = 2048, 8192, 65536
#: Bytes that the rolling hash looks back on: as many as its register has bits.
WINDOW = 32

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint32)
CHUNKS = "rid long, doc_id long, n_bytes long, whole binary, chunks int, seq long, digest binary, data binary"


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(data: bytes) -> bytes:
    """8-bit unsigned mono PCM; a sample is a byte of the payload."""
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(data)) + data


def from_wav(stored: bytes) -> np.ndarray:
    """The samples of a file made by ``to_wav``; a damaged one raises ValueError."""
    if stored[:4] != b"RIFF" or stored[8:16] != b"WAVEfmt " or stored[36:40] != b"data":
        raise ValueError("not an 8-bit mono WAV file")
    (size,) = struct.unpack_from("<I", stored, 40)
    if size != len(stored) - HEADER:
        raise ValueError("the WAV file is cut short")
    return np.frombuffer(stored, dtype=np.uint8, offset=HEADER)


def gear(data: bytes) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + GEAR[byte] in 32 bits, by doubling its window."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:
        if width < len(h):
            nxt = h.copy()
            nxt[width:] += h[:-width] << np.uint32(width)
            h = nxt
        width *= 2
    return h


def cuts(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """The ends of the chunks of ``data``, the last of them its length."""
    if len(data) <= least:
        return [len(data)]
    mask = np.uint32((mean - 1) << (32 - mean.bit_length() + 1))
    places = (np.flatnonzero((gear(data) & mask) == 0) + 1).tolist()
    ends, at, k = [], 0, 0
    while len(data) - at > least:
        while k < len(places) and places[k] < at + least:
            k += 1
        end = min(places[k] if k < len(places) else len(data), at + most, len(data))
        ends.append(end)
        at = end
    if at < len(data):
        ends.append(len(data))
    return ends


def features(samples: np.ndarray) -> str:
    """Mean, RMS about the middle, zero crossings and entropy of the samples."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256) - 128.0
    mean = float(values @ counts) / len(samples)
    rms = math.sqrt(float((values * values) @ counts) / len(samples))
    high = samples >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    return f"mean={mean:.4f};rms={rms:.4f};zero_crossings={crossings};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def chunked(docs: DataFrame, with_data: bool) -> DataFrame:
    """One row for each chunk; ``rid`` tells rows apart even where doc_ids repeat. Without data only the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for rid, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, data = payload(text.as_py())
                stored = to_wav(data)
                at, ends = 0, cuts(stored)
                for seq, end in enumerate(ends):
                    piece = stored[at:end]
                    at = end
                    whole = hashlib.sha256(stored).digest() if not seq and not with_data else None
                    for to, x in zip(rows, (rid, doc_id, n, whole, len(ends), seq, hashlib.sha256(piece).digest(), pack.compress(piece) if with_data else None), strict=True):
                        to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


def chunk_store(docs: DataFrame) -> DataFrame:
    """(digest, data): every distinct chunk once. Copies meet within tasks before they are shuffled."""
    return chunked(docs, True).groupBy("digest").agg(F.first("data").alias("data"))


def chunk_lists(docs: DataFrame) -> DataFrame:
    """The ordered digests of every document, and with the first the digest of the whole stored file."""
    return cut(chunked(docs, False).drop("data"), "chunk-lists")


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, chunks int"


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Each document's file from its chunk list, verified, with what is computed from the samples read back.

    A chunk that the store lacks or a digest that differs raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = [f.split()[0] for f in OUT.split(", ")]

        def made(parts: list[dict]) -> tuple:
            stored = b"".join(unpack.decompress(x["data"]) for x in parts)
            digest = hashlib.sha256(stored)
            if digest.digest() != parts[0]["whole"] or [x["seq"] for x in parts] != list(range(parts[0]["chunks"])):
                raise ValueError(f"document {parts[0]['doc_id']}: the chunks don't give the stored file")
            samples = from_wav(stored)
            data = samples.tobytes()
            return (parts[0]["doc_id"], parts[0]["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(stored), digest.hexdigest(), features(samples), len(parts))

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        parts: list[dict] = []
        for b in batches:
            rows = []
            for x in (dict(zip(b.schema.names, r, strict=True)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if parts and parts[0]["rid"] != x["rid"]:
                    rows.append(made(parts))
                    parts = []
                parts.append(x)
            if rows:
                yield out(rows)
        if parts:
            yield out([made(parts)])

    small_batches(lists.sparkSession)

    def joined(some: DataFrame) -> DataFrame:
        return some.join(store, "digest", "left").select("rid", "doc_id", "n_bytes", "whole", "chunks", "seq", "data")

    # a file of one chunk is whole where it is joined; the chunks of others are brought together
    one, more = joined(lists.where("chunks = 1")), joined(lists.where("chunks > 1"))
    return one.mapInArrow(run, OUT).union(more.repartition("rid").sortWithinPartitions("rid", "seq").mapInArrow(run, OUT))


def media(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``, repeated ones included, with what its stored media gives when read.

    A null text is the empty text; its payload is 64 zero bytes. Null doc_ids keep their rows. An empty table
    gives no rows; other columns, whatever their names, play no part. A very long text is many chunks, put together in
    one task.
    """
    lists = chunk_lists(docs)
    heads = lists.where("seq = 0").select("rid", "doc_id", "n_bytes", "whole")
    # copies of a text are one file: it is put together once, and the copies meet its features in a join that splits
    once = heads.groupBy("whole").agg(F.min("rid").alias("rid")).select("rid")
    files = read_media(lists.join(once, "rid", "left_semi"), chunk_store(docs)).drop("doc_id", "n_bytes")
    found = heads.withColumn("media_sha256", F.lower(F.hex("whole"))).join(files, "media_sha256", "left")
    return found.select(*[f.split()[0] for f in OUT.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: stored media of every document and their features."""
    return media(table(spark, sf_dir, "documents"))
