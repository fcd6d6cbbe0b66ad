"""Token-ID output (3): length-delimited binary records with masked checksums, and an offset index beside them.

A record file is a run of frames::

    length  u64 little-endian          bytes of the payload
    check   u32                        masked CRC-32 of the 8 length bytes
    payload                            doc_id i64, flags u8 (1: doc_id is null, 2: ids take 4 bytes, else 2), ids
    check   u32                        masked CRC-32 of the payload

The mask rotates a checksum right by 15 bits and adds 0xa282ead8, so that checksums of data holding checksums
stay sound. The index file has 20 bytes for each frame: offset u64, payload bytes u64, ids u32, and the masked CRC-32
of all of them at its end; a reader that shuffles seeks by it. Who reads a file holds what it got against the manifest's
counts of documents, ids and bytes. Files are named by range partition and hold ascending doc_ids; a task writes under names
of its own, and only files that a finished task reported are in the manifest, so a lost executor leaves at worst
files that nothing names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import codec, default_path
from plumbline.llm.common import cut, fresh_path, shuffle_parts, small_batches, table

END_ID = 1
MASK_ADD = 0xA282EAD8
#: Bytes of text for a range partition, and of frames for a file; both bound memory and file size only.
PART_BYTES, FILE_BYTES = 32 << 20, 64 << 20
MANIFEST = "part long, piece long, path string, docs long, ids long, bytes long"


def masked(data: bytes) -> int:
    return _mask(zlib.crc32(data))


def _mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def record(doc_id: int | None, ids: bytes) -> bytes:
    """The payload for ids given as little-endian 32-bit integers; they are kept in 2 bytes where all fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    fits = not len(wide) or int(wide.max()) < 1 << 16
    return struct.pack("<qB", doc_id or 0, (doc_id is None) + 2 * (not fits)) + (wide.astype("<u2").tobytes() if fits else ids)


def parse(payload: bytes) -> tuple[int | None, bytes]:
    """(doc_id, ids as little-endian 32-bit integers)."""
    doc_id, flags = struct.unpack_from("<qB", payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=9)
    return None if flags & 1 else doc_id, ids.astype("<u4").tobytes()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def read_index(path: str) -> np.ndarray:
    """The index of a record file: rows of offset, payload bytes and ids. One that is damaged or cut short raises ValueError."""
    where, name = opened(path + ".idx")
    with where.open_input_stream(name) as f:
        data = f.read()
    if len(data) % 20 != 4 or struct.unpack("<I", data[-4:])[0] != masked(data[:-4]):
        raise ValueError(f"{path}: its index is damaged")
    return np.frombuffer(data[:-4], dtype=[("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u4")])


def read_frames(path: str, rows: Iterable[tuple[int, int]] | None = None) -> Iterator[bytes]:
    """The payloads of a file: in file order, or of the index rows (offset, bytes) given, in their order.

    A length or payload that its checksum doesn't fit raises ValueError.
    """
    if rows is None:
        rows = ((int(x["offset"]), int(x["bytes"])) for x in read_index(path))
    where, name = opened(path)
    with where.open_input_file(name) as f:
        for offset, size in rows:
            f.seek(offset)
            got = f.read(size + 16)
            head, payload = got[:8], got[12:-4]
            if len(got) != size + 16 or struct.unpack("<Q", head)[0] != size or struct.unpack_from("<I", got, 8)[0] != masked(head) or struct.unpack("<I", got[-4:])[0] != masked(payload):
                raise ValueError(f"{path}: the frame at {offset} is damaged")
            yield payload


class _File:
    """A record file and its index as one task writes them."""

    def __init__(self, folder: str, part: int, piece: int) -> None:
        self.part, self.piece = part, piece
        self.path = f"{folder}/ids-{part:06d}-{piece:04d}-{uuid.uuid4().hex[:12]}.rec"
        where, name = opened(self.path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.idx = where.open_output_stream(name), where.open_output_stream(name + ".idx")
        self.docs = self.ids = self.bytes = self.crc = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        data = frame(record(doc_id, ids))
        row = struct.pack("<QQI", self.bytes, len(data) - 16, len(ids) // 4)
        self.crc = zlib.crc32(row, self.crc)
        self.idx.write(row)
        self.out.write(data)
        self.docs, self.ids, self.bytes = self.docs + 1, self.ids + len(ids) // 4, self.bytes + len(data)

    def close(self) -> tuple:
        self.out.close()
        self.idx.write(struct.pack("<I", _mask(self.crc)))
        self.idx.close()
        return self.part, self.piece, self.path, self.docs, self.ids, self.bytes


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` and write their ids under ``folder`` in ascending doc_id order; returns the manifest.

    Null doc_ids come first, equal ones by their text's hash. Null and empty texts have the end id alone. An
    empty table writes no file. Other columns, whatever their names, play no part; a very long text is one frame.
    Texts are dealt by range before they are encoded, so the order costs one
    shuffle of text, and the number of ranges follows the bytes of text.
    """
    spark, path = docs.sparkSession, path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, end = codec(path), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        file, done = None, []
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if file is not None and file.bytes >= FILE_BYTES:
                    done.append(file.close())
                    file = None
                if file is None:
                    file = _File(folder, part, len(done))
                file.add(doc_id, c.encode(x.as_py() or "") + end)
        if file is not None:
            done.append(file.close())
        if done:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-size // PART_BYTES))
    small_batches(spark)
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return cut(dealt.mapInArrow(run, MANIFEST), "manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from its files; start counts the ids before it.

    A damaged file, or one that holds other numbers of documents, ids or bytes than the manifest says, raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, docs, ids, size, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cols: list[list] = [[], [], [], []]
                start, got = first, 0
                for payload in read_frames(path):
                    doc_id, own = parse(payload)
                    for to, x in zip(cols, (doc_id, start, len(own) // 4, zlib.crc32(own)), strict=True):
                        to.append(x)
                    start += len(own) // 4
                    got += len(payload) + 16
                if (len(cols[0]), start - first, got) != (docs, ids, size):
                    raise ValueError(f"{path}: not what the manifest says")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=[f.split()[0] for f in READ.split(", ")])

    # ids before a file: within its range partition, and in all partitions before it, a row for each of those
    order = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.withColumn("within", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    placed = within.join(_before(manifest.groupBy("part").agg(F.sum("ids").alias("ids"))), "part").select("path", "docs", "ids", "bytes", (F.col("within") + F.col("before")).alias("start"))
    return placed.repartition(shuffle_parts(manifest.sparkSession), "path").mapInArrow(run, READ)


def _before(parts: DataFrame, stretch: int = 4096) -> DataFrame:
    """(part, before): the ids of all parts before each, by stretches of parts: one window holds a row a stretch, 250 for a million parts."""
    dealt = parts.withColumn("stretch", F.floor(F.col("part") / stretch))
    own = Window.partitionBy("stretch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("ids").over(own), F.lit(0)))
    sums = dealt.groupBy("stretch").agg(F.sum("ids").alias("all"))
    before = sums.select("stretch", F.coalesce(F.sum("all").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum"))
    return inside.join(before, "stretch").select("part", (F.col("inside") + F.col("sum")).alias("before"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's ids, written, and read back from the files."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "token-ids")))
