"""Token-id output as bit planes, and reading it back.

A block is ``BLOCK`` ids at most, as unsigned 32-bit integers. Its bit planes are the matrix of its
bits transposed: plane k holds bit k of every id, eight ids a byte. With ``planes="byte"`` the four
bytes of the ids are transposed instead. Each plane is compressed with zstandard on its own; planes
of zeros alone take no bytes. Layout of a segment's payload (little-endian):

    magic "TPL1" | u8 plane kind (1 bit, 2 byte) | u8 planes a block | u16 zero | u32 block size
    for each block: u32 ids in it, then u32 bytes of each plane        (the chunk index)
    for each block: its planes, lowest first

Segments hold whole documents, so a long document is a segment of many blocks. They are rows of
Parquet files (any file system that Spark can write), in ascending order of doc_id, with each
document's id and length beside the payload; ids before a segment are known from a manifest of one
row a task. A block can be read from the index without decompressing any other.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.llm.common import trimmed
from tessella.shared import delete_at_end, shared_dir

#: Ids in a block.
BLOCK = 1 << 16
#: Ids in a segment, but for a longer document.
SEGMENT = 1 << 19
_HEAD = struct.Struct("<4sBBHI")
_KINDS = {"bit": (1, 32), "byte": (2, 4)}


def _split(ids: np.ndarray, kind: int) -> np.ndarray:
    """The planes of a block, a row each."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == 2:
        return np.ascontiguousarray(raw.T)
    used = np.flatnonzero(raw.any(axis=0))
    out = np.zeros((32, -(-len(ids) // 8)), np.uint8)
    for k in used:
        byte = np.ascontiguousarray(raw[:, k])
        for bit in range(8):
            out[8 * k + bit] = np.packbits(byte & (1 << bit), bitorder="little")
    return out


def _join(planes: list[np.ndarray | None], n: int, kind: int) -> np.ndarray:
    """The ids of a block from its planes (None: zeros)."""
    raw = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        if plane is None:
            continue
        if kind == 2:
            raw[k] = plane
        else:
            raw[k // 8] |= np.unpackbits(plane, count=n, bitorder="little") << (k % 8)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def encode(ids: np.ndarray, planes: str = "bit", block: int = BLOCK, level: int = 1) -> bytes:
    """A payload of the ids."""
    kind, many = _KINDS[planes]
    pack = zstandard.ZstdCompressor(level=level).compress
    index, body = [_HEAD.pack(b"TPL1", kind, many, 0, block)], []
    for lo in range(0, len(ids), block):
        part = ids[lo : lo + block]
        made = [pack(x.tobytes()) if x.any() else b"" for x in _split(part, kind)]
        index.append(struct.pack(f"<I{many}I", len(part), *map(len, made)))
        body += made
    return b"".join([struct.pack("<I", len(index) - 1), *index, *body])


def decode(payload: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a payload, or of its block ``only``."""
    (blocks,) = struct.unpack_from("<I", payload)
    magic, kind, many, _, _ = _HEAD.unpack_from(payload, 4)
    if magic != b"TPL1":
        raise ValueError("not a bit-plane payload")
    index = np.frombuffer(payload, "<u4", blocks * (1 + many), 4 + _HEAD.size).reshape(blocks, 1 + many).astype(np.int64)
    at = 4 + _HEAD.size + 4 * index.size
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for k, (n, *sizes) in enumerate(index.tolist()):
        if only is None or only == k:
            planes, pos = [], at
            for size in sizes:
                planes.append(np.frombuffer(unpack(payload[pos : pos + size]), np.uint8) if size else None)
                pos += size
            out.append(_join(planes, n, kind))
        at += sum(sizes)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _segment_rows(path: str, end_id: int, planes: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, number, before = tokens.encoder(path), TaskContext.get().partitionId(), 0, 0
        docs, held, size = [], [], 0

        def segment():
            nonlocal number, before, docs, held, size
            row = [[task], [number], [before], [size], [docs], [[len(x) for x in held]], [encode(np.concatenate(held), planes)]]
            number, before, docs, held, size = number + 1, before + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _ARROW, strict=True)], _COLUMNS)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    docs.append(doc_id)
                    held.append(np.append(ids, np.uint32(end_id)))
                    size += len(held[-1])
                    if size >= SEGMENT:
                        yield segment()
        if held:
            yield segment()

    return run


_COLUMNS = ["task", "segment", "before", "ids", "doc_ids", "lengths", "payload"]
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_SCHEMA = "task bigint, segment bigint, before bigint, ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def write(docs: DataFrame, path: str, end_id: int = 2, planes: str = "bit", tokenizer: str | None = None) -> None:
    """Write the ids of all texts (doc_id, text), each with ``end_id`` after it, ascending by doc_id.

    Null and empty texts are their end id alone. Rows that repeat a doc_id are ordered by text; rows
    without a doc_id come first. An empty table gives an empty set of files.
    """
    encoder = tokenizer or tokens.default_path()
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(trimmed(_segment_rows(encoder, end_id, planes)), _SCHEMA).write.option("compression", "none").parquet(path)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, docs, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "lengths", "payload")), strict=True):
            raw = decode(payload).astype("<u4")
            ends = np.cumsum([0, *lengths])
            crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of written files, each with ``start``, the ids before it in all files."""
    found = spark.read.schema(_SCHEMA).parquet(path)
    totals, before = [], 0
    for task, n in sorted(map(tuple, found.groupBy("task").agg(F.sum("ids")).collect())):  # one row a file
        totals.append((task, before))
        before += n
    manifest = spark.createDataFrame(totals or [(0, 0)], "task bigint, first bigint")
    return found.join(F.broadcast(manifest), "task").withColumn("start", F.expr("first + before"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from written files alone."""
    rows = segments(spark, path).select("start", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(trimmed(_digest_rows), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """Write all texts to a folder in the shared place and return the digest read back from it."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, end_id)
    delete_at_end(docs.sparkSession, path)
    return digest(docs.sparkSession, path)
