"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

A shard is a pair of files. ``*.rec`` holds one record per document, in ascending id order:

    uint64 length | uint32 masked crc of those 8 bytes | payload | uint32 masked crc of the payload

with crc the CRC-32 of zlib and ``mask(c) = rotate_right(c, 15) + 0xa282ead8`` (mod 2**32). The payload is int64 id, uint8 flags
(1: the id is null, 2: ids take four bytes instead of two), then the token ids, all little-endian. ``*.idx`` holds one entry per
record for shuffled reads: uint64 offset in the .rec file, uint64 first token (ids of the shard's earlier records), uint32 tokens,
uint32 reserved; it ends with the uint32 masked crc of all entries.

Shards are the partitions of a range partitioning by id, sorted inside; their manifest is a staged table of one row per shard, so
no document's data ever reaches the driver. A task writes files named after its attempt and only a finished task's manifest row
names them, so lost executors and speculative copies leave no wrong shard behind.

Nulls: a null text is an empty one (only the end id remains), a null id sorts first and is kept; equal ids keep a row each, ordered
by text. An empty table gives no shard and no row. Extra columns are not read. There are no ties: equal rows are equal
records. A very long text is a slice and a record of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm import shared, subwords

MANIFEST = "shard int, records string, entries string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids binary, shard int, position long"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, position long"
ENTRY = np.dtype([("offset", "<u8"), ("first", "<u8"), ("tokens", "<u4"), ("reserved", "<u4")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qB", doc_id or 0, (doc_id is None) | 2 * (width == 4)) + ids


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the token ids (uint32) of a payload."""
    doc_id, flags = struct.unpack_from("<qB", data)
    return None if flags & 1 else doc_id, np.frombuffer(data, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def read_frames(f) -> Iterator[bytes]:
    """The payloads of a .rec file, every checksum verified."""
    while head := f.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("a record's length is damaged")
        (size,) = struct.unpack("<Q", head[:8])
        data, tail = f.read(size), f.read(4)
        if len(data) < size or struct.pack("<I", masked(data)) != tail:
            raise ValueError("a record's payload is damaged")
        yield data


def read_entries(f) -> np.ndarray:
    """The index of a shard, its checksum verified."""
    data = f.read()
    if len(data) % ENTRY.itemsize != 4 or struct.pack("<I", masked(data[:-4])) != data[-4:]:
        raise ValueError("an index is damaged")
    return np.frombuffer(data[:-4], ENTRY)


def read_at(f, offset: int) -> tuple[int | None, np.ndarray]:
    """One record of an open .rec file by its offset, as shuffled reads need it."""
    f.seek(offset)
    return unpack(next(read_frames(f)))


def write(docs: DataFrame, out_dir: str, vocabulary: str, style: str = "byte", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write every row of ``docs`` under ``out_dir``, a folder that all executors share; returns the staged manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = subwords.encoder(vocabulary, style)
        width, end = encode.dtype.itemsize, np.asarray([end_id], encode.dtype).tobytes()
        task = TaskContext.get()
        shard = task.partitionId()
        names = [f"{out_dir}/shard-{shard:06d}-{task.taskAttemptId()}.{x}" for x in ("rec", "idx")]
        first = next(batches, None)
        if first is None:
            return
        entries, offset, tokens = [], 0, 0
        with shared.open_uri(names[0], "wb") as f:
            for batch in shared.sliced(_chain(first, batches), "t"):
                doc_ids = batch.column(0).to_pylist()
                for doc_id, ids in zip(doc_ids, encode.encode(shared.texts_of(batch, "t")), strict=True):
                    ids += end
                    record = frame(payload(doc_id, ids, width))
                    f.write(record)
                    entries.append((offset, tokens, len(ids) // width, 0))
                    offset += len(record)
                    tokens += len(ids) // width
        if entries:
            index = np.array(entries, ENTRY).tobytes()
            with shared.open_uri(names[1], "wb") as f:
                f.write(index + struct.pack("<I", masked(index)))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "records": [names[0]], "entries": [names[1]], "n_docs": [len(entries)], "n_tokens": [tokens], "n_bytes": [offset]})

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    ordered = rows.repartitionByRange(F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), "t")
    return shared.staged(ordered.mapInArrow(run, MANIFEST), "records-manifest")


def _chain(first, rest):
    yield first
    yield from rest


def read(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """Every record of the shards that ``manifest`` lists, a task for each shard: id, start (tokens of all records before it),
    n_tokens, and the ids as little-endian uint32 or, for ``digests``, their CRC-32."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "records", "entries", "n_docs", before.alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with shared.open_uri(row["entries"], "rb") as f:
                    entries = read_entries(f)
                if len(entries) != row["n_docs"]:
                    raise ValueError(f"{row['entries']} has {len(entries)} entries instead of {row['n_docs']}")
                out, held = [], 0
                with shared.open_uri(row["records"], "rb") as f:
                    for k, data in enumerate(read_frames(f)):
                        doc_id, ids = unpack(data)
                        if len(ids) != entries["tokens"][k]:
                            raise ValueError("the index disagrees with the records")
                        body = ids.tobytes()
                        out.append((doc_id, row["base"] + int(entries["first"][k]), len(ids), zlib.crc32(body) if digests else body, row["shard"], k))
                        held += 64 if digests else len(body)
                        if held > 4 << 20:
                            yield _batch(out, digests)
                            out, held = [], 0
                if k + 1 != len(entries):
                    raise ValueError("records are missing")
                yield _batch(out, digests)

    n = max(1, manifest.count())
    return shards.repartition(n).mapInArrow(run, DIGESTS if digests else ROWS)


def _batch(rows: list[tuple], digests: bool) -> pa.RecordBatch:
    doc_id, start, n, body, shard, position = zip(*rows, strict=True) if rows else [()] * 6
    kind = pa.int64() if digests else pa.binary()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(body, kind), pa.array(shard, pa.int32()), pa.array(position, pa.int64())],
        names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids", "shard", "position"],
    )
