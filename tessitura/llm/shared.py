"""Shared folders, staged tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (tests, local mode) a temporary folder of this machine becomes the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.getCheckpointDir() is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessitura-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def session_conf(spark: SparkSession, **values: str):
    """Runtime SQL settings for the jobs that run inside the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def local_path(uri: str) -> str | None:
    """The mounted path of a file URI; None for any other store."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


@contextlib.contextmanager
def open_uri(uri: str, mode: str):
    """A binary file in the shared folder, in whatever store it lives. mode: rb or wb."""
    if (path := local_path(uri)) is not None:
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, mode) as f:
            yield f
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        if "w" in mode:
            store.create_dir(os.path.dirname(path))
        with store.open_output_stream(path) if "w" in mode else store.open_input_file(path) as f:
            yield f


def sliced(batches: Iterator[pa.RecordBatch], text: str, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``rows`` rows and, unless one row alone is larger, ``size`` bytes of ``text``."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


#: Words of a text are runs of anything but these six ASCII characters; ``bytes.split()`` cuts at exactly them.
SPACES = b" \t\n\v\f\r"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def lowered(text: str) -> bytes:
    """A-Z to lower case and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower()


#: Words whose hashes a worker keeps; two generations take some 150 MB at most.
KNOWN_WORDS = 400_000
_KNOWN: dict[bytes, bytes] = {}
_OLDER: dict[bytes, bytes] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    global _KNOWN, _OLDER
    import xxhash

    hold("words", _forget_words)
    found = list(map(_KNOWN.get, words))
    if None in found:
        if len(_KNOWN) > KNOWN_WORDS:
            _KNOWN, _OLDER = {}, _KNOWN
        for i, h in enumerate(found):
            if h is None:
                word = words[i]
                h = found[i] = _OLDER.get(word) or xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
                if len(word) <= 64:
                    _KNOWN[word] = h
    return np.frombuffer(b"".join(found), "<u8")


_CACHES: dict[str, Callable[[], None]] = {}
_HOLDER: list[str] = []


def hold(name: str, clear: Callable[[], None]) -> None:
    """A worker keeps the tables of one kind only: those of another kind, left by an earlier stage, are emptied."""
    _CACHES[name] = clear
    if _HOLDER != [name]:
        for other, empty in _CACHES.items():
            if other != name:
                empty()
        if _HOLDER:
            give_back()
        _HOLDER[:] = [name]


def give_back() -> None:
    """What a worker has freed goes back to the machine: else it stays with the worker, and counts beside the next stage's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def hold_nothing() -> None:
    """For tasks that keep no tables of their own."""
    hold("nothing", lambda: None)


def _forget_words() -> None:
    global _KNOWN, _OLDER
    _KNOWN, _OLDER = {}, {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``keys`` columns of sorted batches; a run is at most some chunks long."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> list[int]:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in range(keys):
            x = np.asarray(table.column(k))
            change |= x[1:] != x[:-1]
        return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        at = cut(table)
        for a, b in zip(at[:-2], at[1:-1], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(at[-2]).to_batches() if table.num_rows else []
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table
