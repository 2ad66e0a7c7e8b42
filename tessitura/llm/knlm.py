"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Tokens are words (runs of anything but tab, line feed, vertical tab, form feed, return and space; A-Z in lower case) and one end token
per text; a start token is context only. A task counts its n-grams in numpy, some million tokens at a time, and sends one row per
bucket of hashes, so equal n-grams meet aggregated and no word is a hot key: a bigram's bucket comes from both of its words. A bucket's
task merges its arrays, writes them sorted, and passes on what the lower order and the contexts need of it, which meets the same way.

Written arrays (little-endian, one set of files per bucket, under the folder that executors share): ``raw`` word hash and count,
``pair`` bigram hash and count, ``context`` word hash and its followers' total and numbers of followers seen once, twice and more,
``lower`` word hash and number of distinct predecessors. Scoring tasks map them into memory and look up sorted hashes bucket by bucket,
so pages are read in order; a store without paths is read as a file per bucket instead. Nothing of the corpus reaches the driver but
file names and counts of counts.

    p(w|v) = (max(c(vw) - D(c), 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) p(w)) / c(v.)
    p(w)   = (max(d(w) - E(d), 0) + E-mass / (V + 1)) / sum of d        d(w): distinct predecessors, V: distinct tokens

Words are told apart by 64-bit hashes for counts and 48-bit ones inside bigrams.

Nulls: a null text is empty: one end token. Null ids are kept and, for training, belong to the others. Equal rows are scored one by
one. An empty training set gives every token probability 1 / (V + 1) = 1; an empty table gives no row. Extra columns are not read. There are no ties. A very long text is scored
whole, some hundred bytes a word in its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared

START, END = b"\n<s>", b"\n</s>"  # no word holds a line feed
#: Tokens that a task counts before it sends its rows on.
FLUSH_TOKENS = 2_000_000
#: Bigram tokens per bucket, before aggregation.
BUCKET_TOKENS = 3_000_000
MOST_BUCKETS = 1 << 14
ROWS = "kind string, bucket int, body binary, note string"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MAPPED: dict[str, np.ndarray] = {}


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of two 48-bit ones."""
    x = (v + np.uint64(1)) * _A
    x = (x ^ (x >> np.uint64(32)) ^ w) * _B
    return x ^ (x >> np.uint64(29))


def tokenized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, the hashes of the tokens before them, and where each text starts."""
    words: list[bytes] = []
    starts = []
    for t in texts:
        starts.append(len(words))
        words += shared.lowered(t).split()
        words.append(END)
    w = shared.word_hashes(words)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[starts] = shared.word_hashes([START])[0]
    return w, v, np.array(starts, np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers as byte planes, which compress where high bytes repeat."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _body(columns: list[tuple[np.ndarray, int]]) -> bytes:
    return b"".join(_planes(x, width) for x, width in columns)


def _columns(bodies: list[bytes], widths: tuple[int, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in widths]
    for body in bodies:
        n, at, view = len(body) // sum(widths), 0, memoryview(body)
        for part, width in zip(parts, widths, strict=True):
            part.append(_unplanes(view[at : at + n * width], n, width))
            at += n * width
    return [np.concatenate(p) for p in parts]


def _added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their values."""
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[starts], *(np.add.reduceat(v[order], starts) if len(key) else v for v in values)


def _bucket(key: np.ndarray, bits: int, of: int = 64) -> np.ndarray:
    """The high ``bits`` of keys of ``of`` bits."""
    return (key >> np.uint64(of - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _rows(kind: str, key: np.ndarray, bits: int, columns: list[tuple[np.ndarray, int]], of: int = 48) -> Iterator[tuple]:
    """A row for each bucket of sorted keys of so many bits."""
    edges = np.searchsorted(_bucket(key, bits, of), np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        at = slice(edges[b], edges[b + 1])
        yield kind, b, _body([(x[at], width) for x, width in columns]), None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, body, note = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), pa.array(note, pa.string())], names=["kind", "bucket", "body", "note"])


def _spread(h: np.ndarray) -> np.ndarray:
    """48-bit hashes mixed one to one, so that their high bits are even."""
    low = np.uint64((1 << 48) - 1)
    x = ((h + np.uint64(1)) * _A) & low
    return ((x ^ (x >> np.uint64(24))) * (_B | np.uint64(1))) & low


_RAW, _PAIR, _CONTEXT, _LOWER = (8, 5), (6, 6, 5), (6, 5, 4, 4, 4), (6, 4)


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of raw counts and bigram counts, aggregated per ``FLUSH_TOKENS`` tokens of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            w, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            one = np.ones(len(w), np.uint64)
            word, n = _added(w, one)
            yield _table(list(_rows("raw", word, bits, [(word, 8), (n, 5)], 64)))
            v, w = short(v), short(w)
            key = pair_key(v, w)
            order = np.argsort(key)
            key, v, w = key[order], v[order], w[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(starts, len(key))).astype(np.uint64)
            key, v, w = key[starts], v[starts], w[starts]
            # Inside a bucket by context, so that its bytes compress.
            bucket = _bucket(key, bits)
            order = np.argsort((bucket.astype(np.uint64) << np.uint64(48)) | v)
            bucket = bucket[order]
            edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            out = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[b] : edges[b + 1]]
                out.append(("pair", b, _body([(v[at], 6), (w[at], 6), (n[at], 5)]), None))
            yield _table(out)
            held.clear()

        for batch in shared.sliced(batches, "t"):
            w, v, _ = tokenized(shared.texts_of(batch, "t"))
            held.append((w, v))
            size += len(w)
            if size >= FLUSH_TOKENS:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, ROWS)


def _store(out_dir: str, kind: str, bucket: int, arrays: dict[str, np.ndarray], **facts) -> tuple:
    """Write arrays as files of their own; returns the row that names them."""
    stem = f"{out_dir}/{kind}-{bucket:05d}-{TaskContext.get().taskAttemptId()}"
    for name, x in arrays.items():
        with shared.open_uri(f"{stem}.{name}", "wb") as f:
            f.write(np.ascontiguousarray(x).tobytes())
    return "file", bucket, None, json.dumps({"kind": kind, "stem": stem, "arrays": {k: str(x.dtype.str) for k, x in arrays.items()}, "size": len(next(iter(arrays.values())))} | facts)


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)] + [int(np.count_nonzero(n >= 3))]


def _packed(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as single bytes; those of 255 and more by position beside them."""
    at = np.flatnonzero(n >= 255)
    return {"count": np.minimum(n, 255).astype("u1"), "at": at.astype("<u4"), "large": n[at].astype("<u8")}


def _merged(rows: DataFrame, out_dir: str, bits: int, parts: int) -> DataFrame:
    """First merge: files of raw counts and bigrams; rows for the contexts and the lower order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shared.runs(batches, 2):
            kind, bucket, bodies = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py(), group.column("body").to_pylist()
            if kind == "raw":
                word, n = _added(*_columns(bodies, _RAW))
                yield _table([_store(out_dir, "raw", bucket, {"key": word, "count": n}, tokens=int(n.sum()))])
                continue
            v, w, n = _columns(bodies, _PAIR)
            key = pair_key(v, w)
            order = np.argsort(key)
            key, v, w = key[order], v[order], w[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.add.reduceat(n[order], starts)
            key, v, w = key[starts], v[starts], w[starts]
            out = [_store(out_dir, "pair", bucket, {"key": key} | _packed(n), counts=_counts_of_counts(n))]
            context = _added(_spread(v), n, *((n == k).astype(np.uint64) for k in (1, 2)), (n >= 3).astype(np.uint64))
            out += _rows("context", context[0], bits, list(zip(context, _CONTEXT, strict=True)))
            lower = _added(_spread(w), np.ones(len(w), np.uint64))
            out += _rows("lower", lower[0], bits, list(zip(lower, _LOWER, strict=True)))
            yield _table(out)

    dealt = rows.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(run, ROWS)


def _finished(rows: DataFrame, out_dir: str, parts: int) -> DataFrame:
    """Second merge: files of contexts and the lower order, and the names of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shared.runs(batches, 2):
            kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
            if kind == "file":
                yield _table([("file", bucket, None, x) for x in group.column("note").to_pylist()])
                continue
            bodies = group.column("body").to_pylist()
            if kind == "context":
                key, total, one, two, more = _added(*_columns(bodies, _CONTEXT))
                arrays = {"key": key, "total": total} | {k: x.astype("<u4") for k, x in (("one", one), ("two", two), ("more", more))}
                yield _table([_store(out_dir, "context", bucket, arrays)])
            else:
                key, n = _added(*_columns(bodies, _LOWER))
                yield _table([_store(out_dir, "lower", bucket, {"key": key, "count": n}, total=int(n.sum()), counts=_counts_of_counts(n))])

    dealt = rows.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(run, ROWS)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams seen 1, 2, 3 and 4 times; each lies between 0 and its count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3))


@dataclass
class Model:
    bits: int
    files: dict[str, dict[int, tuple[str, dict[str, str]]]]  # kind, bucket: stem and dtypes
    tokens: int
    types: int
    pair: tuple[float, float, float]
    low: tuple[float, float, float]
    low_total: int
    low_mass: float

    def array(self, kind: str, bucket: int, name: str) -> np.ndarray | None:
        found = self.files.get(kind, {}).get(bucket)
        if found is None:
            return None
        path, dtype = f"{found[0]}.{name}", np.dtype(found[1][name])
        if path not in _MAPPED:
            if len(_MAPPED) > 20_000:
                _MAPPED.clear()
            local = shared.local_path(path)
            if local is not None:
                import os

                _MAPPED[path] = np.memmap(local, dtype, "r") if os.path.getsize(local) else np.empty(0, dtype)
            else:
                with shared.open_uri(path, "rb") as f:
                    return np.frombuffer(f.read(), dtype)
        return _MAPPED[path]

    def lookup(self, kind: str, key: np.ndarray, names: tuple[str, ...], of: int = 64) -> list[np.ndarray]:
        """Values of sorted keys (0 where absent), read bucket by bucket in the order of the arrays."""
        out = [np.zeros(len(key), np.float64) for _ in names]
        edges = np.searchsorted(_bucket(key, self.bits, of), np.arange((1 << self.bits) + 1)).tolist()
        for b in range(1 << self.bits):
            if edges[b] == edges[b + 1]:
                continue
            keys = self.array(kind, b, "key")
            if keys is None or not len(keys):
                continue
            wanted = key[edges[b] : edges[b + 1]]
            at = np.searchsorted(keys, wanted)
            np.minimum(at, len(keys) - 1, out=at)
            hit = np.flatnonzero(keys[at] == wanted)
            mine, at = hit + edges[b], at[hit]
            for o, name in zip(out, names, strict=True):
                o[mine] = self.array(kind, b, name)[at]
            if kind == "pair":
                full = np.flatnonzero(out[0][mine] == 255)
                if len(full):
                    out[0][mine[full]] = self.array(kind, b, "large")[np.searchsorted(self.array(kind, b, "at"), at[full])]
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, tokens that training has, base score and model score (log10)."""
        w, v, starts = tokenized(texts)
        word, back = np.unique(np.concatenate((w, v[starts[:1]])), return_inverse=True)
        at_w, first = back[:-1], back[-1]
        at_v = np.empty_like(at_w)
        at_v[1:] = at_w[:-1]
        at_v[starts] = first
        (count,) = self.lookup("raw", word, ("count",))
        narrow = short(word)
        spread = _spread(narrow)
        order = np.argsort(spread)
        spread = spread[order]
        found = [*self.lookup("lower", spread, ("count",), 48), *self.lookup("context", spread, ("total", "one", "two", "more"), 48)]
        values = np.empty((5, len(word)))
        values[:, order] = found
        lower, total, one, two, more = values
        p_low = self._taken(lower, self.low) + self.low_mass / (self.types + 1)
        p_low = p_low / self.low_total if self.low_total else np.full(len(word), 1.0 / (self.types + 1))
        mass = one * self.pair[0] + two * self.pair[1] + more * self.pair[2]
        key, at, again = np.unique(pair_key(narrow[at_v], narrow[at_w]), return_index=True, return_inverse=True)
        (seen,) = self.lookup("pair", key, ("count",))
        pv, pw = at_v[at], at_w[at]
        known = total[pv] > 0
        p = np.where(known, (self._taken(seen, self.pair) + mass[pv] * p_low[pw]) / np.where(known, total[pv], 1.0), p_low[pw])
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        sums = lambda x: np.add.reduceat(x, starts)
        return np.diff(np.append(starts, len(w))), sums((count > 0)[at_w].astype(np.int64)), sums(base[at_w]), sums(np.log10(p)[again])

    @staticmethod
    def _taken(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        """Counts less their discount."""
        return np.maximum(n - np.array((0.0, *d))[np.minimum(n, 3).astype(np.int64)], 0.0)


def train(docs: DataFrame, out_dir: str, text_col: str = "text") -> Model:
    """Count ``docs`` and write the model's arrays under ``out_dir``, a folder that all executors share."""
    rows = docs.select(F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    bits = min(MOST_BUCKETS, max(1, -(-size // 6 // BUCKET_TOKENS))).bit_length()
    parts = 2 << bits
    manifest = shared.staged(_finished(_merged(_counted(rows, bits), out_dir, bits, parts), out_dir, parts), "lm-files")
    files: dict[str, dict] = {}
    tokens = types = low_total = 0
    pair, low = [0] * 5, [0] * 5
    for r in manifest.select("bucket", "note").collect():  # some hundred bytes a file
        x = json.loads(r["note"])
        files.setdefault(x["kind"], {})[r["bucket"]] = (x["stem"], x["arrays"])
        if x["kind"] == "raw":
            tokens, types = tokens + x["tokens"], types + x["size"]
        elif x["kind"] == "pair":
            pair = [a + b for a, b in zip(pair, x["counts"], strict=True)]
        elif x["kind"] == "lower":
            low = [a + b for a, b in zip(low, x["counts"], strict=True)]
            low_total += x["total"]
    d = discounts(low)
    return Model(bits, files, tokens, types, discounts(pair), d, low_total, low[0] * d[0] + low[1] * d[1] + low[4] * d[2])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # names of files only
    inner = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("t"))
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in inner), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        for batch in shared.sliced(batches, "t", rows=4096):
            if batch.num_rows:
                n, known, base, found = fitted.score(shared.texts_of(batch, "t"))
                columns = [pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), fitted.tokens, np.int64)), pa.array(base), pa.array(found)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*inner, *names])

    return rows.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)), *names)
