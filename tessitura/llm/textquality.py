"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Tokens are runs of letters (A-Z in lower case; every byte beyond ASCII counts as a letter), runs of digits, and each other character that
is no space; a line feed is a token too. A token's hash gives one of ``SLOTS`` rows, its shape (kind, case, length) one of ``SHAPES`` more.

Random indexing: each slot has a fixed sparse index vector of ``NONZERO`` entries +1 or -1 among ``DIM``. A row's vector is the sum of the
index vectors of all tokens up to ``WINDOW`` places away in the same text, over all documents. Tasks add up their integer matrices in
numpy and send them once, in blocks; blocks meet in two steps, first salted, so no task gathers more than a share. The driver receives
one matrix of (SLOTS + SHAPES) x (DIM + 1) numbers whatever the input's size; it is broadcast (some 4 MB, fixed by these constants).

A document is pooled to the mean word vector, the mean shape vector, their lengths, the logarithm of its tokens and the share of distinct
slots. The network (tanh, then one logit) is fitted by Adam on at most about ``max_rows`` labelled rows, taken by a hash of their id; a
fifth of them, by another hash, stays out of the fit and sets the temperature that divides the logit. With no label of one kind, every
score is the smoothed share of good labels.

Nulls: a null text is an empty one and gets a score like it; labels without id or quality teach nothing, a null id is kept in scoring.
Repeated rows are scored one by one and equal texts get equal scores; in the sample a text counts once per id. A score of exactly
``threshold`` is predicted 1. An empty table gives no row. Very long texts are read whole, a slice of its own each. Extra columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared

SLOTS, SHAPES, DIM = 1 << 14, 64, 64
NONZERO, WINDOW = 4, 2
MAX_ROWS = 20_000
#: Rows of the matrix in one message.
BLOCK = 257 * 64
_ROWS = SLOTS + SHAPES

_SPACE, _LETTER, _DIGIT, _MARK = 0, 1, 2, 3
_KIND = np.full(256, _MARK, np.uint8)
_KIND[128:] = _LETTER
_KIND[[32, 9, 11, 12, 13]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = np.where(_KIND == _SPACE, np.uint64(0), _mixed(_LOW + np.uint64(1)))
_PLACE = _mixed(np.arange(64, dtype=np.uint64) + np.uint64(1000)) | np.uint64(1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries, ``NONZERO`` a slot; a position may repeat."""
    draw = _mixed(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(1 << 40)).reshape(SLOTS, NONZERO)
    return (draw % np.uint64(DIM)).astype(np.int32), np.where(draw >> np.uint64(63), 1, -1).astype(np.int32)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot and the shape row of every token, and how many tokens each text has."""
    bodies = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(bodies) + b" ", np.uint8)
    edges = np.cumsum([0] + [len(b) + 1 for b in bodies])
    kind = _KIND[data]
    begins = kind != _SPACE
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _MARK)
    start = np.flatnonzero(begins)
    n = np.diff(np.searchsorted(start, edges))
    if not len(start):
        return np.empty(0, np.int32), np.empty(0, np.int32), n
    data, kind = data[start[0] :], kind[start[0] :]
    start -= start[0]
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    slot = (_mixed(np.add.reduceat(_VALUE[data] * _PLACE[np.minimum(place, 63)], start)) >> np.uint64(50)).astype(np.int32)
    length = np.add.reduceat((kind != _SPACE).astype(np.int32), start)
    upper = np.add.reduceat(_UPPER[data].astype(np.int32), start)
    case = np.where(upper == 0, 0, np.where(upper >= length - length // 4, 1, np.where(upper == 1, 2, 3)))  # lower, upper, one capital, mixed
    size = np.searchsorted([2, 4, 8, 16, 32], length, side="right")
    first = kind[start]
    shape = np.where(first == _LETTER, case * 6 + size, np.where(first == _DIGIT, 24 + size, np.where(data[start] == 10, 30, 31 + data[start] % 32)))
    return slot, (SLOTS + shape).astype(np.int32), n


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))


def _messages(total: np.ndarray, salt: int) -> pa.RecordBatch:
    """The blocks of an integer matrix, as compressed byte planes."""
    flat, rows = total.ravel(), []
    for b in range(0, len(flat), BLOCK):
        part = flat[b : b + BLOCK].astype("<i8")
        if part.any():
            rows.append((b, salt, zlib.compress(np.ascontiguousarray(part.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)))
    b, s, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(s, pa.int32()), pa.array(body, pa.binary())], names=["b", "s", "body"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_ROWS * (DIM + 1), np.int64)
    for batch in batches:
        for b, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            planes = np.frombuffer(zlib.decompress(body), np.uint8).reshape(8, -1)
            part = np.ascontiguousarray(planes.T).view("<i8").ravel()
            total[b : b + len(part)] += part
    yield _messages(total, 0)


def count_contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rows x (DIM + 1): the summed index vectors of each row's contexts and, last, its occurrences, over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shared.hold_nothing()
        at, sign = index_vectors()
        total = np.zeros(_ROWS * (DIM + 1), np.int64)
        for batch in shared.sliced(batches, "t", rows=4096, size=2 << 20):
            slot, shape, n = tokens(shared.texts_of(batch, "t"))
            text = np.repeat(np.arange(len(n)), n)
            for rows in (slot, shape):
                total[DIM :: DIM + 1] += np.bincount(rows, minlength=_ROWS)
                base = rows * (DIM + 1)
                for away in range(1, WINDOW + 1):
                    same = np.flatnonzero(text[away:] == text[:-away])
                    for mine, other in ((same, same + away), (same + away, same)):
                        cell, value = base[mine, None] + at[slot[other]], sign[slot[other]]
                        total += np.bincount(cell.ravel(), value.ravel(), minlength=len(total)).astype(np.int64)
        yield _messages(total, TaskContext.get().partitionId() % 64)

    schema = "b int, s int, body binary"
    sent = _texts(docs, text_col).mapInArrow(run, schema).repartition("s", "b").mapInArrow(_added, schema)
    out = np.zeros(_ROWS * (DIM + 1), np.int64)
    for r in sent.repartition("b").mapInArrow(_added, schema).collect():  # one row a block
        planes = np.frombuffer(zlib.decompress(r["body"]), np.uint8).reshape(8, -1)
        part = np.ascontiguousarray(planes.T).view("<i8").ravel()
        out[r["b"] : r["b"] + len(part)] += part
    return out.reshape(_ROWS, DIM + 1)


def word_vectors(counts: np.ndarray) -> np.ndarray:
    """Unit context vectors less their common direction, weighted down where a row is frequent; rows never seen are zero."""
    sums, seen = counts[:, :DIM].astype(np.float64), counts[:, DIM].astype(np.float64)
    mean = sums / np.maximum(seen, 1)[:, None]
    for part in (slice(0, SLOTS), slice(SLOTS, None)):
        total = seen[part].sum()
        if total:
            mean[part] -= np.where(seen[part, None] > 0, (sums[part].sum(axis=0) / total), 0.0)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    unit = np.divide(mean, length, out=np.zeros_like(mean), where=length > 1e-12)
    share = seen[:SLOTS] / max(1.0, seen[:SLOTS].sum())
    unit[:SLOTS] *= (1e-3 / (1e-3 + share))[:, None]
    return unit.astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    slot, shape, n = tokens(texts)
    out = np.zeros((len(texts), 2 * DIM + 4))
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        size = n[full, None]
        out[full, :DIM] = np.add.reduceat(vectors[slot], starts, axis=0) / size
        out[full, DIM : 2 * DIM] = np.add.reduceat(vectors[shape], starts, axis=0) / size
        out[full, -4] = np.linalg.norm(out[full, :DIM], axis=1)
        out[full, -3] = np.linalg.norm(out[full, DIM : 2 * DIM], axis=1)
        out[full, -2] = np.log1p(n[full])
        pairs = np.unique(np.repeat(np.arange(len(n)), n).astype(np.int64) * SLOTS + slot)
        out[:, -1] = np.bincount(pairs // SLOTS, minlength=len(n)) / np.maximum(n, 1)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    prior: float  # the score where there was nothing to tell apart
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()  # weights and biases of the two layers
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.prior)
        return sigmoid(self.logits(pooled(texts, self.vectors)) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the cross-entropy; ``decay`` shrinks the weights."""
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            h = np.tanh(x[rows] @ layers[0] + layers[1])
            error = (sigmoid(h @ layers[2] + layers[3]) - y[rows]) / len(rows)
            back = error[:, None] * layers[2] * (1 - h * h)
            step += 1
            for k, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ error, np.array([error.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layers[k] = layers[k] - speed * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + (decay * layers[k] if k in (0, 2) else 0))
    return tuple(layers)


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, from 0.5 (where all are told apart) to 20, by golden-section search over its logarithm; 1 without rows."""
    if not len(z):
        return 1.0
    low, high, g = np.log(0.5), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if _loss(z / np.exp(a), y) <= _loss(z / np.exp(b), y) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Word vectors from all of ``corpus`` (``docs`` unless given), the network from the rows of ``docs`` that ``labels`` mark."""
    vectors = word_vectors(count_contexts(docs if corpus is None else corpus, text_col))
    usable = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    usable = usable.select(F.col(f"`{id_col}`").cast("long").alias("d"), (F.col(f"`{label_col}`").cast("double") == 1).cast("int").alias("y"))
    share = lambda size: min(1.0, max_rows / max(1, size))
    drawn = lambda of, size: F.pmod(of, F.lit(1 << 30)) / (1 << 30) < share(size)
    chosen = usable.where(drawn(F.xxhash64("d"), usable.count()))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(chosen), "d")  # at most some max_rows labels
    digest = F.xxhash64("d", F.lit(5), "t")
    keys = rows.select(digest.alias("k")).distinct().count()  # where ids repeat there may be many texts for a label
    rows = rows.where(drawn(digest, keys)).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "d"), F.lit(5)).cast("int")).withColumn("k", digest)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.hold_nothing()
        for batch in shared.sliced(batches, "t"):
            x = pooled(shared.texts_of(batch, "t"), fitted.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "y", "part", "x"])

    fitted = docs.sparkSession.sparkContext.broadcast(vectors)
    found = rows.select("k", "y", "part", "t").mapInArrow(features, "k long, y int, part int, x binary").dropDuplicates(["k", "y"]).orderBy("k", "y").collect()
    y = np.array([r["y"] for r in found], np.float64)
    good = float(y.sum())
    prior = (good + 1) / (len(y) + 2)
    if good in (0.0, float(len(y))):
        return Model(vectors, prior)
    x = np.frombuffer(b"".join(r["x"] for r in found)).reshape(len(found), -1)
    held = np.array([r["part"] == 0 for r in found])
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    center, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    model = Model(vectors, prior, center, scale, fit_network((x[~held] - center) / scale, y[~held]))
    model.temperature = calibrated(model.logits(x[held]), y[held])
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns ``keep`` with score and predicted of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    inner = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in inner), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.hold_nothing()
        for batch in shared.sliced(batches, "t", size=2 << 20):
            found = shipped.value.score(shared.texts_of(batch, "t"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*inner, "score", "predicted"])

    return rows.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)), "score", "predicted")
