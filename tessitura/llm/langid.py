"""Language ID: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and every run of other characters than letters becomes one space. The 1- to 3-grams of code points of this string
(a space at either end) are hashed to ``dim`` features. Training counts features per language over whole texts of a bounded sample:
at most ``max_rows`` rows per language, those with the smallest hash of their id. Counts are added per task and language in numpy and
meet as one row per (language, block of features), so the driver receives languages x ``dim`` numbers. The matrix of log
probabilities is broadcast; a document's sparse count vector (its distinct features) is multiplied with its rows in numpy.

The prediction is a learned language, or ``und`` for a text that is null or has no letter (and for all rows if there was nothing to
learn from). Ties go to the alphabetically first language. The score is the posterior probability after dividing all log likelihoods by
``1 + n_grams / calm``, since neighbouring n-grams are far from independent; it lies in 0 to 1 and is 0 for ``und``.

Nulls: rows with a null language or text teach nothing; a null id is kept. Equal rows are judged one by one; an empty table gives an
empty result. Extra columns are not read. A very long text is a slice of its own, some hundred bytes a character.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared

DIM = 1 << 16
MAX_ROWS = 4000
UND = "und"
_BLOCK = 1 << 13
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _TABLE:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(len(table)):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def features(text: str, dim: int = DIM) -> np.ndarray:
    """The hashed n-grams of a text, with repetitions; empty if it has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    points = table[points]
    letter = points != 32
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters the first stays, as a space
    points = np.concatenate(([32], points[keep], [32] * bool(letter[-1]))).astype(np.uint64)
    one = points * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
    shift = np.uint64(64 - (dim.bit_length() - 1))
    mixed = np.concatenate((one[1:-1], two, three))
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # dim x languages: log probability of a feature
    prior: np.ndarray
    calm: float = 50.0

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text of a slice: one sparse array of (text, feature) counts, a language's weights at a time."""
        dim = len(self.weights)
        found = [features(t, dim) if t else np.empty(0, np.int64) for t in texts]
        n = np.array([len(x) for x in found])
        out = [(UND, 0.0)] * len(texts)
        full = np.flatnonzero(n)
        if not len(full) or not self.languages:
            return out
        key, count = np.unique(np.concatenate([found[k] + i * dim for i, k in enumerate(full)]), return_counts=True)
        owner, at = key // dim, key % dim
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        total = np.stack([np.add.reduceat(count * self.weights[at, k], start) for k in range(len(self.languages))], axis=1)
        total = total / (1 + n[full, None] / self.calm) + self.prior
        total = np.exp(total - total.max(axis=1, keepdims=True))
        best = np.argmax(total, axis=1)
        score = total[np.arange(len(full)), best] / total.sum(axis=1)
        for k, b, p in zip(full.tolist(), best.tolist(), score.tolist(), strict=True):
            out[k] = self.languages[b], p
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS, dim: int = DIM, alpha: float = 0.1) -> Model:
    """Fit on at most about ``max_rows`` rows per language (``alpha``: additive smoothing)."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return Model([], np.zeros((dim, 0)), np.zeros(0))
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, max_rows / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / (1 << 30)
    sample = usable.where(draw < share[F.col(lang_col).cast("string")]).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.hold_nothing()
        totals: dict[str, np.ndarray] = {}
        for batch in shared.sliced(batches, "t"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = features(text, dim)
                if lang not in totals:
                    totals[lang] = np.zeros(dim, np.int64)
                totals[lang] += np.bincount(found, minlength=dim)
        for lang, total in totals.items():
            for b in range(0, dim, _BLOCK):
                yield pa.RecordBatch.from_pydict({"l": [lang], "b": pa.array([b], pa.int32()), "c": [total[b : b + _BLOCK].tobytes()]})

    def add(key, frame):
        total = np.sum([np.frombuffer(c, np.int64) for c in frame["c"]], axis=0)
        frame = frame.iloc[:1].copy()
        frame["c"] = [total.tobytes()]
        return frame

    schema = "l string, b int, c binary"
    counts = np.zeros((len(languages), dim))
    for r in sample.mapInArrow(count, schema).groupBy("l", "b").applyInPandas(add, schema).collect():
        block = np.frombuffer(r["c"], np.int64)
        counts[languages.index(r["l"]), r["b"] : r["b"] + len(block)] = block
    weights = np.log(counts + alpha) - np.log(counts.sum(axis=1, keepdims=True) + alpha * dim)
    prior = np.log([sizes[x] for x in languages])
    return Model(languages, np.ascontiguousarray(weights.T), prior - np.log(sum(sizes.values())))


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these names are replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    inner = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, inner, strict=True)), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in inner), "lang string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.hold_nothing()
        fitted = shipped.value
        for batch in shared.sliced(batches, "t", size=1 << 20):
            found = fitted.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*inner, "lang", "score"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(kept, inner, strict=True)), F.col("lang").alias(names[0]), F.col("score").alias(names[1]))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Rows that training must not see; a null id is one of the others."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with the columns of ``docs``, that have a language with a score of ``least`` or more."""
    named = predict(docs, model, names=("_lang_pred", "_lang_score"))
    return named.where((F.col("_lang_pred") != UND) & (F.col("_lang_score") >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
