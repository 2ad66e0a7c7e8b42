"""Ranked lexical search: MaxScore per shard of documents.

Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case. A first pass over the whole
texts writes, for each shard of at most ``SHARD_DOCS`` documents, the posting lists of the terms that the queries hold, as sorted arrays in
the shared folder, with the shard's share of the corpus counts. From these counts come every term's weight and every document's length
factor ``m`` (see :func:`weights` and :func:`length_factors`); a second pass searches each shard for every query.

A shard's posting scores are known as integers, so each list has an exact upper bound. For a query the lists are ordered by their bounds;
as long as the bounds of the smallest ones add up to less than the score to beat, these lists are non-essential: no document of theirs
alone can qualify. Documents come from the essential lists only; the non-essential ones are probed by binary search, the largest bound
first, and only for documents whose score so far and remaining bounds still reach the score to beat. That score is the larger of the
query's k-th best among the shards that the task has searched and the k-th best of a single list of this shard. A task sends at most k
rows a query; a window with a limit per group before its shuffle ranks them.

Queries go in blocks of some ``BLOCK_BYTES`` of text, the only thing that is broadcast; a single longer query makes a block of its own. Each
block is a pass over all documents. Integer arithmetic is exact; lengths times counts beyond 64 bits go through Python's integers.

Nulls: a null text has no terms; a document without terms counts for nothing and is never found; a query without known terms has no rows.
A null document id is kept and comes last among equal scores. Ties go by ascending document id. Repeated rows of either table are
documents or queries of their own, so equal copies fill ranks of their own. An empty table on either side gives no row. A very long text is
read whole, cut into pieces between terms. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm import shared

SHARD_DOCS = 16_384
SHARD_TEXT = 64 << 20
BLOCK_BYTES = 8 << 20
PIECE = 4 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_END = b"\x00"  # no folded text holds it
SHARD = "shard long, n_docs long, n_terms long, ids binary, nulls binary, sizes binary, term binary, sizes_of_lists binary, doc binary, tf binary"


def folded(text: str) -> bytes:
    """The text's UTF-8 with A-Z lowered and a space for every byte that no term holds."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def terms(text: str | None) -> list[bytes]:
    return folded(text or "").split()


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def length_factors(size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L of each document's number of terms n, with L terms in N documents."""
    if len(size) and 25 * n_docs * int(size.max()) >= 1 << 63:
        return np.array([75 + 25 * n_docs * x // n_terms for x in size.tolist()], np.int64)
    return 75 + 25 * n_docs * size // n_terms


def _pieces(body: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(body):
        cut = body.find(b" ", at + PIECE)
        cut = len(body) if cut < 0 else cut
        yield body[at:cut]
        at = cut


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[start], np.add.reduceat(n, start) if len(key) else n


class _Shard:
    """Gathers documents until a shard is full."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.get = {**vocabulary, _END: -2}.get
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.text = 0

    def _count(self, bodies: list[bytes], first: int) -> np.ndarray:
        """Add the postings of folded texts whose places start at ``first``; returns their numbers of terms."""
        words = (b" \x00 ".join(bodies) + b" \x00").split()
        code = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        end = np.flatnonzero(code == -2)
        known = np.flatnonzero(code >= 0)
        key, n = np.unique(code[known] << 32 | (first + np.searchsorted(end, known)), return_counts=True)
        self.parts.append((key, n))
        return np.diff(np.append(-1, end)) - 1

    def add(self, ids: list[int | None], texts: list[str]) -> None:
        first = len(self.ids)
        self.ids += ids
        bodies = [folded(t) for t in texts]
        self.text += sum(map(len, bodies))
        if len(bodies) == 1 and len(bodies[0]) > 2 * PIECE:
            self.sizes.append(np.array([sum(int(self._count([x], first)[0]) for x in _pieces(bodies[0]))], np.int64))
        else:
            self.sizes.append(self._count(bodies, first))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.text >= SHARD_TEXT

    def row(self, number: int) -> pa.RecordBatch:
        """The shard: documents in the order of ids, only those with a query's term; lists by term, each in that order."""
        size = np.concatenate(self.sizes)
        key, tf = _summed(*(np.concatenate([p[k] for p in self.parts]) for k in (0, 1)))
        doc, term = key & 0xFFFFFFFF, key >> 32
        ids, nulls = np.array([i or 0 for i in self.ids], np.int64), np.array([i is None for i in self.ids])
        held = np.unique(doc)
        held = held[np.lexsort((ids[held], nulls[held]))]
        place = np.zeros(len(self.ids), np.int64)
        place[held] = np.arange(len(held))
        doc = place[doc]
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
        lists = [term[start].astype("<i4"), np.diff(np.append(start, len(term))).astype("<i4"), doc.astype("<i4"), tf.astype("<i4")]
        bodies = [ids[held].astype("<i8"), nulls[held], size[held].astype("<i8"), *lists]
        facts = [number, int(np.count_nonzero(size)), int(size.sum())]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in facts), *(pa.array([x.tobytes()], pa.binary()) for x in bodies)], names=[x.split()[0] for x in SHARD.split(", ")])


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged shards of ``docs`` with the postings of ``vocabulary`` (term: number)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.hold_nothing()
        shard, number = _Shard(shipped.value), TaskContext.get().partitionId() << 32
        for batch in shared.sliced(batches, "t", rows=2048, size=PIECE):
            shard.add(batch.column(0).to_pylist(), shared.texts_of(batch, "t"))
            if shard.full():
                yield shard.row(number)
                shard.clear()
                number += 1
        if shard.ids:
            yield shard.row(number)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return shared.staged(rows.mapInArrow(run, SHARD), "search-shards")


def document_frequencies(shards: DataFrame, size: int) -> np.ndarray:
    """Of each of ``size`` terms, the documents that hold it: list lengths added per task, then per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for term, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(term, "<i4")] += np.frombuffer(n, "<i4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for r in shards.select("term", "sizes_of_lists").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


@dataclass
class Lists:
    """One shard's posting lists with the score of each posting."""

    ids: np.ndarray
    nulls: np.ndarray
    doc: np.ndarray
    score: np.ndarray
    span: dict[int, tuple[int, int]]  # term: its stretch of doc and score
    bound: dict[int, int]  # term: largest score
    floor: dict[int, int]  # term: k-th largest score, 0 for shorter lists

    @staticmethod
    def of(row: dict, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> "Lists":
        doc, tf = np.frombuffer(row["doc"], "<i4").astype(np.int64), np.frombuffer(row["tf"], "<i4").astype(np.int64)
        term, size = np.frombuffer(row["term"], "<i4"), np.frombuffer(row["sizes_of_lists"], "<i4").astype(np.int64)
        m = length_factors(np.frombuffer(row["sizes"], "<i8"), n_docs, n_terms)
        score = np.repeat(weight[term], size) * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        end = np.cumsum(size)
        start = end - size
        best = np.maximum.reduceat(score, start) if len(start) else size
        floor = {t: int(np.partition(score[a:b], b - a - k)[b - a - k]) if b - a >= k else 0 for t, a, b in zip(term.tolist(), start.tolist(), end.tolist(), strict=True)}
        spans = dict(zip(term.tolist(), zip(start.tolist(), end.tolist(), strict=True), strict=True))
        return Lists(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], bool), doc, score, spans, dict(zip(term.tolist(), best.tolist(), strict=True)), floor)


def max_score(lists: Lists, query: list[tuple[int, int]], k: int, beat: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents of a shard that may be among the best k and reach ``beat``; ``query``: terms with their repeats."""
    known = sorted((c * lists.bound[t], t, c) for t, c in query if t in lists.span)
    beat = max(beat, max((c * lists.floor[t] for _, t, c in known), default=0))
    rest = essential = 0
    while essential < len(known) and rest + known[essential][0] < beat:
        rest += known[essential][0]
        essential += 1
    if essential == len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.zeros(len(lists.ids), np.int64)
    for _, t, c in known[essential:]:
        a, b = lists.span[t]
        total[lists.doc[a:b]] += c * lists.score[a:b]
    found = np.flatnonzero(total >= beat - rest)  # which is above 0
    score = total[found]
    for bound, t, c in reversed(known[:essential]):
        if len(score) > k:
            beat = max(beat, int(np.partition(score, len(score) - k)[len(score) - k]))
        keep = score + rest >= beat
        found, score = found[keep], score[keep]
        if not len(found):
            break
        a, b = lists.span[t]
        at = np.minimum(np.searchsorted(lists.doc[a:b], found), b - a - 1)
        score = score + np.where(lists.doc[a:b][at] == found, c * lists.score[a:b][at], 0)
        rest -= bound
    keep = score >= beat
    return found[keep], score[keep]


Best = tuple[np.ndarray, np.ndarray, np.ndarray]  # scores, ids, and whether an id is null


def _best(parts: list[Best], k: int) -> Best:
    score, ids, nulls = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, nulls, -score))[:k]
    return score[order], ids[order], nulls[order]


def _searched(shards: DataFrame, queries: list[list[tuple[int, int]]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """q (number of the query), doc_id and score: at most k rows for each query from each task."""
    shipped = shards.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = shipped.value
        best: dict[int, Best] = {}
        for batch in batches:
            for part in range(batch.num_rows):
                lists = Lists.of(batch.slice(part, 1).to_pylist()[0], w, n_docs, n_terms, k)
                for q, query in enumerate(asked):
                    held = best.get(q)
                    found, score = max_score(lists, query, k, int(held[0][-1]) if held and len(held[0]) == k else 1)
                    if len(found):
                        best[q] = _best([*([held] if held else []), (score, lists.ids[found], lists.nulls[found])], k)
        for q, (score, ids, nulls) in best.items():
            doc = pa.array(ids, pa.int64(), mask=nulls)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int64)), doc, pa.array(score)], names=["q", "doc_id", "score"])

    wanted = shards.select("ids", "nulls", "sizes", "term", "sizes_of_lists", "doc", "tf")
    return wanted.mapInArrow(run, "q long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best of all ``docs`` for each row of ``items``."""
    spark = docs.sparkSession
    asked = items.select(F.monotonically_increasing_id().alias("r"), F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("t"))
    asked = shared.staged(asked, "search-items")
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-2 * size // BLOCK_BYTES) or 1  # half full on average
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("r"), F.lit(blocks)) == block).orderBy("r").collect()
        vocabulary: dict[bytes, int] = {}
        queries = []
        for row in rows:
            counts: dict[int, int] = {}
            for term in terms(row["t"]):
                t = vocabulary.setdefault(term, len(vocabulary))
                counts[t] = counts.get(t, 0) + 1
            queries.append(list(counts.items()))
        if not vocabulary:
            continue
        shards = index(docs, vocabulary, id_col, text_col)
        n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            break
        weight = weights(n_docs, document_frequencies(shards, len(vocabulary)))
        found = _searched(shards, queries, weight, n_docs, n_terms, k)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, row["item_id"]) for q, row in enumerate(rows)], "q long, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))  # as many as a block's items
    return out
