"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text gets a space in front, spaces become U+2581 and the text falls into words: a run of U+2581 with what follows it. No piece has
U+2581 behind another character (checked when a model is opened), so no merge crosses a word's start and words are encoded apart
from each other. New words of a batch become one flat array of symbols. In a round, each word finds the best rank among its adjacent
pairs (a segmented minimum) and merges it: at all places, leftmost first and without overlaps, when the merged piece takes part only
in worse pairs, else at the leftmost place alone. The array is compacted and words without a pair leave it. Words of more than
``LONG`` symbols, where rounds would be many, go through a heap with the same order of merges. A symbol that is no piece becomes its
UTF-8 bytes' pieces.

A worker keeps the ids of the words that it has met in a bounded table. The vocabulary file is read, never trained or copied.

Nulls: a null text is empty and has no ids; its decoded text is empty. A null id is kept, equal rows are encoded one by one, an empty
table gives no row, extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared

SPACE = "▁"
LONG = 256
#: Words of a generation that a worker keeps; two generations take some 400 MB at most.
CACHE_WORDS = 600_000
CACHE_CHARS = 64
NONE = np.int64(1 << 40)

_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_OPENED: dict[str, "PieceModel"] = {}


# A byte that starts no whole character is one U+FFFD, and decoding goes on behind it.
codecs.register_error("tessitura-each-byte", lambda e: ("\ufffd", e.start + 1))


def opened(path: str) -> "PieceModel":
    """The worker's model of a vocabulary file."""
    shared.hold("pieces", _OPENED.clear)
    if path not in _OPENED:
        _OPENED[path] = PieceModel(path)
    return _OPENED[path]


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a serialized message: (number, value); submessages and strings as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack_from("<f" if kind == 5 else "<d", data, at)[0], at + size
        yield tag >> 3, value


class PieceModel:
    """A BPE model with byte fallback, read from its file."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, path: str):
        with shared.open_uri(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        normalizer: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, self.NORMAL)))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models with the identity normalizer, a dummy prefix and kept, escaped spaces are read")
        if any(kind in (self.USER, self.UNUSED) for _, _, kind in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == self.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == self.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback are read")
        self.raw = [bytes([int(p[3:5], 16)]) if kind == self.BYTE else b"" if kind == self.CONTROL else b" \xe2\x81\x87 " if kind == self.UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in self.pieces]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self._pairs()
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def _pairs(self) -> None:
        """The merges: sorted keys (left id * size + right id), the merged id, its rank (equal scores share one) and whether the
        merged piece takes part in worse pairs only."""
        size = self.size = len(self.pieces) + 1
        scores = sorted({self.pieces[i][1] for i in self.ids.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank_of = np.array([rank.get(s, 0) for _, s, _ in self.pieces], np.int64)
        rows = []
        best_with = np.full(size, NONE)  # the best rank of a pair that a piece takes part in
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left * size + right, i))
                    for part in (left, right):
                        best_with[part] = min(best_with[part], self.rank_of[i])
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.int64)
        self.merged = np.array([r[1] for r in rows], np.int64)
        self.alone = best_with[: len(self.pieces)] <= self.rank_of  # such a piece must not be merged at several places at once
        self.pair_table = {r[0]: r[1] for r in rows}

    def _pairs_at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of the pairs that begin at the places ``at``; NONE where a word ends or the two make no piece."""
        rank, merged = np.full(len(at), NONE), np.zeros(len(at), np.int64)
        inner = np.flatnonzero(at + 1 < len(symbols))
        places = at[inner]
        left, right = symbols[places], symbols[places + 1]
        fit = np.flatnonzero((owner[places] == owner[places + 1]) & (left >= 0) & (right >= 0))  # unknown symbols are negative
        key = left[fit] * self.size + right[fit]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[found] == key)
        ids = self.merged[found[hit]]
        places = inner[fit[hit]]
        rank[places], merged[places] = self.rank_of[ids], ids
        return rank, merged

    def _symbols(self, word: str) -> list[int]:
        """A word's characters as ids; unknown ones, which never merge, as negative code points."""
        get = self.ids.get
        return [i if (i := get(c)) is not None else -ord(c) - 1 for c in word]

    def merge(self, words: Sequence[str]) -> list[list[int]]:
        """The symbols of each word after all merges."""
        spelled = [self._symbols(w) for w in words]
        out = [s if len(s) < 2 else self._merge_long(s) if len(s) > LONG else [] for s in spelled]
        short = [k for k, s in enumerate(spelled) if 1 < len(s) <= LONG]
        symbols = np.fromiter(chain.from_iterable(spelled[k] for k in short), np.int64)
        owner = np.repeat(np.arange(len(short)), [len(spelled[k]) for k in short])
        rank, merged = self._pairs_at(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            done = np.flatnonzero(~live)
            if len(done):
                values = symbols.tolist()
                for s, n, w in zip(starts[done].tolist(), lengths[done].tolist(), owner[starts[done]].tolist(), strict=True):
                    out[short[w]] = values[s : s + n]
            alive = np.repeat(live, lengths)
            at = np.flatnonzero((rank == np.repeat(best, lengths)) & alive)
            if not len(at):
                break
            first = np.append(True, owner[at[1:]] != owner[at[:-1]])
            # A word merges all places of the pair that is its leftmost best one, if the merged piece allows it.
            lead = at[first][np.cumsum(first) - 1]
            at = at[first | (~self.alone[merged[lead]] & (symbols[at] == symbols[lead]) & (symbols[at + 1] == symbols[lead + 1]))]
            at = at[_apart(at)]
            symbols[at] = merged[at]
            keep = alive
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
            fresh = np.zeros(len(symbols), bool)
            fresh[place] = True
            fresh[np.maximum(place - 1, 0)] = True
            changed = np.flatnonzero(fresh)
            rank[changed], merged[changed] = self._pairs_at(symbols, owner, changed)
        return out

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges for one word by a heap of pairs: best rank first, then leftmost."""
        n, size, table, rank = len(symbols), self.size, self.pair_table, self.rank_of.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols, heap = list(symbols), []

        def push(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (m := table.get(symbols[i] * size + symbols[j])) is not None:
                heap.append((rank[m], i, symbols[i], symbols[j], m)) if filling else heapq.heappush(heap, (rank[m], i, symbols[i], symbols[j], m))

        filling = True
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        filling = False
        gone = bytearray(n)
        while heap:
            _, i, left, right, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = m, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [s for s, x in zip(symbols, gone, strict=True) if not x]

    def _ids(self, merged: list[int]) -> list[int]:
        if merged and min(merged) < 0:
            return [i for s in merged for i in ((s,) if s >= 0 else [self.bytes[b] for b in chr(-s - 1).encode("utf-8", "surrogatepass")])]
        return merged

    @staticmethod
    def words(text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] if w[0] == SPACE and w[1:2] != SPACE and len(w) > 1 else "\0" + w for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]

    def _entry(self, merged: list[int]) -> tuple[str, bytes]:
        """A word's ids as decimals joined by commas, and their bytes."""
        ids = self._ids(merged)
        return ",".join([self.decimal[i] for i in ids]), b"".join([self.raw[i] for i in ids])

    def entries(self, texts: Sequence[str]) -> list[list[tuple[str, bytes]]]:
        """The entries of each text's words. Words are known without their one space; any other word behind a NUL mark."""
        cut = [self.words(t) for t in texts]
        get = self.known.get
        found = [list(map(get, ws)) for ws in cut]
        missing: set[str] = set()
        gaps = []
        for k, parts in enumerate(found):
            if None in parts:
                at = [i for i, x in enumerate(parts) if x is None]
                gaps.append((k, at))
                missing.update([cut[k][i] for i in at])
        table = {w: entry for w in missing if (entry := self.older.get(w)) is not None}
        fresh = sorted(missing.difference(table))
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            table.update(zip(part, map(self._entry, self.merge([w[1:] if w[:1] == "\0" and w[1:2] == SPACE else SPACE + w for w in part])), strict=True))
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        self.known.update((w, entry) for w, entry in table.items() if len(w) <= CACHE_CHARS)
        for k, at in gaps:
            parts, ws = found[k], cut[k]
            for i in at:
                parts[i] = table[ws[i]]
        return found

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """The ids of each text."""
        return [[int(i) for d, _ in entries for i in d.split(",")] for entries in self.entries(texts)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces joined, bytes decoded (broken ones as U+FFFD), the space in front dropped."""
        out: list[str] = []
        part: list[int] = []
        for i in [*ids, None]:  # a control piece has no text, but ends a run of bytes
            if i is not None and self.pieces[i][2] != self.CONTROL:
                part.append(i)
            elif part:
                out.append(self._text(b"".join([self.raw[k] for k in part]), not out and self.pieces[part[0]][2] == self.NORMAL))
                part = []
        return "".join(out)

    @staticmethod
    def _text(data: bytes, spaced: bool = True) -> str:
        return (data.removeprefix(b" ") if spaced else data).decode("utf-8", "tessitura-each-byte")


def _apart(at: np.ndarray) -> np.ndarray:
    """Of ascending positions, those that the leftmost-first choice without neighbours takes."""
    if len(at) < 2:
        return np.ones(len(at), bool)
    run = np.flatnonzero(np.append(True, np.diff(at) != 1))
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return place % 2 == 0


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in UTF-8) and, for
    ``with_ids``, ids (array of int) and decoded (text)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(path)
        for batch in shared.sliced(batches, "t"):
            counts, hashes, texts, all_ids = [], [], [], []
            for entries in model.entries(shared.texts_of(batch, "t")):
                decimals = ",".join([d for d, _ in entries])
                counts.append(decimals.count(",") + 1 if entries else 0)
                hashes.append(hashlib.sha256(decimals.encode()).hexdigest())
                text = model._text(b"".join([raw for _, raw in entries]))  # decode(ids): each word's bytes come from its ids
                texts.append(text if with_ids else hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in decimals.split(",")] if entries else [])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts] if with_ids else texts)]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
