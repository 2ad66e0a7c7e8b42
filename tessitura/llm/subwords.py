"""Whole-text encoding with the tokenizers library, a unit at a time.

Both vocabularies cut a text into pre-tokens first and merge inside each of them. A cut at a single space whose neighbours are not
white space always falls between two pre-tokens, so the ids of a text are the ids of its space-delimited units one after another.
Arrow cuts a slice of texts into units and numbers the distinct ones; each worker keeps the library's ids of the units that it has met
in a bounded table, unknown units are handed to the library many at a time, and numpy gathers the ids of the slice from those of its
distinct units. Texts with other white space beside a space are cut only where the rule holds.

Special strings in a text (such as ``<|endoftext|>``) get their one id, as the library gives it by default: it takes them out of the
raw text first and encodes what lies between them on its own.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessitura.llm import shared

#: Units of a generation that a worker keeps; two generations take some 250 MB at most.
CACHE_UNITS = 500_000
#: Longer units are encoded each time, so the table's memory stays bounded.
CACHE_CHARS = 64

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_OPENED: dict[tuple[str, str], "UnitEncoder"] = {}


def encoder(path: str, style: str) -> "UnitEncoder":
    """The worker's encoder for a vocabulary file; style: ``byte`` (a space belongs to the next unit) or ``word`` (it is dropped)."""
    shared.hold("units", _OPENED.clear)
    key = (path, style)
    if key not in _OPENED:
        _OPENED[key] = UnitEncoder(path, style)
    return _OPENED[key]


class UnitEncoder:
    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.tokenizer.model._resize_cache(0)  # units come here once; looking them up again costs more than it saves
        self.byte = style == "byte"
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        if self.byte:
            # A unit with its space in front has one id that starts with a space: its first.
            self.edge = np.array([t.startswith("\u0120") for t in tokens])
        else:
            # A unit of letters only is one pre-token, and one id that ends a word: its last.
            self.edge = np.array([t.endswith("</w>") for t in tokens])
            (self.mark_id,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units (for ``byte`` with a space before them), many in one call; any whose count of edges is off, one by one."""
        out: dict[str, bytes] = {}
        if self.byte:
            plain, odd = units, []
        else:
            plain = [u for u in units if u.isalpha()]
            odd = [u for u in units if u and not u.isalpha() and "\0" not in u]
            rest = [u for u in units if "\0" in u]
            chunks = [odd[i : i + 2000] for i in range(0, len(odd), 2000)]
            odd = rest
            for chunk, ids in zip(chunks, self._ids([" \0 ".join(c) for c in chunks]), strict=True):
                marks = np.flatnonzero(ids == self.mark_id)
                if len(marks) == len(chunk) - 1:
                    out.update(zip(chunk, _cut(ids, np.append(0, marks + 1), np.append(marks, len(ids))), strict=True))
                else:
                    odd = odd + chunk
        chunks = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        space = " " if self.byte else ""
        for chunk, ids in zip(chunks, self._ids([space + " ".join(c) for c in chunks]), strict=True):
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(chunk):
                odd = odd + chunk
            elif self.byte:
                out.update(zip(chunk, _cut(ids, edges, np.append(edges[1:], len(ids))), strict=True))
            else:
                out.update(zip(chunk, _cut(ids, np.append(0, edges[:-1] + 1), edges + 1), strict=True))
        out.update(zip(odd, (x.tobytes() for x in self._ids([space + u for u in odd])), strict=True))
        if "" in units:
            out[""] = b""
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``self.dtype``; a null text has none."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        held = np.zeros(len(column), bool)
        for content in self.special:
            held |= np.asarray(pc.match_substring(column, content))
        if not held.any():
            return self._plain(column)
        out = self._plain(pc.if_else(pa.array(held), "", column))
        for k in np.flatnonzero(held).tolist():
            parts = self.between.split(column[k].as_py())
            ids = self._plain(pa.array(parts[::2], pa.string())) + [b""]
            marks = [np.asarray(self.special[x], self.dtype).tobytes() for x in parts[1::2]] + [b""]
            out[k] = b"".join(x + mark for x, mark in zip(ids, marks))
        return out

    def _plain(self, column: pa.Array) -> list[bytes]:
        """The ids of texts without special strings."""
        lists = pc.split_pattern(column if self.byte else pc.replace_substring(column, "\n", " "), " ")
        flat, edges = lists.flatten(), np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        coded = flat.dictionary_encode()
        index, units = np.array(coded.indices, np.int64), coded.dictionary.to_pylist()
        parts, unsafe = self._looked_up(units)
        whole: list[int] = []
        if self.byte:
            # The first unit of a text has no space before it.
            heads = flat.take(pa.array(edges[:-1])).to_pylist()
            index[edges[:-1]] = len(parts) + np.arange(len(heads))
            parts = parts + [x.tobytes() for x in self._ids(heads)]
            odd = np.zeros(len(parts), bool)
            odd[unsafe] = True
            odd[len(units) :] = [h[:1].isspace() or h[-1:].isspace() for h in heads]
            whole = np.flatnonzero(np.logical_or.reduceat(odd[index], edges[:-1])).tolist() if len(heads) and odd.any() else []
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        counts = lengths[index]
        ends = np.append(0, np.cumsum(counts))
        at = np.repeat((np.cumsum(lengths) - lengths)[index] - ends[:-1], counts)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(parts), self.dtype)[at]
        out = _cut(ids, ends[edges[:-1]], ends[edges[1:]])
        for k in whole:
            out[k] = b"".join(x.tobytes() for x in self._pieces(column[k].as_py()))
        return out

    def _looked_up(self, units: list[str]) -> tuple[list[bytes], list[int]]:
        """The ids of distinct units, and the places of those at whose edges a text must not be cut."""
        found = list(map(self.known.get, units))
        gaps = [i for i, x in enumerate(found) if x is None]
        new, unsafe = [], []
        for i in gaps:
            u = units[i]
            found[i] = self.older.get(u)
            if found[i] is None:
                if self.byte and (not u or u[0].isspace() or u[-1].isspace()):
                    found[i] = b""
                    unsafe.append(i)
                else:
                    new.append(u)
        learned = self._learn(new)
        if len(self.known) > CACHE_UNITS:
            self.known, self.older = {}, self.known
        odd = set(unsafe)
        for i in gaps:
            u = units[i]
            if found[i] is None:
                found[i] = learned[u]
            if len(u) <= CACHE_CHARS and i not in odd:
                self.known[u] = found[i]
        return found, unsafe

    def _pieces(self, text: str):
        """The ids of the safe cuts of a text, many in one call but never more than some megabytes."""
        held, size = [], 0
        for piece in _SAFE_CUT.split(text):
            held.append(piece)
            size += len(piece)
            if size > 1 << 20:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)


def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, width = ids.tobytes(), ids.itemsize
    return [data[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)]
