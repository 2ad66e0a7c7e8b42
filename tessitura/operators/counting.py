"""Counts of n-grams and classes of all lengths from one shuffle.

A position of a song sends its longest window, packed to a few integers. Windows are dealt out to buckets by the class of their first
three chords, so every n-gram and every class of three or more chords, with all their occurrences, lies in one bucket, which is cut to each
length and counted in numpy. A slice of songs sends one compressed block to each bucket, and a task counts its buckets one after the other.
Nothing is stored: the shuffle takes some five bytes a position, whatever the number of lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions that a task packs at once, and that a bucket holds if all classes are equally frequent.
SLICE, BUCKET_ROWS = 1 << 19, 1_000_000
#: Buckets that a task counts one after the other, and owners whose sums it holds.
TASK_BUCKETS, HELD_OWNERS = 16, 1_000_000
#: Rows of a bucket that are counted at once: some 250 bytes each. Larger buckets are dealt again inside their task, so many rows at a time.
PART_ROWS, DEAL_ROWS = 600_000, 1 << 18
SHORTEST, LONGEST = 3, 8
#: Stands for a null owner.
_NULL = -(1 << 63)


#: By mask: its bits as bytes of two integers, pitch classes 0 to 5 and 6 to 11, the lowest pitch class in the highest byte.
_ROWS = [np.array([sum(((m >> first + k) & 1) << 8 * (5 - k) for k in range(6)) for m in range(4096)], np.int64) for first in (0, 6)]
#: The digits of masks as three hex characters, and by length those of a row of the bit matrix.
_HEX = np.frombuffer("".join(f"{m:03x}" for m in range(4096)).encode(), np.uint8).reshape(4096, 3)
_BITS = {n: (((np.arange(256)[:, None] >> np.arange(n - 1, -1, -1)) & 1) + 48).astype(np.uint8) for n in range(1, LONGEST + 1)}


def bit_rows(masks: list[np.ndarray]) -> list[np.ndarray]:
    """The rows of the bit matrices of ``masks`` from pitch class 0 on: a byte each, by position, six in each of two integers."""
    return [sum(of[m] << (len(masks) - 1 - i) for i, m in enumerate(masks)) for of in _ROWS]


def least_turn(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The smallest of the twelve turns of :func:`bit_rows`, which is that of the least text."""
    heads = [rows[0]]  # the six rows from each one on
    for k in range(11):
        after = (k + 6) % 12
        heads.append(((heads[-1] << 8) & ((1 << 48) - 1)) | ((rows[after // 6] >> 8 * (5 - after % 6)) & 255))
    first, second = rows
    for k in range(1, 12):
        a, b = heads[k], heads[(k + 6) % 12]
        less = (a < first) | ((a == first) & (b < second))
        first, second = np.where(less, a, first), np.where(less, b, second)
    return [first, second]


def key_text(rows: list[np.ndarray], n: int) -> np.ndarray:
    """The characters of ``n:bits`` (see :func:`tessitura.functions.chords.matrix_key`) of :func:`bit_rows`."""
    out = np.empty((len(rows[0]), 2 + 12 * n), np.uint8)
    out[:, 0], out[:, 1] = 48 + n, ord(":")
    for p in range(12):
        out[:, 2 + p * n : 2 + (p + 1) * n] = _BITS[n][(rows[p // 6] >> 8 * (5 - p % 6)) & 255]
    return out


def hex_text(masks: list[np.ndarray]) -> np.ndarray:
    """The characters of a class's text."""
    return np.concatenate([_HEX[m] for m in masks], axis=1)


def _column(key: np.ndarray, n: int, i: int) -> np.ndarray:
    """The mask that stands in column ``i`` of the matrices of key texts."""
    return sum((key[:, 2 + p * n + i].astype(np.int32) - 48) << p for p in range(12)).astype(np.int32)


def _strings(chars: np.ndarray) -> pa.Array:
    """A text a row, all of the same length."""
    size, width = chars.shape
    return pa.Array.from_buffers(pa.string(), size, [None, pa.py_buffer(np.arange(0, (size + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(chars))])


def joined_text(spelled: tuple[list[str], str], codes: list[np.ndarray]) -> pa.Array:
    """The texts of codes (from 1), joined."""
    texts = pa.array(spelled[0], pa.string())
    return pc.binary_join_element_wise(*(texts.take(pa.array(c - 1)) for c in codes), spelled[1])


#: Columns of a class of length n, made of its masks and the characters of its key.
FORMS = {
    "hkey": ("string", lambda n, masks, key: _strings(hex_text(masks))),
    "harmonic_key": ("string", lambda n, masks, key: _strings(key)),
    "canonical": ("string", lambda n, masks, key: _strings(key_text(least_turn(bit_rows(masks)), n))),
    "first": ("int", lambda n, masks, key: _column(key, n, 0)),
    "third": ("int", lambda n, masks, key: _column(key, n, 2)),
}


def formed(n: int, masks: list[np.ndarray], names) -> list:
    key = key_text(bit_rows(masks), n) if set(names) - {"hkey", "canonical"} else None
    return [FORMS[x][1](n, masks, key) for x in names]


class Codec:
    """The dictionary as arrays: how codes are packed, and the turned mask of each code by the number of pitch classes it moves up."""

    def __init__(self, roots: list[int | None], masks: list[int | None]):
        self.bits = max(1, len(masks).bit_length())
        self.each = min(LONGEST, 63 // self.bits)
        self.lanes = -(-LONGEST // self.each)
        self.readable = np.array([True, *(m is not None for m in masks)])
        mask, root = np.array([0, *(m or 0 for m in masks)], np.int64), np.array([0, *(r or 0 for r in roots)], np.int64)
        self.step = (12 - root) % 12
        self._turned = np.stack([((mask << s) | (mask >> (12 - s))) & 4095 for s in range(12)]).astype(np.int16)

    def turned(self, step: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The masks of codes, moved up."""
        return self._turned[step, codes].astype(np.int64)

    def names(self, head: str = "w") -> list[str]:
        return [f"{head}{k}" for k in range(self.lanes)]

    def packed(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Codes (0: none) of up to eight places in lanes, the first highest."""
        lanes = [np.zeros(len(codes[0]), np.int64) for _ in range(self.lanes)]
        for i, c in enumerate(codes):
            lanes[i // self.each] |= c << self.bits * (self.each - 1 - i % self.each)
        return lanes

    def unpacked(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        one = (1 << self.bits) - 1
        return [(lanes[i // self.each] >> self.bits * (self.each - 1 - i % self.each)) & one for i in range(LONGEST)]

    def cut(self, lanes: list[np.ndarray], n: int) -> list[np.ndarray]:
        """The lanes of a window's first ``n`` chords."""
        keep = self.packed([np.array([(1 << self.bits) - 1 if i < n else 0]) for i in range(LONGEST)])
        return [x & m for x, m in zip(lanes, keep, strict=True)]

    def columns(self, head: str = "w") -> list:
        """The codes that lanes hold as Columns, -1 beyond the end."""
        one = (1 << self.bits) - 1
        return [F.shiftright(F.col(f"{head}{i // self.each}"), self.bits * (self.each - 1 - i % self.each)).bitwiseAND(one).cast("int") - 1 for i in range(LONGEST)]


def coded(songs: DataFrame, tokens: list[str], keep: tuple[str, ...] = ("song_id",)) -> DataFrame:
    """``keep`` and the codes (places in ``tokens``) of each song that has tokens: no row leaves its task."""
    shipped = songs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shipped.value, pa.string())
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            words = pc.cast(lists.flatten(), pa.string())
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            if words.null_count:
                real = pc.is_valid(words).to_numpy(zero_copy_only=False)
                sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
                words = words.drop_null()
            found = pc.index_in(words, known)
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=[*keep, "codes"])

    rows = songs.where(F.size("tokens") > 0).select(*keep, "tokens")
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep), "codes array<int>"])
    return rows.mapInArrow(run, schema).where(F.size("codes") > 0)


def _windows(batch: pa.RecordBatch, top: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Of slices of whole songs (owner, codes): the owner, the codes plus one (0 beyond the end) and the place of every position with three
    chords or more."""
    lists = batch.column(1)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    owners, first = pc.fill_null(batch.column(0).cast(pa.int64()), _NULL).to_numpy(zero_copy_only=False), 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        sizes = np.diff(ends[first:last], prepend=base)
        part, at = values[base : ends[last - 1]].astype(np.int64) + 1, np.arange(ends[last - 1] - base)
        left = np.repeat(ends[first:last] - base, sizes) - at
        keep = np.flatnonzero(left >= SHORTEST)
        yield np.repeat(owners[first:last], sizes)[keep], [np.where(left[keep] > i, part[np.minimum(keep + i, len(part) - 1)], 0) for i in range(top)], (np.repeat(sizes, sizes) - left)[keep]
        first = last


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _block(columns: list[np.ndarray]) -> bytes:
    """Columns of integers by bytes of equal weight, which compress well; the first is sorted."""
    first, *rest = columns
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) for x in (np.diff(first, prepend=0), *rest)]
    return len(first).to_bytes(4, "little") + pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _unblocked(block: bytes, width: int) -> list[np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    planes = np.frombuffer(pa.decompress(block[4:], 8 * width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, 8, n)
    first, *rest = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in planes)
    return [np.cumsum(first), *rest]


#: What windows can carry besides their owner: the size of their song, or their place in it.
CARRIED = {None: lambda places: [], "size": lambda places: [_sizes(places)], "place": lambda places: [places]}


def _sizes(places: np.ndarray) -> np.ndarray:
    """The size of the song of each position with three chords or more, from their places."""
    starts = np.flatnonzero(places == 0)
    runs = np.diff(starts, append=len(places))
    return np.repeat(runs + (SHORTEST - 1), runs)


def dealt(songs: DataFrame, codec: Codec, tasks: int, buckets: int, owner: str | None = None, top: int = LONGEST, turn: tuple[int, int] = (0, 1), carried: str | None = None, beside: DataFrame | None = None) -> DataFrame:
    """bucket and the blocks (see :func:`_block`) of its windows: the lanes of a position's longest window (at most ``top`` chords), o
    (``owner``, or 0) and how often a slice holds them. A bucket lies in one task, its blocks one after the other. Of several rounds, ``turn``
    (which, of how many) has the classes of one. With ``carried`` (see :data:`CARRIED`) a column more comes after o. The blocks of ``beside``
    (bucket, block) come first in their bucket."""
    round_, rounds = turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, codes, places in _windows(batch, top):
                if not len(owners):
                    continue
                more = CARRIED[carried](places)
                key = _key(codec, codes[:SHORTEST])
                if rounds > 1:
                    keep = np.flatnonzero(key % rounds == round_)
                    if not len(keep):
                        continue
                    key, owners, codes, more = key[keep] // rounds, owners[keep], [c[keep] for c in codes], [x[keep] for x in more]
                key = key % buckets
                lanes = codec.packed(codes)
                order = np.lexsort((*more, owners, *lanes[::-1], key))
                columns = [x[order] for x in (key, *lanes, owners, *more)]
                starts = np.flatnonzero(_runs(columns))
                count = np.diff(starts, append=len(order))
                key, *columns = [*(x[starts] for x in columns), count]
                edges = np.append(np.flatnonzero(_runs([key])), len(key))
                blocks = [_block([x[i:j] for x in columns]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[edges[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    who = F.col(owner) if owner else F.lit(0)
    rows = songs.select(who.cast("long").alias("o"), "codes")
    found = rows.mapInArrow(run, "bucket int, block binary")
    if beside is None:
        return found.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    found = beside.select("bucket", F.lit(0).alias("k"), "block").unionAll(found.select("bucket", F.lit(1).alias("k"), "block"))
    return found.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "k")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and held:
                yield held
                held = []
            bucket = b
            held.append(block)
    if held:
        yield held


def _added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Lanes, owner, what they carry and count with equal rows added up, in the order of their text."""
    *keys, count = columns
    order = np.lexsort(keys[::-1])
    sorted_ = [x[order] for x in keys]
    starts = np.flatnonzero(_runs(sorted_))
    return [*(x[starts] for x in sorted_), np.add.reduceat(count[order], starts) if len(starts) else count]


def _key(codec: Codec, codes: list[np.ndarray]) -> np.ndarray:
    """A number of the class of up to five codes; without a class, of the codes."""
    step, last = codec.step[codes[0]], len(codes) - 1
    key = sum(codec.turned(step, c) << 12 * (last - i) for i, c in enumerate(codes))
    for c in codes:  # no class: n-grams meet by their codes
        key = np.where(codec.readable[c], key, (key * 31 + c) & ((1 << 40) - 1))
    return _mixed(key)


def _mixed(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The blocks of each bucket with their kinds."""
    bucket, kinds, held = None, [], []
    for batch in batches:
        for b, k, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield kinds, held
                kinds, held = [], []
            bucket = b
            kinds.append(k)
            held.append(block)
    if held:
        yield kinds, held


def _size(blocks: list[bytes]) -> int:
    return sum(int.from_bytes(b[:4], "little") for b in blocks)


def _rows(blocks: list[bytes], codec: Codec, most: int, ns=None, more: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of owner, lanes and count of a bucket's windows. For ``ns`` of those that are long enough, cut to the longest of these lengths;
    equal rows are added up whenever ``most`` are held."""
    held, size, names = [], 0, ["o", *codec.names(), *(f"m{k}" for k in range(more)), "c"]
    for block in blocks:
        columns = _unblocked(block, codec.lanes + 2 + more)
        if ns:
            keep = np.flatnonzero(codec.unpacked(columns[: codec.lanes])[ns[0] - 1] > 0)
            columns = [x[keep] for x in (*codec.cut(columns[: codec.lanes], ns[-1]), *columns[codec.lanes :])]
        held.append(columns)
        size += len(columns[0])
        if ns and size > most:
            held, size = [_added([np.concatenate(x) for x in zip(*held, strict=True)])], 0
    for columns in held:
        owner = columns.pop(codec.lanes)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (owner, *columns)], names=names)


def _redealt(blocks: list[bytes], codec: Codec, of: int, places: int, more: int = 0) -> Iterator[list[bytes]]:
    """A bucket's blocks in ``of`` shares by the class of their first ``places`` chords, compressed again: each row is read once for all shares."""
    shares: list[list[bytes]] = [[] for _ in range(of)]
    held, size = [], 0
    for k, block in enumerate(blocks):
        held.append(_unblocked(block, codec.lanes + 2 + more))
        size += len(held[-1][0])
        if size >= DEAL_ROWS or k == len(blocks) - 1:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            share = (_key(codec, codec.unpacked(columns[: codec.lanes])[:places]) >> 13) % of
            order = np.lexsort((columns[0], share))
            share, *columns = [x[order] for x in (share, *columns)]
            edges = np.append(np.flatnonzero(_runs([share])), len(share))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                shares[share[i]].append(_block([x[i:j] for x in columns]))
            held, size = [], 0
    while shares:
        yield shares.pop()


def _parts(batches: Iterator[pa.RecordBatch], codec: Codec, top: int, ns, most: int, more: int = 0) -> Iterator[tuple["_Part", tuple[int, ...]]]:
    """What is counted at once, and for which lengths: a bucket, or of one with more than ``most`` rows shares by the class of their first
    three chords. Where one such class is too large itself, each length, or all from five on, has shares by the first four or five chords."""
    for bucket in _buckets(batches):
        yield from _parts_of(bucket, codec, top, ns, most, more)


def _parts_of(bucket: list[bytes], codec: Codec, top: int, ns, most: int, more: int = 0) -> Iterator[tuple["_Part", tuple[int, ...]]]:
    size = _size(bucket)
    for blocks in _redealt(bucket, codec, 2 * -(-size // most), SHORTEST, more) if size > most else [bucket]:
        size = _size(blocks)
        if not size:
            continue
        if size <= most:
            yield _Part(_rows(blocks, codec, most, None, more), codec, top), ns
            continue
        for group in filter(None, [*((n,) for n in ns if n < 5), tuple(n for n in ns if n >= 5)]):
            for some in _redealt(blocks, codec, 2 * -(-size // most), min(group[0], 5), more) if group[0] > SHORTEST else [blocks]:
                yield _Part(_rows(some, codec, most, group, more), codec, group[-1]), group


class _Part:
    """A task's rows: equal ones added up, in the order of their text (``w``), with the class of each prefix."""

    def __init__(self, batches: Iterator[pa.RecordBatch], codec: Codec, top: int):
        held = [[np.asarray(c) for c in b.columns] for b in batches if b.num_rows]
        columns = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64) for _ in range(codec.lanes + 2)]
        del held
        owner, *rest, count = columns
        self.codec = codec
        columns = _added([*rest[: codec.lanes], owner, *rest[codec.lanes :], count])
        self.lanes, self.owner, self.more, self.count = columns[: codec.lanes], columns[codec.lanes], columns[codec.lanes + 1 : -1], columns[-1]
        del columns, owner, rest, count
        self.codes = codec.unpacked(self.lanes)[:top]
        step = codec.step[self.codes[0]]
        bad = [~codec.readable[c] for c in self.codes]
        self.masks = [np.where(b, 0, codec.turned(step, c)) for b, c in zip(bad, self.codes, strict=True)] + [np.zeros(len(step), np.int64)] * (LONGEST - top)
        self.size = sum((c > 0).astype(np.int64) for c in self.codes)
        self.read = self.size.copy()
        for i in range(top - 1, -1, -1):
            self.read[bad[i]] = i
        self.u = sum(self.masks[i] << 12 * (4 - i) for i in range(5))
        self.v = sum(self.masks[i] << 12 * (7 - i) for i in range(5, 8))
        self.order = np.lexsort((self.v, self.u))
        self.top = top
        self._exact, self._class = np.zeros(len(step), bool), np.zeros(len(step), bool)
        self._exact[:1] = self._class[:1] = True

    def lengths(self, ns) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length n in order: n, the number of the n-gram and of the class that each row starts with."""
        for n in range(1, max(ns) + 1):
            c, m = self.codes[n - 1], self.masks[n - 1][self.order]
            self._exact[1:] |= c[1:] != c[:-1]
            self._class[1:] |= m[1:] != m[:-1]
            if n in ns:
                of_class = np.empty(len(c), np.int64)
                of_class[self.order] = np.cumsum(self._class) - 1
                yield n, np.cumsum(self._exact) - 1, of_class

    def key(self, rows: np.ndarray, n: int) -> list[np.ndarray]:
        """(u, v) of the class of length ``n`` that rows start with."""
        keep = lambda first, places: sum(4095 << 12 * (places - 1 - k) for k in range(places) if first + k < n)
        return [self.u[rows] & keep(0, 5), self.v[rows] & keep(5, 3)]

    def grams(self, n: int, of_gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row and the count of each n-gram of length ``n``, in the order of their text."""
        rows = np.flatnonzero(self.size >= n)
        starts = np.flatnonzero(_runs([of_gram[rows]]))
        return rows[starts], np.add.reduceat(self.count[rows], starts) if len(rows) else rows


    def classes(self, n: int, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row and the count of each class of length ``n`` that can be read, in their order."""
        rows = self.order[self.read[self.order] >= n]
        starts = np.flatnonzero(_runs([of_class[rows]]))
        return rows[starts], np.add.reduceat(self.count[rows], starts) if len(rows) else rows

    def members(self, n: int, of_gram: np.ndarray, of_class: np.ndarray) -> tuple:
        """Of each class of length ``n`` that can be read, in their order: a row, the count, how many n-grams it has, and the first row of the
        most frequent one (of equal ones the least text) and of the least."""
        rows, count = self.grams(n, of_gram)
        of_row, first = np.zeros(len(self.count), np.int64), np.zeros(len(self.count), bool)
        of_row[rows], first[rows] = count, self.read[rows] >= n
        rows = self.order[first[self.order]]
        if not len(rows):
            return rows, rows, rows, rows, rows
        starts = np.flatnonzero(_runs([of_class[rows]]))
        count, members = of_row[rows], np.diff(starts, append=len(rows))
        most = np.repeat(np.maximum.reduceat(count, starts), members)
        best = np.minimum.reduceat(np.where(count == most, rows, len(of_row)), starts)
        return rows[starts], np.add.reduceat(count, starts), members, best, np.minimum.reduceat(rows, starts)


def _sent(names: list[str], columns: list, n: int | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        arrays = [pa.array(c[at : at + (1 << 16)]) if isinstance(c, np.ndarray) else c.slice(at, 1 << 16) for c in columns]
        if n is not None:
            arrays = [pa.array(np.full(len(arrays[0]), n, np.int32)), *arrays]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def collided(part: _Part, ns) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: n, the first row of n-grams with more than one class, and how many."""
    for n, of_gram, of_class in part.lengths(ns):
        rows = np.flatnonzero(part.read >= n)
        rows = rows[np.lexsort((of_class[rows], of_gram[rows]))]
        new = np.flatnonzero(_runs([of_gram[rows], of_class[rows]]))  # a row an n-gram and class
        starts = np.flatnonzero(_runs([of_gram[rows[new]]]))
        keys = np.diff(starts, append=len(new))
        yield n, rows[new[starts]][keys > 1], keys[keys > 1]


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """Counts by a total, rounded half up to ten decimals of the shortest text of the quotient, as Spark's round: once for each distinct count."""
    found, at = np.unique(count, return_inverse=True)
    return np.array([float(Decimal(repr(c / total)).quantize(Decimal("1e-10"), ROUND_HALF_UP)) for c in map(float, found.tolist())])[at]


def first_by_count(most: int, last: int):
    """For :meth:`Counts.grams`: the ``most`` n-grams of highest count, of equal ones the least texts; the count ``last`` comes last."""

    def keep(n: int, codes: list[np.ndarray], count: np.ndarray) -> np.ndarray:
        value = np.where(count == last, -1, count)
        if len(value) <= most:
            return np.arange(len(value))
        least = np.partition(value, -most)[-most]
        above = np.flatnonzero(value > least)
        return np.sort(np.concatenate([above, np.flatnonzero(value == least)[: most - len(above)]]))

    return keep


def with_in_order(tokens: list[str], first: str, second: str):
    """For :meth:`Counts.grams`: n-grams in which ``second`` stands somewhere after ``first``, in one token or in a later one; both are lower case
    and without blanks, so that neither runs over two tokens."""
    low = [t.lower() for t in tokens]
    has = lambda of: np.array([False, *map(of, low)])
    one, two, both = has(lambda t: first in t), has(lambda t: second in t), has(lambda t: second in t.partition(first)[2])

    def keep(n: int, codes: list[np.ndarray], count: np.ndarray) -> np.ndarray:
        seen, found = np.zeros(len(count), bool), np.zeros(len(count), bool)
        for c in codes:
            found |= (seen & two[c]) | both[c]
            seen |= one[c]
        return np.flatnonzero(found)

    return keep


class Counts:
    """The counts of packed songs by length. ``ns`` are the lengths asked for, ``owner`` the column by which :meth:`terms` count, ``turn`` the
    round (see :func:`dealt`), which has all windows of its classes."""

    def __init__(self, songs: DataFrame, codec: Codec, positions: int, ns, owner: str | None = None, turn: tuple[int, int] = (0, 1), carried: str | None = None):
        full = -(-positions // (BUCKET_ROWS * turn[1]))
        tasks = max(2 * songs.sparkSession.sparkContext.defaultParallelism, -(-full // TASK_BUCKETS))
        self.codec, self.ns, self.top, self.most = codec, tuple(sorted(ns)), max(ns), PART_ROWS
        self.tasks, self.buckets, self.more = tasks, max(4 * tasks, full), int(carried is not None)
        self.dealt = lambda beside=None: dealt(songs, codec, tasks, self.buckets, owner, self.top, turn, carried, beside)
        self.rows = self.dealt()

    def _mapped(self, names: list[str], each, kinds: dict[str, str] | None = None) -> DataFrame:
        codec, top, lengths, most, more, kinds = self.codec, self.top, self.ns, self.most, self.more, {"n": "int"} | (kinds or {})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, ns in _parts(batches, codec, top, lengths, most, more):
                yield from each(part, ns)

        return self.rows.select("bucket", "block").mapInArrow(run, ", ".join(f"{x} {kinds.get(x, 'long')}" for x in names))

    def _summed(self, names: list[str], kind: str, each) -> DataFrame:
        """o and the sums of the columns ``names``, as many for each length, that ``each`` gives for the owners of a part: added up by task, then
        by owner."""
        codec, top, lengths, most, dtype = self.codec, self.top, self.ns, self.most, np.dtype("f8" if kind == "double" else "i8")
        width = len(names) // len(lengths)

        def placed(owners: np.ndarray, columns: list[np.ndarray], ns) -> tuple:
            total = np.zeros((len(names), len(owners)), dtype)
            for k, n in enumerate(ns):
                at = width * lengths.index(n)
                total[at : at + width] = columns[width * k : width * (k + 1)]
            return owners, total

        def added(held: list) -> list:
            owners, at = np.unique(np.concatenate([o for o, _ in held]), return_inverse=True)
            total, rows = np.zeros((len(names), len(owners)), dtype), np.concatenate([x for _, x in held], axis=1)
            for t, x in zip(total, rows, strict=True):
                np.add.at(t, at, x)
            return [(owners, total)]

        def sent(held: list) -> Iterator[pa.RecordBatch]:
            for owners, total in held:
                yield from _sent(["o", *names], [pa.array(owners, mask=owners == _NULL), *total])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []
            for part, ns in _parts(batches, codec, top, lengths, most):
                held.append(placed(*each(part, ns), ns))
                if len(held) > 1 and sum(len(o) for o, _ in held[1:]) >= HELD_OWNERS // 4:
                    held = added(held)
                    if len(held[0][0]) > HELD_OWNERS:
                        yield from sent(held)
                        held = []
            if held:
                yield from sent(added(held))

        rows = self.rows.select("bucket", "block").mapInArrow(run, f"o long, {', '.join(f'{x} {kind}' for x in names)}")
        return rows.groupBy("o").agg(*(F.sum(x).alias(x) for x in names))

    def grams(self, texts: dict[str, tuple[list[str], str]] | None = None, keep=None, totals: dict[int, int] | None = None, forms: tuple[str, ...] = ()) -> DataFrame:
        """n, the lanes w0, ... of each n-gram, its class (u, v; null if it cannot be read) and cnt; with ``texts`` these columns instead of the
        lanes: a text of each code, joined by a separator. ``keep`` tells the rows to send from n, their codes (0: none) and counts, which
        are in the order of their text; ``totals`` by length add the column frequency; ``forms`` as in :meth:`keys`, null without a class."""
        codec, texts = self.codec, texts or {}
        names = ["n", *(texts or codec.names()), "u", "v", "cnt", *(["frequency"] if totals else []), *forms]
        shipped = self.rows.sparkSession.sparkContext.broadcast(texts) if texts else None

        def columns(part: _Part, n: int, rows: np.ndarray) -> list:
            if not shipped:
                return codec.cut([x[rows] for x in part.lanes], n)
            codes = [part.codes[i][rows] for i in range(n)]
            return [joined_text(spelled, codes) for spelled in shipped.value.values()]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, of_gram, _ in part.lengths(ns):
                rows, count = part.grams(n, of_gram)
                if keep:
                    kept = keep(n, [part.codes[i][rows] for i in range(n)], count)
                    rows, count = rows[kept], count[kept]
                last = [count, shares(count, totals[n])] if totals and len(rows) else [count]
                for at in range(0, len(rows), 1 << 16):
                    some = rows[at : at + (1 << 16)]
                    bad = part.read[some] < n
                    made = [pc.if_else(pa.array(~bad), x, None) for x in formed(n, [m[some] for m in part.masks[:n]], forms)]
                    yield from _sent(names, [*columns(part, n, some), *(pa.array(x, mask=bad) for x in part.key(some, n)), *(x[at : at + (1 << 16)] for x in last), *made], n)

        return self._mapped(names, each, dict.fromkeys(texts, "string") | {"frequency": "double"} | {x: FORMS[x][0] for x in forms})

    def classes(self, forms: tuple[str, ...] = (), spelled: tuple[list[str], str] | None = None) -> DataFrame:
        """n, u, v, cnt, n_exact, and the lanes of the most frequent member (b0, ...; of equal ones the least text) and of the least (l0, ...);
        ``forms`` as in :meth:`keys`, with ``spelled`` (a text of each code and what joins them) the first one's text as example."""
        names, codec = ["n", "u", "v", "cnt", "n_exact", *self.codec.names("b"), *self.codec.names("l"), *(["example"] if spelled else []), *forms], self.codec
        shipped = self.rows.sparkSession.sparkContext.broadcast(spelled) if spelled else None

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, of_gram, of_class in part.lengths(ns):
                found, total, members, best, least = part.members(n, of_gram, of_class)
                for at in range(0, len(found), 1 << 16):
                    to = at + (1 << 16)
                    ends = [x for r in (best, least) for x in codec.cut([lane[r[at:to]] for lane in part.lanes], n)]
                    text = [joined_text(shipped.value, [part.codes[i][best[at:to]] for i in range(n)])] if shipped else []
                    yield from _sent(names, [*part.key(found[at:to], n), total[at:to], members[at:to], *ends, *text, *formed(n, [m[found[at:to]] for m in part.masks[:n]], forms)], n)

        return self._mapped(names, each, {x: FORMS[x][0] for x in forms} | {"example": "string"})

    def keys(self, forms: tuple[str, ...]) -> DataFrame:
        """n and columns (see :data:`FORMS`) of every class, made where the class is counted: a few array steps for many classes at once."""
        names = ["n", *forms]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, _, of_class in part.lengths(ns):
                found, _ = part.classes(n, of_class)
                for at in range(0, len(found), 1 << 16):
                    yield from _sent(names, formed(n, [m[found[at : at + (1 << 16)]] for m in part.masks[:n]], forms), n)

        return self._mapped(names, each, {x: FORMS[x][0] for x in forms})

    def summary(self) -> DataFrame:
        """n and the numbers of windows, of n-grams, of windows that can be read and of classes."""
        names = ["n", "windows", "grams", "read", "classes"]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, of_gram, of_class in part.lengths(ns):
                rows, count = part.grams(n, of_gram)
                read = part.read[rows] >= n
                yield from _sent(names, [np.array([x]) for x in (count.sum(), len(rows), count[read].sum(), len(np.unique(of_class[rows[read]])))], n)

        return self._mapped(names, each).where("windows > 0").groupBy("n").agg(*(F.sum(x).alias(x) for x in names[1:]))

    def collisions(self) -> DataFrame:
        """n, the lanes and the number of classes of n-grams whose occurrences have more than one class."""
        names, codec = ["n", *self.codec.names(), "keys"], self.codec

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, first, keys in collided(part, ns):
                yield from _sent(names, [*codec.cut([x[first] for x in part.lanes], n), keys], n)

        return self._mapped(names, each)

    def leading(self, most: int) -> DataFrame:
        """The ``most`` classes and n-grams of highest count of each length: n, h (1: classes), the lanes, u, v and cnt; of equal ones the least class
        or text. For classes, the lanes are those of their most frequent member. A part sends its own; the few of all parts are ranked."""
        names, codec = ["n", "h", *self.codec.names(), "u", "v", "cnt"], self.codec
        best_of = first_by_count(most, last=-1)

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, of_gram, of_class in part.lengths(ns):
                rows, count = part.grams(n, of_gram)
                kept = best_of(n, [], count)
                rows, count = rows[kept], count[kept]
                bad = part.read[rows] < n
                yield from _sent(names, [np.zeros(len(rows), np.int64), *codec.cut([x[rows] for x in part.lanes], n), *(pa.array(x, mask=bad) for x in part.key(rows, n)), count], n)
                found, total, _, best, _ = part.members(n, of_gram, of_class)
                kept = best_of(n, [], total)
                yield from _sent(names, [np.ones(len(kept), np.int64), *codec.cut([x[best[kept]] for x in part.lanes], n), *part.key(found[kept], n), total[kept]], n)

        rows = self._mapped(names, each)
        order = [F.desc("cnt"), *(F.when(F.col("h") == 1, F.col(c)) for c in "uv"), *codec.names()]
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("n", "h").orderBy(*order))).where(F.col("r") <= most)

    def _terms(part: _Part, ns, support: int):  # noqa: N805
        """For each length: n, and the row, count and df (number of owners) of every owner's supported class."""
        owners, who = np.unique(part.owner, return_inverse=True)
        for n, _, of_class in part.lengths(ns):
            rows = np.flatnonzero(part.read >= n)
            total = np.bincount(of_class[rows], part.count[rows], minlength=1)
            rows = rows[total[of_class[rows]] >= support]
            key = of_class[rows] * len(owners) + who[rows]
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(_runs([key[order]]))
            count = np.add.reduceat(part.count[rows[order]], starts) if len(rows) else rows
            first = rows[order[starts]]
            df = np.bincount(of_class[first], minlength=1)[of_class[first]] if len(first) else first
            yield n, first, count, df, who, owners

    def terms(self, support: int) -> DataFrame:
        """o (null again where it was), n, u, v, cnt and df of every owner's classes that occur ``support`` times or more in all; and size, if it
        is carried."""
        names, found = ["n", "o", "u", "v", "cnt", "df", *(["size"] if self.more else [])], Counts._terms

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, rows, count, df, _, _ in found(part, ns, support):
                owner = part.owner[rows]
                yield from _sent(names, [pa.array(owner, mask=owner == _NULL), *part.key(rows, n), count, df, *(x[rows] for x in part.more)], n)

        return self._mapped(names, each)

    def extremes(self, support: int, most: int = 0, least: int = 0) -> DataFrame:
        """o, n, u, v, cnt and low of the ``most`` terms of highest count (low: 0) and the ``least`` ones of lowest (low: 1) of each owner and length,
        of equal ones the least classes. A part sends no more than its own."""
        names, found = ["n", "o", "u", "v", "cnt", "low"], Counts._terms

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, rows, count, _, who, _ in found(part, ns, support):
                for low, size, value in ((0, most, -count), (1, least, count)):
                    order = np.lexsort((value, who[rows]))  # rows are in the order of classes
                    of = who[rows[order]]
                    kept = order[np.arange(len(of)) - np.searchsorted(of, of) < size]
                    owner = part.owner[rows[kept]]
                    yield from _sent(names, [pa.array(owner, mask=owner == _NULL), *part.key(rows[kept], n), count[kept], np.full(len(kept), low)], n)

        rows = self._mapped(names, each)
        order = [F.when(F.col("low") == 1, F.col("cnt")).otherwise(-F.col("cnt")), F.col("u"), F.col("v")]
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("o", "n", "low").orderBy(*order)))
        return ranked.where(F.col("r") <= max(most, least)).where(F.when(F.col("low") == 1, F.col("r") <= least).otherwise(F.col("r") <= most))

    def frequencies(self, support: int) -> DataFrame:
        """n, u, v and df of those classes."""
        names, found = ["n", "u", "v", "df"], Counts._terms

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, rows, _, df, _, _ in found(part, ns, support):
                key = part.key(rows, n)
                starts = np.flatnonzero(_runs(key))
                yield from _sent(names, [*(x[starts] for x in key), df[starts]], n)

        return self._mapped(names, each)

    def located_ids(self, support: int, ids: DataFrame) -> DataFrame:
        """o, n, cnt, df and id of those terms; ``ids`` (n, u, v, id) of all their classes meet them in their buckets, as blocks."""
        codec, top, lengths, most, buckets, found = self.codec, self.top, self.ns, self.most, self.buckets, Counts._terms
        names = ["n", "o", "cnt", "df", "id"]

        def dealt_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, u, v, i = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
                bucket = _mixed(u >> 24) % buckets
                order = np.lexsort((v, u, n, bucket))
                bucket, *columns = [x[order] for x in (bucket, u, v, n, i)]
                edges = np.append(np.flatnonzero(_runs([bucket])), len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array([_block([x[a:b] for x in columns]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["bucket", "block"])

        def each(part: _Part, ns, known: dict) -> Iterator[pa.RecordBatch]:
            for n, rows, count, df, _, _ in found(part, ns, support):
                if len(rows):
                    heads, keys, number = known[n]
                    u, v = part.key(rows, n)
                    owner, at = part.owner[rows], np.searchsorted(keys, (np.searchsorted(heads, u) << 36) | v)
                    yield from _sent(names, [pa.array(owner, mask=owner == _NULL), count, df, number[at]], n)

        def read(blocks: list[bytes]) -> dict:
            u, v, n, number = (np.concatenate(x) for x in zip(*(_unblocked(b, 4) for b in blocks), strict=True)) if blocks else [np.zeros(0, np.int64)] * 4
            known = {}
            for m in lengths:
                heads, at = np.unique(u[n == m], return_inverse=True)
                key = (at << 36) | v[n == m]
                order = np.argsort(key)
                known[m] = heads, key[order], number[n == m][order]
            return known

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for kinds, blocks in _marked(batches):
                known = read([b for k, b in zip(kinds, blocks, strict=True) if k == 0])
                for part, ns in _parts_of([b for k, b in zip(kinds, blocks, strict=True) if k == 1], codec, top, lengths, most):
                    yield from each(part, ns, known)

        beside = ids.select("n", "u", "v", "id").mapInArrow(dealt_ids, "bucket int, block binary")
        return self.dealt(beside).select("bucket", "k", "block").mapInArrow(run, "n int, o long, cnt long, df long, id long")

    def examples(self, support: int, spelled: tuple[list[str], str]) -> DataFrame:
        """o, n, the place that windows carry and the text of the most frequent member of their class, of classes of ``support`` windows or more."""
        shipped, names = self.rows.sparkSession.sparkContext.broadcast(spelled), ["n", "o", "pos", "example"]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, of_gram, of_class in part.lengths(ns):
                found, total, _, best, _ = part.members(n, of_gram, of_class)
                kept = total >= support
                place = np.full(int(of_class.max(initial=0)) + 1, -1)
                place[of_class[found[kept]]] = np.arange(kept.sum())
                text = joined_text(shipped.value, [part.codes[i][best[kept]] for i in range(n)])
                rows = np.flatnonzero((part.read >= n) & (place[of_class] >= 0))
                rows = np.repeat(rows, part.count[rows])
                for at in range(0, len(rows), 1 << 16):
                    some = rows[at : at + (1 << 16)]
                    owner = part.owner[some]
                    yield from _sent(names, [pa.array(owner, mask=owner == _NULL), part.more[0][some], text.take(pa.array(place[of_class[some]]))], n)

        return self._mapped(names, each, {"example": "string"})

    def totals(self, support: int) -> DataFrame:
        """o, and for each length n: u{n} and i{n}, how many supported classes an owner has and how many windows of them."""
        found = Counts._terms

        def each(part: _Part, ns) -> tuple:
            columns = []
            for _, rows, count, _, who, owners in found(part, ns, support):
                columns += [np.bincount(who[rows], minlength=len(owners)), np.bincount(who[rows], count, minlength=len(owners)).astype(np.int64)]
            return owners, columns

        return self._summed([f"{x}{n}" for n in self.ns for x in "ui"], "long", each)

    def norms(self, support: int, songs: dict[int, int], kinds: str) -> DataFrame:
        """o, and for each length n and kind the sum over an owner's supported classes of (ln(1 + cnt) * idf) squared (l{n}) or
        (cnt * idf) squared (f{n}); ``songs`` has the number of songs with windows of a length."""
        found = Counts._terms

        def each(part: _Part, ns) -> tuple:
            columns = []
            for n, rows, count, df, who, owners in found(part, ns, support):
                idf = np.log((songs.get(n, 0) + 1) / (df + 1)) + 1
                of = {"l": np.log(1 + count) * idf, "f": count * idf}
                columns += [np.bincount(who[rows], of[k] ** 2, minlength=len(owners)) for k in kinds]
            return owners, columns

        return self._summed([f"{k}{n}" for n in self.ns for k in kinds], "double", each)

    def _documents(part: _Part, ns, least: int, of: list[np.ndarray]):  # noqa: N805
        """For each length: n, the classes of ``least`` windows or more (a row, the count and the most frequent member's row of each), and for each
        of ``of`` (by the number of an owner its document, -1 for none) the places of classes, documents and counts, in the order of classes."""
        for n, of_gram, of_class in part.lengths(ns):
            found, total, _, best, _ = part.members(n, of_gram, of_class)
            kept = total >= least
            place = np.full(int(of_class.max(initial=0)) + 1, -1)
            place[of_class[found[kept]]] = np.arange(kept.sum())
            rows = np.flatnonzero((part.read >= n) & (part.owner != _NULL))
            at = place[of_class[rows]]
            rows, at = rows[at >= 0], at[at >= 0]
            counts = []
            for documents in of:
                d = documents[part.owner[rows]]
                width, has = int(documents.max(initial=-1)) + 1, d >= 0
                key, count = at[has] * width + d[has], part.count[rows[has]]
                if kept.sum() * width <= 4 * len(key):
                    dense = np.bincount(key, count, minlength=1).astype(np.int64)
                    key = np.flatnonzero(dense)
                    count = dense[key]
                else:
                    key, back = np.unique(key, return_inverse=True)
                    count = np.bincount(back, count, minlength=len(key)).astype(np.int64)
                counts.append((key // max(width, 1), key % max(width, 1), count))
            yield n, found[kept], total[kept], best[kept], counts

    def documents(self, least: int, of: list[np.ndarray]) -> DataFrame:
        """A row for each class of ``least`` windows or more and document (see :meth:`_documents`) that has it: n, t (the place in ``of``), d, u, v,
        cnt, total (of all songs), the lanes b0, ... of the most frequent member, and over the documents of t: sum_cnt and df."""
        codec, counted = self.codec, Counts._documents
        names = ["n", "t", "d", "u", "v", "cnt", "total", "sum_cnt", "df", *codec.names("b")]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, rows, total, best, counts in counted(part, ns, least, of):
                for t, (at, d, cnt) in enumerate(counts):
                    whole, df = np.bincount(at, cnt, minlength=1).astype(np.int64)[at], np.bincount(at, minlength=1)[at]
                    ends = codec.cut([lane[best[at]] for lane in part.lanes], n)
                    yield from _sent(names, [np.full(len(at), t), d, *part.key(rows[at], n), cnt, total[at], whole, df, *ends], n)

        return self._mapped(names, each)

    def document_terms(self, least: int, of: list[np.ndarray]) -> DataFrame:
        """Of each such class over the documents of t: n, t, u, v, total, df, max_count, weighted (the sum of cnt ln cnt) and whole (of all songs). A
        row with v = -1 says that the document u has a class of length n."""
        counted = Counts._documents

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, rows, total, _, counts in counted(part, ns, least, of):
                for t, (at, d, cnt) in enumerate(counts):
                    starts, seen = np.flatnonzero(_runs([at])), np.unique(d)
                    zero = np.zeros(len(seen), np.int64)
                    heads = at[starts]
                    added = lambda x: np.add.reduceat(x, starts) if len(starts) else x
                    most = np.maximum.reduceat(cnt, starts) if len(starts) else cnt
                    stats = [*part.key(rows[heads], n), added(cnt), np.diff(starts, append=len(at)), most, added(cnt * np.log(cnt)), total[heads]]
                    for columns in (stats, [seen, zero - 1, zero, zero, zero, zero.astype(float), zero]):
                        yield from _sent(names, [np.full(len(columns[0]), t), *columns], n)

        names = ["n", "t", "u", "v", "total", "df", "max_count", "weighted", "whole"]
        return self._mapped(names, each, {"weighted": "double"})

    def document_sizes(self, least: int, of: list[np.ndarray]) -> DataFrame:
        """n, t, d, cnt and f: how many such classes a document has so many times."""
        counted, names = Counts._documents, ["n", "t", "d", "cnt", "f"]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, _, _, _, counts in counted(part, ns, least, of):
                for t, (_, d, cnt) in enumerate(counts):
                    order = np.lexsort((cnt, d))
                    d, cnt = d[order], cnt[order]
                    starts = np.flatnonzero(_runs([d, cnt]))
                    yield from _sent(names, [np.full(len(starts), t), d[starts], cnt[starts], np.diff(starts, append=len(d))], n)

        return self._mapped(names, each).groupBy(*names[:4]).agg(F.sum("f").alias("f"))

    def document_pairs(self, least: int, of: np.ndarray, pairs: list[tuple[int, int, int]], windows: dict[int, list[int]]) -> DataFrame:
        """For ``pairs`` of documents (a number, the first, the second; -1: none): n, p and over all such classes the sums l1, l2, ab, aa and bb of
        their shares a and b in a document's ``windows`` (by length)."""
        counted, names = Counts._documents, ["n", "p", "l1", "l2", "ab", "aa", "bb"]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, rows, _, _, ((at, d, cnt),) in counted(part, ns, least, [of]):
                share = cnt / np.array(windows[n], float)[d]
                for p, first, second in pairs:
                    one, two = d == first, d == second
                    if not (one.any() or two.any()):
                        continue
                    a, b = np.zeros(len(rows)), np.zeros(len(rows))
                    a[at[one]], b[at[two]] = share[one], share[two]
                    yield from _sent(names, [np.array([x]) for x in (p, np.abs(b - a).sum(), ((b - a) ** 2).sum(), (a * b).sum(), (a * a).sum(), (b * b).sum())], n)

        return self._mapped(names, each, dict.fromkeys(names[2:], "double")).groupBy("n", "p").agg(*(F.sum(x).alias(x) for x in names[2:]))

    def document_beside(self, least: int, of: np.ndarray, first: int, second: int) -> DataFrame:
        """n, u, v and the counts a and b of such classes in two documents, of those that are in either."""
        counted, names = Counts._documents, ["n", "u", "v", "a", "b"]

        def each(part: _Part, ns) -> Iterator[pa.RecordBatch]:
            for n, rows, _, _, ((at, d, cnt),) in counted(part, ns, least, [of]):
                a, b = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for x, which in ((a, first), (b, second)):
                    x[at[d == which]] = cnt[d == which]
                some = np.flatnonzero(a + b)
                yield from _sent(names, [*part.key(rows[some], n), a[some], b[some]], n)

        return self._mapped(names, each)


class Trie:
    """The classes of one song's windows: of each length, the sorted keys (number of the class without its last chord, that chord's mask).
    Every class has a number, the shorter first."""

    def __init__(self, codec: Codec, songs: list[list[int]], ns):
        self.keys: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        self.hkeys: list[str] = []
        self.lengths: list[int] = []
        self.codec, self.top = codec, max(ns)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(songs)), pa.int64()), pa.array(songs, pa.list_(pa.int32()))], names=["o", "codes"])
        parts = list(_windows(batch, self.top)) if songs else []
        codes = [np.concatenate([c[i] for _, c, _ in parts] or [np.zeros(0, np.int64)]) for i in range(self.top)]
        at, rows = None, np.arange(len(codes[0]))
        for n in range(SHORTEST, self.top + 1):
            rows, at, key = self._keyed(codes, rows, at, n)
            self.keys[n], at = np.unique(key, return_inverse=True)
            self.first[n], heads = len(self.hkeys), self.hkeys[self.first[n - 1] :] if n > SHORTEST else None
            for k in self.keys[n].tolist():
                self.hkeys.append(f"{k:09x}" if heads is None else f"{heads[k >> 12]}{k & 4095:03x}")
                self.lengths.append(n)

    def _keyed(self, codes: list[np.ndarray], rows: np.ndarray, at, n: int) -> tuple:
        """The rows whose window of length n can be read, the number of their class of length n - 1, and their key."""
        step = self.codec.step
        new = range(SHORTEST) if n == SHORTEST else [n - 1]
        ok = np.logical_and.reduce([self.codec.readable[codes[i][rows]] & (codes[i][rows] > 0) for i in new])
        rows = rows[ok]
        key = np.zeros(len(rows), np.int64) if at is None else at[ok].astype(np.int64)
        for i in new:
            key = (key << 12) | self.codec.turned(step[codes[0][rows]], codes[i][rows])
        return rows, None if at is None else at[ok], key

    def found(self, codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each length: the rows whose window's class is one of these, and its number."""
        at, rows = None, np.arange(len(codes[0]))
        for n in range(SHORTEST, self.top + 1):
            rows, at, key = self._keyed(codes, rows, at, n)
            if not len(self.keys[n]):
                return
            at = np.minimum(np.searchsorted(self.keys[n], key), len(self.keys[n]) - 1)
            hit = self.keys[n][at] == key
            rows, at = rows[hit], at[hit]
            yield rows, at + self.first[n]


def met(songs: DataFrame, codec: Codec, trie: Trie) -> DataFrame:
    """o (song_id), f and cnt: the classes of ``trie``, a bounded table, that each song has. No row leaves its task."""
    shipped = songs.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, codes, places in _windows(batch, shipped.value.top):
                song = np.cumsum(places == 0)  # songs with equal ids stay apart
                pairs = list(shipped.value.found(codes))
                rows, f = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.int64)]) for i in (0, 1))
                order = np.lexsort((f, song[rows]))
                rows, f = rows[order], f[order]
                starts = np.flatnonzero(_runs([song[rows], f]))
                owner = owners[rows[starts]]
                yield from _sent(["o", "f", "cnt"], [pa.array(owner, mask=owner == _NULL), f[starts], np.diff(starts, append=len(rows))])

    return songs.select(F.col("song_id").cast("long").alias("o"), "codes").mapInArrow(run, "o long, f long, cnt long")


def local_terms(songs: DataFrame, codec: Codec, n: int, harmonic: bool) -> DataFrame:
    """o (song_id) and the count of each n-gram (its lanes) or readable class (u, v) of length ``n`` in a song: no row leaves its task."""
    keys = ["u", "v"] if harmonic else codec.names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, codes, _ in _windows(batch, n):
                if n > SHORTEST:
                    keep = codes[n - 1] > 0
                    owners, codes = owners[keep], [c[keep] for c in codes]
                if harmonic:
                    ok = np.logical_and.reduce([codec.readable[c] for c in codes])
                    owners, codes = owners[ok], [c[ok] for c in codes]
                    step = codec.step[codes[0]]
                    masks = [codec.turned(step, c) for c in codes]
                    columns = [sum((masks[i] << 12 * (4 - i) for i in range(min(5, n))), np.zeros(len(step), np.int64)), sum((masks[i] << 12 * (7 - i) for i in range(5, n)), np.zeros(len(step), np.int64))]
                else:
                    columns = codec.packed(codes)
                order = np.lexsort((*columns[::-1], owners))
                columns = [x[order] for x in (owners, *columns)]
                starts = np.flatnonzero(_runs(columns))
                owner = columns[0][starts]
                yield from _sent(["o", *keys, "cnt"], [pa.array(owner, mask=owner == _NULL), *(x[starts] for x in columns[1:]), np.diff(starts, append=len(order))])

    return songs.select(F.col("song_id").cast("long").alias("o"), "codes").mapInArrow(run, f"o long, {', '.join(f'{k} long' for k in keys)}, cnt long")


def weighed(songs: DataFrame, codec: Codec, features: list[tuple[int, int, int]], train: int) -> DataFrame:
    """song_id, label, decade, split and the sparse vector (indices, values) of each song: (1 + ln cnt) * (ln((1 + train) / (1 + df)) + 1) over the
    classes of three chords in ``features`` (u, v, df; a bounded table), of length one. Songs without any have no row."""
    shipped, kept = songs.sparkSession.sparkContext.broadcast(np.array(features, np.int64)), ("song_id", "label", "decade", "split")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, _, df = shipped.value.T  # three chords lie in u
        order = np.argsort(u)
        keys, idf = u[order], np.log((1 + train) / (1 + df)) + 1
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(len(kept))], names=["o", "codes"])
            for owners, codes, _ in _windows(numbered, SHORTEST):
                ok = np.logical_and.reduce([codec.readable[c] for c in codes])
                owners, codes = owners[ok], [c[ok] for c in codes]
                key = sum(codec.turned(codec.step[codes[0]], c) << 12 * (4 - i) for i, c in enumerate(codes))
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                pair, count = np.unique(owners[hit] * len(keys) + order[at[hit]], return_counts=True)
                row, i = pair // len(keys), pair % len(keys)
                starts = np.flatnonzero(_runs([row]))
                if not len(starts):
                    continue
                w = (1 + np.log(count)) * idf[i]
                w /= np.sqrt(np.repeat(np.add.reduceat(w * w, starts), np.diff(starts, append=len(w))))
                ends = pa.array(np.append(starts, len(w)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(i, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w))]
                songs_ = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(songs_) for k in range(len(kept))), *lists], names=[*kept, "indices", "values"])

    rows = songs.select(*kept, "codes")
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept), "indices array<int>, values array<double>"])
    return rows.mapInArrow(run, schema)


def hits(songs: DataFrame, codec: Codec, classes: dict[int, list[tuple[int, int]]], grams: dict[int, list[tuple[int, ...]]]) -> DataFrame:
    """Of packed songs with a number o: o, n, h (whether classes), k and cnt, how many windows are the k-th of ``classes`` (u, v) or of ``grams``
    (lanes) of their length, both bounded tables. Counted in place, a row a slice."""
    names = ["n", "o", "h", "k", "cnt"]

    def table(rows: list[tuple[int, ...]]) -> tuple:
        """Sorted keys of one integer: of several columns, the first by its place."""
        heads: list[np.ndarray] = []
        key, *rest = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        for c in rest:
            heads.append(np.unique(key))
            both = np.stack([np.searchsorted(heads[-1], key), c])
            pairs, key = np.unique(both, axis=1, return_inverse=True)
            heads.append(pairs)
            key = key.ravel()
        return heads, key

    def found(of: tuple, columns: list[np.ndarray], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are in the table, and their place there."""
        heads, keys = of
        rows, key = np.arange(len(columns[0])), columns[0]
        for k, c in enumerate(columns[1:]):
            head, pairs = heads[2 * k], heads[2 * k + 1]
            at = np.minimum(np.searchsorted(head, key), len(head) - 1)
            hit = head[at] == key
            rows, at, c = rows[hit], at[hit], c[rows[hit]]
            first, last = np.searchsorted(pairs[0], at), np.searchsorted(pairs[0], at, side="right")
            key = np.full(len(rows), -1)
            for step in range(int((last - first).max(initial=0))):  # few pairs share their first column
                here = np.minimum(first + step, pairs.shape[1] - 1)
                key = np.where((first + step < last) & (pairs[1][here] == c), here, key)
            rows, key = rows[key >= 0], key[key >= 0]
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys[order], key), len(keys) - 1)
        hit = keys[order][at] == key
        return rows[hit], number[order[at[hit]]]

    tables = {(n, h): (table(rows), np.arange(len(rows))) for h, by in ((1, classes), (0, grams)) for n, rows in by.items() if rows}
    shipped = songs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        top = max(n for n, _ in known)
        for batch in batches:
            for owners, codes, _ in _windows(batch, top):
                ok = np.logical_and.accumulate([codec.readable[c] & (c > 0) for c in codes])
                step = codec.step[codes[0]]
                masks = [codec.turned(step, c) for c in codes]
                lanes = codec.packed(codes)
                for (n, h), (of, number) in known.items():
                    if h:
                        rows = np.flatnonzero(ok[n - 1])
                        u = sum(masks[i][rows] << 12 * (4 - i) for i in range(min(n, 5)))
                        columns = [u, sum((masks[i][rows] << 12 * (7 - i) for i in range(5, n)), np.zeros(len(rows), np.int64))]
                    else:
                        rows = np.flatnonzero(codes[n - 1] > 0)
                        columns = codec.cut([x[rows] for x in lanes], n)
                    hit, k = found(of, columns, number)
                    owner = owners[rows[hit]]
                    order = np.lexsort((k, owner))
                    owner, k = owner[order], k[order]
                    starts = np.flatnonzero(_runs([owner, k]))
                    owner = owner[starts]
                    yield from _sent(names, [pa.array(owner, mask=owner == _NULL), np.full(len(starts), h), k[starts], np.diff(starts, append=len(k))], n)

    return songs.select("o", "codes").mapInArrow(run, "n int, o long, h long, k long, cnt long").groupBy("o", "n", "h", "k").agg(F.sum("cnt").alias("cnt"))


def followed(songs: DataFrame, codec: Codec, ns) -> DataFrame:
    """song_id, n, pos, hkey and following (the hkey of the song's next window) of every window; null without a class. No row leaves its task."""
    names = ["n", "song_id", "pos", "hkey", "following"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, codes, places in _windows(batch, max(ns)):
                ok = np.logical_and.accumulate([codec.readable[c] & (c > 0) for c in codes])
                step = codec.step[codes[0]]
                masks = [np.where(codec.readable[c], codec.turned(step, c), 0) for c in codes]
                for n in ns:
                    rows = np.flatnonzero(codes[n - 1] > 0)
                    for at in range(0, len(rows), 1 << 16):
                        some = rows[at : at + (1 << 16) + 1]  # one more, which only follows
                        text = pc.if_else(pa.array(ok[n - 1][some]), _strings(hex_text([m[some] for m in masks[:n]])), None)
                        here, size = some[: 1 << 16], min(len(some), 1 << 16)
                        after = np.arange(1, size + 1)
                        last = np.append(places[some[1:]] == 0, True)[:size] if len(some) <= 1 << 16 else places[some[1:]] == 0
                        owner = owners[here]
                        yield from _sent(names, [pa.array(owner, mask=owner == _NULL), places[here].astype(np.int32), text.slice(0, size), text.take(pa.array(np.where(last, 0, after), mask=last))], n)

    return songs.select(F.col("song_id").cast("long").alias("o"), "codes").mapInArrow(run, "n int, song_id long, pos int, hkey string, following string").select("song_id", "n", "pos", "hkey", "following")


def errors(songs: DataFrame, codec: Codec, ns) -> DataFrame:
    """Of windows that cannot be read: n, e (the code of the first unreadable token) and cnt, with the first of them by song and place: o, pos
    and its lanes. A row a slice, so that the caller adds few."""
    names = ["n", "e", "cnt", "o", "pos", *codec.names()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, codes, places in _windows(batch, max(ns)):
                bad = np.stack([~codec.readable[c] for c in codes])
                hit = np.flatnonzero(bad.any(axis=0))
                owners, places, codes, first = owners[hit], places[hit], [c[hit] for c in codes], bad[:, hit].argmax(axis=0)
                token = np.choose(first, codes) - 1
                order = np.lexsort((places, owners, token))
                for n in ns:
                    rows = order[((first < n) & (codes[n - 1] > 0))[order]]
                    starts = np.flatnonzero(_runs([token[rows]]))
                    head, count = rows[starts], np.diff(starts, append=len(rows))
                    owner = owners[head]
                    yield from _sent(names, [token[head], count, pa.array(owner, mask=owner == _NULL), places[head], *codec.cut(codec.packed([c[head] for c in codes]), n)], n)

    return songs.select(F.col("song_id").cast("long").alias("o"), "codes").mapInArrow(run, ", ".join(f"{x} {'int' if x == 'n' else 'long'}" for x in names))


def located(songs: DataFrame, codec: Codec, states: dict[int, list[tuple[int, int, int]]]) -> DataFrame:
    """song_id, n and the states of a song's windows in order; ``states`` are (u, v, state) of the chosen classes by length, a bounded table.
    No row leaves its task."""
    shipped = songs.sparkSession.sparkContext.broadcast({n: sorted(rows) for n, rows in states.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for n, rows in shipped.value.items():
            u, v, state = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            heads, at = np.unique(u, return_inverse=True)  # u, then v with the place of u before it
            tables[n] = heads, (at << 36) | v, state
        for batch in batches:
            for owners, codes, places in _windows(batch, max(tables)):
                ok = np.logical_and.accumulate([codec.readable[c] & (c > 0) for c in codes])
                step = codec.step[codes[0]]
                masks = [codec.turned(step, c) for c in codes] + [np.zeros(len(step), np.int64)] * (LONGEST - len(codes))
                # A window at place 0 starts a song; songs with equal ids stay apart.
                song = np.cumsum(places == 0)
                for n, (heads, keys, state) in tables.items():
                    rows = np.flatnonzero(ok[n - 1])
                    u = sum(masks[i][rows] << 12 * (4 - i) for i in range(min(n, 5)))
                    v = sum((masks[i][rows] << 12 * (7 - i) for i in range(5, n)), np.zeros(len(rows), np.int64))
                    head = np.minimum(np.searchsorted(heads, u), len(heads) - 1)
                    key = (head << 36) | v
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    found = (heads[head] == u) & (keys[at] == key)
                    rows, got = rows[found], state[at[found]]
                    starts = np.flatnonzero(_runs([song[rows]]))
                    owner, lists = owners[rows[starts]], pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), pa.array(got, pa.int32()))
                    yield from _sent(["n", "song_id", "states"], [pa.array(owner, mask=owner == _NULL), lists], n)

    return songs.select(F.col("song_id").cast("long").alias("o"), "codes").mapInArrow(run, "n int, song_id long, states array<int>").select("song_id", "n", "states")
