"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

Every task packs the rows of its own partition, so nothing is shuffled. A row's ids are cut into pieces of ``max_tokens``, each a
sequence of its own, and a remainder. Remainders wait in a pool of bounded size; bins are filled from it one at a time. The
dot-product heuristic chooses, of the waiting items that fit, the one whose demand vector (tokens, segments, loss-bearing tokens,
each over its limit) has the largest dot product with what the bin has left. When nothing fits and more than ``slack`` tokens are
free, the longest waiting item that may be cut gives exactly the missing tokens. A task's last, unfilled bin is closed as sequences
of powers of two, which need no padding.

Items that must stay whole (``cut=False``: instruction examples) are never cut; one that exceeds a limit by itself gets a bin of its
own and the flag ``oversize`` instead of being dropped.

Nulls: a null text is empty (only its end id remains), a null id is kept; equal rows are packed one by one. An empty table gives no
row. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared, subwords

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, oversize boolean"
FIELDS = PIECES.replace(" long", "").replace(" boolean", "").split(", ")
#: Sequence ids of a task start at its partition number times this.
TASK_SEQUENCES = 1 << 40


@dataclass
class Item:
    """A stretch of a document's ids: ``loss`` marks its loss-bearing tokens (None: all of them)."""

    doc: object
    start: int
    ids: np.ndarray
    total: int
    loss: np.ndarray | None = None
    segments: int = 1

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), self.segments, len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, at: int) -> tuple["Item", "Item"]:
        loss = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Item(self.doc, self.start, self.ids[:at], self.total, loss[0], self.segments), Item(self.doc, self.start + at, self.ids[at:], self.total, loss[1], self.segments)


@dataclass
class Packer:
    """Fills bins from a pool of at most ``pool`` items and gives each closed bin to ``emit``."""

    emit: object
    max_tokens: int = 2048
    max_segments: int = 1024
    max_loss: int = 2048
    pool: int = 2048
    slack: int = 8
    cut: bool = True
    powers: bool = True
    items: list = field(default_factory=list)

    def __post_init__(self):
        self.limits = np.array([self.max_tokens, self.max_segments, self.max_loss], np.float64)

    def add(self, item: Item) -> None:
        demand = item.demand()
        if self.cut and item.loss is None:
            whole = min(self.max_tokens, self.max_loss)
            while len(item.ids) >= whole:
                head, item = item.split(whole)
                self.emit([head], False)
            if not len(item.ids):
                return
        elif np.any(np.array(demand) > self.limits):
            self.emit([item], True)
            return
        self.items.append(item)
        if len(self.items) >= self.pool:
            self.pack(self.pool // 2)

    def pack(self, leave: int) -> None:
        """Close bins until at most ``leave`` items wait; with 0, the last bin is closed too."""
        demands = np.array([x.demand() for x in self.items], np.float64).reshape(-1, 3)
        scaled = demands / self.limits
        here = np.ones(len(demands), bool)
        waiting = len(demands)
        while waiting > leave or (leave == 0 and waiting):
            left, room, chosen = self.limits.copy(), None, []
            while waiting:
                fits = here & (demands <= left).all(axis=1)
                if not fits.any():
                    break
                k = int(np.argmax(np.where(fits, scaled @ (left / self.limits), -1.0)))
                chosen.append(self.items[k])
                left -= demands[k]
                here[k] = False
                waiting -= 1
            room = int(min(left[0], left[2]))
            if self.cut and waiting and room > self.slack and left[1] >= 1:
                k = int(np.argmax(np.where(here, demands[:, 0], -1.0)))
                if self.items[k].loss is None:
                    head, self.items[k] = self.items[k].split(room)
                    chosen.append(head)
                    demands[k] = self.items[k].demand()
                    scaled[k] = demands[k] / self.limits
                    room = 0
            if not waiting and self.cut and self.powers and room > 0 and all(x.loss is None for x in chosen):
                self._close_in_powers(chosen)
            elif chosen:
                self.emit(chosen, False)
        self.items = [x for x, keep in zip(self.items, here, strict=True) if keep]

    def _close_in_powers(self, chosen: list) -> None:
        """The last bin as sequences of powers of two, the largest first."""
        queue, total = list(chosen), sum(len(x.ids) for x in chosen)
        while total:
            size = want = 1 << (total.bit_length() - 1)
            out = []
            while want:
                item = queue.pop(0)
                if len(item.ids) > want:
                    item, rest = item.split(want)
                    queue.insert(0, rest)
                out.append(item)
                want -= len(item.ids)
            self.emit(out, False)
            total -= size


def pack(docs: DataFrame, vocabulary: str, style: str = "word", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **limits) -> DataFrame:
    """One row per piece of every document's ids: where it starts in its document and lies in its sequence, with the CRC-32 of its
    ids as little-endian uint32 and, for ``with_ids``, these bytes. ``limits`` go to :class:`Packer`."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = subwords.encoder(vocabulary, style)
        sequence = TaskContext.get().partitionId() * TASK_SEQUENCES
        rows: list[tuple] = []

        def emit(items: list[Item], oversize: bool) -> None:
            nonlocal sequence
            offset, size = 0, sum(len(x.ids) for x in items)
            for x in items:
                body = x.ids.tobytes()
                rows.append((x.doc, x.start, len(x.ids), zlib.crc32(body), x.total, sequence, offset, size, oversize, *([body] if with_ids else ())))
                offset += len(x.ids)
            sequence += 1

        packer = Packer(emit, **limits)
        for batch in shared.sliced(batches, "t"):
            for doc_id, body in zip(batch.column(0).to_pylist(), encode.encode(shared.texts_of(batch, "t")), strict=True):
                ids = np.append(np.frombuffer(body, encode.dtype).astype("<u4"), np.uint32(end_id))
                packer.add(Item(doc_id, 0, ids, len(ids)))
            if rows:
                yield _batch(rows, with_ids)
                rows.clear()
        packer.pack(0)
        if rows:
            yield _batch(rows, with_ids)

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 8 + [pa.bool_()] + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=FIELDS + ["ids"] * with_ids)
