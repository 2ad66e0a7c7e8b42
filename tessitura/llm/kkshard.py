"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal keys form a group that stays together. A partial partition holds k sums with the groups behind each; differencing
takes the two partial partitions with the largest spread and joins the largest sum of one with the smallest of the other, the second
largest with the second smallest and so on, until one partition is left.

It runs in two levels. Groups (one row each after a map-side aggregated count and sum) are dealt to tasks by their key; a task
differences at most ``chunk`` groups at a time into one partial partition. The partial partitions, k numbers per chunk, are
differenced on the driver in the same way: their number is the number of groups over ``chunk``. Rows then join their group's shard.

Slots are gapless per shard without a global sort: rows are dealt by a hash of their id to blocks, counted per (block, shard), and
numbered inside each behind the counts of earlier blocks.

The law is ``bytes``: shards of near equal bytes. Nulls: a null text has size 1 and CRC 0 and shares the group of the empty text; rows
with a null id are kept. Equal rows keep a row each. An empty table gives no row. Extra columns are not read. A very long text counts by its bytes alone and is never moved whole into numpy.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm import shared


def difference(parts: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """Combine partial partitions (k sums each) into one; returns, for each of them, the bin of each of its k sums."""
    if not parts:
        return []
    nodes: list[tuple] = []  # (left, slots of left, right, slots of right) by node; leaves are indices of parts
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda b: (-sums[b], b))
        ranked = tuple(sums[b] for b in order)
        heap.append((ranked[-1] - ranked[0], i, ranked))
        nodes.append((None, order))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = [left[j] + right[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        ranked = tuple(sums[j] for j in order)
        nodes.append((a, b, order))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    out: list[list[int]] = [[] for _ in parts]
    stack = [(heap[0][1], list(range(k)))]  # a node and the bin of each of its ranks
    while stack:
        n, bins = stack.pop()
        if nodes[n][0] is None:
            found = [0] * k
            for rank, slot in enumerate(nodes[n][1]):
                found[slot] = bins[rank]
            out[n] = found
        else:
            a, b, order = nodes[n]
            inner = [0] * k
            for rank, j in enumerate(order):
                inner[j] = bins[rank]
            stack.append((a, inner))
            stack.append((b, inner[::-1]))
    return out


def assign_bytes(groups: DataFrame, k: int, chunk: int = 50_000) -> DataFrame:
    """``groups``: key string, size long, one row per group. Returns key and shard."""
    parts = groups.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, held, rows, number = TaskContext.get().partitionId(), [], 0, 0

        def close() -> pd.DataFrame:
            nonlocal number
            g = pd.concat(held).sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
            bins = difference([(int(x), *[0] * (k - 1)) for x in g["size"]], k)
            g["part"], g["bin"] = f"{task}-{number}", [b[0] for b in bins]
            number += 1
            return g

        for f in frames:  # sorted by key, so that chunks are the same in every attempt
            while len(f):
                take = f.iloc[: chunk - rows]
                held.append(take)
                rows, f = rows + len(take), f.iloc[len(take) :]
                if rows == chunk:
                    yield close()
                    held, rows = [], 0
        if rows:
            yield close()

    dealt = groups.repartition(int(parts), "key").sortWithinPartitions("key")
    local = shared.staged(dealt.mapInPandas(run, "key string, size long, part string, bin int"), "shard-chunks")
    sums: dict[str, list[int]] = {}
    for r in local.groupBy("part", "bin").agg(F.sum("size").alias("size")).toLocalIterator():
        sums.setdefault(r["part"], [0] * k)[r["bin"]] = r["size"]
    names = sorted(sums)
    bins = difference([sums[p] for p in names], k)
    table = groups.sparkSession.createDataFrame([(p, b, s) for p, found in zip(names, bins, strict=True) for b, s in enumerate(found)], "part string, bin int, shard int")
    return local.join(table, ["part", "bin"]).select("key", "shard")


def numbered(rows: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Add ``slot``, gapless from 0 inside each ``shard``. ``rows`` must be a staged table: it is read twice."""
    blocks = blocks or max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("shard", "_block", before.alias("_base"))
    place = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(base), ["shard", "_block"]).withColumn("slot", (F.col("_base") + F.col("_place") - 1).cast("long")).drop("_block", "_base", "_place")


def shard_by_bytes(docs: DataFrame, k: int = 8, id_col: str = "doc_id", text_col: str = "text", chunk: int = 50_000) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (null for this law); equal texts share a shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    rows = shared.staged(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    placed = shared.staged(rows.join(assign_bytes(groups, k, chunk), "key"), "shard-placed")
    out = numbered(placed.withColumn("shard", F.col("shard").cast("int")), ["doc_id", "key"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
