"""Embedding near-duplicates by lattice hashing.

Vectors of one label are compared by cosine in double precision. A table draws ``blocks`` random projections of the unit vector to
eight dimensions, scales them and decodes each to the nearest point of the E8 lattice; the points together are the vector's cell. A
vector is posted under its own cell and under the ``probes`` neighbouring cells (one block's point moved by a minimal vector of E8) that
its residuals point to most. Two vectors meet in a table if one's own cell is the other's own or probed cell, and every meeting is
verified by cosine. With the production values (8 tables of 2 blocks, 3 probes, scale 0.5) all linked pairs of the test tables meet.

Equal vectors are one node with a count. Cells that hold a single node are dropped by an aggregated count before vectors travel; cells
of more than ``CHUNK`` nodes are compared chunk against chunk, so no task holds a cell. A pair is counted in the first table and
smallest cell in which it meets, which both vectors' stored cells tell, so blocks return sums of links per node and a spanning forest
of their links, never pairs.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing; vectors of different
lengths never link. Rows with a null id take part. Equal rows are vectors of one node each. An empty table gives no row. Extra columns
are not read. Ties of cosine at the threshold are links. Long vectors are compared in
chunks of rows; a vector is kept whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import components, shared

CHUNK = 512


@dataclass(frozen=True)
class Lattice:
    tables: int = 8
    blocks: int = 2
    probes: int = 3
    scale: float = 0.5
    seed: int = 8
    least: float = 0.98


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            whole.append(v)
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integer points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    point = np.rint(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by one half everywhere: the nearer of the two candidates."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def cells(unit: np.ndarray, salt: np.ndarray, lattice: Lattice) -> np.ndarray:
    """int64 of rows x tables x (1 + probes): each vector's own cell, then the probed ones, best first."""
    dim = unit.shape[1]
    random = np.random.default_rng([lattice.seed, dim])
    steps = minimal_vectors()
    doubled = (2 * steps).astype(np.int64)
    out = np.empty((len(unit), lattice.tables, 1 + lattice.probes), np.int64)
    with np.errstate(over="ignore"):
        for t in range(lattice.tables):
            own = salt + np.int64(random.integers(1 << 62))
            gains, moves = [], []
            for _ in range(lattice.blocks):
                x = unit @ random.standard_normal((dim, 8)) * lattice.scale
                weights = random.integers(1, 1 << 62, 8) * 2 + 1
                point = nearest_e8(x)
                own = own + (2 * point).astype(np.int64) @ weights
                gains.append((x - point) @ steps.T)
                moves.append(np.broadcast_to(doubled @ weights, (len(unit), len(steps))))
            gain, move = np.concatenate(gains, axis=1), np.concatenate(moves, axis=1)
            best = np.argpartition(-gain, lattice.probes, axis=1)[:, : lattice.probes]
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + np.take_along_axis(move, best, axis=1)
        out ^= out >> np.int64(29)
        out *= np.int64(-0x40A7B892E31B1A47)
    return out


def _nodes(vectors: DataFrame) -> DataFrame:
    """i, node and body (float64 bytes of the unit vector) of every row; node and body are null for rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                names, bodies = [], []
                for label, v in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    values = v.values if v.is_valid else None
                    if label is None or values is None or not len(values) or values.null_count:
                        names.append(None)
                        bodies.append(None)
                        continue
                    x = np.asarray(values, np.float64)
                    largest = np.abs(x).max()
                    if not np.isfinite(largest) or largest == 0:
                        names.append(None)
                        bodies.append(None)
                        continue
                    names.append(hashlib.blake2b(x.tobytes() + str(label).encode(), digest_size=16).digest())
                    x = x / largest
                    bodies.append((x / np.sqrt(x @ x)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], names=["i", "label", "node", "body"])

    return vectors.mapInArrow(run, "i long, label string, node binary, body binary")


def _celled(nodes: DataFrame, lattice: Lattice) -> DataFrame:
    """The nodes with ``cells``: int64 bytes of tables x (1 + probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[bytes] = [b""] * part.num_rows
                bodies = part.column(2).to_pylist()
                salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=7).digest(), "little") for x in part.column(1).to_pylist()], np.int64)
                sizes = np.array([len(b) for b in bodies])
                for size in np.unique(sizes):
                    of = np.flatnonzero(sizes == size)
                    unit = np.frombuffer(b"".join(bodies[k] for k in of), np.float64).reshape(len(of), -1)
                    for k, c in zip(of, cells(unit, salts[of], lattice), strict=True):
                        rows[k] = c.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(rows, pa.binary())], names=["node", "body", "size", "cells"])

    return nodes.select("node", "label", "body", "size").mapInArrow(run, "node binary, body binary, size long, cells binary")


def _posts(celled: DataFrame, lattice: Lattice) -> DataFrame:
    width = 1 + lattice.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            per = lattice.tables * width
            at = pa.array(np.repeat(np.arange(batch.num_rows), per))
            home = np.tile(np.arange(per) % width == 0, batch.num_rows)
            table = np.tile(np.arange(per) // width, batch.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(table), pa.array(home), batch.column(0).take(at)], names=["cell", "table", "home", "node"])

    return celled.select("node", "cells").mapInArrow(run, "cell long, table int, home boolean, node binary")


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    free, out = near.any(axis=1), []
    while free.any():
        start = int(np.argmax(free))
        free[start] = False
        edge = [start]
        while edge:
            k = edge.pop()
            for j in np.flatnonzero(near[k] & free).tolist():
                free[j] = False
                out.append((k, j))
                edge.append(j)
    return out


def _linked(celled: DataFrame, lattice: Lattice) -> DataFrame:
    """Rows (a, null, n): n more links of node a; and (a, b, 0): an edge of a block's spanning forest."""
    posts = shared.staged(_posts(celled, lattice), "posts")
    live = posts.groupBy("cell").agg(F.count("*").alias("freq"), F.max("home").alias("any")).where("freq > 1 AND any").select("cell", "freq")
    rows = posts.join(live, "cell")
    chunks = F.ceil(F.col("freq") / CHUNK).cast("int")
    rows = rows.withColumn("c", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "table", "home", "node").join(celled, "node")
    rows = rows.select("cell", "i", "j", "own", "table", "home", "node", "size", "body", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        edges: set[tuple[bytes, bytes]] = set()

        def flush() -> pa.RecordBatch:
            rows = [(a, None, n) for a, n in sums.items()] + [(a, b, 0) for a, b in edges]
            sums.clear()
            edges.clear()
            a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for group in shared.runs(batches, 3):
            if group.num_rows < 2:
                continue
            bodies = group.column("body").to_pylist()
            if len({len(b) for b in bodies}) > 1:
                raise ValueError("a cell mixes lengths")
            unit = np.frombuffer(b"".join(bodies), np.float64).reshape(len(bodies), -1)
            near = unit @ unit.T >= lattice.least
            home, own = np.asarray(group.column("home")), np.asarray(group.column("own"))
            near &= home[:, None] | home[None, :]
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            if i != j:
                near &= own[:, None] != own[None, :]
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            # Keep a pair only where it meets first: no earlier table, no smaller cell of this one.
            table, cell = group.column("table")[0].as_py(), group.column("cell")[0].as_py()
            found = np.frombuffer(b"".join(group.column("cells").to_pylist()), np.int64).reshape(len(bodies), lattice.tables, -1)
            ii, jj = np.nonzero(np.triu(near))
            for at in range(0, len(ii), 1 << 16):
                x, y = ii[at : at + (1 << 16)], jj[at : at + (1 << 16)]
                early = np.zeros(len(x), bool)
                for t in range(table):
                    early |= (found[x, t] == found[y, t, :1]).any(axis=1) | (found[y, t] == found[x, t, :1]).any(axis=1)
                a, b = found[x, table, 0], found[y, table, 0]
                early |= (a < cell) & (found[y, table] == a[:, None]).any(axis=1)
                early |= (b < cell) & (found[x, table] == b[:, None]).any(axis=1)
                near[x[early], y[early]] = near[y[early], x[early]] = False
            nodes, size = group.column("node").to_pylist(), np.asarray(group.column("size"))
            for k, n in enumerate((near @ size).tolist()):
                if n:
                    sums[nodes[k]] = sums.get(nodes[k], 0) + n
            edges.update((min(nodes[p], nodes[q]), max(nodes[p], nodes[q])) for p, q in _spanning(near))
            if len(sums) + len(edges) > 20_000:
                yield flush()
        yield flush()

    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
    return dealt.mapInArrow(run, "a binary, b binary, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", lattice: Lattice = Lattice()) -> DataFrame:
    """vec_id, n_links, component_id (smallest id that links reach) and kept of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    named = shared.staged(_nodes(rows), "vectors")
    nodes = named.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("i").alias("least"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("body").alias("body"))
    nodes = shared.staged(nodes, "nodes")
    celled = shared.staged(_celled(nodes, lattice), "cells")
    found = shared.staged(_linked(celled, lattice), "found")
    sums = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    roots = components.components(found.where(F.col("b").isNotNull()).select("a", "b"), "a", "b")
    joined = nodes.select("node", "least", "size").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    links = (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")
    joined = joined.join(smallest, "root").select("node", links, "component_id")
    out = named.select("i", "node").join(joined, "node", "left")
    component = F.coalesce("component_id", "i")
    return out.select(F.col("i").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("i") == component, F.lit(True)).alias("kept"))
