"""MinHash near-duplicates by an inverted join on signature coordinates.

A document is its set of distinct word shingles. Documents with equal sets are one node (a 128-bit fingerprint of the whole set), so
copies cost nothing further. A node's signature has ``K`` coordinates, the first ``POST`` of which are posted. For a pair of Jaccard
similarity 0.75 equal coordinates follow a binomial law: with a probability under 2e-7 there are fewer than ``SHARED`` = 19 among the
48 posted ones, or fewer than ``MATCHES`` = 70 among all 128.

*Inverted lists.* A node is posted under its coordinate-value pairs. Pairs that only one node has (most) hold no candidate and are
dropped after a map-side aggregated count; a node with fewer than SHARED live pairs cannot reach the threshold and leaves.
*Prefix and skip.* Two nodes with SHARED equal posted coordinates share one of the POST - SHARED + 1 rarest of each, in one global
order. So a node is listed under these alone (its dead pairs come first and need no list); the longest lists are skipped, and the count
of equal coordinates is completed from the signatures when two nodes meet.
*Merging a list.* Lists longer than ``CHUNK`` are cut by a hash of the node and merged chunk against chunk, so no task holds a list.
Candidates (MATCHES equal coordinates, sizes that allow the similarity) never leave the merge as pairs: it returns a spanning forest of
the strongest. Its edges are verified on the full sets of shingles and give components; unverified, they give families, which hold every
candidate pair.
*Rest.* Similarity is not transitive, so a family that still holds several components is compared exactly: its nodes' full sets meet
chunk against chunk, nodes of the largest component only with the others, and a spanning forest of the links found comes back. Nothing is
capped: links decide components exactly, up to the signatures' error above.

Nulls: a null text is empty; a text without words has no shingles (size 0) and links with nothing; one with fewer than ``width`` words
is one shingle. Rows with a null id take part: the smallest id that is not null names a component, and they are kept only if all ids of
their component are null. Equal rows fall into one node. An empty table gives no row. Extra columns are not read. Ties of similarity count as links; the smallest id, then
the smallest hash of id and text, stands for a group. A very long text is shingled whole, some 80 bytes a word in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm import components, shared

K, MATCHES = 128, 70
POST, SHARED = 48, 19
WIDTH, PERCENT = 5, 75
#: Nodes of a list's, and of a family's, chunk.
CHUNK, FAMILY_CHUNK = 1024, 256
#: Nodes whose ids may be broadcast for the second reading of texts (some 40 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Rows that go or were repeated, whose hashes may be broadcast (some 30 bytes each); more are joined by a shuffle.
BROADCAST_FATES = 2_000_000

_RANDOM = np.random.default_rng(20240607)
_ODD = _RANDOM.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _RANDOM.integers(0, 1 << 63, K, dtype=np.uint64)
_POWERS = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of ``width`` words, A-Z in lower case."""
    words = shared.lowered(text).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = shared.word_hashes(words)
    n = max(1, len(words) - width + 1)
    total = np.full(n, min(len(words), width), np.uint64)
    for i in range(min(width, len(words))):
        total = (total ^ (total >> np.uint64(31))) * _POWERS[0] + hashes[i : i + n]
    total ^= total >> np.uint64(29)
    total *= _POWERS[1]
    total ^= total >> np.uint64(32)
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """K coordinates (uint32) of a set that is not empty."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    space = np.empty((K, min(512, len(hashes))), np.uint64)
    for a in range(0, len(hashes), 512):
        part = hashes[a : a + 512]
        x = space[:, : len(part)]
        np.bitwise_xor(part, _MASK[:, None], out=x)
        np.multiply(x, _ODD[:, None], out=x)
        np.minimum(least, x.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _described(docs: DataFrame) -> DataFrame:
    """d, h, n and, null without shingles, node, posted (POST coordinates of four bytes) and sig (K of one byte) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, "t"):
            ns, nodes, posted, sigs = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                sig = signature(s) if len(s) else None
                ns.append(len(s))
                nodes.append(fingerprint(s) if len(s) else None)
                posted.append(sig[:POST].tobytes() if len(s) else None)
                sigs.append(sig.astype("u1").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), *(pa.array(x, pa.binary()) for x in (nodes, posted, sigs))], names=["d", "h", "n", "node", "posted", "sig"])

    return docs.mapInArrow(run, "d long, h long, n long, node binary, posted binary, sig binary")


def _posts(nodes: DataFrame) -> DataFrame:
    """key (coordinate number and value) and node, POST rows for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(POST, dtype=np.int64) << 32
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, POST)
            keys = (sig.astype(np.int64) + base).ravel()
            at = pa.array(np.repeat(np.arange(batch.num_rows), POST))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at)], names=["key", "node"])

    return nodes.select("node", "posted").mapInArrow(run, "key long, node binary")


def _listed(nodes: DataFrame) -> DataFrame:
    """key, freq, node, n and sig: the lists of the inverted join."""
    posts = _posts(nodes)
    live = posts.groupBy("key").agg(F.count("*").alias("freq")).where("freq > 1")
    ranked = posts.join(live, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("pairs"))
    heads = ranked.where(F.size("pairs") >= SHARED).select("node", F.slice("pairs", F.lit(1), F.size("pairs") - (SHARED - 1)).alias("head"))
    joined = heads.join(nodes.select("node", "n", "sig"), "node")
    return joined.select(F.explode("head").alias("h"), "node", "n", "sig").select("h.key", "h.freq", "node", "n", "sig")


def _candidates(sig: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Equal coordinates of every pair in a chunk, 0 where they or the sizes rule it out."""
    counts = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(K):
        counts += sig[:, k, None] == sig[None, :, k]
    fits = 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
    counts[(counts < MATCHES) | ~fits] = 0
    np.fill_diagonal(counts, 0)
    return counts


def _forest(counts: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the strongest candidates."""
    n = len(counts)
    if n == 2:
        return [(0, 1)] if counts[0, 1] else []
    out, free = [], counts.any(axis=1)
    best, parent = np.zeros(n, np.int16), np.zeros(n, np.int64)
    while free.any():
        k = int(np.argmax(np.where(free, best, -1)))
        if best[k] > 0:
            out.append((int(parent[k]), k))
        free[k] = False
        better = free & (counts[k] > best)
        best[better], parent[better] = counts[k][better], k
        best[~free] = 0
    return out


def _pairs(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _arrays(group: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "u1").reshape(-1, K)
    return group.column("node").to_pylist(), np.asarray(group.column("n")), sig


def _against(rows: DataFrame, chunks: Column, *columns: str) -> DataFrame:
    """Every row once for each pair of chunks that its own is part of: i and j (i <= j), own, and ``columns``."""
    rows = rows.withColumn("c", chunks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return rows.select(*columns, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own")


def _strongest(lists: DataFrame) -> DataFrame:
    """First merge: spanning forests of the strongest candidates of each list's chunks."""
    rows = _against(lists, F.ceil(F.col("freq") / CHUNK).cast("int"), "key", "node", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[bytes, bytes]] = set()
        for group in shared.runs(batches, 3):
            if group.num_rows > 1:
                nodes, n, sig = _arrays(group)
                counts = _candidates(sig, n)
                if group.column("i")[0] != group.column("j")[0]:
                    own = np.asarray(group.column("own"))
                    counts[own[:, None] == own[None, :]] = 0
                out.update((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])) for a, b in _forest(counts))
            if len(out) > 20_000:
                yield _pairs(list(out))
                out.clear()
        yield _pairs(list(out))

    dealt = rows.select("key", "i", "j", "own", "node", "n", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts[at] > 1
    place = (np.cumsum(counts > 1) - 1)[at[several]]
    owner = owner[several]
    out, width = np.zeros((n, n), np.float32), max(1, (1 << 22) // n)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    edges = np.searchsorted(place, np.arange(0, (int(place[-1]) if len(place) else -1) + width + 1, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        if edges[k] < edges[k + 1]:
            block = np.zeros((n, width), np.float32)
            block[owner[part], place[part] - k * width] = 1
            out += block @ block.T
    return out


def _within(families: DataFrame) -> DataFrame:
    """Second merge: links of families as spanning forests of pairs of chunks. The largest component's nodes (major) have cj chunks, the
    others cm; a major node meets the others' chunks only."""
    spot = F.xxhash64("node")
    own = F.when(F.col("major"), F.col("cm") + F.pmod(spot, F.col("cj"))).otherwise(F.pmod(spot, F.col("cm"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("major"), F.col("cm") - 1).otherwise(F.col("cm") + F.col("cj") - 1))
    rows = families.withColumn("own", own).withColumn("o", F.explode(others))
    rows = rows.select("family", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "root", "node", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[bytes, bytes]] = set()
        for group in shared.runs(batches, 3):
            roots = group.column("root").to_pylist()
            if len(set(roots)) > 1:
                nodes = group.column("node").to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in group.column("body").to_pylist()]
                both, n = _common(sets), np.array([len(x) for x in sets])
                linked = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
                np.fill_diagonal(linked, False)
                out.update((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])) for a, b in _forest(linked.astype(np.uint8)))
            if len(out) > 20_000:
                yield _pairs(list(out))
                out.clear()
        yield _pairs(list(out))

    dealt = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and body (its sorted 64-bit shingle hashes) of the wanted nodes (node, h), from a second reading of the texts. They meet on ``h``, which only
    equal rows share, so that neither null nor repeated ids multiply."""
    wanted = shared.staged(wanted, "candidates")
    texts = docs.select("t", F.col("h").alias("h2"))
    # The size is checked; without the hint Spark joins by a shuffle.
    found = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted, F.col("h") == F.col("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, "t"):
            nodes, bodies = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if len(s) and fingerprint(s) == node:  # else another row with the same hash
                    nodes.append(node)
                    bodies.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(bodies, pa.binary())], names=["node", "body"])

    # Rows of equal sets and ids meet first.
    return shared.staged(found.select("node", "t").mapInArrow(run, "node binary, body binary").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, "y"):
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= PERCENT * (len(x) + len(y) - common):
                    out.append((a, b))
            yield _pairs(out)

    left = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    both = left.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary")


def _undecided(candidates: DataFrame, roots: DataFrame, bodies: DataFrame) -> DataFrame:
    """family, node, root, major (in the largest component), cm, cj and body of families of three and more nodes with several components."""
    families = components.components(candidates, "a", "b").select("node", F.col("root").alias("family"))
    rows = shared.staged(families.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "families")
    sizes = rows.groupBy("family", "root").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most"), F.count("*").alias("c"), F.sum("n").alias("n")).where("c > 1 AND n > 2")
    pieces = lambda n: F.ceil(n / FAMILY_CHUNK).cast("int")
    facts = shared.staged(facts.select("family", "largest", pieces(F.col("n") - F.col("most")).alias("cm"), pieces(F.col("most")).alias("cj")), "families")
    rows = rows.join(facts, "family").select("family", "node", "root", (F.col("root") == F.col("largest")).alias("major"), "cm", "cj")
    return rows.join(bodies, "node")


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (d, h, t): their descriptions (d, h, n, node), and node with the root of its component and its smallest d."""
    described = shared.staged(_described(rows), "signatures")
    firsts = [F.first(c).alias(c) for c in ("n", "posted", "sig")]
    nodes = described.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("d").alias("d"), F.min("h").alias("h"), *firsts)
    nodes = shared.staged(nodes, "nodes")
    lists = shared.staged(_listed(nodes), "lists")
    candidates = shared.staged(_strongest(lists), "pairs")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bodies = _bodies(rows, wanted.join(nodes.select("node", "h"), "node"))
    links = shared.staged(_verified(candidates, bodies), "verified")
    roots = components.components(links, "a", "b")
    more = shared.staged(_within(_undecided(candidates, roots, bodies)), "verified")
    if not more.isEmpty():
        roots = components.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "d")
    return described.select("d", "h", "n", "node"), named


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.select("d", F.xxhash64("d", F.lit(0), "t").alias("h"), "t")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) and kept of every row."""
    described, named = _grouped(_rows(docs, id_col, text_col))
    smallest = named.groupBy("root").agg(F.min("d").alias("component_id"))
    named = named.join(smallest, "root").select("node", "component_id")
    out = described.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group of near duplicates: the one with the smallest id (null last),
    then the smallest hash of id and text. Rows are told apart by id and text, so repeated ids with other texts are rows of their own, and a
    row repeated whole stays once."""
    described, named = _grouped(_rows(docs, id_col, text_col))
    first = F.min(F.struct(F.col("d").isNull().alias("null"), "d", "h"))
    grouped = described.where(F.col("node").isNotNull()).join(named.select("node", "root"), "node").groupBy("root").agg(first.alias("f")).select(F.col("f.h").alias("h"))
    alone = described.where(F.col("node").isNull()).select("h").distinct()
    copies = described.groupBy("h").agg(F.count("*").alias("n"))
    # Most rows stay as they are: only those that go (n = 0) or were repeated whole meet their texts.
    marked = copies.join(grouped.union(alone).withColumn("stays", F.lit(True)), "h", "left")
    fates = shared.staged(marked.select("h", F.when(F.col("stays"), F.col("n")).otherwise(0).alias("n")).where("n <> 1"), "fates")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.lit(0), text).alias("h"))
    # The size is checked; without the hint Spark joins by a shuffle of the texts.
    rows = rows.join(F.broadcast(fates) if fates.count() <= BROADCAST_FATES else fates, "h", "left")
    once = rows.where("n > 1").groupBy("h").agg(F.first("row").alias("row"))
    return rows.where("n IS NULL").select("row.*").union(once.select("row.*"))
