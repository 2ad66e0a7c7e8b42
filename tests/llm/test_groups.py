"""Near duplicates, components, sharding and the pipeline against brute force."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import components, e8dedup, kkshard, minhash, quality, shared
from tests.llm.conftest import CASES


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    """rows: key, text. Smallest key of each component of Jaccard links."""
    g, sets = Groups(), {k: shingle_set(t) for k, t in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            g.join(a, b)
    return {k: (len(s), g.find(k)) for k, s in sets.items()}


def check_minhash(df):
    want = brute_components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == want


def test_minhash_on_the_corpus(corpus):
    check_minhash(corpus)


def test_minhash_chain_and_family(spark, monkeypatch):
    """Near copies whose similarity lies around the threshold, in chunks of few nodes: similarity is not transitive there."""
    monkeypatch.setattr(minhash, "CHUNK", 7)
    monkeypatch.setattr(minhash, "FAMILY_CHUNK", 5)
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in r.integers(0, 400, 80)]
    texts = []
    for k in range(40):
        copy = list(base)
        for at in r.integers(0, 80, 1 + k % 4):
            copy[at] = words[r.integers(0, 400)]
        texts.append(" ".join(copy))
    texts += [" ".join(base[: 40 + k]) for k in range(0, 40, 3)] + ["Short text", "short TEXT", "other"]
    check_minhash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_exact_intersections(monkeypatch):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 50, n).astype(np.uint64)) for n in (3, 30, 40, 1, 25)]
    got = minhash._common(sets)
    for i, j in itertools.combinations(range(5), 2):
        assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_minhash_cases(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(CASES)
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    assert all(x.component_id == 1 for i in (1, 2) for x in by[i]) and by[1][0].kept and not by[2][0].kept
    assert {(x.n_shingles, x.component_id, x.kept) for x in by[3] + by[4] + by[5]} == {(0, 3, True), (0, 4, True), (0, 5, True)}
    assert {(x.component_id, x.kept) for x in by[None]} == {(8, False), (None, True)}
    assert minhash.near_duplicates(empty).isEmpty()
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns and minhash.one_of_each(empty).isEmpty()
    texts = [t.text for t in kept.collect() if t.text and t.text.strip()]
    assert len(texts) == len(set(texts)) == len({t for _, t, _ in CASES if t and t.strip()})


def test_one_of_each_tells_rows_by_id_and_text(spark):
    a, b = "one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (None, ""), (None, "")], "doc_id long, text string")
    rows = {tuple(r) for r in minhash.one_of_each(docs).collect()}
    assert rows == {(1, a), (2, b), (None, "")} and minhash.one_of_each(docs).count() == 3


@pytest.mark.parametrize("most", [0, 1000])
def test_one_of_each_sends_no_texts(spark, monkeypatch, most):
    """The texts of rows that stay meet a table of those that go; only a large one is joined by a shuffle. Both give the same rows."""
    monkeypatch.setattr(minhash, "BROADCAST_FATES", most)
    monkeypatch.setattr(minhash, "BROADCAST_NODES", 1000)
    texts = [" ".join(f"w{i // 2}x{k}" for k in range(12)) for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (50, None)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash.one_of_each(docs)
        assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 40, 2), 50]
        plan = kept._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan) == (most == 0)


def test_many_rows_without_an_id(spark):
    """Null ids are no key: the work is linear in the rows."""
    docs = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat_ws(' ', 'w', id % 10000, id % 10000 + 1, 'x', id % 10000, 'y') AS text")
    rows = minhash.near_duplicates(docs)
    assert rows.count() == 20_000 and rows.where("NOT kept OR component_id IS NOT NULL").isEmpty()
    assert minhash.one_of_each(docs).count() == 10_000


def test_components_of_chains(spark):
    r = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(int(a), int(b)) for a, b in r.integers(200, 260, (40, 2))] + [(5, 5)]
    g = Groups()
    for a, b in edges:
        g.join(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: g.find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").isEmpty()


def check_vectors(df, least=0.98):
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    usable = [i for i, (_, label, v) in enumerate(rows) if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, g = dict.fromkeys(range(len(rows)), 0), Groups()
    scaled = {i: np.array(rows[i][2], np.float64) / np.abs(rows[i][2]).max() for i in usable}
    unit = {i: x / np.linalg.norm(x) for i, x in scaled.items()}
    for a, b in itertools.combinations(usable, 2):
        if rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
            links[a] += 1
            links[b] += 1
            g.join(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(g.find(i), []).append(rows[i][0])
    want = sorted((rows[i][0], links[i], min(members[g.find(i)])) for i in range(len(rows)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in e8dedup.near_duplicates(df).collect()) == want


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(e8dedup, "CHUNK", 8)
    r = np.random.default_rng(3)
    rows, centre = [], r.standard_normal((4, 64))
    for i in range(160):
        v = centre[i % 4] + r.standard_normal(64) * (0.12 if i % 3 else 1.0)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] + [1.0] * 63, 1), (2003, [None] + [1.0] * 63, 1), (2004, rows[0][1], None), (2005, [1.0, 2.0], 0), (2006, [1.0, 2.0], 0), (2007, [], 0), (2008, [float("inf")] * 64, 0), (2009, [1e300] * 64, 0), (2010, [1e-300] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("size", F.lit(1)).withColumn("cell", F.lit("x")).repartition(3)
    check_vectors(df)
    assert e8dedup.near_duplicates(df.where("false")).isEmpty()


def test_vectors_of_the_corpus(spark):
    check_vectors(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))


def test_e8_decoding():
    """The decoder finds the nearest of all lattice points around."""
    steps = e8dedup.minimal_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    r = np.random.default_rng(1)
    x = r.uniform(-3, 3, (300, 8))
    point = e8dedup.nearest_e8(x)
    assert (np.isclose(point, np.rint(point)).all(axis=1) | np.isclose(point - 0.5, np.rint(point - 0.5)).all(axis=1)).all()
    assert np.allclose(point.sum(axis=1) % 2, 0)
    here = ((x - point) ** 2).sum(axis=1)
    for s in steps:
        assert (here <= ((x - point - s) ** 2).sum(axis=1) + 1e-9).all()


def test_differencing():
    r = np.random.default_rng(9)
    sizes = [int(x) for x in r.integers(1, 1000, 200)]
    bins = kkshard.difference([(s, 0, 0, 0) for s in sizes], 4)
    sums = [0] * 4
    for s, b in zip(sizes, bins, strict=True):
        assert sorted(b) == [0, 1, 2, 3]
        sums[b[0]] += s
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 2
    assert kkshard.difference([], 3) == [] and sorted(kkshard.difference([(5, 1)], 2)[0]) == [0, 1]


def check_shards(df, **options):
    rows = kkshard.shard_by_bytes(df, 8, **options).collect()
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=key) == sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts), key=key)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    homes = {}
    for r in rows:
        assert homes.setdefault((r.text_crc32, r.size), r.shard) == r.shard and 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
    return [sum(r.size for r in s) for s in shards.values()]


def test_shards(docs, empty, corpus):
    check_shards(docs)
    sums = check_shards(corpus)
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.01 * sum(sums) / 8
    sums = check_shards(corpus, chunk=7)  # many partial partitions
    assert max(sums) - min(sums) <= 0.02 * sum(sums) / 8
    assert kkshard.shard_by_bytes(empty).isEmpty()


def test_pipeline(spark, docs, corpus):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "packing"]
    for table in (docs, corpus):
        kept = [table]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept.append(shared.staged(stage(spark, kept[-1], None), f"test-{name}"))
            assert kept[-1].columns == table.columns
        texts = [[r.text for r in k.select("text").collect()] for k in kept]
        assert all(t and any(c.isalpha() for c in t) for t in texts[1])
        verdict = {t: quality.measure(t) for t in texts[1]}
        assert sorted(texts[2]) == sorted(t for t in texts[1] if verdict[t][0] >= 50 and 100 * verdict[t][5] <= 50 * verdict[t][0] and t in set(texts[2]))
        rows = {r.doc_id: r.text for r in kept[2].collect()}
        want = {c for _, c in brute_components(rows.items()).values()}
        assert {r.doc_id for r in kept[3].collect()} == want
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept[3], None)
        assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == want
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() >= 1


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_take_an_empty_table(spark, empty, stage):
    import corpus_pipeline

    assert corpus_pipeline.STAGES[stage][1](spark, empty, None).isEmpty()
