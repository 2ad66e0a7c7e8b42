"""The engine's mechanisms by brute force: ranks, co-occurrence, factors, target ranks, pruned requests, metrics, page attributes."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import pages
from tessitura.operators import classify, embeddings, language_model, ngrams
from tessitura.operators import similarity as sim
from tessitura.plans import catalogue, store
from tessitura.plans.ranking import placed
from tessitura.sources import tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def corpus(spark):
    return store.opened(spark, DATA)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def files_read(df):
    """Files that each scan of a collected frame without shuffles has read."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    if plan.nodeName() == "ResultQueryStage":
        plan = plan.plan()
    leaves = plan.collectLeaves()
    metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return [m.apply("numFiles").value() for m in metrics if m.contains("numFiles")]


@pytest.mark.parametrize("group", [(), ("g",)])
def test_places(spark, group):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randrange(30), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(7)
    got = {x.id: x.place for x in placed(df, [F.desc("v"), F.asc("id")], group).collect()}
    want, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda x: (-x[1], x[2])):
        key = g if group else 0
        want[i] = seen[key] = seen.get(key, 0) + 1
    assert got == want
    assert placed(df.where("false"), [F.asc("id")], group).isEmpty()


@pytest.mark.parametrize("name", ["agg_freq_table_exact", "agg_freq_table_harmonic", "win_rank_within_n", "win_pandas_rank", "win_dense_feature_id", "compact_index", "agg_vocab_finalize", "win_sum_partition"])
def test_no_rank_gathers_a_whole_length(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, DATA))
    assert "SinglePartition" not in plan and "Window [" not in plan


def test_packed_windows_spell_their_text(spark):
    """Any number of unreadable tokens, songs of all lengths, packed and read back."""
    tokens = ["C", "F#min", "G/H", "Bb7", "zz", "Amin"]
    r = random.Random(2)
    songs = [(i, [r.choice(tokens) for _ in range(i % 12)]) for i in range(40)]
    df = spark.createDataFrame(songs, "song_id long, tokens array<string>")
    words = ngrams.dictionary_of(df)
    coded = ngrams.packed(ngrams.token_rows(df, words))
    errors = {w.token: w.error for w in words.collect()}
    got = {(x.song_id, x.n, x.pos): (x.ngram, x.hkey is None, x.error) for x in ngrams.windows(coded, ngrams.Words(words), ngrams.NS).collect()}
    want = {}
    for song, ts in songs:
        for n in ngrams.NS:
            for p in range(len(ts) - n + 1):
                bad = [errors[t] for t in ts[p : p + n] if errors[t]]
                want[song, n, p] = " ".join(ts[p : p + n]), bool(bad), bad[0] if bad else None
    assert got == want and any(b for _, b, _ in got.values()) and not all(b for _, b, _ in got.values())


def test_windows_need_no_shuffle(corpus):
    assert "Exchange" not in plan_of(ngrams.spread(corpus.table("packed_songs"), ngrams.NS, ngrams.words_of(corpus)))


def test_pairs_by_brute_force(spark):
    r = random.Random(3)
    rows = [(n, [r.randrange(20) for _ in range(k)]) for n in (3, 8) for k in (0, 1, 2, 5, 60)]
    got = {(x.kind, x.n, x.i, x.j): x.c for x in embeddings.count_pairs(spark.createDataFrame(rows, "n int, states array<int>").repartition(3)).collect()}
    want = {}
    for n, s in rows:
        for p, a in enumerate(s):
            for q, b in enumerate(s):
                if p != q and abs(p - q) <= embeddings.RADIUS:
                    want["local", n, a, b] = want.get(("local", n, a, b), 0) + 1
        for a in set(s):
            for b in set(s) - {a}:
                want["song", n, a, b] = want.get(("song", n, a, b), 0) + 1
    assert got == want


def test_cooccurrence_joins_no_song_with_itself(spark):
    for name in ("agg_cooccurrence", "join_band_positions", "ppmi"):
        joins = [x for x in plan_of(catalogue.queries()[name](spark, DATA)).splitlines() if "Join" in x]
        assert not any("song_id" in x for x in joins), name


def test_factors_are_a_truncated_svd(corpus):
    n = 5
    rows = corpus.sql(f"SELECT i, j, v FROM ppmi WHERE kind = 'local' AND n = {n}").collect()
    names = sorted({r.i for r in rows} | {r.j for r in rows})
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names.index(r.i), names.index(r.j)] = r.v
    u, s, vt = np.linalg.svd(m)
    got = {r.hkey: r.vector for r in corpus.table("factors").where(f"n = {n}").collect()}
    v = np.array([got[x] for x in names])
    k = embeddings.DIM
    assert np.allclose(v @ v.T, u[:, :k] * s[:k] @ u[:, :k].T, atol=1e-6)  # alpha is a half, signs cancel
    near = embeddings.distributional_neighbors(corpus.table("factors").where(f"n = {n}")).where(f"hkey = '{names[0]}'").orderBy(F.desc("cosine"), "neighbor").collect()
    c = np.round(v @ v[0] / np.maximum(np.linalg.norm(v, axis=1) * np.linalg.norm(v[0]), 1e-300), 9)
    want = sorted(((-c[i], x) for i, x in enumerate(names) if i), key=lambda z: z)[:10]
    assert [x.neighbor for x in near] == [x for _, x in want]


def test_split_sources_score_alike(corpus):
    tables = [corpus.table(x) for x in ("lm_events", "transition_counts", "states", "unigrams")]
    parted = language_model.score_targets(*tables, source_events=3)
    assert parted.exceptAll(corpus.table("lm_scored")).isEmpty() and parted.count() == corpus.table("lm_scored").count()
    plan = plan_of(parted)
    assert "NullAware" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("sql", [sim.similar_exact(1, sim.W), sim.similar_fast(1, sim.W, min_shared=2, max_df_rate=0.2), sim.compare_n(1, ngrams.NS)])
def test_requests_read_their_folders_only(corpus, sql):
    df = corpus.sql(sql)
    df.collect()
    plan = plan_of(df)
    assert "dynamicpruning" in plan and " tfidf[" not in plan
    song = corpus.sql(f"SELECT * FROM {sim._Spark.song(1)} x")
    assert {r.song_id for r in song.collect()} == {1}
    total = len(corpus.table("tfidf_by_song").inputFiles())
    read = files_read(song)
    assert total > 40 and read and all(x < total / 4 for x in read)


def test_metrics_of_the_models_predictions(corpus):
    rows = corpus.table("ml_predictions").toPandas()
    con = duckdb.connect()
    con.register("ml_predictions", rows)
    for sql in (classify.metrics_sql("ml_predictions"), classify.confusion_sql("ml_predictions")):
        got = corpus.sql(sql)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, con.execute(sql).df()[got.columns].itertuples(index=False)))
    labels = sorted(set(rows.label) | set(rows.predicted))
    f1 = [2 * ((rows.label == x) & (rows.predicted == x)).sum() / ((rows.label == x).sum() + (rows.predicted == x).sum()) for x in labels]
    m = corpus.sql(classify.metrics_sql("ml_predictions")).first()
    assert abs(m.macro_f1 - np.mean(f1)) < 1e-6 and abs(m.accuracy - (rows.label == rows.predicted).mean()) < 1e-6
    assert abs(m.mae_decades - ((rows.decade - rows.predicted_decade).abs() / 10).mean()) < 1e-6
    assert "ArrowEvalPython" not in plan_of(corpus.table("ml_vectors")) and "BatchEvalPython" not in plan_of(corpus.table("ml_vectors"))
    most = corpus.sql("SELECT max(c) AS c FROM (SELECT count(*) AS c FROM ml_split GROUP BY label) x").first().c
    assert most <= classify.PER_CLASS


PAGES = [
    ('<meta name="description" content="Plain">', "Plain"),
    ("<META CONTENT='First &amp; last' NAME='Description'/>", "First & last"),
    ('<meta content="a > b" data-x="1" name="description">', "a > b"),
    ("<meta name=description content=bare>", "bare"),
    ('<meta name="description" content="  ">\n<meta name="description" content=" &#233;&#x1F600;&eacute; ">', "é😀é"),
    ('<meta name="descriptions" content="no"><meta property="description" content="no">', None),
    ('<metadata name="description" content="no">', None),
    ('<meta name="description" content="&unknown; &amp;lt;">', "&unknown; &lt;"),
    ("<meta " + "x" * 100_000, None),
    ("", None),
    (None, None),
]


def test_meta_of_pages(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, html string")
    got = {r.i: r.d for r in df.select("i", pages.html_meta("html", "name", "description").alias("d")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAGES)}


def test_presets_are_fixed():
    assert sim.PRESETS["rare"] == {3: 0.4, 4: 0.7, 5: 1.2, 6: 2.0, 7: 3.2, 8: 4.0} and set(sim.PRESETS["long"]) == {6, 7, 8} and sim.PRESETS["balanced"][4] == 1.33


def test_versioned_tables(spark, tmp_path):
    root = tables.Root(spark, str(tmp_path / "a"))
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v int, t string")
    assert root.tables() == [] and root.batches("x") == []
    with pytest.raises(KeyError):
        root.read("x")
    assert root.append("x", rows((1, 1, "a"), (2, 1, "a")), "b1") == 1
    assert root.append("x", rows((3, 1, "b")), "b2") == 2
    assert root.append("x", rows((3, 1, "c"), (4, 1, "c")), "b2") == 2  # a retried batch
    assert {tuple(r) for r in root.read("x").collect()} == {(1, 1, "a"), (2, 1, "a"), (3, 1, "c"), (4, 1, "c")}
    assert root.merge("x", rows((1, 0, "older"), (2, 1, "tie"), (9, 5, "new")), "k", "v") == 3
    assert {tuple(r) for r in root.read("x").collect()} == {(1, 1, "a"), (2, 1, "tie"), (3, 1, "c"), (4, 1, "c"), (9, 5, "new")}
    assert root.read("x", 1).count() == 2 and root.versions("x") == [1, 2, 3]
    (tmp_path / "a/x/manifest/00000004").mkdir()  # a commit that was lost half way
    assert root.versions("x") == [1, 2, 3] and root.read("x").count() == 5
    other = tables.Root(spark, str(tmp_path / "b"))
    other.append("y", rows((1, 1, "z")), "only")
    assert tables.attach(spark, str(tmp_path / "b"), "second") == {"y": "second_y"}
    assert spark.table("second_y").join(root.read("x"), "k").count() == 1
    with pytest.raises(PermissionError):
        tables.Root(spark, str(tmp_path / "b"), read_only=True).append("y", rows(), "more")


def test_search_reads_the_folders_of_its_grams(corpus):
    df = sim.search_songs(corpus, "example.org")
    assert df.count() > 0 and "PartitionFilters: [isnotnull(gb" in plan_of(df).replace("gb#", "gb") or "PartitionFilters: [gb" in plan_of(df)
    assert sim.search_songs(corpus, "t1").first().track_id is not None
    first = corpus.sql("SELECT song_id FROM search_summary WHERE indexed_features > 0 ORDER BY song_id LIMIT 1").first().song_id
    assert sim.search_songs(corpus, str(first)).first().song_id == first
    long = "a" * 22
    assert sim.search_songs(corpus, f"https://x.example/track/{long}").isEmpty()
