"""Counts from one shuffle by brute force, and what large corpora keep and send."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.operators import counting, embeddings, ngrams, similarity
from tessitura.plans import catalogue, store

DATA = "/root/testdata/sf0.001"
TABLES = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NS = ngrams.NS


def _songs(few: bool):
    """Songs of all lengths with unreadable tokens, copies and a null id; with ``few`` tokens n-grams fit in one lane."""
    r = random.Random(4)
    names = ["C", "F#min", "G/H", "Bb7", "zz", "Amin"] if few else ["G/H", *(f"{a}{b}{c}{d}" for a in "CDEFGAB" for b in ("", "#", "b") for c in ("", "min", "7", "maj7") for d in ("", "/C", "/D"))]
    rows = [(i, [r.choice(names) for _ in range(i % 14)]) for i in range(60)]
    return [*rows, *((i + 100, t) for i, t in rows[10:30]), (None, rows[13][1]), (90, None)]


@pytest.mark.parametrize("few", [True, False])
def test_counts_by_brute_force(spark, few):
    rows = _songs(few)
    df = spark.createDataFrame(rows, "song_id long, tokens array<string>").repartition(5)
    words = ngrams.Words(ngrams.dictionary_of(df))
    songs = counting.coded(df, words.names).persist()
    assert words.codec.lanes == (1 if few else 2) and not words.readable
    key = {(x.song_id, x.n, x.pos): (x.ngram, x.hkey) for x in ngrams.windows(ngrams.packed(ngrams.token_rows(df, ngrams.dictionary_of(df))), words, NS).collect()}
    grams = Counter((n, *v) for (_, n, _), v in key.items())
    made = lambda o=None: counting.Counts(songs, words.codec, 3_000_000, NS, o)
    hkey = ngrams.hex_key(F.col("n")).alias("hkey")
    assert {(x.n, x.ngram, x.hkey): x.cnt for x in made().grams().select("n", words.text().alias("ngram"), hkey, "cnt").collect()} == grams
    want: dict = {}
    for (n, text, k), c in grams.items():
        if k:
            want.setdefault((n, k), []).append((-c, text))
    got = {(x.n, x.hkey): (x.cnt, x.n_exact, x.example, x.least) for x in made().classes().select("n", hkey, "cnt", "n_exact", words.text("b").alias("example"), words.text("l").alias("least")).collect()}
    assert got == {k: (-sum(c for c, _ in v), len(v), min(v)[1], min(t for _, t in v)) for k, v in want.items()}
    terms = Counter((s, n, k) for (s, n, _), (_, k) in key.items() if k and got[n, k][0] >= 5)
    dfs = Counter((n, k) for _, n, k in terms)
    found = made("song_id").terms(5).select("o", "n", hkey, "cnt", "df").collect()
    assert {(x.o, x.n, x.hkey): (x.cnt, x.df) for x in found} == {(s, n, k): (c, dfs[n, k]) for (s, n, k), c in terms.items()} and len(found) == len(terms)
    for x in made("song_id").totals(5).collect():
        for n in NS:
            mine = [c for (s, m, _), c in terms.items() if s == x.o and m == n]
            assert (x[f"u{n}"], x[f"i{n}"]) == (len(mine), sum(mine))
    for x in made().summary().collect():
        of = {k: c for k, c in grams.items() if k[0] == x.n}
        assert (x.windows, x.grams, x["read"], x.classes) == (sum(of.values()), len(of), sum(c for k, c in of.items() if k[2]), len({k[2] for k in of} - {None}))
    assert made().collisions().isEmpty()
    for harmonic in (False, True):
        text = hkey if harmonic else words.text().alias("x")
        mine = Counter()
        for x in counting.local_terms(songs, words.codec, 5, harmonic).withColumn("n", F.lit(5)).select("o", text, "cnt").collect():
            mine[x.o, x[1]] += x.cnt
        assert mine == Counter((s, v[harmonic]) for (s, n, _), v in key.items() if n == 5 and v[harmonic])


def test_equal_n_grams_of_two_classes_are_found():
    """The check of the vocabulary compares the rows' own classes."""
    import pyarrow as pa

    codec = counting.Codec([0, 7], [145, 2180])
    lanes = codec.packed([np.array(x) for x in ([1, 1, 2], [2, 2, 2], [1, 1, 1], [0, 1, 0])])
    part = counting._Part(iter([pa.record_batch([pa.array(x) for x in (np.zeros(3, np.int64), *lanes, np.ones(3, np.int64))], names=["o", "w0", "c"])]), codec, 8)
    assert not list(counting.collided(part, (3,)))[0][1].size
    part.masks[2] = part.masks[2] + np.arange(3)
    (n, rows, keys), = counting.collided(part, (3,))
    assert n == 3 and len(rows) == 1 and keys.tolist() == [2]


LARGE = """agg_any_value agg_artist_profile agg_count_distinct agg_parse_errors agg_run_summary agg_song_terms agg_validation_collision filter_between filter_in_subquery join_cross_scalar join_filtered_on math
set_intersect_diff representative_split ml_harmonic_matrix agg_song_totals""".split()


@TABLES
@pytest.mark.parametrize("name", LARGE)
def test_large_corpora_keep_no_row_a_window(spark, monkeypatch, name):
    """As in a large corpus: tables with a row a window are not files, and the results are those of a small one."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    query = catalogue.queries()[name]
    monkeypatch.setattr(store, "_STORES", {})
    large = query(spark, DATA)
    (used,) = store._STORES.values()
    files = {t for t in used.kept if os.path.isdir(f"{used.folder.removeprefix('file:')}/{t}")}
    assert not files & {"tokens", "dirty_tokens", "grams", "exact", "harm", "terms", "supported"}
    monkeypatch.undo()
    small = query(spark, DATA)
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()


@TABLES
@pytest.mark.parametrize("name", ["math", "agg_any_value", "agg_song_terms", "progression_family"])
def test_vocabularies_take_one_shuffle(spark, monkeypatch, name):
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(store, "_STORES", {})
    df = catalogue.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Join" not in plan


REQUESTS = "similar_exact similar_exact_filtered similar_fast presets similar_by_n compare_n compare_n_fast explain_features explain_by_n explain_unique agg_norms search_songs".split()


@TABLES
@pytest.mark.parametrize("name", REQUESTS)
def test_requests_of_large_corpora_build_no_index(spark, monkeypatch, name):
    """Neither the index nor terms are files, and the results are those of the index."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    query = catalogue.queries()[name]
    monkeypatch.setattr(store, "_STORES", {})
    large = query(spark, DATA).persist()
    large.count()
    (used,) = store._STORES.values()
    files = set(os.listdir(used.folder.removeprefix("file:")))
    assert not files & {"tfidf", "dfs", "tfidf_by_song", "tfidf_by_feature", "terms", "harm", "exact"}
    monkeypatch.undo()
    small = query(spark, DATA)
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()


def test_requests_with_repeated_and_missing_ids(spark, monkeypatch):
    """Songs that share an id are one song, as in the index."""
    r = random.Random(5)
    rows = [(i % 40 if i < 90 else None, [r.choice(["C", "F#min", "G/H", "Bb7"]) for _ in range(i % 19)]) for i in range(95)]
    songs = spark.createDataFrame(rows, "song_id long, tokens array<string>").repartition(5)
    small = store.Store(spark, songs=songs)
    want = small.sql("SELECT song_id, n, hkey, cnt, round(idf, 9) AS idf FROM tfidf WHERE (n, hkey) IN (SELECT n, hkey FROM tfidf WHERE song_id = 7)")
    got = similarity.met_terms(store.Store(spark, songs=songs), 7).select("song_id", "n", "hkey", "cnt", F.round("idf", 9).alias("idf"))
    assert {(x.song_id, x.n, x.hkey): x.cnt for x in got.collect()} == {(x.song_id, x.n, x.hkey): x.cnt for x in want.collect()}
    assert got.count() == want.select("song_id", "n", "hkey").distinct().count() > 50


def test_nearest_vectors_by_brute_force(spark, monkeypatch):
    """Several blocks of queries and chunks of rows; ties, zero vectors, nulls, holes, NaN and another width."""
    r = np.random.default_rng(5)
    v = [[float(x) for x in row] for row in r.integers(-2, 3, (400, 4))]
    v[7], v[8], v[9], v[50], v[100], v[11] = [0.0] * 4, None, [1.0, None, 0.0, 0.0], None, [0.0] * 4, [float("nan"), 1.0, 0.0, 0.0]
    v[12] = [1.0, 2.0]
    monkeypatch.setattr(embeddings, "CHUNK", 64)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 100)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(None, v[0])], "vec_id long, embedding array<double>").repartition(3)
    found = embeddings.nearest_of(df, df.where("vec_id % 50 = 0"))
    got = {(x.query, x.neighbor): x.cosine for x in found.collect()}
    assert len(got) == 80

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return None
        with np.errstate(all="ignore"):
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            return 0.0 if norm == 0 else round(float(np.dot(a, b) / norm), 6)

    for q in range(0, 400, 50):
        all_ = [(c := cosine(v[q], v[i]), i) for i in range(400) if i != q]
        rank = lambda c: 2 if c is None else -9 if c != c else -c
        want = sorted(all_, key=lambda x: (rank(x[0]), x[1]))[:10]
        assert {i for _, i in want} == {i for a, i in got if a == q}
        for c, i in want:
            assert (got[q, i] is None) == (c is None) and (c is None or np.isnan(c) == np.isnan(got[q, i])) and (not c or c != c or abs(got[q, i] - c) < 1e-9)


@TABLES
@pytest.mark.parametrize("name", ["agg_vocab_finalize", "exact_ngram_id", "filter_regex_ci", "win_nulls_last", "agg_any_value", "agg_song_totals", "agg_norms", "agg_song_terms", "agg_validation_collision"])
def test_frequent_classes_are_counted_in_parts(spark, monkeypatch, name):
    """a bucket of more rows than are held at once is read in shares; no task holds it whole, and the results are the same."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(store, "_STORES", {})
    query = catalogue.queries()[name]
    want = query(spark, DATA).persist()
    want.count()
    monkeypatch.setattr(store, "_STORES", {})
    monkeypatch.setattr(counting, "PART_ROWS", 300)
    got = query(spark, DATA)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("few", [True, False])
def test_parts_hold_few_rows(spark, few):
    """Of a bucket that holds everything: parts stay small, and each n-gram and class of a length is in one of them."""
    df = spark.createDataFrame(_songs(few), "song_id long, tokens array<string>")
    words = ngrams.Words(ngrams.dictionary_of(df))
    rows = counting.dealt(counting.coded(df, words.names), words.codec, 1, 1, "song_id").toArrow().select(["bucket", "block"]).to_batches()
    whole = dict(counting._parts(iter(rows), words.codec, 8, NS, 1 << 30))
    (part,) = whole
    size = len(part.count)
    grams, classes, n_parts = Counter(), Counter(), 0
    for some, ns in counting._parts(iter(rows), words.codec, 8, NS, 40):
        n_parts += 1
        assert 3 in ns or len(some.count) < size / 2
        for n, of_gram, _ in some.lengths(ns):
            first, count = some.grams(n, of_gram)
            grams.update({(n, *(int(some.codes[i][r]) for i in range(n))): int(c) for r, c in zip(first, count)})
            classes.update({(n, *(int(x) for x in k)) for k in zip(*some.key(first[some.read[first] >= n], n))})
    want = Counter()
    for n, of_gram, _ in part.lengths(NS):
        first, count = part.grams(n, of_gram)
        want.update({(n, *(int(part.codes[i][r]) for i in range(n))): int(c) for r, c in zip(first, count)})
    assert grams == want and n_parts > 10 and set(classes.values()) == {1}


FORMER = {
    "agg_vocab_finalize": "SELECT n, ngram, cnt, round(cnt / sum(cnt) OVER (PARTITION BY n), 10) AS frequency FROM exact",
    "filter_regex_ci": "SELECT n, ngram, cnt FROM exact WHERE ngram RLIKE '(?i)amin.*g7'",
    "win_nulls_last": "SELECT n, ngram, cnt FROM (SELECT n, ngram, cnt, row_number() OVER (PARTITION BY n ORDER BY nullif(cnt, 2) DESC NULLS LAST, ngram) AS r FROM exact) x WHERE r <= 20",
    "exact_ngram_id": "SELECT ngram, concat(size(split(ngram, ' ')), '_', substr(sha1(to_json(split(ngram, ' '))), 1, 16)) AS exact_ngram_id FROM exact",
}


@TABLES
@pytest.mark.parametrize("name", list(FORMER))
def test_rows_are_finished_where_they_are_counted(spark, monkeypatch, name):
    """No row is rounded, split, sorted or matched that the counting task could settle by codes or counts."""
    monkeypatch.setattr(store, "_STORES", {})
    df = catalogue.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("round(", "split(", "Join", "concat_ws") if x in plan]
    want = store.opened(spark, DATA).sql(FORMER[name])
    assert df.exceptAll(want).isEmpty() and want.exceptAll(df).isEmpty()


def test_few_rows_leave_a_bucket():
    """the first of a length by count and text; n-grams that hold two texts in order, or a token that holds both."""
    count = np.array([2, 5, 1, 5, 2, 1, 3])
    assert counting.first_by_count(3, last=2)(3, [], count).tolist() == [1, 3, 6]
    assert counting.first_by_count(4, last=2)(3, [], count).tolist() == [1, 2, 3, 6]
    assert counting.first_by_count(9, last=2)(3, [], count).tolist() == list(range(7))
    keep = counting.with_in_order(["AMIN", "xG7", "aming7", "G7amin"], "amin", "g7")
    codes = [np.array(x) for x in ([1, 2, 3, 4, 1, 4], [2, 1, 4, 1, 1, 4], [0, 0, 0, 2, 4, 1])]
    assert keep(3, codes, np.ones(6)).tolist() == [0, 2, 3, 4, 5]


def test_shares_round_as_spark_does(spark):
    rows = [(int(c), int(t)) for c, t in np.random.default_rng(3).integers(1, 10**10, (400, 2))] + [(1, 2**35), (5, 10**11), (15, 10**11), (1, 8), (0, 3)]
    found = spark.createDataFrame(rows, "c long, t long").select(F.round(F.col("c") / F.col("t"), 10)).collect()
    assert [x[0] for x in found] == [float(counting.shares(np.array([c]), t)[0]) for c, t in rows]


def test_words_of_texts_become_chords(spark):
    """words are hashed once a batch; white space as the expression has it, nulls and empty texts have none."""
    import hashlib
    import re

    from tessitura.sources import songs

    texts = [None, "", " \t\n", "  a b\x0bb\x0cc \r\n a", "\x01 \x85\u00e9 \x1c\x1d k\u00a0m", "one"]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    for dirty in (False, True):
        alphabet = [*songs.ALPHABET[:-1], songs.UNREADABLE] if dirty else songs.ALPHABET
        want = {i: [alphabet[hashlib.md5(w.encode()).digest()[0] % 24] for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w] for i, t in enumerate(texts)}
        df = songs.songs_from_documents(docs, dirty)
        assert {x.song_id: x.tokens for x in df.collect()} == want
        assert "md5" not in df._jdf.queryExecution().optimizedPlan().toString()


def _files(spark) -> dict[str, int]:
    """The session's shuffle files and their bytes."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {x: os.path.getsize(os.path.join(d, x)) for top in folders for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_") and x.endswith(".data")}


@TABLES
def test_sums_by_song_leave_no_shuffle(spark, monkeypatch):
    """the windows of large corpora are shuffled in rounds of disjoint classes, and a round's files go before the next."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    large = store.Store(spark, DATA)
    sizes = []
    keep = store.Store.keep
    before = _files(spark)

    def kept(self, name, df):
        out = keep(self, name, df)
        sizes.append((name, sum(size for x, size in _files(spark).items() if x not in before)))
        return out

    monkeypatch.setattr(store.Store, "keep", kept)
    got = large.table("totals")
    assert [x for x, _ in sizes if x.startswith("totals_")] == [f"totals_{k}" for k in range(ngrams.ROUNDS)]
    assert all(left < 2000 for name, left in sizes if name.startswith("totals"))  # small ones of the store's own questions
    rounds = [ngrams.counts_of(large, turn=(k, 3)).grams().groupBy("n").agg(F.sum("cnt").alias("c")).collect() for k in range(3)]
    whole = {x.n: x.c for x in ngrams.counts_of(large).grams().groupBy("n").agg(F.sum("cnt").alias("c")).collect()}
    assert all(len(r) for r in rounds) and {n: sum(x.c for r in rounds for x in r if x.n == n) for n in whole} == whole
    monkeypatch.undo()
    want = store.Store(spark, DATA).table("totals")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@TABLES
@pytest.mark.parametrize("name", "matrix_key matrix_from_key canonical_transposition_key harmonic_id short_label first_root_normalized_key".split())
def test_texts_of_classes_are_made_where_they_are_counted(spark, monkeypatch, name):
    """No expression splits or turns text a row, in small corpora and in large ones."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(store, "_STORES", {})
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("transform(", "array_min", "conv(", "lambda", "concat_ws"))


def test_forms_of_classes(spark):
    """keys, their least turns and columns against the expressions of the chord language."""
    from tessitura.functions import chords

    r = np.random.default_rng(7)
    for n in (1, 3, 8):
        masks = r.integers(0, 4096, (n, 50))
        masks[:, 0], masks[:, 1] = 4095, 0
        df = spark.createDataFrame([(int(k), [int(x) for x in m]) for k, m in enumerate(masks.T)], "k int, m array<int>")
        key = chords.matrix_key("m")
        read = chords.matrix_from_key(key)
        want = [x[1:] for x in df.select("k", key, chords.canonical_transposition_key("m"), F.get(read, F.lit(0)), F.get(read, F.lit(min(2, n - 1)))).orderBy("k").collect()]
        text = counting.key_text(counting.bit_rows(list(masks)), n)
        got = counting.formed(n, list(masks), ("harmonic_key", "canonical", "first"))
        assert list(zip(*(x.tolist() if isinstance(x, np.ndarray) else x.to_pylist() for x in (*got, counting._column(text, n, min(2, n - 1)))))) == want


DOCUMENTS = "agg_entropy agg_gini agg_top_share genre_diversity_ranked decade_diversity agg_diversity_summary agg_term_stats doc_tfidf doc_tfidf_top enrichment enrichment_top decade_vector_distance join_outer_vector_diff".split()


@TABLES
def test_documents_of_large_corpora_join_no_terms(spark, monkeypatch):
    """Documents are counted with the classes; terms of songs are neither made nor joined."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(store, "_STORES", {})
    large = {name: catalogue.queries()[name](spark, DATA).persist() for name in DOCUMENTS}
    assert all(df.count() for df in large.values())
    (used,) = store._STORES.values()
    assert not set(used.kept) & {"terms", "harm", "song_windows"}
    monkeypatch.undo()
    for name, df in large.items():
        small = catalogue.queries()[name](spark, DATA)
        assert df.exceptAll(small).isEmpty() and small.exceptAll(df).isEmpty() and df.dtypes == small.dtypes, name


def test_documents_of_odd_songs(spark, monkeypatch):
    """Songs without an id, genre or decade, decades before 1950 and tokens that cannot be read, by both ways."""
    r = random.Random(8)
    rows = [(i if i % 30 else None if i == 30 else -1 - i, r.choice(["a", "b", None]), r.choice([1940, 1950, 1960, None]), [r.choice(["C", "F#min", "G/H", "Bb7"]) for _ in range(i % 23)]) for i in range(150)]
    songs = spark.createDataFrame(rows, "song_id long, main_genre string, decade int, tokens array<string>").repartition(5)
    want = store.Store(spark, songs=songs).table("docterms")
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    got = store.Store(spark, songs=songs).table("docterms").select(want.columns)
    assert want.count() > 30 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@TABLES
@pytest.mark.parametrize("name, most", [("song_tfidf", 1), ("join_self_feature", 3), ("join_map_lookup", 1), ("win_lead_transition", 0), ("compact_index", 2)])
def test_rows_a_window_are_not_joined_by_shuffles(spark, monkeypatch, name, most):
    """No index, term or window is written, windows are shuffled once at most, and the results are those of a small corpus."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(store, "_STORES", {})
    large = catalogue.queries()[name](spark, DATA)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Window [") <= most and "posexplode" not in plan and "inline(" not in plan
    large = large.persist()
    large.count()
    (used,) = store._STORES.values()
    assert not set(os.listdir(used.folder.removeprefix("file:"))) & {"tfidf", "dfs", "terms", "supported", "harm"}
    monkeypatch.undo()
    small = catalogue.queries()[name](spark, DATA)
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty() and large.dtypes == small.dtypes


@pytest.mark.parametrize("most", [600_000, 40])
def test_index_of_odd_songs(spark, monkeypatch, most):
    """A song without an id, empty songs and tokens that cannot be read, whole and in small parts."""
    r = random.Random(9)
    rows = [(i if i != 30 else None, [r.choice(["C", "F#min", "G/H", "Bb7"]) for _ in range(i % 23)]) for i in range(120)]
    songs = spark.createDataFrame(rows, "song_id long, tokens array<string>").repartition(5)
    own = store.Store(spark, songs=songs)
    from tessitura.operators import relational

    builds = {"tfidf": lambda s: s.table("tfidf"), "compact": similarity.compact_index, "lookup": relational.join_map_lookup, "lead": lambda s: relational.win_lead_transition(s)}
    want = {k: f(own).persist() for k, f in builds.items()}
    want["lead"] = own.sql(relational._LEAD)
    assert all(df.count() > 100 for df in want.values())
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(counting, "PART_ROWS", most)
    large = store.Store(spark, songs=songs)
    for k, f in builds.items():
        got = f(large).select(want[k].columns)
        assert got.exceptAll(want[k]).isEmpty() and want[k].exceptAll(got).isEmpty(), k


@TABLES
def test_models_take_every_labelled_song(spark, monkeypatch):
    """a class's songs are not cut, neither for the fit nor for the predictions; the vectors are those of the split where it cuts nothing."""
    from tessitura.operators import classify

    own = store.Store(spark, DATA)
    whole = own.sql("SELECT song_id, feature, round(w, 9) AS w FROM harmonic_tfidf")
    names = {r.i: r.hkey for r in own.table("ml_features").collect()}
    got = {(r.song_id, names[int(i)], round(float(w), 9)) for r in own.table("ml_vectors").collect() for i, w in zip(r.features.indices, r.features.values)}
    assert got == {tuple(r) for r in whole.collect()}
    for text in ("ml_songs", "ml_split"):
        assert own.sql(f"SELECT count(*) AS c FROM {text}").first().c == own.sql("SELECT count(*) AS c FROM songs WHERE main_genre IS NOT NULL AND artist_id IS NOT NULL").first().c
    small = own.sql("SELECT * FROM ml_split WHERE song_id % 9 = 0")
    cut = store.Store(spark, DATA)
    cut.keep("ml_split", small)  # as a split that leaves songs out
    held = cut.table("ml_vectors").where("split = 'test'").count()
    assert classify.ml_findings(cut).agg(F.sum("songs")).first()[0] == held == own.table("ml_vectors").where("split = 'test'").count()


@TABLES
def test_trends_of_large_corpora_seek_targets_in_songs(spark, monkeypatch):
    """no term or window meets a target by a join, and vocabularies are not ranked whole; the results are those of a small corpus."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(store, "_STORES", {})
    names = "trend_comparison trend_harmonic trend_exact top_global_targets agg_stratum_totals".split()
    large = {name: catalogue.queries()[name](spark, DATA).persist() for name in names}
    assert all(df.count() for df in large.values())
    (used,) = store._STORES.values()
    assert not set(used.kept) & {"terms", "win", "harm", "exact", "song_windows"}
    monkeypatch.undo()
    for name, df in large.items():
        small = catalogue.queries()[name](spark, DATA)
        assert df.exceptAll(small).isEmpty() and small.exceptAll(df).isEmpty() and df.dtypes == small.dtypes, name


@pytest.mark.parametrize("few", [True, False])
def test_trends_of_odd_songs(spark, monkeypatch, few):
    """A null id, missing strata and tokens that cannot be read; n-grams in one lane and in two."""
    rows = [(i if i is not None else None, t, [1940, 1950, None][k % 3], ["a", None][k % 2], None if k % 4 else "rock", f"19{50 + k % 3}-01-01") for k, (i, t) in enumerate(_songs(few)) if i is None or i != 90]
    songs = spark.createDataFrame(rows, "song_id long, tokens array<string>, decade int, main_genre string, rock_genre string, release_date string").repartition(4)
    small = store.Store(spark, songs=songs)
    want = {name: small.table(name).persist() for name in ("trend_e", "trend_h", "stratum_totals", "exact_targets", "targets")}
    assert all(df.count() for name, df in want.items() if few or name != "trend_h")  # many tokens: no class has support
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    large = store.Store(spark, songs=songs)
    assert not ngrams.ids_repeat(large)
    for name, df in want.items():
        got = large.table(name).select(df.columns)
        assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty(), name


@TABLES
@pytest.mark.parametrize("name, most", [("win_row_number_qualify", 3), ("join_self_rank", 1)])
def test_ranks_in_songs_shuffle_few_terms(spark, monkeypatch, name, most):
    """a part sends no more terms of a song and length than are asked for, as numbers; the results are those of a small corpus."""
    monkeypatch.setattr(ngrams, "KEPT_POSITIONS", 0)
    monkeypatch.setattr(store, "_STORES", {})
    large = catalogue.queries()[name](spark, DATA)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "hkey" not in plan.split("Window [")[1]
    monkeypatch.undo()
    small = catalogue.queries()[name](spark, DATA)
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty() and large.dtypes == small.dtypes
