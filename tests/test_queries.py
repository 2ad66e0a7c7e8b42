"""Registered queries against DuckDB, invariants of the tables, sources and the request surface."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessitura import api
from tessitura.operators import classify, embeddings
from tessitura.operators import similarity as sim
from tessitura.plans import catalogue, store
from tessitura.sources import songs as files
from tessitura.streaming import ingest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
CHECKED = """remove_sections chord_tokens chord_3channel matrix_key exact_ngram_id harmonic_id scan_csv_typed sink_upsert sink_json_api unpivot_totals pivot_table agg_run_summary agg_parse_errors
top_harmonic_classes agg_df_idf trend_comparison decade_shifts genre_lift exact_share enrichment_top decade_diversity decade_families genre_families family_findings decade_vector_distance similar_exact similar_fast
similar_by_n compare_n explain_features explain_unique search_songs song_detail agg_transitions lm_predict lm_score_events agg_eval_metrics ppmi structural_neighbors ml_literal_tfidf ml_metrics win_dense_feature_id""".split()


def _text(value):
    return repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in store.SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_against_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted(tuple(_text(r[c]) for c in sorted(columns)) for r in df.collect())
    other = sorted(tuple(_text(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert mine == other


def test_every_query_that_is_in_sql_has_an_oracle():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.oracle_sql()) > 180


@pytest.fixture(scope="module")
def corpus(spark):
    return store.opened(spark, DATA)


def test_invariants(corpus):
    assert corpus.sql("SELECT sum(cnt) AS a, (SELECT sum(cnt) FROM harm) AS b FROM exact").first()[:] == corpus.sql("SELECT sum(cnt) AS a, sum(cnt) AS b FROM exact").first()[:]
    assert corpus.sql("SELECT abs(sum(p) - 1) AS e FROM unigram").first().e < 1e-9
    sums = corpus.sql("SELECT rid, sum(p) AS p FROM lm_distributions GROUP BY rid").agg(F.min("p"), F.max("p")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9
    assert corpus.sql("SELECT artist_id FROM ml_split GROUP BY artist_id HAVING count(DISTINCT split) > 1").isEmpty()
    dots = corpus.sql("SELECT sum(t.tfidf_log_count * t.tfidf_log_count) AS d, max(m.nl) AS v FROM tfidf t JOIN norms m ON t.song_id = m.song_id AND t.n = m.n WHERE t.song_id = 1 AND t.n = 3").first()
    assert abs(dots.d - dots.v) < 1e-6


LENGTHS = [3, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("name", "exact harm terms totals dfs tfidf norms stratum_totals docterms targets win_dirty".split())
def test_tables_hold_all_lengths(corpus, name):
    assert [r.n for r in corpus.table(name).select("n").distinct().orderBy("n").collect()] == LENGTHS


def test_long_lengths_are_searched(corpus):
    song = corpus.sql("SELECT min(t.song_id) AS s FROM terms t JOIN dfs d ON t.n = d.n AND t.hkey = d.hkey WHERE t.n = 8 AND d.song_df > 1").first().s
    for n in LENGTHS:
        status, rows = api.handle(corpus, "/api/compare-n", {"song_id": str(song), "ns": str(n), "exact": "1", "min_shared": "1"})
        assert status == 200 and {json.loads(r)["n"] for r in rows} == {n}
    assert corpus.sql(sim.similar_exact(song, sim.PRESETS["long"], min_shared=1)).first().similarity > 0


@pytest.mark.parametrize("name", ["agg_family_summary", "song_tfidf"])
def test_all_lengths_against_duckdb(spark, duck, name):
    test_against_duckdb(spark, duck, name)


@pytest.mark.parametrize("name", ["progression_family", "first_root_normalized_key", "canonical_transposition_key", "short_label"])
def test_scalar_queries_take_whole_vocabularies(spark, duck, corpus, name):
    assert catalogue.queries()[name](spark, DATA).count() == corpus.table("exact" if name in ("progression_family", "first_root_normalized_key") else "harm").count()
    test_against_duckdb(spark, duck, name)


def test_ranks_of_the_models(corpus):
    """Every state, feature and target up to the ranks, each length by itself."""
    sizes = {r.n: r.c for r in corpus.sql("SELECT n, count(*) AS c FROM harm GROUP BY n").collect()}
    got = lambda name: {r.n: r.c for r in corpus.sql(f"SELECT n, count(*) AS c FROM {name} GROUP BY n").collect()}
    assert got("states") == {n: min(1000, sizes[n]) for n in (3, 4, 5)}
    assert got("embedded") == {n: min(750, sizes[n]) for n in LENGTHS}
    assert got("targets") == got("exact_targets") == dict.fromkeys(LENGTHS, 100)
    assert {r.n for r in corpus.table("transitions").select("n").distinct().collect()} == {3, 4, 5}
    assert all(abs(r.p - 1) < 1e-9 for r in corpus.sql("SELECT n, sum(p) AS p FROM unigrams GROUP BY n").collect())
    assert embeddings.neighbor_overlap(corpus).count() == sum(got("embedded").values()) - corpus.sql("SELECT n, hkey FROM embedded EXCEPT SELECT n, i FROM ppmi WHERE kind = 'local'").count()
    vectors = embeddings.factorised(corpus).collect()
    assert {r.n for r in vectors} == set(LENGTHS) and {len(r.vector) for r in vectors} == {32}
    least = f"SELECT count(*) AS c FROM (SELECT c.hkey FROM harmonic_counts c JOIN ml_split s ON c.song_id = s.song_id WHERE s.split = 'train' GROUP BY c.hkey HAVING count(*) >= {classify.MIN_DF}) x"
    assert corpus.table("harmonic_tfidf").select("feature").distinct().count() == min(5000, corpus.sql(least).first().c)


def test_fast_scores_like_exact(corpus):
    fast = {r.song_id: r.similarity for r in corpus.sql(sim.similar_fast(1, sim.parse_weights("", (3, 4)), min_shared=1, max_df_rate=1.0)).collect()}
    exact = {r.song_id: r.similarity for r in corpus.sql(sim.similar_exact(1, sim.parse_weights("", (3, 4)), top_k=1000, min_shared=1)).collect()}
    assert fast and all(exact[k] == v for k, v in fast.items())
    total = corpus.sql(sim.explain_by_n(1, 3, {3: 1.0, 4: 4 / 3})).agg(F.sum("share")).first()[0]
    assert abs(total - 1) < 1e-5


SONGS = [
    (1, "<intro_1> C F G C <verse_1> C F G", "1994-05-01", "'pop' 'soft rock'", "1990.0", None, "a1", "pop"),
    (2, "D G A D", "1987", "rock, blues", None, "hard rock", "a1", "rock"),
    (3, "C♯ Bb,F N.C. G", None, None, None, None, "a2", None),
    (4, "C/B F G/H C", "2001-01-01", "nan", "2000", None, "a2", "jazz"),
    (5, "G", "1965", "", "1960", None, "a3", "pop"),
    (6, None, "1965", None, "1960", None, None, "nan"),
    (7, "C G Amin F C G Amin F", "2015", "'pop'", "2010", None, "a3", "pop"),
]


def test_raw_songs(spark, tmp_path):
    raw = spark.createDataFrame([(*s, None, None) for s in SONGS], "id long, chords string, release_date string, genres string, decade string, rock_genre string, artist_id string, main_genre string, spotify_song_id string, spotify_artist_id string").select(*files.RAW.names)
    raw.coalesce(1).write.csv(str(tmp_path / "raw"), header=True, escape='"')
    read = files.read_raw_csv(spark, str(tmp_path / "raw"))
    assert files.missing_columns(read, {"id", "nothing"}) == {"nothing"}
    own = store.Store(spark, songs=files.songs_from_raw(read))
    counts = {r.song_id: r.c for r in own.sql("SELECT song_id, count(*) AS c FROM win WHERE n = 3 GROUP BY song_id").collect()}
    assert counts == {1: 5, 2: 2, 3: 2, 4: 2, 7: 6}
    assert {r.error for r in own.table("win").where("song_id = 4 AND n = 3").collect()} == {"Unknown note: H"}
    classes = {r.ngram: r.hkey for r in own.table("win").where("n = 3").collect()}
    assert classes["C F G"] == classes["D G A"]
    meta = {r.song_id: r for r in own.table("songs").collect()}
    assert (meta[2].decade, meta[6].main_genre, meta[3].decade) == (1980, None, None)
    assert own.sql("SELECT song_count FROM stratum_songs WHERE stype = 'main_genre' AND svalue = 'pop'").first()[0] == 3


def test_empty_corpus(spark):
    own = store.Store(spark, songs=files.songs_from_documents(spark.createDataFrame([], "doc_id long, text string, lang string, source string")))
    for name in ("win", "harm", "terms", "tfidf", "docterms", "transition_counts", "ppmi"):
        assert own.table(name).isEmpty()


def test_requests(corpus):
    status, rows = api.handle(corpus, "/api/similar", {"song_id": "1", "exact": "1", "top_k": "3"})
    assert status == 200 and len(rows) == 3 and "similarity" in json.loads(rows[0])
    assert api.handle(corpus, "/api/explain", {"song_id": "1", "candidate_id": "3", "part": "by_n"})[0] == 200
    assert api.handle(corpus, "/api/song", {"song_id": "1"})[0] == 200
    assert api.handle(corpus, "/api/health", {})[0] == 200
    assert api.handle(corpus, "/api/nothing", {})[0] == 404
    assert [api.handle(corpus, "/api/spotify", x)[0] for x in ({}, {"spotify_song_id": "t1"}, {"spotify_song_id": "none"})] == [400, 200, 404]
    assert api.handle(corpus, "/api/song", {"song_id": "x"})[0] == 400
    assert api.handle(corpus, "/api/song", {"song_id": "99999999"})[0] == 404
    assert api.handle(corpus, "/api/similar", {"song_id": "1", "weights": "3:nan"})[0] == 400
    assert sim.parse_weights("3:50,9:1", (3, 4)) == {3: 10.0, 4: 4 / 3}
    assert sim.bounded_int("7", 1, 2, 5) == 5
    assert sim.track_id("https://x.example/track/" + "a" * 22 + "?si=1") == "a" * 22
    with pytest.raises(sim.ParameterError):
        sim.parse_ns("9")


def test_stream_counts_like_batch(spark, corpus, tmp_path):
    songs = corpus.table("songs").select("song_id", "tokens")
    songs.repartition(3).write.parquet(str(tmp_path / "in"))
    query = ingest.stream_counts(spark.readStream.schema(songs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    streamed = ingest.counts(spark, str(tmp_path / "out"))
    assert streamed.exceptAll(corpus.table("exact").select("n", "ngram", "hkey", "cnt")).isEmpty()
    assert streamed.count() == corpus.table("exact").count()


def test_entry_works_without_the_training_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert "similar_exact" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert "similar_exact" in entry.oracle_sql()


@pytest.mark.parametrize("text", ["\\' OR true) ORDER BY 1 -- ", "a\\", "'", "\\", "%", "_", ":q", "the", "example.org", "ö"])
def test_search_text_is_no_sql(corpus, text):
    held = corpus.table("search_values").where(F.contains("text", F.lit(text.strip().lower())))
    of = lambda *kinds: [r.value for r in held.where(F.col("kind").isin(*kinds)).collect()]
    found = F.col("artist_id").isin(of("artist", "name")) | F.col("track_id").isin(of("track", "title")) | F.col("main_genre").isin(of("genre"))
    want = corpus.table("search_summary").where("indexed_features > 0").where(found).count()
    assert api.ROUTES["/api/search"](corpus, {"q": text}).count() == min(want, 20)
