"""The relational operators of the engine, one small query each, over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.kernel import DUCK_ID, class_id
from tessitura.operators.counting import errors, first_by_count, followed, local_terms, with_in_order
from tessitura.operators.ngrams import NS, SUPPORT, _small, classes_of, counts_of, hex_key, ids_repeat, spelled, windows_of_length, words_of
from tessitura.operators.similarity import met_terms
from tessitura.operators.trends import TOP_TARGETS
from tessitura.plans.ranking import placed
from tessitura.plans.register import query
from tessitura.plans.store import Store
from tessitura.sources import songs as files
from tessitura.sources.tables import Root, attach

# --- scans and sinks ---------------------------------------------------------------------------------------------------------


def _raw_file(store: Store) -> str:
    """The corpus as a raw song CSV in the store's folder."""
    path = f"{store.folder}/raw_csv"
    if "raw_csv" not in store.kept:
        songs = store.table("songs")
        raw = songs.select(F.col("song_id").alias("id"), F.concat(F.lit("<intro_1>\n"), F.array_join("tokens", " ")).alias("chords"), "release_date", "genres", F.concat(F.col("decade").cast("string"), F.lit(".0")).alias("decade"), "rock_genre", "artist_id", "main_genre", F.col("track_id").alias("spotify_song_id"), F.lit(None).cast("string").alias("spotify_artist_id"))
        raw.write.mode("overwrite").csv(path, header=True, escape='"')
        store.kept["raw_csv"] = raw
    return path


@query("scan_csv_full", duck="SELECT song_id AS id, (SELECT count(*) FROM tokens t WHERE t.song_id = s.song_id)::INTEGER AS n_tokens, main_genre FROM songs s")
def scan_csv_full(store: Store) -> DataFrame:
    raw = files.read_raw_csv(store.spark, _raw_file(store))
    from tessitura.functions import chords

    return raw.select("id", F.size(chords.chord_tokens("chords")).alias("n_tokens"), "main_genre")


@query("scan_csv_chunked", duck="SELECT song_id AS id, artist_id FROM songs")
def scan_csv_chunked(store: Store) -> DataFrame:
    return files.read_raw_csv(store.spark, _raw_file(store), ["id", "artist_id"])


@query("scan_csv_typed", duck="SELECT song_id AS id, substr(release_date, 1, 4)::INTEGER AS release_year, decade, main_genre, rock_genre, artist_id FROM songs")
def scan_csv_typed(store: Store) -> DataFrame:
    return files.song_metadata(files.read_raw_csv(store.spark, _raw_file(store))).select("id", "release_year", "decade", "main_genre", "rock_genre", "artist_id")


@query("sink_parquet", duck="SELECT song_id AS id, decade, year(release_date::DATE)::INTEGER AS year FROM songs")
def sink_parquet(store: Store) -> DataFrame:
    """The canonical song table, written and read again."""
    path = f"{store.folder}/songs_master"
    files.write_table(files.canonical_songs(files.read_raw_csv(store.spark, _raw_file(store))), path)
    return store.spark.read.parquet(path).select("id", "decade", F.year("release_date").alias("year"))


@query("sink_csv_gz", duck="SELECT n, ngram, cnt FROM exact")
def sink_csv_gz(store: Store) -> DataFrame:
    path = f"{store.folder}/exact_csv"
    files.write_report_csv(store.table("exact").select("n", "ngram", "cnt"), path, gzip=True)
    return store.spark.read.schema("n int, ngram string, cnt long").csv(path, header=True)


@query("sink_ctas", duck="SELECT n, hkey, cnt FROM harm")
def sink_ctas(store: Store) -> DataFrame:
    path = f"{store.folder}/harm_by_n"
    files.write_table(store.table("harm").select("hkey", "cnt", "n"), path, ("n",))
    return store.spark.read.parquet(path).select("n", "hkey", "cnt")


@query("sink_upsert", duck="SELECT song_id, CASE WHEN song_id % 3 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN song_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM songs")
def sink_upsert(store: Store) -> DataFrame:
    songs = store.table("songs").select("song_id")
    old = songs.select("song_id", F.lit("old").alias("title"), F.lit(1).alias("version"))
    fresh = songs.where("song_id % 3 = 0").select("song_id", F.lit("new").alias("title"), F.lit(2).alias("version"))
    return files.upsert(old, fresh, "song_id", "version")


@query("sink_insert_batch", duck="SELECT song_id, artist_id, decade FROM songs")
def sink_insert_batch(store: Store) -> DataFrame:
    """The songs in three batches, one of them written twice as after a retry."""
    root, songs = Root(store.spark, f"{store.folder}/batches"), store.table("songs").select("song_id", "artist_id", "decade")
    for k in (0, 1, 1, 2):
        root.append("songs", songs.where(F.pmod("song_id", F.lit(3)) == k), f"part-{k}")
    return root.read("songs")


@query("sink_merge", duck="SELECT song_id, CASE WHEN song_id % 3 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN song_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM songs")
def sink_merge(store: Store) -> DataFrame:
    """A merge by key into a versioned table; the version before it stays readable."""
    root, songs = Root(store.spark, f"{store.folder}/merged"), store.table("songs").select("song_id")
    root.merge("titles", songs.select("song_id", F.lit("old").alias("title"), F.lit(1).alias("version")), "song_id", "version")
    root.merge("titles", songs.where("song_id % 3 = 0").select("song_id", F.lit("new").alias("title"), F.lit(2).alias("version")), "song_id", "version")
    return root.read("titles")


@query("attach_db", duck="SELECT s.song_id, s.main_genre, t.n, t.uniq FROM songs s JOIN totals t ON s.song_id = t.song_id")
def attach_db(store: Store) -> DataFrame:
    """Totals of this store joined with songs of a second root, attached read-only."""
    Root(store.spark, f"{store.folder}/second").append("songs", store.table("songs").select("song_id", "main_genre"), "all")
    view = attach(store.spark, f"{store.folder}/second", "second")["songs"]
    return store.spark.table(view).join(store.table("totals"), "song_id").select("song_id", "main_genre", "n", "uniq")


@query("sink_json_api", duck="""SELECT '{"song_id":' || song_id || ',"ratio":' || CASE WHEN song_id % 2 = 0 THEN '0.5' ELSE 'null' END || '}' AS json FROM songs""")
def sink_json_api(store: Store) -> DataFrame:
    rows = store.table("songs").select("song_id", F.when(F.col("song_id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(float("nan"))).alias("ratio"))
    return files.json_rows(rows)


@query("scan_registered_frame", duck="SELECT t.song_id, t.n, t.cnt, w.alpha FROM terms t JOIN (VALUES (3, 1.0::DOUBLE), (4, 1.5::DOUBLE), (5, 2.0::DOUBLE), (6, 2.5::DOUBLE), (7, 3.0::DOUBLE), (8, 3.5::DOUBLE)) w(n, alpha) ON t.n = w.n")
def scan_registered_frame(store: Store) -> DataFrame:
    weights = store.spark.createDataFrame([(n, (n - 1) / 2) for n in NS], "n int, alpha double")
    return store.table("terms").join(F.broadcast(weights), "n").select("song_id", "n", "cnt", "alpha")


query("scan_parquet", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
query("scan_table", "SELECT song_id, n, uniq FROM totals")
query("scan_values", "SELECT t.n, t.label, h.cnt FROM (VALUES (3, 'three'), (4, 'four')) t(n, label) JOIN (SELECT n, count(*) AS cnt FROM harm GROUP BY n) h ON t.n = h.n")
query("scan_unnest_param", "SELECT n, count(*) AS c FROM harm WHERE n IN (SELECT explode(array(3, 4))) GROUP BY n", "SELECT n, count(*) AS c FROM harm WHERE n IN (SELECT unnest([3, 4])) GROUP BY n")
query("sink_view", "SELECT n, hkey, cnt, example FROM supported")

# --- table-generating operators ----------------------------------------------------------------------------------------------

query("ngram_windows", "SELECT song_id, n, pos, ngram FROM win")
query("song_scopes", "SELECT song_id, 'global' AS scope, 'all' AS value FROM songs UNION ALL SELECT song_id, 'decade', CAST(decade AS STRING) FROM songs UNION ALL SELECT song_id, 'genre', main_genre FROM songs UNION ALL SELECT song_id, 'artist', artist_id FROM songs")


@query("unpivot_totals", duck="SELECT song_id, n, total_windows FROM song_windows")
def unpivot_totals(store: Store) -> DataFrame:
    wide = store.table("songs").select("song_id", *(F.greatest(F.size("tokens") - (n - 1), F.lit(0)).cast("long").alias(f"n_ngrams_{n}") for n in NS))
    long = wide.unpivot("song_id", [f"n_ngrams_{n}" for n in NS], "name", "total_windows")
    return long.where("total_windows > 0").select("song_id", F.substring_index("name", "_", -1).cast("int").alias("n"), "total_windows")


@query("pivot_table", duck="SELECT main_genre, coalesce(sum(CASE WHEN decade = 1950 THEN 1 END), 0)::BIGINT AS d1950, coalesce(sum(CASE WHEN decade = 1960 THEN 1 END), 0)::BIGINT AS d1960 FROM songs GROUP BY main_genre")
def pivot_table(store: Store) -> DataFrame:
    wide = store.table("songs").groupBy("main_genre").pivot("decade", [1950, 1960]).count().na.fill(0)
    return wide.select("main_genre", F.col("1950").alias("d1950"), F.col("1960").alias("d1960"))


# --- projections and filters -------------------------------------------------------------------------------------------------

query("project_arith", "SELECT song_id, n, round(indexed / nullif(total_windows - indexed, 0), 8) AS ratio, total_windows - indexed AS missing FROM totals")
query("filter_threshold", "SELECT n, hkey, cnt FROM harm WHERE cnt >= 20")
query("filter_between", "SELECT n, count(*) AS c FROM harm WHERE n BETWEEN 3 AND 8 GROUP BY n")
query("filter_in_list", "SELECT song_id, decade FROM songs WHERE decade IN (1950, 1990)")


@query("filter_in_subquery", duck="SELECT song_id, n, cnt FROM terms WHERE hkey IN (SELECT hkey FROM targets WHERE n = 3)")
def filter_in_subquery(store: Store) -> DataFrame:
    """A key tells its length, so the terms are those of three chords: counted in the songs, where the chosen classes are sought."""
    top = counts_of(store, (3,)).classes().where(F.col("cnt") >= SUPPORT).orderBy(F.desc("cnt"), hex_key(F.lit(3))).limit(TOP_TARGETS).select("u", "v")
    rows = local_terms(store.table("packed_songs"), words_of(store).codec, 3, True).join(F.broadcast(top), ["u", "v"])
    if ids_repeat(store):
        rows = rows.groupBy("o", "u", "v").agg(F.sum("cnt").alias("cnt"))
    return rows.select(F.col("o").alias("song_id"), F.lit(3).alias("n"), "cnt")


query("filter_null_tests", "SELECT song_id, rock_genre, track_id FROM songs WHERE rock_genre IS NOT NULL AND track_id IS NULL AND artist_id <> ''")
query("filter_like_ci", "SELECT song_id, artist_id FROM songs WHERE lower(coalesce(artist_id, '')) LIKE '%c1%'")


@query("filter_regex_ci", duck="SELECT n, ngram, cnt FROM exact WHERE regexp_matches(ngram, '(?i)amin.*g7')")
def filter_regex_ci(store: Store) -> DataFrame:
    """The expression reads only n-grams whose tokens hold both texts in this order, which their codes tell."""
    return spelled(store, keep=with_in_order(words_of(store).names, "amin", "g7")).where(F.col("ngram").rlike("(?i)amin.*g7"))


query("filter_or_null_safe", """SELECT c.song_id FROM songs c JOIN songs q ON q.song_id = 1 WHERE c.song_id <> q.song_id AND (c.track_id IS NULL OR q.track_id IS NULL OR c.track_id <> q.track_id)
    AND (c.artist_id IS NULL OR q.artist_id IS NULL OR c.artist_id <> q.artist_id) AND (c.main_genre IS NULL OR q.main_genre IS NULL OR c.main_genre <> q.main_genre)""")  # fmt: skip
query("case_rank", "SELECT song_id, CASE WHEN track_id = 't1' THEN 0 WHEN track_id LIKE 't1%' THEN 1 ELSE 2 END AS place FROM songs ORDER BY place, song_id LIMIT 50")
query("coalesce_nullif", "SELECT song_id, coalesce(rock_genre, main_genre) AS genre, nullif(track_id, 't1') AS track FROM songs")
query("cast_try_cast", "SELECT song_id, CAST(song_id AS DOUBLE) AS d, TRY_CAST(substr(release_date, 1, 4) AS INT) AS y, TRY_CAST(artist_id AS INT) AS bad FROM songs")
query("concat_op", "SELECT song_id, main_genre || ':' || CAST(decade AS STRING) AS document_id, rock_genre || '!' AS nullable FROM songs")
query("math", "SELECT n, hkey, round(ln(cnt), 8) AS l, round(sqrt(cnt), 8) AS s, abs(cnt - 10) AS a, round(ln(1 + cnt), 8) AS l1, round(log2(cnt), 8) AS l2, round(exp(1 / cnt), 8) AS e, round(power(2, 1 / cnt), 8) AS p FROM harm")
query("string_fns", "SELECT ngram, substr(ngram, 1, 3) AS head, lower(ngram) AS low, replace(ngram, 'min', 'm') AS short, length(ngram) AS chars FROM exact", "SELECT ngram, substr(ngram, 1, 3) AS head, lower(ngram) AS low, replace(ngram, 'min', 'm') AS short, length(ngram)::INTEGER AS chars FROM exact")


@query("fillna_dropna", duck="SELECT song_id, rock_genre, coalesce(track_id, 'none') AS track_id FROM songs WHERE rock_genre IS NOT NULL")
def fillna_dropna(store: Store) -> DataFrame:
    return store.table("songs").dropna(subset=["rock_genre"]).fillna({"track_id": "none"}).select("song_id", "rock_genre", "track_id")


query("modulo_split", "SELECT song_id, CASE WHEN song_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM songs")

# --- joins -------------------------------------------------------------------------------------------------------------------

query("join_inner_using", "SELECT song_id, n, cnt, total_windows FROM terms JOIN song_windows USING (song_id, n)")
query("join_left_using", "SELECT song_id, n, coalesce(uniq, 0) AS uniq FROM songs LEFT JOIN totals USING (song_id)")
query("join_left_multikey", "SELECT e.stype, e.svalue, e.n, e.ngram, h.cnt FROM trend_exact_counts e LEFT JOIN trend_harmonic_counts h ON e.stype = h.stype AND e.svalue = h.svalue AND e.n = h.n AND e.hkey = h.hkey")
_RANKS = """WITH r AS (SELECT song_id, n, hkey, cnt, row_number() OVER (PARTITION BY song_id, n ORDER BY cnt DESC, hkey) AS a, row_number() OVER (PARTITION BY song_id, n ORDER BY cnt, hkey) AS b FROM terms)
    SELECT x.song_id, x.n, x.hkey AS most, y.hkey AS least FROM r x JOIN r y ON x.song_id = y.song_id AND x.n = y.n WHERE x.a = 1 AND y.b = 1"""


@query("join_self_rank", duck=_RANKS)
def join_self_rank(store: Store) -> DataFrame:
    """In large corpora only each count's own first and last terms of a song leave it, as numbers."""
    if _small(store):
        return store.sql(_RANKS)
    hkey = hex_key(F.col("n"))
    rows = counts_of(store, owner="song_id").extremes(SUPPORT, 1, 1).where("o IS NOT NULL")
    of = lambda low: F.max(F.when(F.col("low") == low, hkey))
    return rows.groupBy(F.col("o").alias("song_id"), "n").agg(of(0).alias("most"), of(1).alias("least"))


_SELF = "SELECT c.song_id, round(sum(q.tfidf_log_count * c.tfidf_log_count), 5) AS dot, count(*) AS shared FROM tfidf q JOIN tfidf c ON q.n = c.n AND q.hkey = c.hkey WHERE q.song_id = 1 GROUP BY c.song_id"


@query("join_self_feature", duck=_SELF)
def join_self_feature(store: Store) -> DataFrame:
    """In large corpora the song's own classes are sought in all songs, in place; no index is made."""
    if _small(store):
        return store.sql(_SELF)
    for name, only in (("met_terms_1", 1), ("met_terms", None)):
        met_terms(store, 1, only).createOrReplaceTempView(name)
    return store.sql("SELECT /*+ BROADCAST(q) */ c.song_id, round(sum(q.tfidf_log_count * c.tfidf_log_count), 5) AS dot, count(*) AS shared FROM met_terms_1 q JOIN met_terms c ON q.f = c.f GROUP BY c.song_id")


query("join_filtered_on", "SELECT q.n, q.hkey, c.cnt FROM terms q LEFT JOIN terms c ON c.song_id = 3 AND q.n = c.n AND q.hkey = c.hkey WHERE q.song_id = 1")
query("join_cross_scalar", "SELECT h.n, h.hkey, round(h.cnt / t.total, 8) AS share FROM harm h CROSS JOIN (SELECT sum(cnt) AS total FROM harm) t")
query("join_anti", "SELECT q.n, q.hkey FROM terms q LEFT ANTI JOIN (SELECT n, hkey FROM terms WHERE song_id = 3) c ON q.n = c.n AND q.hkey = c.hkey WHERE q.song_id = 1", "SELECT q.n, q.hkey FROM terms q ANTI JOIN (SELECT n, hkey FROM terms WHERE song_id = 3) c ON q.n = c.n AND q.hkey = c.hkey WHERE q.song_id = 1")
query("join_semi", "SELECT w.song_id, w.n, w.pos FROM win w LEFT SEMI JOIN targets t ON w.n = t.n AND w.hkey = t.hkey", "SELECT w.song_id, w.n, w.pos FROM win w SEMI JOIN targets t ON w.n = t.n AND w.hkey = t.hkey")
query("join_null_check", "SELECT e.n, count(*) AS orphans FROM exact e LEFT JOIN supported h ON e.n = h.n AND e.hkey = h.hkey WHERE h.hkey IS NULL GROUP BY e.n")


@query("join_pandas_merge", duck="SELECT h.n, h.hkey, h.cnt AS cnt_all, t.cnt AS cnt_target FROM harm h LEFT JOIN targets t USING (n, hkey)")
def join_pandas_merge(store: Store) -> DataFrame:
    """A left merge whose clashing columns get suffixes."""
    left, right = store.table("harm").select("n", "hkey", F.col("cnt").alias("cnt_all")), store.table("targets").select("n", "hkey", F.col("cnt").alias("cnt_target"))
    return left.join(right, ["n", "hkey"], "left")




@query("join_map_lookup", duck="SELECT w.song_id, w.n, w.pos, s.example FROM win w JOIN supported s ON w.n = s.n AND w.hkey = s.hkey")
def join_map_lookup(store: Store) -> DataFrame:
    """In large corpora windows carry their place to the task that counts their class and so knows its example; they are shuffled once for all
    lengths."""
    if _small(store):
        return classes_of(store, store.table("supported").select("n", "hkey", "example")).select("song_id", "n", "pos", "example")
    rows = counts_of(store, owner="song_id", carried="place").examples(SUPPORT, words_of(store).spelled())
    return rows.select(F.col("o").alias("song_id"), "n", F.col("pos").cast("int").alias("pos"), "example")


# --- aggregations ------------------------------------------------------------------------------------------------------------

query("agg_count_ngrams", "SELECT n, ngram, cnt FROM exact")
query("agg_harmonic_pushforward", "SELECT n, hkey, cnt, n_exact, example FROM harm")
query("agg_vocabulary_sizes", "SELECT h.n, h.classes, h.windows, e.ngrams FROM (SELECT n, count(*) AS classes, CAST(sum(cnt) AS BIGINT) AS windows FROM harm_all GROUP BY n) h JOIN (SELECT n, count(*) AS ngrams FROM exact_all GROUP BY n) e ON h.n = e.n")


@query("top_harmonic_classes", duck=f"SELECT n, {DUCK_ID} AS harmonic_id, example, cnt, n_exact FROM harm_all QUALIFY row_number() OVER (PARTITION BY n ORDER BY cnt DESC, hkey) <= 20")
def top_harmonic_classes(store: Store) -> DataFrame:
    """The twenty most frequent classes of each length; text ids are made for these alone."""
    ranked = store.table("harm_all").withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cnt"), "hkey"))).where("r <= 20")
    return ranked.select("n", class_id().alias("harmonic_id"), "example", "cnt", "n_exact")


_SHARE = "SELECT {cols}, round(cnt / sum(cnt) OVER (PARTITION BY n), 10) AS frequency{place} FROM {t}"
_PLACE = ", CAST(row_number() OVER (PARTITION BY n ORDER BY cnt DESC, {key}) AS BIGINT) AS place"


def _shares(store: Store, rows: DataFrame, t: str) -> DataFrame:
    """Share of each row in its length's total: the totals are a row a length. All windows are n-grams, so theirs come from the songs' sizes."""
    totals = store.table("song_windows").groupBy("n").agg(F.sum("total_windows").alias("total")) if t == "exact" else store.table(t).groupBy("n").agg(F.sum("cnt").alias("total"))
    return rows.join(F.broadcast(totals), "n").withColumn("frequency", F.round(F.col("cnt") / F.col("total"), 10))


def _frequency_table(store: Store, t: str, key: str) -> DataFrame:
    ranked = placed(store.table(t).select("n", key, "cnt"), [F.desc("cnt"), F.asc(key)], ("n",))
    return _shares(store, ranked, t).select("n", key, "cnt", "frequency", "place")


@query("agg_vocab_finalize", duck=_SHARE.format(cols="n, ngram, cnt", place="", t="exact"))
def agg_vocab_finalize(store: Store) -> DataFrame:
    """Shares are rounded once for each distinct count of a bucket, where n-grams are counted: decimal rounding is dearer than the count itself."""
    return spelled(store, totals=windows_of_length(store)).select("n", "ngram", "cnt", "frequency")


@query("agg_freq_table_exact", duck=_SHARE.format(cols="n, ngram, cnt", place=_PLACE.format(key="ngram"), t="exact"))
def agg_freq_table_exact(store: Store) -> DataFrame:
    return _frequency_table(store, "exact", "ngram")


@query("agg_freq_table_harmonic", duck=_SHARE.format(cols="n, hkey, cnt", place=_PLACE.format(key="hkey"), t="harm"))
def agg_freq_table_harmonic(store: Store) -> DataFrame:
    return _frequency_table(store, "harm", "hkey")


@query("agg_song_summary", duck="SELECT s.song_id, count(t.pos) AS n_chords, greatest(count(t.pos) - 2, 0) AS n_ngrams_3, greatest(count(t.pos) - 7, 0) AS n_ngrams_8 FROM songs s LEFT JOIN tokens t USING (song_id) GROUP BY s.song_id")
def agg_song_summary(store: Store) -> DataFrame:
    """Counts from array sizes, nothing is exploded."""
    size = F.size("tokens").cast("long")
    return store.table("songs").select("song_id", size.alias("n_chords"), *(F.greatest(size - (n - 1), F.lit(0).cast("long")).alias(f"n_ngrams_{n}") for n in (3, 8)))


_RUN = "SELECT n, count(*) AS total_windows, count(DISTINCT ngram) AS unique_exact, count(hkey) AS harmonic_occurrences, count(DISTINCT hkey) AS unique_classes, count(*) - count(hkey) AS parse_error_occurrences, round((count(*) - count(hkey)) / count(*), 8) AS parse_error_rate FROM win_dirty GROUP BY n"
_ERRORS = "SELECT n, error, count(*) AS cnt, first(ngram ORDER BY song_id, pos) AS ngram, min(song_id) AS song_id FROM win_dirty WHERE error IS NOT NULL GROUP BY n, error ORDER BY cnt DESC, error LIMIT 25"


@query("agg_run_summary", duck=_RUN)
def agg_run_summary(store: Store) -> DataFrame:
    """N-grams and classes lie in one task each, so their numbers add up."""
    s = counts_of(store, dirty=True).summary()
    bad = F.col("windows") - F.col("read")
    return s.select("n", F.col("windows").alias("total_windows"), F.col("grams").alias("unique_exact"), F.col("read").alias("harmonic_occurrences"), F.col("classes").alias("unique_classes"), bad.alias("parse_error_occurrences"), F.round(bad / F.col("windows"), 8).alias("parse_error_rate"))


@query("agg_parse_errors", duck=_ERRORS)
def agg_parse_errors(store: Store) -> DataFrame:
    words = words_of(store, "dirty_dictionary")
    rows = errors(store.table("dirty_packed"), words.codec, NS).select("n", words.error(F.col("e").cast("int")).alias("error"), "cnt", words.text().alias("ngram"), "o", "pos")
    found = rows.groupBy("n", "error").agg(F.sum("cnt").alias("cnt"), F.min_by("ngram", F.struct("o", "pos")).alias("ngram"), F.min("o").alias("song_id"))
    return found.orderBy(F.desc("cnt"), "error").limit(25)


query("agg_validation_mass", "SELECT v.n, v.v_count, h.h_count, v.v_count = h.h_count AS counts_match FROM (SELECT n, CAST(sum(cnt) AS BIGINT) AS v_count FROM exact GROUP BY n) v JOIN (SELECT n, CAST(sum(cnt) AS BIGINT) AS h_count FROM harm GROUP BY n) h ON v.n = h.n")


@query("agg_validation_collision", duck="SELECT n, ngram, count(DISTINCT hkey) AS keys FROM win GROUP BY n, ngram HAVING count(DISTINCT hkey) > 1")
def agg_validation_collision(store: Store) -> DataFrame:
    """The classes of an n-gram's occurrences are compared in the task that holds them all."""
    return counts_of(store).collisions().select("n", words_of(store).text().alias("ngram"), "keys")


query("agg_collapse_summary", "SELECT e.n, e.v, h.h, round(e.v / h.h, 6) AS ratio, h.mean_members, h.most_members FROM (SELECT n, count(*) AS v FROM exact GROUP BY n) e JOIN (SELECT n, count(*) AS h, round(avg(n_exact), 6) AS mean_members, max(n_exact) AS most_members FROM harm GROUP BY n) h ON e.n = h.n")
query("agg_song_terms", "SELECT song_id, n, hkey, cnt FROM terms")
query("agg_song_totals", "SELECT song_id, n, total_windows, uniq, indexed, round(coverage, 8) AS coverage FROM totals")
query("agg_df_idf", "SELECT n, hkey, song_df, n_songs, round(df_rate, 8) AS df_rate, round(idf, 8) AS idf FROM dfs")
query("agg_norms", "SELECT song_id, n, round(nf, 8) AS nf, round(nl, 6) AS nl FROM norms")
query("agg_default_norms", "SELECT song_id, round(sqrt(sum(nl * n * n / 9)), 6) AS norm_log, round(sqrt(sum(nf * n * n / 9)), 8) AS norm_frequency FROM norms GROUP BY song_id")
query("agg_search_summary", "SELECT s.song_id, s.artist_id, s.main_genre, s.decade, CAST(coalesce(sum(t.indexed), 0) AS BIGINT) AS indexed_windows, CAST(coalesce(sum(t.uniq), 0) AS BIGINT) AS indexed_features FROM songs s LEFT JOIN totals t ON s.song_id = t.song_id GROUP BY s.song_id, s.artist_id, s.main_genre, s.decade")
query("agg_threshold_audit", "SELECT h.n, x.least, sum(CASE WHEN h.cnt >= x.least THEN 1 ELSE 0 END) AS classes, round(sum(CASE WHEN h.cnt >= x.least THEN h.cnt ELSE 0 END) / sum(h.cnt), 8) AS coverage FROM harm h CROSS JOIN (VALUES (1), (2), (5), (10), (20), (50), (100)) x(least) GROUP BY h.n, x.least", "SELECT h.n, x.least, sum(CASE WHEN h.cnt >= x.least THEN 1 ELSE 0 END)::BIGINT AS classes, round(sum(CASE WHEN h.cnt >= x.least THEN h.cnt ELSE 0 END) / sum(h.cnt), 8) AS coverage FROM harm h CROSS JOIN (VALUES (1), (2), (5), (10), (20), (50), (100)) x(least) GROUP BY h.n, x.least")
query("agg_coverage_stats", "SELECT n, round(sum(indexed) / sum(total_windows), 8) AS weighted, round(avg(coverage), 8) AS mean, round(median(coverage), 8) AS median FROM totals GROUP BY n")
query("agg_table_counts", "SELECT 'terms' AS name, count(*) AS c FROM terms UNION ALL SELECT 'totals', count(*) FROM totals UNION ALL SELECT 'dfs', count(*) FROM dfs UNION ALL SELECT 'exact', count(*) FROM exact UNION ALL SELECT 'harm', count(*) FROM harm")
query("agg_having", "SELECT artist_id, count(*) AS songs FROM songs GROUP BY artist_id HAVING count(*) >= 5")


@query("agg_any_value", duck="SELECT n, hkey, min(ngram) AS member FROM exact GROUP BY n, hkey")
def agg_any_value(store: Store) -> DataFrame:
    """The least member of each class, known where the class is counted; n-grams that cannot be read are one group a length."""
    words = words_of(store)
    found = counts_of(store).classes().select("n", hex_key(F.col("n")).alias("hkey"), words.text("l").alias("member"))
    if words.readable:
        return found
    rest = store.table("exact").where("hkey IS NULL").groupBy("n", "hkey").agg(F.min("ngram").alias("member"))
    return found.unionByName(rest)


@query("agg_count_distinct", duck="SELECT n, count(DISTINCT song_id) AS songs, count(DISTINCT hkey) AS classes FROM terms GROUP BY n")
def agg_count_distinct(store: Store) -> DataFrame:
    """Every supported class is some song's term, and a song with a term has some in its totals."""
    songs = store.table("totals").where("uniq > 0").groupBy("n").agg(F.countDistinct("song_id").alias("songs"))
    return songs.join(counts_of(store).classes().where(F.col("cnt") >= SUPPORT).groupBy("n").agg(F.count("*").alias("classes")), "n")


query("agg_argmax_group", "SELECT main_genre, max_by(song_id, struct(c, -song_id)) AS longest, max(c) AS chords FROM (SELECT s.main_genre, s.song_id, count(*) AS c FROM songs s JOIN tokens t ON s.song_id = t.song_id GROUP BY s.main_genre, s.song_id) x GROUP BY main_genre", "SELECT main_genre, first(song_id ORDER BY c DESC, song_id) AS longest, max(c) AS chords FROM (SELECT s.main_genre, s.song_id, count(*) AS c FROM songs s JOIN tokens t ON s.song_id = t.song_id GROUP BY s.main_genre, s.song_id) x GROUP BY main_genre")
query("agg_concat_distinct", "SELECT song_id, array_join(array_sort(collect_set(n)), ',') AS ns FROM terms GROUP BY song_id", "SELECT song_id, string_agg(DISTINCT n::VARCHAR, ',' ORDER BY n::VARCHAR) AS ns FROM terms GROUP BY song_id")

# --- windows -----------------------------------------------------------------------------------------------------------------

@query("win_sum_partition", duck=_SHARE.format(cols="n, hkey", place="", t="harm"))
def win_sum_partition(store: Store) -> DataFrame:
    return _shares(store, store.table("harm"), "harm").select("n", "hkey", "frequency")


@query("win_row_number_qualify", duck="SELECT song_id, n, hkey, cnt FROM terms QUALIFY row_number() OVER (PARTITION BY song_id, n ORDER BY cnt DESC, hkey) <= 3")
def win_row_number_qualify(store: Store) -> DataFrame:
    if _small(store):
        return store.sql("SELECT song_id, n, hkey, cnt FROM (SELECT *, row_number() OVER (PARTITION BY song_id, n ORDER BY cnt DESC, hkey) AS r FROM terms) x WHERE r <= 3")
    return counts_of(store, owner="song_id").extremes(SUPPORT, 3).select(F.col("o").alias("song_id"), "n", hex_key(F.col("n")).alias("hkey"), "cnt")


query("win_first_last", "SELECT n, hkey, min_by(svalue, svalue) AS first_decade, max_by(cnt, svalue) AS last_count FROM trend_harmonic_counts WHERE stype = 'decade' GROUP BY n, hkey")
query("win_dual_rank", "SELECT n, hkey, cnt FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, hkey) AS hi, row_number() OVER (PARTITION BY n ORDER BY cnt, hkey) AS lo FROM targets) x WHERE hi <= 5 OR lo <= 5")


@query("win_rank_within_n", duck="SELECT n, hkey, cnt, CAST(row_number() OVER (PARTITION BY n ORDER BY cnt DESC, hkey) AS BIGINT) AS place FROM supported")
def win_rank_within_n(store: Store) -> DataFrame:
    return placed(store.table("supported").select("n", "hkey", "cnt"), [F.desc("cnt"), F.asc("hkey")], ("n",))


@query("win_dense_feature_id", duck="SELECT n, hkey, row_number() OVER (ORDER BY n, hkey) AS feature_id FROM supported")
def win_dense_feature_id(store: Store) -> DataFrame:
    return placed(store.table("supported").select("n", "hkey"), [F.asc("n"), F.asc("hkey")], name="feature_id")


@query("win_nulls_last", duck="SELECT n, ngram, cnt FROM (SELECT n, ngram, cnt, row_number() OVER (PARTITION BY n ORDER BY nullif(cnt, 2) DESC NULLS LAST, ngram) AS r FROM exact) x WHERE r <= 20")
def win_nulls_last(store: Store) -> DataFrame:
    """A bucket sends its own first twenty of each length; the few of all buckets are ranked."""
    order = Window.partitionBy("n").orderBy(F.nullif("cnt", F.lit(2)).desc_nulls_last(), "ngram")
    return spelled(store, keep=first_by_count(20, last=2)).withColumn("r", F.row_number().over(order)).where("r <= 20").drop("r")


@query("win_pandas_rank", duck="SELECT song_id, n, CAST(row_number() OVER (PARTITION BY n ORDER BY coverage DESC, song_id) AS BIGINT) AS place FROM totals")
def win_pandas_rank(store: Store) -> DataFrame:
    return placed(store.table("totals").select("song_id", "n", "coverage"), [F.desc("coverage"), F.asc("song_id")], ("n",)).drop("coverage")



_LEAD = "SELECT song_id, n, pos, hkey, lead(hkey) OVER (PARTITION BY song_id, n ORDER BY pos) AS following FROM win"


@query("win_lead_transition", duck=_LEAD)
def win_lead_transition(store: Store) -> DataFrame:
    """A song's windows lie side by side in its array, so the one that follows is read there; songs that share an id are ordered by a shuffle."""
    if ids_repeat(store):
        return store.sql(_LEAD)
    return followed(store.table("packed_songs"), words_of(store).codec, NS)


query("win_group_head", "SELECT main_genre, song_id FROM (SELECT main_genre, song_id, row_number() OVER (PARTITION BY main_genre ORDER BY song_id DESC) AS r FROM songs) x WHERE r <= 5")
query("win_local_context", "SELECT song_id, pos, count(*) OVER (PARTITION BY song_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS around, CAST(sum(mask) OVER (PARTITION BY song_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS BIGINT) AS mass FROM tokens")
query("win_cumulative", "SELECT n, hkey, round(sum(cnt) OVER (PARTITION BY n ORDER BY cnt DESC, hkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(cnt) OVER (PARTITION BY n), 8) AS cumulative FROM targets")

# --- sorts, limits, sets -----------------------------------------------------------------------------------------------------

query("sort_multi", "SELECT n, hkey, cnt FROM harm ORDER BY cnt DESC, n, hkey LIMIT 40")
query("topk_global", "SELECT ngram, cnt FROM exact ORDER BY cnt DESC, ngram LIMIT 25")
query("limit_offset", "SELECT song_id, artist_id FROM songs ORDER BY song_id LIMIT 20 OFFSET 30")
query("sample_head_tail", "SELECT song_id FROM songs ORDER BY song_id DESC LIMIT 10")
query("sample_per_class", "SELECT main_genre, song_id FROM (SELECT main_genre, song_id, row_number() OVER (PARTITION BY main_genre ORDER BY md5(CAST(song_id AS STRING)), song_id) AS r FROM songs) x WHERE r <= 30")


@query("physical_sort", duck="SELECT n, hkey, song_id, cnt FROM terms")
def physical_sort(store: Store) -> DataFrame:
    """Terms clustered by feature, so that row groups prune."""
    path = f"{store.folder}/terms_by_feature"
    store.table("terms").repartitionByRange(8, "n", "hkey").sortWithinPartitions("n", "hkey", "song_id").write.mode("overwrite").parquet(path)
    return store.spark.read.parquet(path).select("n", "hkey", "song_id", "cnt")


query("union_all", "SELECT song_id, n FROM song_windows WHERE n = 3 UNION ALL SELECT song_id, n FROM song_windows WHERE n = 4")


@query("concat_frames", duck="SELECT n, ngram AS target, hkey FROM exact_targets UNION ALL SELECT n, hkey, NULL FROM targets")
def concat_frames(store: Store) -> DataFrame:
    return store.table("exact_targets").select("n", F.col("ngram").alias("target"), "hkey").unionByName(store.table("targets").select("n", F.col("hkey").alias("target")), allowMissingColumns=True)


query("distinct", "SELECT DISTINCT artist_id, main_genre FROM songs")
query("dedupe_keep_first", "SELECT song_id, track_id FROM (SELECT song_id, track_id, row_number() OVER (PARTITION BY coalesce('s:' || track_id, 'l:' || CAST(song_id AS STRING)) ORDER BY song_id) AS r FROM songs) x WHERE r = 1")


@query("set_intersect_diff", duck="SELECT song_id, len(list_filter(a, lambda x: list_contains(b, x)))::INTEGER AS both, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INTEGER AS only FROM (SELECT song_id, list(hkey) AS a, (SELECT list(hkey) FROM targets WHERE n = 3) AS b FROM terms WHERE n = 3 GROUP BY song_id)")
def set_intersect_diff(store: Store) -> DataFrame:
    """A song's distinct classes and those among the targets are counted where they are, so only counts are grouped."""
    top = store.table("targets").where("n = 3").select("hkey", F.lit(1).alias("hit"))
    rows = store.table("harmonic_counts").join(F.broadcast(top), "hkey", "left")  # TOP_TARGETS
    return rows.groupBy("song_id").agg(F.count("hit").cast("int").alias("both"), (F.count("*") - F.count("hit")).cast("int").alias("only"))
