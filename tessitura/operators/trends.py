"""Strata, trends, documents and corpus statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import chords
from tessitura.operators.counting import coded, hits
from tessitura.operators.kernel import DUCK_FAMILY
from tessitura.operators.ngrams import NS, SUPPORT, _direct, counts_of, hex_key, windows_of_length, words_of
from tessitura.plans.register import query
from tessitura.plans.store import Store, table

#: Thresholds, scaled to the derived corpus.
TOP_TARGETS, MIN_WINDOWS, MIN_COUNT, TOP_K, MIN_DOCUMENT_COUNT, ALPHA = 100, 500, 5, 25, 20, 0.5

table("strata", """SELECT song_id, 'decade' AS stype, CAST(decade AS STRING) AS svalue FROM songs WHERE decade IS NOT NULL
    UNION ALL SELECT song_id, 'main_genre', main_genre FROM songs WHERE main_genre IS NOT NULL
    UNION ALL SELECT song_id, 'rock_genre', rock_genre FROM songs WHERE rock_genre IS NOT NULL
    UNION ALL SELECT song_id, 'year', substr(release_date, 1, 4) FROM songs WHERE release_date IS NOT NULL""", view=True)  # fmt: skip
_STRATUM_TOTALS = "SELECT s.stype, s.svalue, w.n, CAST(sum(w.total_windows) AS BIGINT) AS total_windows FROM strata s JOIN song_windows w ON s.song_id = w.song_id GROUP BY s.stype, s.svalue, w.n"
table("stratum_songs", "SELECT stype, svalue, count(*) AS song_count FROM strata GROUP BY stype, svalue")
_TARGETS = f"SELECT n, hkey, cnt, example FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, hkey) AS r FROM harm) x WHERE r <= {TOP_TARGETS}"
_EXACT_TARGETS = f"SELECT n, ngram, hkey, cnt FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, ngram) AS r FROM exact) x WHERE r <= {TOP_TARGETS}"
_HARMONIC_COUNTS = """SELECT s.stype, s.svalue, t.n, t.hkey, CAST(sum(t.cnt) AS BIGINT) AS cnt FROM terms t JOIN targets g ON t.n = g.n AND t.hkey = g.hkey
    JOIN strata s ON t.song_id = s.song_id GROUP BY s.stype, s.svalue, t.n, t.hkey"""
_EXACT_COUNTS = """SELECT s.stype, s.svalue, w.n, w.ngram, min(w.hkey) AS hkey, count(*) AS cnt FROM win w JOIN exact_targets g ON w.n = g.n AND w.ngram = g.ngram
    JOIN strata s ON w.song_id = s.song_id GROUP BY s.stype, s.svalue, w.n, w.ngram"""


class Strata:
    """Songs by their values of all strata: the number of each group of equal values, packed songs with that number, and windows by group. Groups
    are a bounded table: decades, genres and years."""

    NAMES = ("decade", "main_genre", "rock_genre", "year")

    def __init__(self, store: Store):
        songs = store.table("songs").where("song_id IS NOT NULL").select("song_id", "tokens", F.col("decade").cast("string").alias("decade"), "main_genre", "rock_genre", F.substring("release_date", 1, 4).alias("year"))
        size = F.size(F.array_compact("tokens")).cast("long")
        groups = songs.groupBy(*self.NAMES).agg(*(F.sum(F.greatest(size - (n - 1), F.lit(0).cast("long"))).alias(str(n)) for n in NS)).collect()
        spark, kinds = store.spark, ", ".join(f"{x} string" for x in self.NAMES)
        numbered = spark.createDataFrame([(*g[:4], k) for k, g in enumerate(groups)], f"{kinds}, o long")
        same = F.lit(True)
        for x in self.NAMES:
            same = same & F.col(f"c.{x}").eqNullSafe(F.col(f"g.{x}"))
        self.rows = coded(songs, words_of(store).names, ("song_id", *self.NAMES)).alias("c").join(F.broadcast(numbered.alias("g")), same).select("o", "codes")
        #: o, stype and svalue of the strata of each group, and the windows of each stratum.
        self.table = spark.createDataFrame([(k, x, g[x]) for k, g in enumerate(groups) for x in self.NAMES if g[x] is not None], "o long, stype string, svalue string")
        windows: dict[tuple, int] = {}
        for g in groups:
            for x in self.NAMES:
                for n in NS:
                    if g[x] is not None and g[str(n)]:
                        windows[x, g[x], n] = windows.get((x, g[x], n), 0) + g[str(n)]
        self.windows = spark.createDataFrame([(*k, w) for k, w in windows.items()], "stype string, svalue string, n int, total_windows long")


def strata_of(store: Store) -> Strata:
    if "strata by group" not in store.kept:
        store.kept["strata by group"] = Strata(store)
    return store.kept["strata by group"]


@table("stratum_totals", duck=_STRATUM_TOTALS)
def stratum_totals(store: Store) -> DataFrame:
    return strata_of(store).windows if _direct(store) else store.sql(_STRATUM_TOTALS)


@table("leading")
def leading(store: Store) -> DataFrame:
    """The most frequent classes and n-grams of each length, from one count."""
    return counts_of(store).leading(TOP_TARGETS)


@table("targets", duck=_TARGETS)
def targets(store: Store) -> DataFrame:
    return store.table("leading").where("h = 1").select("n", hex_key(F.col("n")).alias("hkey"), "cnt", words_of(store).text().alias("example")) if _direct(store) else store.sql(_TARGETS)


@table("exact_targets", duck=_EXACT_TARGETS)
def exact_targets(store: Store) -> DataFrame:
    return store.table("leading").where("h = 0").select("n", words_of(store).text().alias("ngram"), hex_key(F.col("n")).alias("hkey"), "cnt") if _direct(store) else store.sql(_EXACT_TARGETS)


@table("stratum_hits")
def stratum_hits(store: Store) -> DataFrame:
    """stype, svalue, n, h, k and cnt: the windows of each stratum that are the k-th leading class or n-gram. Targets are sought in the songs, so
    neither terms nor windows are joined."""
    words, strata = words_of(store), strata_of(store)
    found: dict[int, dict[int, list]] = {0: {}, 1: {}}
    for r in store.table("leading").orderBy("n", "h", "r").collect():  # TOP_TARGETS a length
        found[r.h].setdefault(r.n, []).append((r.u, r.v) if r.h else tuple(r[x] for x in words.codec.names()))
    if not found[0]:
        return store.spark.createDataFrame([], "stype string, svalue string, n int, h long, k long, cnt long")
    rows = hits(strata.rows, words.codec, found[1], found[0])
    return rows.join(F.broadcast(strata.table), "o").groupBy("stype", "svalue", "n", "h", "k").agg(F.sum("cnt").alias("cnt"))


def _found(store: Store, h: int) -> DataFrame:
    named = store.table("leading").where(F.col("h") == h).withColumnRenamed("cnt", "all").withColumn("k", F.col("r").cast("long") - 1)
    return store.table("stratum_hits").where(F.col("h") == h).drop("h").join(F.broadcast(named), ["n", "k"])


@table("trend_harmonic_counts", duck=_HARMONIC_COUNTS)
def trend_harmonic_counts(store: Store) -> DataFrame:
    if not _direct(store):
        return store.sql(_HARMONIC_COUNTS)
    return _found(store, 1).where(F.col("all") >= SUPPORT).select("stype", "svalue", "n", hex_key(F.col("n")).alias("hkey"), "cnt")


@table("trend_exact_counts", duck=_EXACT_COUNTS)
def trend_exact_counts(store: Store) -> DataFrame:
    if not _direct(store):
        return store.sql(_EXACT_COUNTS)
    return _found(store, 0).select("stype", "svalue", "n", words_of(store).text().alias("ngram"), hex_key(F.col("n")).alias("hkey"), "cnt")


table("trend_h", """SELECT c.stype, c.svalue, c.n, c.hkey, g.example, c.cnt, t.total_windows, c.cnt / t.total_windows AS frequency
    FROM trend_harmonic_counts c JOIN stratum_totals t ON c.stype = t.stype AND c.svalue = t.svalue AND c.n = t.n LEFT JOIN targets g ON c.n = g.n AND c.hkey = g.hkey""", view=True)  # fmt: skip
table("trend_e", """SELECT c.stype, c.svalue, c.n, c.ngram, c.hkey, c.cnt, t.total_windows, c.cnt / t.total_windows AS frequency
    FROM trend_exact_counts c JOIN stratum_totals t ON c.stype = t.stype AND c.svalue = t.svalue AND c.n = t.n""", view=True)  # fmt: skip
table("document_values", """SELECT song_id, 'main_genre' AS document_type, main_genre AS document_value FROM songs WHERE main_genre IS NOT NULL
    UNION ALL SELECT song_id, 'decade_1950_plus', CAST(decade AS STRING) FROM songs WHERE decade >= 1950""", view=True)  # fmt: skip
_DOCTERMS = f"""SELECT c.document_type, c.document_value, c.document_type || ':' || c.document_value AS document_id, c.n, c.hkey, h.example, h.cnt AS global_count,
        h.cnt / g.total AS global_frequency, c.cnt, t.total_windows, c.cnt / t.total_windows AS frequency, s.song_count
    FROM (SELECT d.document_type, d.document_value, t.n, t.hkey, CAST(sum(t.cnt) AS BIGINT) AS cnt FROM terms t JOIN document_values d ON t.song_id = d.song_id GROUP BY d.document_type, d.document_value, t.n, t.hkey) c
    JOIN (SELECT n, hkey, cnt, example FROM harm WHERE cnt >= {MIN_DOCUMENT_COUNT}) h ON c.n = h.n AND c.hkey = h.hkey
    JOIN (SELECT n, sum(cnt) AS total FROM harm GROUP BY n) g ON c.n = g.n
    JOIN (SELECT d.document_type, d.document_value, w.n, CAST(sum(w.total_windows) AS BIGINT) AS total_windows FROM document_values d JOIN song_windows w ON d.song_id = w.song_id GROUP BY d.document_type, d.document_value, w.n) t
        ON c.document_type = t.document_type AND c.document_value = t.document_value AND c.n = t.n
    JOIN (SELECT document_type, document_value, count(*) AS song_count FROM document_values GROUP BY document_type, document_value) s ON c.document_type = s.document_type AND c.document_value = s.document_value"""


class Documents:
    """The documents of a corpus, a bounded table: genres and decades, the songs and windows of each, and which of them a song's group belongs to."""

    TYPES = ("main_genre", "decade_1950_plus")

    def __init__(self, store: Store):
        songs = store.table("songs").withColumn("d", F.when(F.col("decade") >= 1950, F.col("decade")))
        size = F.when(F.col("song_id").isNotNull(), F.size(F.array_compact("tokens"))).cast("long")
        sums = [F.sum(F.greatest(size - (n - 1), F.lit(0).cast("long"))).alias(str(n)) for n in NS]
        groups = songs.groupBy("main_genre", "d").agg(F.count("*").alias("songs"), *sums).collect()
        groups.sort(key=lambda g: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in (g.main_genre, g.d)))
        self.values = [sorted({g[c] for g in groups} - {None}) for c in ("main_genre", "d")]
        self.of = [np.array([values.index(g[c]) if g[c] is not None else -1 for g in groups], np.int64) for values, c in zip(self.values, ("main_genre", "d"), strict=True)]
        self.songs = [[sum(g.songs for g, x in zip(groups, of, strict=True) if x == k) for k in range(len(values))] for values, of in zip(self.values, self.of, strict=True)]
        self.windows = [{n: [sum(g[str(n)] or 0 for g, x in zip(groups, of, strict=True) if x == k) for k in range(len(values))] for n in NS} for values, of in zip(self.values, self.of, strict=True)]
        spark = store.spark
        numbered = spark.createDataFrame([(g.main_genre, g.d, k) for k, g in enumerate(groups)], "main_genre string, decade int, o long")
        coded_ = coded(songs.select("song_id", "main_genre", F.col("d").alias("decade"), "tokens"), words_of(store).names, ("song_id", "main_genre", "decade")).alias("c")
        same = F.col("c.main_genre").eqNullSafe(F.col("g.main_genre")) & F.col("c.decade").eqNullSafe(F.col("g.decade"))
        self.rows = coded_.join(F.broadcast(numbered.alias("g")), same).select(F.when(F.col("song_id").isNotNull(), F.col("o")).alias("o"), "codes")
        rows = [(t, d, name, str(v), f"{name}:{v}", self.songs[t][d]) for t, name in enumerate(self.TYPES) for d, v in enumerate(self.values[t])]
        self.table = spark.createDataFrame(rows, "t long, d long, document_type string, document_value string, document_id string, song_count long")
        self.sizes = spark.createDataFrame([(n, t, d, w) for t in (0, 1) for n in NS for d, w in enumerate(self.windows[t][n])], "n int, t long, d long, total_windows long")


def documents_of(store: Store) -> Documents:
    if "documents by group" not in store.kept:
        store.kept["documents by group"] = Documents(store)
    return store.kept["documents by group"]


def _document_counts(store: Store):
    return counts_of(store, owner="o", songs=documents_of(store).rows)


def read_windows(store: Store) -> dict[int, int]:
    """By length: the windows of all songs that can be read."""
    if words_of(store).readable:
        return windows_of_length(store)
    if "windows read" not in store.kept:
        store.kept["windows read"] = {r.n: r["read"] for r in counts_of(store).summary().collect()}
    return {n: store.kept["windows read"].get(n, 0) for n in NS}


@table("document_rows")
def document_rows(store: Store) -> DataFrame:
    """Numbers alone, a row for each frequent class and document; text is made where it is asked for."""
    return _document_counts(store).documents(MIN_DOCUMENT_COUNT, documents_of(store).of)


@table("document_terms")
def document_terms(store: Store) -> DataFrame:
    return _document_counts(store).document_terms(MIN_DOCUMENT_COUNT, documents_of(store).of)


def _named(store: Store, rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(documents_of(store).table), ["t", "d"])


def _sized(store: Store, rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(documents_of(store).sizes), ["n", "t", "d"])


@table("docterms", duck=_DOCTERMS, view=lambda store: not _direct(store))
def docterms(store: Store) -> DataFrame:
    """A class's documents are counted in the task that holds its windows: no term of a song leaves it."""
    if not _direct(store):
        return store.sql(_DOCTERMS)
    totals = store.spark.createDataFrame(list(read_windows(store).items()), "n int, whole long")
    rows = _named(store, _sized(store, store.table("document_rows"))).join(F.broadcast(totals), "n")
    return rows.select("document_type", "document_value", "document_id", "n", hex_key(F.col("n")).alias("hkey"), words_of(store).text("b").alias("example"), F.col("total").alias("global_count"),
        (F.col("total") / F.col("whole")).alias("global_frequency"), "cnt", "total_windows", (F.col("cnt") / F.col("total_windows")).alias("frequency"), "song_count")


@table("document_counts")
def document_counts(store: Store) -> DataFrame:
    """How many classes a document has so many times: all that measures of diversity ask."""
    if not _direct(store):
        return store.sql("SELECT document_type, document_value, document_id, n, cnt, count(*) AS f FROM docterms GROUP BY document_type, document_value, document_id, n, cnt")
    return _named(store, _document_counts(store).document_sizes(MIN_DOCUMENT_COUNT, documents_of(store).of)).select("document_type", "document_value", "document_id", "n", "cnt", "f")


query("row_strata", "SELECT song_id, stype, svalue FROM strata")
query("document_values", "SELECT song_id, document_type, document_value FROM document_values")
query("agg_stratum_totals", "SELECT stype, svalue, n, total_windows FROM stratum_totals")
query("agg_stratum_songs", "SELECT stype, svalue, song_count FROM stratum_songs")
query("agg_stratified_counts", "SELECT stype, svalue, n, hkey, cnt FROM trend_harmonic_counts")
query("agg_document_counts", "SELECT document_id, n, hkey, cnt, song_count FROM docterms")
query("top_global_targets", "SELECT n, ngram AS target, cnt FROM exact_targets UNION ALL SELECT n, hkey, cnt FROM targets")
query("supported_targets", f"SELECT h.n, h.hkey, h.cnt, e.ngram AS member FROM harm h JOIN exact e ON h.n = e.n AND h.hkey = e.hkey WHERE h.cnt >= {MIN_DOCUMENT_COUNT}")
query("trend_exact", "SELECT stype, svalue, n, ngram, hkey, cnt, total_windows, round(frequency, 8) AS frequency FROM trend_e")
query("trend_harmonic", "SELECT stype, svalue, n, hkey, example, cnt, total_windows, round(frequency, 8) AS frequency FROM trend_h")
query("trend_comparison", """SELECT e.stype, e.svalue, e.n, e.ngram, e.hkey, e.cnt AS exact_count, h.cnt AS harmonic_count, round(h.frequency / nullif(e.frequency, 0), 6) AS harmonic_to_exact_frequency_ratio
    FROM trend_e e LEFT JOIN trend_h h ON e.stype = h.stype AND e.svalue = h.svalue AND e.n = h.n AND e.hkey = h.hkey""")  # fmt: skip
query("top_by_stratum", f"""SELECT stype, svalue, n, hkey, cnt, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY stype, svalue, n ORDER BY cnt DESC, hkey) AS r FROM trend_h WHERE total_windows >= {MIN_WINDOWS}) x WHERE r <= 5""")

table("shifts", f"""SELECT n, hkey, min(example) AS example, min(decade) AS first_decade, max(decade) AS last_decade, CAST(sum(cnt) AS BIGINT) AS support,
        max(CASE WHEN up = 1 THEN frequency END) AS first_frequency, max(CASE WHEN down = 1 THEN frequency END) AS last_frequency
    FROM (SELECT n, hkey, example, CAST(svalue AS INT) AS decade, cnt, frequency, row_number() OVER (PARTITION BY n, hkey ORDER BY CAST(svalue AS INT)) AS up, row_number() OVER (PARTITION BY n, hkey ORDER BY CAST(svalue AS INT) DESC) AS down
        FROM trend_h WHERE stype = 'decade' AND total_windows >= {MIN_WINDOWS} AND cnt >= {MIN_COUNT}) x GROUP BY n, hkey HAVING count(*) > 1""")  # fmt: skip
table("ranked_shifts", f"""SELECT * FROM (SELECT *, round(last_frequency - first_frequency, 8) AS delta, round(last_frequency / nullif(first_frequency, 0), 6) AS ratio,
        row_number() OVER (PARTITION BY n ORDER BY abs(round(last_frequency - first_frequency, 8)) DESC, hkey) AS r FROM shifts) x WHERE r <= {TOP_K}""", view=True)  # fmt: skip
query("decade_shifts", "SELECT n, hkey, example, first_decade, last_decade, delta, ratio, CAST(r AS BIGINT) AS place FROM ranked_shifts")
query("decade_trajectories", "SELECT t.n, t.hkey, t.svalue AS decade, t.cnt, round(t.frequency, 8) AS frequency FROM trend_h t JOIN ranked_shifts s ON t.n = s.n AND t.hkey = s.hkey WHERE t.stype = 'decade' AND s.r <= 6")

table("lifts", f"""WITH g AS (SELECT n, hkey, example, svalue AS genre, cnt, total_windows, frequency FROM trend_h WHERE stype = 'main_genre' AND total_windows >= {MIN_WINDOWS} AND cnt >= {MIN_COUNT}),
    a AS (SELECT n, hkey, sum(cnt) AS c, sum(total_windows) AS t FROM g GROUP BY n, hkey)
    SELECT g.n, g.hkey, g.example, g.genre, g.cnt, g.frequency, (a.c - g.cnt) / nullif(a.t - g.total_windows, 0) AS other, g.frequency / nullif((a.c - g.cnt) / nullif(a.t - g.total_windows, 0), 0) AS lift
    FROM g JOIN a ON g.n = a.n AND g.hkey = a.hkey""")  # fmt: skip
query("genre_lift", f"""SELECT n, hkey, genre, cnt, lift, CAST(r AS BIGINT) AS place FROM (SELECT n, hkey, genre, cnt, round(lift, 6) AS lift, row_number() OVER (PARTITION BY n, genre ORDER BY round(lift, 6) DESC NULLS LAST, hkey) AS r FROM lifts) x WHERE r <= {TOP_K}""")
table("shares", """SELECT e.n, e.svalue AS decade, e.ngram, e.hkey, e.cnt, e.frequency / nullif(h.frequency, 0) AS share FROM trend_e e JOIN trend_h h ON e.stype = h.stype AND e.svalue = h.svalue AND e.n = h.n AND e.hkey = h.hkey
    WHERE e.stype = 'decade'""")  # fmt: skip
query("exact_share", """SELECT n, decade, ngram, share, CAST(hi AS BIGINT) AS high_rank, CAST(lo AS BIGINT) AS low_rank FROM (SELECT n, decade, ngram, round(share, 6) AS share,
    row_number() OVER (PARTITION BY n ORDER BY round(share, 6) DESC, ngram, decade) AS hi, row_number() OVER (PARTITION BY n ORDER BY round(share, 6), ngram, decade) AS lo FROM shares) x WHERE hi <= 10 OR lo <= 10""")  # fmt: skip
table("representatives", "SELECT n, ngram, hkey FROM (SELECT e.n, e.ngram, e.hkey, row_number() OVER (PARTITION BY e.n ORDER BY e.cnt DESC, e.ngram) AS r FROM exact e JOIN (SELECT n, min(hkey) AS hkey FROM (SELECT n, hkey, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, hkey) AS r FROM targets) t WHERE r = 1 GROUP BY n) b ON e.n = b.n AND e.hkey = b.hkey) x WHERE r <= 10")
table("splits", """SELECT r.n, s.stype, s.svalue, r.ngram, count(*) AS cnt FROM win w JOIN representatives r ON w.n = r.n AND w.ngram = r.ngram JOIN strata s ON w.song_id = s.song_id WHERE s.stype IN ('decade', 'main_genre') GROUP BY r.n, s.stype, s.svalue, r.ngram""")
query("representative_split", "SELECT n, stype, svalue, ngram, cnt, round(cnt / sum(cnt) OVER (PARTITION BY n, stype, svalue), 8) AS share FROM splits")
query("representative_stack", """SELECT n, svalue, CASE WHEN r <= 8 THEN ngram ELSE 'Other' END AS part, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT s.n, s.svalue, s.ngram, s.cnt, dense_rank() OVER (PARTITION BY s.n ORDER BY t.total DESC, s.ngram) AS r
    FROM splits s JOIN (SELECT n, ngram, sum(cnt) AS total FROM splits WHERE stype = 'decade' GROUP BY n, ngram) t ON s.n = t.n AND s.ngram = t.ngram WHERE s.stype = 'decade' AND CAST(s.svalue AS INT) >= 1970) x GROUP BY n, svalue, CASE WHEN r <= 8 THEN ngram ELSE 'Other' END""")  # fmt: skip
for _name, _sign, _order in (("supported_rises", ">", "DESC"), ("supported_declines", "<", "ASC")):
    query(_name, f"SELECT n, hkey, delta, CAST(r2 AS BIGINT) AS place FROM (SELECT n, hkey, delta, row_number() OVER (PARTITION BY n ORDER BY delta {_order}, hkey) AS r2 FROM ranked_shifts WHERE support >= 20 AND delta {_sign} 0) x WHERE r2 <= 15")
query("supported_genre", "SELECT n, genre, hkey, lift, CAST(r AS BIGINT) AS place FROM (SELECT n, genre, hkey, round(lift, 6) AS lift, row_number() OVER (PARTITION BY n ORDER BY round(lift, 6) DESC, hkey, genre) AS r FROM lifts WHERE lift >= 1.2 AND cnt >= 10) x WHERE r <= 15")

query("stopgrams", """SELECT n, hkey, df, rate FROM (SELECT t.n, t.hkey, count(*) AS df, round(count(*) / max(d.docs), 6) AS rate, sum(t.cnt) AS cnt FROM docterms t JOIN (SELECT document_type, n, count(DISTINCT document_id) AS docs FROM docterms GROUP BY document_type, n) d
    ON t.document_type = d.document_type AND t.n = d.n WHERE t.document_type = 'decade_1950_plus' GROUP BY t.n, t.hkey) x WHERE rate >= 0.8 AND cnt >= 20""")  # fmt: skip
_TERM_STATS = """SELECT document_type, n, hkey, total, df, max_count, mean_count, background, ln((docs + 1) / (df + 1)) + 1 AS idf, ln(total) - weighted / total AS entropy,
        CASE WHEN df > 1 THEN (ln(total) - weighted / total) / ln(df) ELSE 0.0 END AS normalized_entropy
    FROM (SELECT t.document_type, t.n, t.hkey, CAST(sum(t.cnt) AS BIGINT) AS total, count(*) AS df, max(t.cnt) AS max_count, avg(t.cnt) AS mean_count, max(t.global_frequency) AS background, sum(t.cnt * ln(t.cnt)) AS weighted, max(d.docs) AS docs
        FROM docterms t JOIN (SELECT document_type, n, count(DISTINCT document_id) AS docs FROM docterms GROUP BY document_type, n) d ON t.document_type = d.document_type AND t.n = d.n GROUP BY t.document_type, t.n, t.hkey) x"""


@table("term_stats", duck=_TERM_STATS, view=lambda store: not _direct(store))
def term_stats(store: Store) -> DataFrame:
    if not _direct(store):
        return store.sql(_TERM_STATS)
    rows = store.table("document_terms")
    docs = rows.where("v < 0").groupBy("n", "t").agg(F.countDistinct("u").alias("docs"))  # a row a length and type
    types = store.spark.createDataFrame(list(enumerate(Documents.TYPES)), "t long, document_type string")
    whole = store.spark.createDataFrame(list(read_windows(store).items()), "n int, windows long")
    rows = rows.where("v >= 0").join(F.broadcast(docs), ["n", "t"]).join(F.broadcast(types), "t").join(F.broadcast(whole), "n")
    return rows.selectExpr("document_type", "n", "u", "v", "total", "df", "max_count", "total / df AS mean_count", "whole / windows AS background", "ln((docs + 1) / (df + 1)) + 1 AS idf", "ln(total) - weighted / total AS entropy",
        "CASE WHEN df > 1 THEN (ln(total) - weighted / total) / ln(df) ELSE 0.0 END AS normalized_entropy").withColumn("hkey", hex_key(F.col("n"))).drop("u", "v")


query("agg_term_stats", "SELECT document_type, n, hkey, total, df, max_count, round(mean_count, 6) AS mean_count, round(background, 8) AS background, round(idf, 8) AS idf, round(entropy, 6) + 0.0 AS entropy, round(normalized_entropy, 6) + 0.0 AS normalized_entropy FROM term_stats")
_SCORED = "SELECT t.document_type, t.document_id, t.n, t.hkey, t.frequency * s.idf AS w_frequency, ln(1 + t.cnt) * s.idf AS w_log FROM docterms t JOIN term_stats s ON t.document_type = s.document_type AND t.n = s.n AND t.hkey = s.hkey"


@table("scored", duck=_SCORED, view=True)
def scored(store: Store) -> DataFrame:
    """In large corpora a row has its class's df with it, so that only the number of documents is looked up."""
    if not _direct(store):
        return store.sql(_SCORED)
    rows = store.table("document_rows")
    docs = rows.groupBy("n", "t").agg(F.countDistinct("d").alias("docs"))  # a row a length and type
    rows = _named(store, _sized(store, rows)).join(F.broadcast(docs), ["n", "t"]).withColumn("idf", F.expr("ln((docs + 1) / (df + 1)) + 1"))
    return rows.select("document_type", "document_id", "n", hex_key(F.col("n")).alias("hkey"), F.expr("cnt / total_windows * idf AS w_frequency"), F.expr("ln(1 + cnt) * idf AS w_log"))


query("doc_tfidf", "SELECT document_id, n, hkey, round(w_frequency, 8) AS w_frequency, round(w_log, 6) AS w_log FROM scored")
query("doc_tfidf_top", f"SELECT document_id, n, hkey, w_log, CAST(r AS BIGINT) AS place FROM (SELECT document_id, n, hkey, round(w_log, 6) AS w_log, row_number() OVER (PARTITION BY document_type, n, document_id ORDER BY round(w_log, 6) DESC, hkey) AS r FROM scored) x WHERE r <= {TOP_K}")
_ENRICHED = f"""WITH v AS (SELECT document_type, n, count(DISTINCT hkey) AS vocabulary FROM docterms GROUP BY document_type, n),
    d AS (SELECT document_type, document_id, n, sum(cnt) AS doc_total FROM docterms GROUP BY document_type, document_id, n), a AS (SELECT document_type, n, sum(cnt) AS all_total FROM docterms GROUP BY document_type, n)
    SELECT t.document_type, t.document_id, t.n, t.hkey, t.cnt, log2(((t.cnt + CAST({ALPHA} AS DOUBLE)) / (d.doc_total + CAST({ALPHA} AS DOUBLE) * v.vocabulary)) / ((s.total - t.cnt + CAST({ALPHA} AS DOUBLE)) / (a.all_total - d.doc_total + CAST({ALPHA} AS DOUBLE) * v.vocabulary))) AS log2_lift
    FROM docterms t JOIN term_stats s ON t.document_type = s.document_type AND t.n = s.n AND t.hkey = s.hkey JOIN d ON t.document_id = d.document_id AND t.n = d.n JOIN a ON t.document_type = a.document_type AND t.n = a.n JOIN v ON t.document_type = v.document_type AND t.n = v.n"""


@table("enriched", duck=_ENRICHED, view=lambda store: not _direct(store))
def enriched(store: Store) -> DataFrame:
    if not _direct(store):
        return store.sql(_ENRICHED)
    rows = store.table("document_rows")
    sums = rows.groupBy("n", "t", "d", "df").agg(F.sum("cnt").alias("c"), F.count("*").alias("k"))  # a few rows a document and length
    by = lambda *keys: sums.groupBy(*keys)
    d, a = by("n", "t", "d").agg(F.sum("c").alias("doc_total")), by("n", "t").agg(F.sum("c").alias("all_total"))
    v = by("n", "t", "df").agg(F.sum("k").alias("k")).groupBy("n", "t").agg(F.sum(F.expr("k div df")).alias("vocabulary"))  # a class has df rows
    rows = _named(store, rows).join(F.broadcast(d), ["n", "t", "d"]).join(F.broadcast(a), ["n", "t"]).join(F.broadcast(v), ["n", "t"])
    lift = f"log2(((cnt + CAST({ALPHA} AS DOUBLE)) / (doc_total + CAST({ALPHA} AS DOUBLE) * vocabulary)) / ((sum_cnt - cnt + CAST({ALPHA} AS DOUBLE)) / (all_total - doc_total + CAST({ALPHA} AS DOUBLE) * vocabulary)))"
    return rows.select("document_type", "document_id", "n", hex_key(F.col("n")).alias("hkey"), "cnt", F.expr(lift).alias("log2_lift"))


query("enrichment", "SELECT document_id, n, hkey, cnt, round(log2_lift, 6) AS log2_lift FROM enriched")
query("enrichment_top", f"SELECT document_id, n, hkey, log2_lift, CAST(r AS BIGINT) AS place FROM (SELECT document_id, n, hkey, round(log2_lift, 6) AS log2_lift, row_number() OVER (PARTITION BY document_id, n ORDER BY round(log2_lift, 6) DESC, hkey) AS r FROM enriched) x WHERE r <= {TOP_K}")

#: From counts of counts: classes of equal count share their ranks, so no group's classes are sorted, and the ten largest merge.
_COUNTED = """SELECT {g}, total, uniq, round(ln(total) - w / total, 6) AS entropy, round(CASE WHEN uniq > 1 THEN (ln(total) - w / total) / ln(uniq) ELSE 0.0 END, 6) AS normalized_entropy,
        round(exp(ln(total) - w / total), 4) AS effective_vocabulary, round(2 * ranked / (uniq * total) - (uniq + 1) / uniq, 6) AS gini, round(top / total, 6) AS top10_share
    FROM (SELECT {g}, sum(f * cnt) AS total, sum(f) AS uniq, sum(f * (cnt * ln(cnt))) AS w, sum(cnt * (f * coalesce(below, 0) + (f * (f + 1)) div 2)) AS ranked, sum(cnt * least(f, greatest(10 - coalesce(above, 0), 0))) AS top
        FROM (SELECT {g}, cnt, f, sum(f) OVER (PARTITION BY {g} ORDER BY cnt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below, sum(f) OVER (PARTITION BY {g} ORDER BY cnt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
            FROM (SELECT {g}, cnt, {f} AS f FROM {t} GROUP BY {g}, cnt) a) b GROUP BY {g}) c"""
_DIVERSITY = """SELECT {g}, CAST(max(total) AS BIGINT) AS total, count(*) AS uniq, round(ln(max(total)) - sum(cnt * ln(cnt)) / max(total), 6) AS entropy,
        round(CASE WHEN count(*) > 1 THEN (ln(max(total)) - sum(cnt * ln(cnt)) / max(total)) / ln(count(*)) ELSE 0.0 END, 6) AS normalized_entropy,
        round(exp(ln(max(total)) - sum(cnt * ln(cnt)) / max(total)), 4) AS effective_vocabulary,
        round(2 * sum(up * cnt) / (count(*) * max(total)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(CASE WHEN down <= 10 THEN cnt ELSE 0 END) / max(total), 6) AS top10_share
    FROM (SELECT {g}, cnt, sum(cnt) OVER (PARTITION BY {g}) AS total, row_number() OVER (PARTITION BY {g} ORDER BY cnt, hkey) AS up, row_number() OVER (PARTITION BY {g} ORDER BY cnt DESC, hkey) AS down FROM {t}) x GROUP BY {g}"""
_ADDED = "CAST(sum(f) AS BIGINT)"
table("decade_diversity_t", _COUNTED.format(g="document_value, n", f=_ADDED, t="(SELECT * FROM document_counts WHERE document_type = 'decade_1950_plus') d"), _DIVERSITY.format(g="document_value, n", t="(SELECT * FROM docterms WHERE document_type = 'decade_1950_plus') d"))
table("genre_diversity_t", _COUNTED.format(g="document_value, n", f=_ADDED, t="(SELECT * FROM document_counts WHERE document_type = 'main_genre') d"), _DIVERSITY.format(g="document_value, n", t="(SELECT * FROM docterms WHERE document_type = 'main_genre') d"))
query("agg_diversity_summary", _COUNTED.format(g="document_id, n", f=_ADDED, t="document_counts"), _DIVERSITY.format(g="document_id, n", t="docterms"))
query("decade_diversity", "SELECT * FROM decade_diversity_t")
query("decade_diversity_slopes", "SELECT n, round(regr_slope(entropy, CAST(document_value AS INT)), 8) AS entropy_slope, round(regr_slope(gini, CAST(document_value AS INT)), 8) AS gini_slope FROM decade_diversity_t GROUP BY n")
query("genre_diversity_ranked", "SELECT document_value, n, entropy, top10_share, CAST(row_number() OVER (PARTITION BY n ORDER BY entropy DESC, document_value) AS BIGINT) AS entropy_rank, CAST(row_number() OVER (PARTITION BY n ORDER BY top10_share DESC, document_value) AS BIGINT) AS concentration_rank FROM genre_diversity_t")
query("agg_entropy", "SELECT document_value, n, entropy, normalized_entropy, effective_vocabulary FROM genre_diversity_t")
query("agg_gini", "SELECT document_value, n, gini FROM genre_diversity_t")
query("agg_top_share", "SELECT document_value, n, top10_share FROM genre_diversity_t")
query("agg_ols_slope", "SELECT n, hkey, round(regr_slope(frequency, CAST(svalue AS DOUBLE)), 10) AS slope FROM trend_h WHERE stype = 'decade' GROUP BY n, hkey HAVING count(*) >= 2")
query("song_length_by_decade", """SELECT decade, count(*) AS songs, round(avg(c), 6) AS mean, median(c) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c), 6) AS p90 FROM (SELECT s.decade, count(t.pos) AS c FROM songs s LEFT JOIN tokens t ON s.song_id = t.song_id GROUP BY s.song_id, s.decade) x GROUP BY decade""")
query("agg_quantile", """SELECT main_genre, median(c) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c), 6) AS p90, min(c) AS least, max(c) AS most FROM (SELECT s.main_genre, count(*) AS c FROM songs s JOIN tokens t ON s.song_id = t.song_id GROUP BY s.song_id, s.main_genre) x GROUP BY main_genre""")
table("decade_vectors", "SELECT CAST(document_value AS INT) AS decade, n, hkey, frequency FROM docterms WHERE document_type = 'decade_1950_plus'", view=True)
_DISTANCE = """SELECT decade, n, round(sum(abs(d)), 8) AS l1, round(sqrt(sum(d * d)), 8) AS l2, round(greatest(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 0.0), 8) AS cosine
    FROM (SELECT coalesce(x.decade, y.decade - 10) AS decade, coalesce(x.n, y.n) AS n, coalesce(x.frequency, 0) AS a, coalesce(y.frequency, 0) AS b, coalesce(y.frequency, 0) - coalesce(x.frequency, 0) AS d
        FROM decade_vectors x FULL OUTER JOIN decade_vectors y ON x.decade = y.decade - 10 AND x.n = y.n AND x.hkey = y.hkey) z WHERE decade BETWEEN 1950 AND 2010 GROUP BY decade, n"""
_OUTER = """SELECT coalesce(x.n, y.n) AS n, coalesce(x.hkey, y.hkey) AS hkey, round(coalesce(y.frequency, 0) - coalesce(x.frequency, 0), 8) AS d FROM (SELECT * FROM decade_vectors WHERE decade = 1950) x FULL OUTER JOIN (SELECT * FROM decade_vectors WHERE decade = 1960) y ON x.n = y.n AND x.hkey = y.hkey"""


@query("decade_vector_distance", duck=_DISTANCE)
def decade_vector_distance(store: Store) -> DataFrame:
    """In large corpora the tasks that count classes add up their part of each sum."""
    if not _direct(store):
        return store.sql(_DISTANCE)
    documents = documents_of(store)
    at = {int(v): k for k, v in enumerate(documents.values[1])}
    pairs = [(v, at.get(v, -1), at.get(v + 10, -1)) for v in sorted({*at, *(v - 10 for v in at)}) if 1950 <= v <= 2010]
    sums = _document_counts(store).document_pairs(MIN_DOCUMENT_COUNT, documents.of[1], pairs, documents.windows[1])
    return sums.selectExpr("CAST(p AS INT) AS decade", "n", "round(l1, 8) AS l1", "round(sqrt(l2), 8) AS l2", "round(greatest(1 - ab / (sqrt(aa) * sqrt(bb)), 0.0), 8) AS cosine")


@query("join_outer_vector_diff", duck=_OUTER)
def join_outer_vector_diff(store: Store) -> DataFrame:
    if not _direct(store):
        return store.sql(_OUTER)
    documents = documents_of(store)
    at = {int(v): k for k, v in enumerate(documents.values[1])}
    found = _document_counts(store).document_beside(MIN_DOCUMENT_COUNT, documents.of[1], at.get(1950, -2), at.get(1960, -2))
    size = store.spark.createDataFrame([(n, *(max(1, w[at[d]]) if d in at else 1 for d in (1950, 1960))) for n, w in documents.windows[1].items()], "n int, w1 long, w2 long")
    return found.join(F.broadcast(size), "n").select("n", hex_key(F.col("n")).alias("hkey"), F.expr("round(b / w2 - a / w1, 8)").alias("d"))


table("top_artists", "SELECT artist_id, songs FROM (SELECT artist_id, songs, row_number() OVER (ORDER BY songs DESC, artist_id) AS r FROM (SELECT artist_id, count(*) AS songs FROM songs WHERE artist_id IS NOT NULL GROUP BY artist_id HAVING count(*) >= 5) a) x WHERE r <= 250")


@query("agg_artist_profile", duck="SELECT s.artist_id, t.n, t.hkey, CAST(sum(t.cnt) AS BIGINT) AS cnt, max(a.songs) AS songs FROM terms t JOIN songs s ON t.song_id = s.song_id JOIN top_artists a ON s.artist_id = a.artist_id GROUP BY s.artist_id, t.n, t.hkey")
def agg_artist_profile(store: Store) -> DataFrame:
    """Terms counted by the number of the artist at once; songs of other artists have none, but count for a class's support."""
    top = store.table("top_artists").withColumn("a", F.row_number().over(Window.orderBy("artist_id")))  # at most 250
    packed = coded(store.table("songs"), words_of(store).names, ("artist_id",)).join(F.broadcast(top.select("artist_id", "a")), "artist_id", "left")
    found = counts_of(store, owner="a", songs=packed).terms(SUPPORT).where("o IS NOT NULL")
    return found.join(F.broadcast(top), F.col("o") == F.col("a")).select("artist_id", "n", hex_key(F.col("n")).alias("hkey"), "cnt", "songs")


query("artist_diversity", _COUNTED.format(g="artist_id, n", f="count(*)", t="(SELECT s.artist_id, t.n, t.hkey, CAST(sum(t.cnt) AS BIGINT) AS cnt FROM terms t JOIN songs s ON t.song_id = s.song_id JOIN top_artists a ON s.artist_id = a.artist_id GROUP BY s.artist_id, t.n, t.hkey) p"), _DIVERSITY.format(g="artist_id, n", t="(SELECT s.artist_id, t.n, t.hkey, CAST(sum(t.cnt) AS BIGINT) AS cnt FROM terms t JOIN songs s ON t.song_id = s.song_id JOIN top_artists a ON s.artist_id = a.artist_id GROUP BY s.artist_id, t.n, t.hkey) p"))
query("report_takeaways", """SELECT n, 'rise' AS kind, hkey, delta AS value FROM (SELECT n, hkey, delta, row_number() OVER (PARTITION BY n ORDER BY delta DESC, hkey) AS k FROM ranked_shifts) x WHERE k = 1
    UNION ALL SELECT n, 'decline', hkey, delta FROM (SELECT n, hkey, delta, row_number() OVER (PARTITION BY n ORDER BY delta, hkey) AS k FROM ranked_shifts) x WHERE k = 1""")  # fmt: skip
query("agg_stratification_audit", """SELECT kind, groups, songs, smallest, round(mean, 6) AS mean, largest, round(singles / groups, 6) AS singleton_rate, round(exp(ln(songs) - w / songs), 4) AS effective_groups FROM (SELECT kind, count(*) AS groups, CAST(sum(c) AS BIGINT) AS songs, min(c) AS smallest, avg(c) AS mean, max(c) AS largest,
    sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS singles, sum(c * ln(c)) AS w FROM (SELECT 'main_genre' AS kind, main_genre AS v, count(*) AS c FROM songs GROUP BY main_genre UNION ALL SELECT 'decade', CAST(decade AS STRING), count(*) FROM songs GROUP BY decade
    UNION ALL SELECT 'artist', artist_id, count(*) FROM songs GROUP BY artist_id UNION ALL SELECT 'genre_decade', main_genre || ':' || CAST(decade AS STRING), count(*) FROM songs GROUP BY main_genre, decade) g GROUP BY kind) x""")  # fmt: skip
query("agg_strata_summary", "SELECT t.stype, t.n, count(*) AS strata, CAST(sum(t.total_windows) AS BIGINT) AS windows, min(t.total_windows) AS least, median(t.total_windows) AS median, max(t.total_windows) AS most, CAST(sum(s.song_count) AS BIGINT) AS songs FROM stratum_totals t JOIN stratum_songs s ON t.stype = s.stype AND t.svalue = s.svalue GROUP BY t.stype, t.n")
query("agg_metadata_profile", "SELECT decade, main_genre, count(*) AS songs, count(rock_genre) AS with_rock_genre, count(track_id) AS with_track, count(DISTINCT artist_id) AS artists FROM songs GROUP BY decade, main_genre")

@table("labelled", duck=f"SELECT n, hkey, example, {DUCK_FAMILY} AS family FROM (SELECT n, hkey, example, string_split(example, ' ') AS t FROM supported)")
def labelled(store: Store) -> DataFrame:
    """Supported classes with the progression family of their example."""
    return store.table("supported").select("n", "hkey", "example", chords.progression_family("example")["family"].alias("family"))


_NS = "array_join(array_sort(collect_set({n})), ',')", "string_agg(DISTINCT {n}::VARCHAR, ',' ORDER BY {n}::VARCHAR)"
_BEST = "max_by({x}, struct({by}, {x}))", "first({x} ORDER BY {by} DESC, {x} DESC)"
_DECADE = "SELECT family, direction, classes, ns, total, best FROM (SELECT l.family, CASE WHEN s.delta > 0 THEN 'rise' ELSE 'decline' END AS direction, count(*) AS classes, {ns} AS ns, CAST(sum(CAST(round(abs(s.delta) * 100000000) AS BIGINT)) AS DOUBLE) / 100000000 AS total, {best} AS best FROM ranked_shifts s JOIN labelled l ON s.n = l.n AND s.hkey = l.hkey GROUP BY l.family, CASE WHEN s.delta > 0 THEN 'rise' ELSE 'decline' END) x"
_GENRE = "SELECT l.genre, f.family, count(*) AS classes, {ns} AS ns, round(max(l.lift), 6) AS best_lift, CAST(sum(l.cnt) AS BIGINT) AS support, {best} AS best FROM lifts l JOIN labelled f ON l.n = f.n AND l.hkey = f.hkey WHERE l.lift >= 1 GROUP BY l.genre, f.family"
table_sql = [_DECADE.format(ns=_NS[k].format(n="s.n"), best=_BEST[k].format(x="s.hkey", by="abs(s.delta)")) for k in (0, 1)]
genre_sql = [_GENRE.format(ns=_NS[k].format(n="l.n"), best=_BEST[k].format(x="l.hkey", by="round(l.lift, 9)")) for k in (0, 1)]
query("decade_families", *table_sql)
query("genre_families", *genre_sql)
query("agg_family_summary", "SELECT family, count(*) AS classes, min(n) AS shortest, max(n) AS longest FROM labelled GROUP BY family")
_FINDINGS = "SELECT {f} AS finding FROM (SELECT l.family, s.first_decade, s.last_decade, s.delta, row_number() OVER (ORDER BY abs(s.delta) DESC, s.n, s.hkey) AS r FROM ranked_shifts s JOIN labelled l ON s.n = l.n AND s.hkey = l.hkey) x WHERE r <= 10"
query("family_findings", _FINDINGS.format(f="concat(family, ' moved by ', format_string('%.4f', 100 * delta), ' points from ', first_decade, ' to ', last_decade)"), _FINDINGS.format(f="family || ' moved by ' || printf('%.4f', 100 * delta) || ' points from ' || first_decade || ' to ' || last_decade"))
