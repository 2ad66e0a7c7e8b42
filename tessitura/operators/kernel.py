"""Queries of the chord kernel: every scalar function over the corpus or over derived texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import chords as c
from tessitura.functions import pages
from tessitura.operators.ngrams import DUCK_KEY, MASKS, ROOTS, counts_of, text_key, words_of
from tessitura.plans.register import query
from tessitura.plans.store import Store
from tessitura.sources.songs import ALPHABET

#: Intervals over the root of each chord of the alphabet, worked out by hand for the oracle.
INTERVALS = "145 145 145 145 145 145 137 137 137 137 145 145 137 73 273 161 133 1169 2193 149 145 1173 585 1161".split()
BASS = ["NULL"] * 20 + ["'Bb'"] + ["NULL"] * 3
RESTS = [t.split("/")[0][2 if t[1:2] in ("b", "s") and not t[1:3].startswith("su") else 1 :] for t in ALPHABET]


def _values(*columns: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(row)})" for row in zip(*columns, strict=True)) + ")"


def _quoted(values) -> list[str]:
    return [f"'{v}'" for v in values]


#: Raw texts in the style of song files, made from documents: a tag, separators, sharps and slashes.
RAW_SPARK = "SELECT doc_id, concat('<', source, '> C♯ Bb,F  N.C. G', CAST(doc_id % 7 AS STRING), '/B <', lang, '> Csus4/D Fmaj7') AS chords FROM documents"
RAW_DUCK = "SELECT doc_id, '<' || source || '> C♯ Bb,F  N.C. G' || (doc_id % 7)::VARCHAR || '/B <' || lang || '> Csus4/D Fmaj7' AS chords FROM documents"


def _raw(store: Store) -> DataFrame:
    store.table("documents").createOrReplaceTempView("documents")
    return store.spark.sql(RAW_SPARK)


@query("remove_sections", duck=rf"SELECT doc_id, trim(regexp_replace(regexp_replace(chords, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS out FROM ({RAW_DUCK})")
def remove_sections(store: Store) -> DataFrame:
    return _raw(store).select("doc_id", c.remove_sections("chords").alias("out"))


@query("chord_tokens", duck=f"SELECT doc_id, 'C# Bb F G' || (doc_id % 7)::VARCHAR || '/B Csus4/D Fmaj7' AS out, 6::INTEGER AS n FROM ({RAW_DUCK})")
def chord_tokens(store: Store) -> DataFrame:
    return _raw(store).select("doc_id", F.array_join(c.chord_tokens("chords"), " ").alias("out"), F.size(c.chord_tokens("chords")).alias("n"))


@query("strip_root", duck=r"SELECT song_id, string_agg(regexp_replace(token, '^[A-G](?:[#b]|s)?', ''), ' ' ORDER BY pos) AS out FROM tokens GROUP BY song_id")
def strip_root(store: Store) -> DataFrame:
    return store.table("songs").where(F.size("tokens") > 0).select("song_id", F.array_join(F.transform("tokens", c.strip_root), " ").alias("out"))


@query("remove_upper_extensions", duck="SELECT DISTINCT token, CASE token WHEN 'Fmaj7' THEN 'F' WHEN 'G7' THEN 'G' WHEN 'Cadd9' THEN 'C' WHEN 'C/Bb' THEN 'C' WHEN 'E9' THEN 'E' WHEN 'Adim7' THEN 'Adim' WHEN 'Gmin7' THEN 'Gmin' ELSE token END AS out FROM tokens")
def remove_upper_extensions(store: Store) -> DataFrame:
    return store.table("tokens").select("token").distinct().select("token", c.remove_upper_extensions("token").alias("out"))


@query("replace_slash_chords", duck=rf"SELECT doc_id, trim(regexp_replace(regexp_replace(chords, '/\S+', '', 'g'), '\s+', ' ', 'g')) AS out FROM ({RAW_DUCK})")
def replace_slash_chords(store: Store) -> DataFrame:
    return _raw(store).select("doc_id", c.replace_slash_chords("chords").alias("out"))


@query("n_sections", duck=f"SELECT doc_id, len(regexp_extract_all(chords, '<[^>]+>'))::INTEGER AS total, len(list_distinct(regexp_extract_all(chords, '<[^>]+>')))::INTEGER AS uniq FROM ({RAW_DUCK})")
def n_sections(store: Store) -> DataFrame:
    return _raw(store).select("doc_id", c.n_sections_total("chords").alias("total"), c.n_sections_unique("chords").alias("uniq"))


def _dimension(store: Store) -> DataFrame:
    return store.table("tokens").groupBy("token").agg(F.count("*").alias("uses"))


@query("pitch_class", duck=f"SELECT token, uses, v.root FROM (SELECT token, count(*) AS uses FROM tokens GROUP BY token) JOIN {_values(_quoted(ALPHABET), ROOTS)} v(token, root) USING (token)")
def pitch_class(store: Store) -> DataFrame:
    return _dimension(store).select("token", "uses", c.pitch_class(c.parse_token("token")["root"]).alias("root"))


@query("parse_token", duck=f"SELECT token, v.rest, v.bass FROM (SELECT DISTINCT token FROM tokens) JOIN {_values(_quoted(ALPHABET), _quoted(RESTS), BASS)} v(token, rest, bass) USING (token)")
def parse_token(store: Store) -> DataFrame:
    p = c.parse_token("token")
    return _dimension(store).select("token", p["rest"].alias("rest"), p["bass"].alias("bass"))


@query("chord_type", duck=f"SELECT token, coalesce(nullif(v.rest, ''), 'maj') AS kind FROM (SELECT DISTINCT token FROM tokens) JOIN {_values(_quoted(ALPHABET), _quoted(RESTS))} v(token, rest) USING (token)")
def chord_type(store: Store) -> DataFrame:
    return _dimension(store).select("token", c.chord_type("token").alias("kind"))


@query(
    "chord_types_from_string",
    duck=f"""SELECT song_id, string_agg(DISTINCT coalesce(nullif(v.rest, ''), 'maj'), ',' ORDER BY coalesce(nullif(v.rest, ''), 'maj')) AS kinds
    FROM tokens JOIN {_values(_quoted(ALPHABET), _quoted(RESTS))} v(token, rest) USING (token) GROUP BY song_id""",
)
def chord_types_from_string(store: Store) -> DataFrame:
    kinds = store.table("tokens").select("song_id", "token").distinct().groupBy("song_id").agg(F.array_join(F.collect_set("token"), " ").alias("s"))
    return kinds.select("song_id", F.array_join(c.chord_types_from_string("s"), ",").alias("kinds"))


@query("chord_intervals", duck=f"SELECT token, v.intervals FROM (SELECT DISTINCT token FROM tokens) JOIN {_values(_quoted(ALPHABET), INTERVALS)} v(token, intervals) USING (token)")
def chord_intervals(store: Store) -> DataFrame:
    return _dimension(store).select("token", c.chord_intervals(c.parse_token("token")["rest"]).alias("intervals"))


@query("chord_pitch_bits", duck=f"SELECT token, v.root, v.mask FROM (SELECT DISTINCT token FROM tokens) JOIN {_values(_quoted(ALPHABET), ROOTS, MASKS)} v(token, root, mask) USING (token)")
def chord_pitch_bits(store: Store) -> DataFrame:
    b = c.chord_bits("token")
    return _dimension(store).select("token", b["root"].alias("root"), b["mask"].alias("mask"))


#: Extension channel and bass of each chord of the alphabet, by hand.
EXT = "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 32 16 4 0 68 64 32".split()


@query(
    "chord_3channel",
    duck=f"""SELECT token, (v.mask & ~v.ext & ~(CASE WHEN token = 'C/Bb' THEN 1024 ELSE 0 END))::INTEGER AS core, v.ext, CASE WHEN token = 'C/Bb' THEN 1024 ELSE (1 << v.root) END::INTEGER AS bass
    FROM (SELECT DISTINCT token FROM tokens) JOIN {_values(_quoted(ALPHABET), ROOTS, MASKS, EXT)} v(token, root, mask, ext) USING (token)""",
)
def chord_3channel(store: Store) -> DataFrame:
    t = c.chord_3channel("token")
    return _dimension(store).select("token", t["core"].alias("core"), t["ext"].alias("ext"), t["bass"].alias("bass"))


@query("song_matrix", duck="SELECT song_id, count(*)::INTEGER AS length, sum(mask * (pos + 1))::BIGINT AS digest FROM tokens GROUP BY song_id")
def song_matrix(store: Store) -> DataFrame:
    """Masks of each song in order; the digest weighs each with its place."""
    order = F.array_sort(F.collect_list(F.struct("pos", "mask")))
    songs = store.table("tokens").groupBy("song_id").agg(order.alias("m"))
    total = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["mask"] * (x["pos"] + 1))
    return songs.select("song_id", F.size("m").alias("length"), total.alias("digest"))


@query("song_tensor", duck=f"SELECT song_id, count(*)::INTEGER AS length, sum(bit_count(v.ext))::BIGINT AS extensions FROM tokens JOIN {_values(_quoted(ALPHABET), EXT)} v(token, ext) USING (token) GROUP BY song_id")
def song_tensor(store: Store) -> DataFrame:
    read = _dimension(store).select("token", c.chord_3channel("token").alias("t"))
    frames = store.table("tokens").join(read, "token").select("song_id", "pos", "t")
    return frames.groupBy("song_id").agg(F.count("*").cast("int").alias("length"), F.sum(F.bit_count("t.ext")).cast("long").alias("extensions"))


@query("ngram_matrix", duck="SELECT song_id, pos, mask AS m0, lead(mask, 1) OVER (PARTITION BY song_id ORDER BY pos) AS m1, lead(mask, 2) OVER (PARTITION BY song_id ORDER BY pos) AS m2 FROM tokens QUALIFY m2 IS NOT NULL")
def ngram_matrix(store: Store) -> DataFrame:
    grams = store.table("win").where("n = 3").select("ngram").distinct()
    read = grams.select("ngram", c.ngram_matrix(F.split("ngram", " ")).alias("m"))
    rows = store.table("win").where("n = 3").join(read, "ngram")
    return rows.select("song_id", "pos", *(F.get("m", F.lit(i)).alias(f"m{i}") for i in range(3)))


@query("matrix_key", duck=f"SELECT n, hkey, {DUCK_KEY} AS harmonic_key FROM harm")
def matrix_key(store: Store) -> DataFrame:
    return counts_of(store).keys(("hkey", "harmonic_key"))


@query("matrix_from_key", duck=f"SELECT n, {DUCK_KEY} AS harmonic_key, ('0x' || substr(hkey, 1, 3))::INTEGER AS first, ('0x' || substr(hkey, 7, 3))::INTEGER AS third FROM harm")
def matrix_from_key(store: Store) -> DataFrame:
    """The columns are read from the texts of the keys, many at once."""
    return counts_of(store).keys(("harmonic_key", "first", "third"))


@query("first_root_normalized_key", duck=f"SELECT ngram, {DUCK_KEY} AS harmonic_key FROM exact")
def first_root_normalized_key(store: Store) -> DataFrame:
    """Each distinct token is parsed once; roots and masks are looked up by code, and texts made where the n-grams are counted."""
    return counts_of(store).grams(texts={"ngram": words_of(store).spelled()}, forms=("harmonic_key",)).select("ngram", "harmonic_key")


_SHIFTED = DUCK_KEY.replace("('0x' || substr(hkey, (3 * i + 1)::INTEGER, 3))::INTEGER >> p::INTEGER", "('0x' || substr(hkey, (3 * i + 1)::INTEGER, 3))::INTEGER >> ((p + 12 - s) % 12)::INTEGER")


@query("canonical_transposition_key", duck=f"SELECT n, hkey, min({_SHIFTED}) AS canonical FROM harm, range(12) r(s) GROUP BY n, hkey")
def canonical_transposition_key(store: Store) -> DataFrame:
    """Turns of the key's rows are compared as integers, not as text."""
    return counts_of(store).keys(("hkey", "canonical")).select("n", "hkey", "canonical")


@query(
    "harmonic_key_l2",
    duck="""SELECT hkey, round(sqrt(bit_count(xor(('0x' || substr(hkey, 1, 3))::INTEGER, 145)) + bit_count(xor(('0x' || substr(hkey, 4, 3))::INTEGER, 545)) + bit_count(xor(('0x' || substr(hkey, 7, 3))::INTEGER, 2180))), 6) AS distance
    FROM harm WHERE n = 3""",
)
def harmonic_key_l2(store: Store) -> DataFrame:
    """Distance of every class to that of C F G."""
    key = text_key(F.col("hkey"), F.col("n"))
    return store.table("harm").where("n = 3").select("hkey", F.round(c.harmonic_key_l2(key, F.lit("3:110000001000100010000101000010000001")), 6).alias("distance"))


_DUCK_JSON = """'["' || replace(ngram, ' ', '","') || '"]'"""


@query("exact_ngram_id", duck=f"SELECT ngram, n || '_' || substr(sha1({_DUCK_JSON}), 1, 16) AS exact_ngram_id FROM exact")
def exact_ngram_id(store: Store) -> DataFrame:
    """The JSON of an n-gram is joined from its tokens', no text is split."""
    words = words_of(store)
    rows = counts_of(store).grams(texts={"ngram": words.spelled(), "json": ([x[1:-1] for x in words.json], ",")})
    digest = F.substring(F.sha1(F.concat(F.lit("["), "json", F.lit("]")).cast("binary")), 1, 16)
    return rows.select("ngram", F.concat(F.col("n").cast("string"), F.lit("_"), digest).alias("exact_ngram_id"))


DUCK_ID = f"'H' || n || '_' || substr(sha1({DUCK_KEY}), 1, 16)"


def class_id():
    return c.harmonic_id(text_key(F.col("hkey"), F.col("n")))


@query("harmonic_id", duck=f"SELECT hkey, n, {DUCK_ID} AS harmonic_id FROM harm")
def harmonic_id(store: Store) -> DataFrame:
    return counts_of(store).keys(("hkey", "harmonic_key")).select("hkey", "n", c.harmonic_id("harmonic_key").alias("harmonic_id"))


@query("ngram_label", duck="SELECT song_id, pos, ngram AS label FROM win WHERE n = 4")
def ngram_label(store: Store) -> DataFrame:
    grams = store.table("songs").select("song_id", F.posexplode(c.ngram_windows("tokens", 4)).alias("pos", "g"))
    return grams.select("song_id", "pos", c.ngram_label("g").alias("label"))


#: For every length: tokens that equal themselves moved by 1, 2 or 3 places repeat a phrase of so many.
DUCK_FAMILY = """CASE WHEN t[2:len(t)] = t[1:len(t) - 1] THEN t[1] || ' loop' WHEN t[3:len(t)] = t[1:len(t) - 2] THEN t[1] || ' ' || t[2] || ' loop'
    WHEN len(t) > 3 AND t[4:len(t)] = t[1:len(t) - 3] THEN t[1] || ' ' || t[2] || ' ' || t[3] || ' loop' ELSE t[1] || ' ' || t[2] || ' ' || t[3] END"""


@query("progression_family", duck=f"SELECT ngram, {DUCK_FAMILY} AS family, CASE WHEN suffix(family, 'loop') THEN 'loop' ELSE 'phrase' END AS kind FROM (SELECT ngram, string_split(ngram, ' ') AS t FROM exact)")
def progression_family(store: Store) -> DataFrame:
    """Repeats are found on the codes of each n-gram, no text is split."""
    words = words_of(store)
    codes = [f"c{i}" for i in range(8)]
    rows = counts_of(store).grams().select("n", words.text().alias("ngram"), *(x.alias(name) for x, name in zip(words.codec.columns(), codes, strict=True)))

    def tiles(p: int):
        same = F.lit(True)
        for i in range(p, 8):
            same = same & ((F.col(codes[i]) < 0) | (F.col(codes[i]) == F.col(codes[i - p])))
        return same  # every n-gram is longer than p

    first = lambda k: F.concat_ws(" ", *(F.get(words.tokens, F.col(x)) for x in codes[:k]))
    family = F.when(tiles(1), F.concat(first(1), F.lit(" loop"))).when(tiles(2), F.concat(first(2), F.lit(" loop"))).when((F.col("n") > 3) & tiles(3), F.concat(first(3), F.lit(" loop"))).otherwise(first(3))
    return rows.select("ngram", family.alias("family"), F.when(tiles(1) | tiles(2) | ((F.col("n") > 3) & tiles(3)), "loop").otherwise("phrase").alias("kind"))


@query("short_label", duck=f"SELECT example || ' (' || substr(split_part({DUCK_ID}, '_', 2), 1, 6) || ')' AS label FROM harm")
def short_label(store: Store) -> DataFrame:
    found = counts_of(store).classes(("harmonic_key",), words_of(store).spelled())
    return found.select(F.concat("example", F.lit(" ("), F.substring(F.sha1(F.col("harmonic_key").cast("binary")), 1, 6), F.lit(")")).alias("label"))


@query("release_year", duck="SELECT song_id, substr(release_date, 1, 4)::INTEGER AS year FROM songs")
def release_year(store: Store) -> DataFrame:
    return store.table("songs").select("song_id", c.release_year("release_date").alias("year"))


@query("decade_value", duck="SELECT song_id, decade AS derived, (decade + CASE WHEN song_id % 2 = 0 THEN 10 ELSE 0 END)::INTEGER AS explicit FROM songs")
def decade_value(store: Store) -> DataFrame:
    text = F.when(F.col("song_id") % 2 == 0, F.concat((F.col("decade") + 10).cast("string"), F.lit(".0")))
    return store.table("songs").select("song_id", c.decade_value(F.lit(None).cast("string"), "release_date").alias("derived"), c.decade_value(text, "release_date").alias("explicit"))


@query("clean_value", duck="SELECT song_id, CASE WHEN lower(trim(x)) NOT IN ('', 'nan') THEN trim(x) END AS out FROM (SELECT song_id, CASE song_id % 4 WHEN 0 THEN ' NaN ' WHEN 1 THEN '  ' WHEN 2 THEN ' ' || main_genre END AS x FROM songs)")
def clean_value(store: Store) -> DataFrame:
    k = F.col("song_id") % 4
    x = F.when(k == 0, " NaN ").when(k == 1, "  ").when(k == 2, F.concat(F.lit(" "), "main_genre"))
    return store.table("songs").select("song_id", c.clean_value(x).alias("out"))


@query("genre_tags", duck="SELECT song_id, main_genre || '|' || artist_id AS tags FROM songs")
def genre_tags(store: Store) -> DataFrame:
    return store.table("songs").select("song_id", F.array_join(c.genre_tags("genres"), "|").alias("tags"))


@query("parse_track_id", duck=r"SELECT page_id, regexp_extract(url || '/track/' || lpad(page_id::VARCHAR, 22, '0') || '?si=1', '([A-Za-z0-9]{22})(?:[?/]|$)', 1) AS track FROM pages")
def parse_track_id(store: Store) -> DataFrame:
    text = F.concat("url", F.lit("/track/"), F.lpad(F.col("page_id").cast("string"), 22, "0"), F.lit("?si=1"))
    return store.table("pages").select("page_id", F.regexp_extract(text, "([A-Za-z0-9]{22})(?:[?/]|$)", 1).alias("track"))


@query(
    "html_meta",
    duck="""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset,
    nullif(trim(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)), '') AS description, nullif(trim(regexp_extract(html, '<meta name="viewport" content="([^"]*)"', 1)), '') AS viewport FROM pages""",
)
def html_meta(store: Store) -> DataFrame:
    """Title and meta attributes of pages."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    charset = F.get(F.array_compact(F.transform(pages.meta_tags("html"), lambda t: pages.attribute(t, "charset"))), F.lit(0)).alias("charset")
    return store.table("pages").select("page_id", title, charset, *(pages.html_meta("html", "name", x).alias(x) for x in ("description", "viewport")))
