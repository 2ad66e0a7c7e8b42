"""Tokens, windows, vocabularies and song terms: the base tables of the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import chords
from tessitura.operators import counting
from tessitura.plans.ranking import placed
from tessitura.plans.store import Store, table
from tessitura.sources.songs import ALPHABET, UNREADABLE, songs_from_documents

#: N-gram lengths of the vocabularies, the song index and all analyses over them.
NS = (3, 4, 5, 6, 7, 8)
#: Least corpus count of an indexed class.
SUPPORT = 5

#: Hand-worked roots and masks of the alphabet, for the oracle only.
ROOTS = "0 7 2 9 4 5 9 4 2 11 10 6 1 11 4 2 9 7 5 0 0 4 9 7".split()
MASKS = "145 2180 580 530 2320 545 529 2192 548 2116 1060 1090 274 2084 273 644 2576 2212 561 149 1169 2388 585 1188".split()


def _alphabet(dirty: bool) -> str:
    rows = list(zip(range(24), ALPHABET, ROOTS, MASKS, ["NULL"] * 24, strict=True))
    if dirty:
        rows[-1] = (23, UNREADABLE, "NULL", "NULL", "'Unknown note: H'")
    return "SELECT * FROM (VALUES " + ", ".join(f"({b}, '{t}', {r}, {m}, {e})" for b, t, r, m, e in rows) + ") a(b, token, root, mask, error)"


def _duck_tokens(dirty: bool) -> str:
    return rf"""SELECT song_id, pos, a.token, a.root, a.mask, a.error FROM (
        SELECT doc_id AS song_id, unnest(ws) AS word, (unnest(range(len(ws))))::INTEGER AS pos FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents)) w
        JOIN ({_alphabet(dirty)}) a ON a.b = ('0x' || substr(md5(word), 1, 2))::INTEGER % 24"""


def _duck_windows(tokens: str, ns) -> str:
    top = max(ns)
    leads = ", ".join(f"lead({c}, {i}) OVER s AS {c[0]}{i}" for i in range(top) for c in ("token", "mask", "error"))

    def part(n: int) -> str:
        label = " || ' ' || ".join(f"t{i}" for i in range(n))
        key = " || ".join(f"format('{{:03x}}', ((m{i} << (12 - root)) | (m{i} >> root)) & 4095)" for i in range(n))
        error = f"coalesce({', '.join(f'e{i}' for i in range(n))})"
        return f"SELECT song_id, {n} AS n, pos, {label} AS ngram, CASE WHEN {error} IS NULL THEN {key} END AS hkey, {error} AS error FROM l WHERE t{n - 1} IS NOT NULL"

    return f"WITH l AS (SELECT song_id, pos, root, {leads} FROM {tokens} WINDOW s AS (PARTITION BY song_id ORDER BY pos)) " + " UNION ALL ".join(map(part, ns))


DUCK_SONGS = """SELECT doc_id AS song_id, source AS artist_id, lang AS main_genre, CASE WHEN doc_id % 3 = 0 THEN 'rock ' || (doc_id % 4) END AS rock_genre,
    (1950 + 10 * (doc_id % 8))::INTEGER AS decade, (1950 + 10 * (doc_id % 8) + doc_id % 10) || '-01-01' AS release_date, '''' || lang || ''' ''' || source || '''' AS genres,
    CASE WHEN doc_id % 5 <> 0 THEN 't' || (doc_id % 700) END AS track_id FROM documents"""


@table("songs", duck=DUCK_SONGS)
def songs(store: Store) -> DataFrame:
    return songs_from_documents(store.table("documents"))


#: Packed n-grams: three codes of tokens (plus one, 0 for none) of so many bits in each of three integers.
BITS = 21
MOST_TOKENS = (1 << BITS) - 2


def dictionary_of(songs: DataFrame) -> DataFrame:
    """token, code, root, mask and error of every distinct token, parsed once. Codes follow the order of the tokens' text, so that packed
    n-grams sort like their text."""
    distinct = songs.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    coded = placed(distinct, [F.col("token").asc()], name="code")
    read = coded.select("token", (F.col("code") - 1).cast("int").alias("code"), chords.chord_bits("token").alias("c"))
    return read.select("token", "code", "c.root", "c.mask", "c.error")


@table("dictionary")
def dictionary(store: Store) -> DataFrame:
    return dictionary_of(store.table("songs"))


def token_rows(songs: DataFrame, words: DataFrame) -> DataFrame:
    """song_id, pos, token, code, root, mask and error of every token; the join is a broadcast where the dictionary is small enough for
    Spark's threshold."""
    return songs.select("song_id", F.posexplode("tokens").alias("pos", "token")).join(words, "token").select("song_id", "pos", "token", "code", "root", "mask", "error")


@table("tokens", duck=_duck_tokens(False), view=True)
def tokens(store: Store) -> DataFrame:
    """A view: some tens of bytes a token, made again from the songs where needed."""
    return token_rows(store.table("songs"), store.table("dictionary"))


@table("dirty_songs")
def dirty_songs(store: Store) -> DataFrame:
    """Some five bits a token as a file, so that texts are cut into words once."""
    return songs_from_documents(store.table("documents"), dirty=True).select("song_id", "tokens")


@table("dirty_dictionary")
def dirty_dictionary(store: Store) -> DataFrame:
    return dictionary_of(store.table("dirty_songs"))


@table("dirty_tokens", duck=_duck_tokens(True), view=True)
def dirty_tokens(store: Store) -> DataFrame:
    return token_rows(store.table("dirty_songs"), store.table("dirty_dictionary"))


@table("packed_songs")
def packed_songs(store: Store) -> DataFrame:
    """song_id and the codes of its tokens in order, of songs that have any: looked up in place, without a shuffle."""
    return counting.coded(store.table("songs"), words_of(store).names)


@table("dirty_packed")
def dirty_packed(store: Store) -> DataFrame:
    return counting.coded(store.table("dirty_songs"), words_of(store, "dirty_dictionary").names)


def packed(tokens: DataFrame) -> DataFrame:
    """song_id and the codes of its tokens in order: windows come from this array without a shuffle."""
    rows = tokens.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("t"))
    return rows.select("song_id", F.transform("t", lambda x: x["code"]).alias("codes"))


class Words:
    """The dictionary as literal arrays for expressions: each distinct token is parsed once, on reading its code nothing is parsed."""

    def __init__(self, words: DataFrame):
        rows = words.withColumn("json", F.to_json(F.array("token"))).orderBy("code").limit(MOST_TOKENS + 1).collect()
        if len(rows) > MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} distinct tokens: these are no chords")
        literal = lambda name, kind: F.split(F.lit("\x01".join("" if r[name] is None else str(r[name]) for r in rows)), "\x01").try_cast(f"array<{kind}>")
        self.tokens, self.errors = literal("token", "string"), literal("error", "string")
        self.roots, self.masks = literal("root", "int"), literal("mask", "int")
        self.readable = all(r["mask"] is not None for r in rows)
        self.names, self.json = [r["token"] for r in rows], [r["json"] for r in rows]
        self.codec = counting.Codec([r["root"] for r in rows], [r["mask"] for r in rows])

    def text(self, head: str = "w"):
        """The text of the n-gram in the lanes of :mod:`counting`."""
        return F.concat_ws(" ", *(F.get(self.tokens, c) for c in self.codec.columns(head)))

    def spelled(self) -> tuple[list[str], str]:
        """The tokens and what stands between them, for :meth:`counting.Counts.grams`: in large numbers text is made there, by column."""
        return self.names, " "

    def error(self, code):
        return F.nullif(F.get(self.errors, code), F.lit(""))


def words_of(store: Store, name: str = "dictionary") -> Words:
    if (key := f"words of {name}") not in store.kept:
        store.kept[key] = Words(store.table(name))
    return store.kept[key]


def counts_of(store: Store, ns=NS, owner: str | None = None, songs: DataFrame | None = None, dirty: bool = False, turn: tuple[int, int] = (0, 1), carried: str | None = None) -> counting.Counts:
    """The counts of the store's songs (or of ``songs``, packed) for the lengths ``ns``; ``turn`` as in :func:`counting.dealt`."""
    name = "dirty_packed" if dirty else "packed_songs"
    songs = store.table(name) if songs is None else songs
    return counting.Counts(songs, words_of(store, "dirty_dictionary" if dirty else "dictionary").codec, positions(store), ns, owner, turn, carried)


def positions(store: Store) -> int:
    """Chords of all songs."""
    if "positions" not in store.kept:
        store.kept["positions"] = store.table("packed_songs").agg(F.sum(F.size("codes").cast("long"))).first()[0] or 0
    return store.kept["positions"]


#: Tables that hold rows for every window are kept in corpora of at most so many chords; in larger ones they are views, counted again by one
#: shuffle where needed, since as files they are several times the input.
KEPT_POSITIONS = 5_000_000


def _small(store: Store) -> bool:
    return positions(store) <= KEPT_POSITIONS


#: In larger corpora sums by song come from so many rounds, one after the other, so that only a part of the windows lies in shuffle files.
ROUNDS = 4


def summed(store: Store, name: str, of) -> DataFrame:
    """o and the sums by song that ``of`` makes of :class:`counting.Counts`. A round's sums, a row a song, are a file before the next begins."""
    if _small(store):
        return of(counts_of(store, owner="song_id"))
    rows = [store.keep(f"{name}_{k}", of(counts_of(store, owner="song_id", turn=(k, ROUNDS)))) for k in range(ROUNDS)]
    return reduce(DataFrame.unionAll, rows).groupBy("o").agg(*(F.sum(c).alias(c) for c in rows[0].columns if c != "o"))


_LANES = lambda of: F.array(*(F.lit(sum(of(s) << 12 * k for k in range(5))).cast("long") for s in range(12)))


def turned(x, step):
    """Up to five masks of 12 bits in one integer, each moved up by ``step`` pitch classes at once."""
    up = F.call_function("shiftleft", x, step).bitwiseAND(F.get(_LANES(lambda s: chords.FULL ^ ((1 << s) - 1)), step))
    return up.bitwiseOR(F.call_function("shiftrightunsigned", x, 12 - step).bitwiseAND(F.get(_LANES(lambda s: (1 << s) - 1), step)))


def _joined(values, width: int):
    """Integers side by side in one, the first highest."""
    total = F.lit(0).cast("long")
    for k, v in enumerate(reversed(values)):
        total = total.bitwiseOR(F.shiftleft(v.cast("long"), width * k))
    return total


def _kept(width: int, places: int, first: int):
    """By length n: the bits of the places first, first + 1, ... that lie inside a window of n."""
    keep = lambda n: sum(((1 << width) - 1) << width * (places - 1 - k) for k in range(places) if first + k < n)
    return F.get(F.array(*(F.lit(keep(n)).cast("long") for n in range(9))), F.col("n"))


def gram_codes() -> list:
    """The codes that (a, b, c) hold, -1 beyond the end."""
    return [F.shiftright(F.col(name), BITS * k).bitwiseAND((1 << BITS) - 1).cast("int") - 1 for name in "abc" for k in (2, 1, 0)]


def hex_key(n):
    """The text of a class (u, v): three hex digits a chord."""
    digits = lambda x, width: F.lpad(F.lower(F.hex(x)), width, "0")
    return F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.substring(F.concat(digits("u", 15), digits("v", 9)), F.lit(1), 3 * n))


def class_of(hkey) -> list:
    """(u, v) of a class's text."""
    full = F.rpad(hkey, 24, "0")
    return [F.conv(F.substring(full, at, size), 16, 10).cast("long").alias(name) for at, size, name in ((1, 15, "u"), (16, 9, "v"))]


def leads(songs: DataFrame, ns) -> DataFrame:
    """song_id, pos and the codes c0, c1, ... of each position and those after it, null beyond the end."""
    size, top = F.size("codes"), max(ns)
    ahead = [F.slice("codes", F.lit(i + 1), size) for i in range(top)]
    return songs.select("song_id", F.inline(F.arrays_zip(F.sequence(F.lit(0), size - 1), *ahead)).alias("pos", *(f"c{i}" for i in range(top))))


def spread(songs: DataFrame, ns, words: Words | None = None, grams: bool = False, whole: bool = False) -> DataFrame:
    """song_id, pos and n of every window of :func:`packed` songs; for ``grams`` its packed codes (a, b, c: three codes each), for ``words``
    its class (u, v: five and three masks, moved so that the first root is C), null if a token cannot be read (``whole``: no row then).

    A position is packed and turned once for the longest window; shorter ones keep its first bits."""
    rows = leads(songs, ns)
    codes = [F.col(f"c{i}") for i in range(max(ns))]
    wide = [sum((c.isNotNull().cast("int") for c in codes[1:]), F.lit(1)).alias("left")]
    if grams:
        padded = [*(F.coalesce(c + 1, F.lit(0)) for c in codes), *[F.lit(0)] * (9 - len(codes))]
        wide += [_joined(padded[i : i + 3], BITS).alias(name) for i, name in ((0, "a"), (3, "b"), (6, "c"))]
    if words:
        masks = [F.coalesce(F.get(words.masks, c), F.lit(0)) for c in codes] + [F.lit(0)] * (8 - len(codes))
        step = F.pmod(F.lit(12) - F.get(words.roots, codes[0]), F.lit(12))
        unread = F.lit(9) if words.readable else F.coalesce(*(F.when(c.isNotNull() & F.get(words.masks, c).isNull(), i + 1) for i, c in enumerate(codes)), F.lit(9))
        wide += [_joined(masks[:5], 12).alias("u0"), _joined(masks[5:], 12).alias("v0"), step.alias("step"), unread.alias("unread")]
    rows = rows.select("song_id", "pos", *wide)
    if words:
        rows = rows.select(*(c for c in rows.columns if c not in ("u0", "v0", "step")), turned(F.col("u0"), F.col("step")).alias("u"), turned(F.col("v0"), F.col("step")).alias("v"))
    rows = rows.withColumn("n", F.explode(F.array(*map(F.lit, ns)))).where("n <= left AND n < unread" if whole and not words.readable else "n <= left")
    out = [F.col(x).bitwiseAND(_kept(BITS, 3, at)).alias(x) for x, at in (("a", 0), ("b", 3), ("c", 6))] if grams else []
    if words:
        out += [F.when(F.col("n") < F.col("unread"), F.col(x).bitwiseAND(_kept(12, size, at))).alias(x) for x, size, at in (("u", 5, 0), ("v", 3, 5))]
    return rows.select("song_id", "pos", "n", *out)


def windows(songs: DataFrame, words: Words, ns) -> DataFrame:
    """song_id, n, pos, ngram, hkey and error of every window of :func:`packed` songs, as text."""
    codes = gram_codes()[: max(ns)]
    text = F.concat_ws(" ", *(F.get(words.tokens, c) for c in codes))
    error = F.lit(None).cast("string") if words.readable else F.coalesce(*map(words.error, codes))
    rows = spread(songs, ns, words, grams=True)
    return rows.select("song_id", "n", "pos", text.alias("ngram"), hex_key(F.col("n")).alias("hkey"), error.alias("error"))


@table("win", duck=_duck_windows("tokens", NS), view=True)
def win(store: Store) -> DataFrame:
    """A view: the windows of all lengths are some tens of times the tokens, from which they are made again where needed, without a shuffle."""
    return windows(store.table("packed_songs"), words_of(store), NS)


@table("win_dirty", duck=_duck_windows("dirty_tokens", NS), view=True)
def win_dirty(store: Store) -> DataFrame:
    return windows(store.table("dirty_packed"), words_of(store, "dirty_dictionary"), NS)


def classes_of(store: Store, chosen: DataFrame, ns=NS) -> DataFrame:
    """song_id, pos and the columns of ``chosen`` (n, hkey, ...) for every window of a chosen class; they meet on packed keys."""
    at = spread(store.table("packed_songs"), ns, words_of(store), whole=True)
    return at.join(chosen.select("*", *class_of(F.col("hkey"))), ["n", "u", "v"]).drop("u", "v")


def text_key(hkey, n):
    """The row-major bit text of a compact class key."""
    masks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(hkey, 3 * i + 1, F.lit(3)), 16, 10).cast("int"))
    return chords.matrix_key(masks)


DUCK_KEY = "n || ':' || array_to_string(list_transform(range(12), lambda p: array_to_string(list_transform(range(n), lambda i: ((('0x' || substr(hkey, (3 * i + 1)::INTEGER, 3))::INTEGER >> p::INTEGER) & 1)::VARCHAR), '')), '')"


@table("exact", duck="SELECT n, ngram, min(hkey) AS hkey, count(*) AS cnt FROM win GROUP BY n, ngram", view=_small)
def exact(store: Store) -> DataFrame:
    """Text is made after aggregation, from each distinct n-gram's codes."""
    return counts_of(store).grams(texts={"ngram": words_of(store).spelled()}).select("n", "ngram", hex_key(F.col("n")).alias("hkey"), "cnt")


@table("harm", duck="SELECT n, hkey, sum(cnt)::BIGINT AS cnt, count(*) AS n_exact, first(ngram ORDER BY cnt DESC, ngram) AS example FROM exact WHERE hkey IS NOT NULL GROUP BY n, hkey", view=_small)
def harm(store: Store) -> DataFrame:
    """Classes of the exact vocabulary: count, members and the most frequent member, whose text is made last. Codes follow the tokens' text, so
    the least code wins a tie as the least text would."""
    return harm_of(store)


def harm_of(store: Store, ns=NS) -> DataFrame:
    return counts_of(store, ns).classes().select("n", hex_key(F.col("n")).alias("hkey"), "cnt", "n_exact", words_of(store).text("b").alias("example"))


#: The names under which queries ask for all lengths.
table("exact_all", "SELECT n, ngram, hkey, cnt FROM exact", view=True)
table("harm_all", "SELECT n, hkey, cnt, n_exact, example FROM harm", view=True)
table("supported", f"SELECT n, hkey, cnt, example FROM harm WHERE cnt >= {SUPPORT}", view=_small)


@table("terms", duck="SELECT w.song_id, w.n, w.hkey, count(*) AS cnt FROM win w JOIN supported h ON w.n = h.n AND w.hkey = h.hkey GROUP BY w.song_id, w.n, w.hkey", view=_small)
def terms(store: Store) -> DataFrame:
    """Counted by song in the task that holds all windows of a class, and so its support."""
    return counts_of(store, owner="song_id").terms(SUPPORT).select(F.col("o").alias("song_id"), "n", hex_key(F.col("n")).alias("hkey"), "cnt")


@table("song_windows", duck="SELECT song_id, n, count(*) AS total_windows FROM win GROUP BY song_id, n")
def song_windows(store: Store) -> DataFrame:
    """From the songs' sizes, nothing is counted."""
    size = F.size("codes")
    each = F.explode(F.array_compact(F.array(*(F.when(size >= n, F.struct(F.lit(n).alias("n"), (size - (n - 1)).cast("long").alias("total_windows"))) for n in NS))))
    return store.table("packed_songs").select("song_id", each.alias("w")).select("song_id", "w.*")


@table(
    "totals",
    duck="""SELECT s.song_id, s.n, s.total_windows, COALESCE(t.uniq, 0) AS uniq, COALESCE(t.indexed, 0) AS indexed, COALESCE(t.indexed, 0) / s.total_windows AS coverage
    FROM song_windows s LEFT JOIN (SELECT song_id, n, count(*) AS uniq, CAST(sum(cnt) AS BIGINT) AS indexed FROM terms GROUP BY song_id, n) t ON s.song_id = t.song_id AND s.n = t.n""",
)
def totals(store: Store) -> DataFrame:
    """A task adds up all lengths of a song before it sends them, in one row."""
    size = F.size("codes")
    sizes = store.table("packed_songs").groupBy("song_id").agg(*(F.sum(F.greatest(size - (n - 1), F.lit(0)).cast("long")).alias(f"w{n}") for n in NS))
    found = summed(store, "totals", lambda counts: counts.totals(SUPPORT))
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"w{n}").alias("w"), F.coalesce(f"u{n}", F.lit(0).cast("long")).alias("u"), F.coalesce(f"i{n}", F.lit(0).cast("long")).alias("i")) for n in NS))
    rows = sizes.join(found, F.col("song_id") == F.col("o"), "left").select("song_id", F.inline(each)).where("w > 0")
    return rows.select("song_id", "n", F.col("w").alias("total_windows"), F.col("u").alias("uniq"), F.col("i").alias("indexed"), (F.col("i") / F.col("w")).alias("coverage"))


table(
    "dfs",
    """SELECT d.n, d.hkey, d.song_df, c.n_songs, d.song_df / c.n_songs AS df_rate, ln((c.n_songs + 1) / (d.song_df + 1)) + 1 AS idf
    FROM (SELECT n, hkey, count(*) AS song_df FROM terms GROUP BY n, hkey) d JOIN (SELECT n, count(*) AS n_songs FROM song_windows GROUP BY n) c ON d.n = c.n""",
)
_TFIDF = """SELECT t.song_id, t.n, t.hkey, t.cnt, s.total_windows, t.cnt / s.total_windows AS tf_frequency, ln(1 + t.cnt) AS tf_log_count, d.idf, d.df_rate,
        t.cnt / s.total_windows * d.idf AS tfidf_frequency, ln(1 + t.cnt) * d.idf AS tfidf_log_count
    FROM terms t JOIN song_windows s ON t.song_id = s.song_id AND t.n = s.n JOIN dfs d ON t.n = d.n AND t.hkey = d.hkey"""


def _direct(store: Store) -> bool:
    """Whether the index is counted from the songs: in large corpora, unless songs share an id, since windows carry the size of their own song."""
    return not _small(store) and not ids_repeat(store)


@table("tfidf", duck=_TFIDF, view=lambda store: not _direct(store))
def tfidf(store: Store) -> DataFrame:
    """In large corpora a view: a class's df is known where it is counted, and windows carry the size of their song."""
    if not _direct(store):
        return store.sql(_TFIDF)
    rows = counts_of(store, owner="song_id", carried="size").terms(SUPPORT).where("o IS NOT NULL")
    n_songs = F.get(F.array(*(F.lit(songs_of_length(store)[n]).cast("long") for n in NS)), F.col("n") - NS[0])
    rows = rows.select(F.col("o").alias("song_id"), "n", hex_key(F.col("n")).alias("hkey"), "cnt", (F.col("size") - F.col("n") + 1).alias("total_windows"), "df", n_songs.alias("n_songs"))
    rows = rows.selectExpr("song_id", "n", "hkey", "cnt", "total_windows", "cnt / total_windows AS tf_frequency", "ln(1 + cnt) AS tf_log_count", "ln((n_songs + 1) / (df + 1)) + 1 AS idf", "df / n_songs AS df_rate")
    return rows.selectExpr("*", "tf_frequency * idf AS tfidf_frequency", "tf_log_count * idf AS tfidf_log_count")


_NORMS = "SELECT song_id, n, sum(tfidf_frequency * tfidf_frequency) AS nf, sum(tfidf_log_count * tfidf_log_count) AS nl FROM tfidf GROUP BY song_id, n"


def songs_of_length(store: Store) -> dict[int, int]:
    """By length: the songs that have windows of it."""
    if "songs of length" not in store.kept:
        size = F.size("codes")
        store.kept["songs of length"] = store.table("packed_songs").groupBy("song_id").agg(F.max(size).alias("s")).agg(*(F.count_if(F.col("s") >= n).alias(str(n)) for n in NS)).first().asDict()
    return {n: store.kept["songs of length"][str(n)] for n in NS}


def windows_of_length(store: Store) -> dict[int, int]:
    """By length: the windows of all songs."""
    if "windows of length" not in store.kept:
        size = F.size("codes").cast("long")
        found = store.table("packed_songs").agg(*(F.sum(F.greatest(size - (n - 1), F.lit(0).cast("long"))).alias(str(n)) for n in NS)).first().asDict()
        store.kept["windows of length"] = {n: found[str(n)] or 0 for n in NS}
    return store.kept["windows of length"]


def spelled(store: Store, **named) -> DataFrame:
    """n, ngram, cnt and what ``named`` adds (see :meth:`counting.Counts.grams`) of the n-grams of all songs."""
    found = counts_of(store).grams(texts={"ngram": words_of(store).spelled()}, **named)
    return found.drop("u", "v")


def ids_repeat(store: Store) -> bool:
    """Whether songs share an id, so that a song's counts are not all in one place."""
    if "ids repeat" not in store.kept:
        store.kept["ids repeat"] = not store.table("packed_songs").groupBy("song_id").count().where("count > 1").isEmpty()
    return store.kept["ids repeat"]


def norms_of(store: Store, kinds: str) -> DataFrame:
    """song_id, n and nl or nf (``kinds``: l, f) without an index: df is known in the task that holds a class, and only a song's sums leave it."""
    size, zero = F.size("codes"), F.lit(0)
    found = summed(store, f"norms_{kinds}", lambda counts: counts.norms(SUPPORT, songs_of_length(store), kinds))
    each = F.array(*(F.struct(F.lit(n).alias("n"), *(F.col(f"{k}{n}").alias(f"n{k}") for k in kinds)) for n in NS))
    rows = found.select(F.col("o").alias("song_id"), F.inline(each)).where(" OR ".join(f"n{k} > 0" for k in kinds))
    if "f" not in kinds:
        return rows
    sizes = store.table("packed_songs").groupBy(F.col("song_id").alias("s")).agg(F.array(*(F.sum(F.greatest(size - (n - 1), zero)) for n in NS)).alias("w"))
    total = F.get("w", F.col("n") - NS[0])
    return rows.join(sizes, F.col("song_id") == F.col("s")).select("song_id", "n", *((F.col("nf") / (total * total)).alias("nf") if k == "f" else "nl" for k in kinds))


@table("norms", duck=_NORMS)
def norms(store: Store) -> DataFrame:
    return store.sql(_NORMS) if _small(store) else norms_of(store, "fl")


table("norms_log", duck="SELECT song_id, n, nl FROM norms")(lambda store: norms_of(store, "l"))
table("norms_frequency", duck="SELECT song_id, n, nf FROM norms")(lambda store: norms_of(store, "f"))
