"""The chord language as Column expressions: tokens, pitch-class masks, transposition-invariant keys and ids.

A pitch-class set is a 12-bit mask (bit p: pitch class p, C = 0), an n-gram an array of n masks. All functions take and return
Columns; a token that cannot be read gives a struct with a null mask and an error text, never an exception.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch class of each note name.
NOTES = {
    "C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "Fb": 4, "E#": 5, "F": 5, "F#": 6, "Gb": 6,
    "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11, "Cb": 11, "B#": 0,
}
FULL = 4095


def mask(*classes: int) -> int:
    return sum(1 << p for p in set(classes))


def _text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- song text ---------------------------------------------------------------------------------------------------------------


def squeezed(text) -> Column:
    return F.trim(F.regexp_replace(_text(text), r"\s+", " "))


def remove_sections(text) -> Column:
    """Without ``<...>`` tags, white space squeezed; null stays null."""
    return squeezed(F.regexp_replace(_text(text), "<[^>]+>", " "))


def accidentals(text) -> Column:
    return F.replace(F.replace(_text(text), F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("b"))


def chord_tokens(text) -> Column:
    """The tokens of a song that start like a chord; null text has none."""
    parts = F.split(squeezed(accidentals(F.replace(remove_sections(text), F.lit(","), F.lit(" ")))), " ")
    return F.coalesce(F.filter(parts, lambda t: t.rlike("^[A-G]")), F.array().cast("array<string>"))


def _each(text, change) -> Column:
    """Apply ``change`` to the white-space separated parts of a text and join them again."""
    return F.array_join(F.transform(F.filter(F.split(_text(text), r"\s+"), lambda t: t != ""), change), " ")


def strip_root(text) -> Column:
    return _each(text, lambda t: F.regexp_replace(t, "^[A-G](?:[#b]|s)?", ""))


def replace_slash_chords(text) -> Column:
    return squeezed(F.regexp_replace(_text(text), r"/\S+", ""))


def remove_upper_extensions(text, collapse_major: bool = True, half_dim_to_dim: bool = False) -> Column:
    """Tokens without slash bass, sixths, sevenths and upper extensions; parts that are no chord stay as they are."""
    rewrites = [("min7b5", "dim"), ("m7b5", "dim")] if half_dim_to_dim else []
    rewrites += [("maj7", "maj"), ("min7", "min"), ("m7", "m"), ("[67]", ""), ("(add)?[b#]?(?:9|11|13)", "")]
    rewrites += [("maj$", "")] if collapse_major else []

    def simple(t: Column) -> Column:
        return reduce(lambda c, rule: F.regexp_replace(c, *rule), rewrites, F.regexp_replace(t, "/.*$", ""))

    parts = F.transform(F.filter(F.split(_text(text), r"\s+"), lambda t: t != ""), lambda t: F.when(t.rlike("^[A-G]"), simple(t)).otherwise(t))
    return F.when(_text(text).isNotNull(), F.array_join(F.filter(parts, lambda t: t != ""), " "))


def section_tags(text) -> Column:
    return F.coalesce(F.regexp_extract_all(_text(text), F.lit("<[^>]+>"), F.lit(0)), F.array().cast("array<string>"))


def n_sections_total(text) -> Column:
    return F.size(section_tags(text))


def n_sections_unique(text) -> Column:
    return F.size(F.array_distinct(section_tags(text)))


# --- one token ---------------------------------------------------------------------------------------------------------------


def pitch_class(note) -> Column:
    """Pitch class of a note name, null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    return F.try_element_at(table, _text(note))


def _spelled(token: Column) -> Column:
    """Sharps as ``s``, a leading accidental behind its letter."""
    plain = F.replace(accidentals(F.replace(F.trim(token), F.lit(","), F.lit(" "))), F.lit("#"), F.lit("s"))
    return F.regexp_replace(plain, "^([sb])([A-G])", "$2$1")


def parse_token(token) -> Column:
    """struct(root, rest, bass, error): root with ``#`` or ``b``, rest in lower case, bass as a note name or null."""
    spelled = _spelled(_text(token))
    slash = F.instr(spelled, "/")
    head = F.when(slash > 0, F.trim(F.substring_index(spelled, "/", 1))).otherwise(spelled)
    tail = F.when(slash > 0, F.trim(F.substring(spelled, slash + 1, F.length(spelled))))
    bass = F.nullif(F.regexp_replace(tail, "^([A-G])s$", "$1#"), F.lit(""))
    pattern = "^([A-G])((?:b|s)(?!us))?(.*)$"
    ok = head.rlike("^[A-G]")
    root = F.concat(F.regexp_extract(head, pattern, 1), F.replace(F.regexp_extract(head, pattern, 2), F.lit("s"), F.lit("#")))
    error = F.when(head == "", "Cannot parse token: <empty>").when(~ok, F.concat(F.lit("Cannot parse token: "), head))
    error = error.when(bass.isNotNull() & pitch_class(bass).isNull(), F.concat(F.lit("Unknown note: "), bass))
    return F.struct(F.when(ok, root).alias("root"), F.when(ok, F.lower(F.regexp_extract(head, pattern, 3))).alias("rest"), bass.alias("bass"), error.alias("error"))


def chord_type(token, default_major: str = "maj") -> Column:
    return F.coalesce(F.nullif(F.trim(parse_token(token)["rest"]), F.lit("")), F.lit(default_major))


def chord_types_from_string(text, default_major: str = "maj") -> Column:
    tokens = F.filter(F.split(F.trim(_text(text)), r"\s+"), lambda t: t.rlike("^[A-G]"))
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: chord_type(t, default_major))))


class _Suffix:
    """What a chord suffix says, as conditions."""

    def __init__(self, rest: Column):
        self.rest = rest
        self.seven_major, self.seven_dim = self("maj7"), self("dim7")
        self.seven_flat = self("7") & ~self("add7") & ~self.seven_major & ~self.seven_dim
        self.major = self("maj")
        self.sharp9, self.sharp11 = self("s9") | self("9s"), self("s11") | self("11s")
        self.flat9_strict, self.flat9 = self("b9"), self("b9") | self("9b")
        self.flat13 = self("b13") | self("13b")

    def __call__(self, part: str) -> Column:
        return F.contains(self.rest, F.lit(part))

    def stacked(self, degree: str) -> Column:
        return self(degree) & ~self(f"add{degree}")


def _also(m: Column, condition: Column, add: int = 0, drop: int = 0) -> Column:
    """Where the condition holds, without the pitch classes ``drop`` and then with ``add``. The mask occurs once in the result, so
    that steps in a row stay small."""
    kept = m.bitwiseAND(F.when(condition, FULL & ~drop).otherwise(FULL)) if drop else m
    return kept.bitwiseOR(F.when(condition, add).otherwise(0)) if add else kept


def _tensions(m: Column, s: _Suffix, flat9: Column) -> Column:
    """Sevenths, ninths, elevenths and thirteenths over a mask of intervals."""
    m = _also(m, s.seven_dim, mask(9))
    m = _also(m, s.seven_major, mask(11))
    m = _also(m, s.seven_flat, mask(10))
    no_seventh = ~s.seven_major & ~s.seven_flat
    implied = no_seventh & (s.stacked("9") | s.stacked("11") | s.stacked("13") & ~s.seven_dim)
    m = _also(m, implied & s.major, mask(11))
    m = _also(m, implied & ~s.major, mask(10))
    m = _also(m, s("9") | s.stacked("11") & ~s.sharp11, mask(2))
    m = _also(m, s("11"), mask(5))
    m = _also(m, flat9, mask(1), drop=mask(2))
    m = _also(m, s.sharp9, mask(3), drop=mask(2))
    m = _also(m, s.sharp11, mask(6), drop=mask(5))
    m = _also(m, s("13"), mask(9))
    return _also(m, s.flat13, mask(8), drop=mask(9))


def _intervals(rest: Column, flat9) -> Column:
    s = _Suffix(rest)
    triad = (
        F.when(s("sus2"), mask(0, 2, 7))
        .when(s("sus"), mask(0, 5, 7))
        .when(s("dim") | s("m7b5"), mask(0, 3, 6))
        .when(s("aug") | s("+"), mask(0, 4, 8))
        .when(s("min") | rest.rlike("^m(?!aj)"), mask(0, 3, 7))
        .otherwise(mask(0, 4, 7))
    )
    return _also(_tensions(triad, s, flat9(s)), s("no3"), drop=mask(3, 4)).cast("int")


def chord_intervals(rest) -> Column:
    """Mask of intervals over the root that a suffix (in lower case) spells."""
    return let(_text(rest), lambda r: _intervals(r, lambda s: s.flat9))


def extension_intervals(rest) -> Column:
    """Mask of the intervals of a suffix that are extensions by their spelling."""

    def spelled(r: Column) -> Column:
        s = _Suffix(r)
        return _tensions(F.lit(0), s, s.flat9).cast("int")

    return let(_text(rest), spelled)


def rotated(m: Column, steps: Column) -> Column:
    """A mask moved up by ``steps`` semitones (0 to 11)."""
    return let(m, lambda x: F.call_function("shiftleft", x, steps).bitwiseOR(F.call_function("shiftright", x, F.lit(12) - steps)).bitwiseAND(F.lit(FULL)))


def chord_bits(token, include_bass: bool = True) -> Column:
    """struct(root int, mask int, error string) of a token; root and mask are null with an error."""

    def bits(p: Column) -> Column:
        root, ok = pitch_class(p["root"]), p["error"].isNull()
        m = rotated(chord_intervals(p["rest"]), root)
        if include_bass:
            m = m.bitwiseOR(F.coalesce(F.call_function("shiftleft", F.lit(1), pitch_class(p["bass"])), F.lit(0)))
        return F.struct(F.when(ok, root).alias("root"), F.when(ok, m).alias("mask"), p["error"].alias("error"))

    return let(parse_token(token), bits)


def root_pc(token) -> Column:
    return pitch_class(parse_token(token)["root"])


def chord_3channel(token) -> Column:
    """struct(core, ext, bass, error): masks of the triad, the extensions and the bass (or root)."""

    def channels(p: Column) -> Column:
        s, root, ok = _Suffix(p["rest"]), pitch_class(p["root"]), p["error"].isNull()
        held = F.when(s("sus2"), mask(2)).otherwise(0).bitwiseOR(F.when(s("sus"), mask(5)).otherwise(0))
        spelled = F.bitwise_not(extension_intervals(p["rest"])).bitwiseAND(F.lit(mask(0, 3, 4, 6, 7, 8)))
        tones = _intervals(p["rest"], lambda s: s.flat9_strict)
        inner = tones.bitwiseAND(held.bitwiseOR(spelled))
        outer = tones.bitwiseAND(F.bitwise_not(held.bitwiseOR(spelled)))
        bass = F.call_function("shiftleft", F.lit(1), F.coalesce(pitch_class(p["bass"]), root))
        return F.struct(*(F.when(ok, m).alias(n) for n, m in (("core", rotated(inner, root)), ("ext", rotated(outer, root)), ("bass", bass))), p["error"].alias("error"))

    return let(parse_token(token), channels)


def song_matrix(text) -> Column:
    """Array of chord structs of a song's tokens; a dangling slash is dropped, a part that starts with a slash is no token."""
    parts = F.split(squeezed(accidentals(F.replace(_text(text), F.lit(","), F.lit(" ")))), " ")
    parts = F.transform(parts, lambda t: F.regexp_replace(t, "/$", ""))
    parts = F.filter(parts, lambda t: (t != "") & ~t.startswith("/") & ~t.endswith("/"))
    return F.coalesce(F.transform(parts, lambda t: chord_bits(t)), F.array().cast("array<struct<root:int,mask:int,error:string>>"))


def song_tensor(text) -> Column:
    """Array of channel structs of the parts of a song that start like a chord."""
    parts = F.split(squeezed(accidentals(F.replace(_text(text), F.lit(","), F.lit(" ")))), " ")
    return F.coalesce(F.transform(F.filter(parts, lambda t: t.rlike("^[A-G]")), lambda t: chord_3channel(t)), F.array().cast("array<struct<core:int,ext:int,bass:int,error:string>>"))


# --- n-grams -----------------------------------------------------------------------------------------------------------------


def ngram_windows(tokens, n: int) -> Column:
    """All runs of n elements, none for a shorter array."""
    if n < 1:
        raise ValueError("n must be at least 1")
    t = _text(tokens)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>"))


def ngram_label(ngram) -> Column:
    return F.array_join(_text(ngram), " ")


def ngram_matrix(ngram, include_bass: bool = True) -> Column:
    """Array of masks of an n-gram's tokens."""
    return F.transform(_text(ngram), lambda t: chord_bits(t, include_bass)["mask"])


def matrix_key(masks) -> Column:
    """``n:bits``, row by row of pitch classes and inside each by position; null if a mask is null."""
    m = _text(masks)
    rows = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: F.array_join(F.transform(m, lambda x: F.call_function("shiftright", x, p).bitwiseAND(F.lit(1)).cast("string")), ""))
    return F.when(~F.exists(m, lambda x: x.isNull()), F.concat(F.size(m).cast("string"), F.lit(":"), F.array_join(rows, "")))


def matrix_from_key(key) -> Column:
    """The masks of a key; null for one of a wrong form, length or alphabet."""

    def read(k: Column) -> Column:
        n = F.substring_index(k, ":", 1).try_cast("int")
        ok = k.rlike("^[0-9]{1,3}:[01]*$") & (n > 0) & (F.length(k) - F.instr(k, ":") == 12 * n)
        # Column i of the matrix, its rows from the last to the first, is a mask in binary.
        rows = F.transform(F.sequence(F.lit(11), F.lit(0), F.lit(-1)), lambda p: F.instr(k, ":") + 1 + p * n)
        column = lambda i: F.array_join(F.transform(rows, lambda at: F.substring(k, at + i, F.lit(1))), "")
        return F.when(ok, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(column(i), 2, 10).cast("int")))

    return let(_text(key), read)


def first_root_masks(root, masks) -> Column:
    """Masks moved so that pitch class ``root`` becomes C."""
    steps = F.pmod(F.lit(12) - _text(root), F.lit(12))
    return F.transform(_text(masks), lambda m: rotated(m, steps))


def first_root_normalized_key(ngram, include_bass: bool = True) -> Column:
    """Key of an n-gram after moving its first root to C; null if a token cannot be read."""
    g = _text(ngram)
    return matrix_key(first_root_masks(root_pc(F.try_element_at(g, F.lit(1))), ngram_matrix(g, include_bass)))


def canonical_transposition_key(masks) -> Column:
    """The smallest key over the twelve transpositions: moving all masks turns the key's rows, so the bit text turns by n at a time."""

    def least(p: Column) -> Column:
        turned = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda s: F.concat(F.substring(p["bits"], s * p["n"] + 1, F.length(p["bits"])), F.substring(p["bits"], F.lit(1), s * p["n"])))
        return F.concat(p["n"].cast("string"), F.lit(":"), F.array_min(turned))

    m = _text(masks)
    return let(F.struct(F.size(m).alias("n"), F.substring_index(matrix_key(m), ":", -1).alias("bits")), least)


def harmonic_key_l2(left, right) -> Column:
    """Euclidean distance of two keys' matrices; null if either is malformed or their lengths differ."""

    def distance(p: Column) -> Column:
        bits = F.aggregate(F.zip_with(p["a"], p["b"], lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda acc, x: acc + x)
        return F.when(F.size(p["a"]) == F.size(p["b"]), F.sqrt(bits.cast("double")))

    return let(F.struct(matrix_from_key(left).alias("a"), matrix_from_key(right).alias("b")), distance)


def exact_ngram_id(ngram) -> Column:
    g = _text(ngram)
    return F.concat(F.size(g).cast("string"), F.lit("_"), F.substring(F.sha1(F.to_json(g).cast("binary")), 1, 16))


def harmonic_id(key) -> Column:
    k = _text(key)
    return F.concat(F.lit("H"), F.substring_index(k, ":", 1), F.lit("_"), F.substring(F.sha1(k.cast("binary")), 1, 16))


def progression_family(label, max_phrase_len: int = 3) -> Column:
    """struct(family, kind): ``... loop`` for a label that repeats a phrase of at most ``max_phrase_len`` tokens, the last time perhaps in part, else its first tokens."""
    t = F.split(_text(label), " ")
    n = F.size(t)

    def tiles(p: int) -> Column:
        return (n > p) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get(t, i) == F.get(t, i % p))

    period = reduce(lambda c, p: c.when(tiles(p), p), range(2, max_phrase_len + 1), F.when(tiles(1), 1))
    first = lambda k: F.array_join(F.slice(t, F.lit(1), k), " ")
    return F.when(period.isNotNull(), F.struct(F.concat(first(period), F.lit(" loop")).alias("family"), F.lit("loop").alias("kind"))).otherwise(
        F.struct(first(F.least(n, F.lit(max_phrase_len))).alias("family"), F.lit("phrase").alias("kind"))
    )


def short_label(example, id_) -> Column:
    return F.concat(_text(example), F.lit(" ("), F.substring(F.regexp_replace(_text(id_), "^[^_]*_", ""), 1, 6), F.lit(")"))


# --- song metadata -----------------------------------------------------------------------------------------------------------


def clean_value(value) -> Column:
    v = F.trim(_text(value).cast("string"))
    return F.when(~F.lower(v).isin("", "nan"), v)


def release_year(value) -> Column:
    return F.nullif(F.regexp_extract(clean_value(value), r"^(\d{4})", 1), F.lit("")).cast("int")


def decade_value(decade, release_date) -> Column:
    """The explicit decade, cut to an integer, else the release year's."""
    explicit = clean_value(decade).try_cast("double").cast("int")
    return F.coalesce(explicit, (F.floor(release_year(release_date) / 10) * 10).cast("int"))


def genre_tags(value) -> Column:
    """Quoted names of a list, or the parts of a comma list; null and blank have none."""
    v = clean_value(value)
    quoted = F.regexp_extract_all(v, F.lit("'([^']+)'"), F.lit(1))
    listed = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.size(quoted) > 0, quoted).otherwise(listed), F.array().cast("array<string>"))
