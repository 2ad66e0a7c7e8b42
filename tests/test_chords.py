"""Golden values of the chord kernel, worked out by hand from its rules."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessitura.functions import chords as c

GOLDEN = [
    ("C", 0, {0, 4, 7}), ("Bb", 10, {0, 4, 7}), ("Fs", 6, {0, 4, 7}), ("F#", 6, {0, 4, 7}), ("Es", 5, {0, 4, 7}), ("Cb", 11, {0, 4, 7}),
    ("Csus4", 0, {0, 5, 7}), ("Cssus4", 1, {0, 5, 7}), ("Bsus4", 11, {0, 5, 7}), ("Asus2", 9, {0, 2, 7}), ("Amin", 9, {0, 3, 7}), ("Am", 9, {0, 3, 7}),
    ("CM7", 0, {0, 3, 7, 10}), ("Cm7b5", 0, {0, 3, 6, 10}), ("Amin7b5", 9, {0, 3, 7, 10}), ("Bdim", 11, {0, 3, 6}), ("Cdim7", 0, {0, 3, 6, 9}),
    ("Caug", 0, {0, 4, 8}), ("C+", 0, {0, 4, 8}), ("C7", 0, {0, 4, 7, 10}), ("Cmaj7", 0, {0, 4, 7, 11}), ("Cmmaj7", 0, {0, 3, 7, 11}), ("C6", 0, {0, 4, 7}),
    ("C5", 0, {0, 4, 7}), ("Cadd9", 0, {0, 2, 4, 7}), ("C9", 0, {0, 2, 4, 7, 10}), ("Cmaj9", 0, {0, 2, 4, 7, 11}), ("C7b9", 0, {0, 1, 4, 7, 10}),
    ("C7#9", 0, {0, 3, 4, 7, 10}), ("C9sus4", 0, {0, 3, 5, 7, 10}), ("C11", 0, {0, 2, 4, 5, 7, 10}), ("C13", 0, {0, 4, 7, 9, 10}),
    ("C13b9", 0, {0, 1, 4, 7, 8, 10}), ("Eno3d", 4, {0, 7}),
]


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in values.items()) or "x int")
    return row.select(column.alias("out")).first()["out"]


def test_tokens_and_intervals(spark):
    rows = spark.createDataFrame([(t,) for t, _, _ in GOLDEN], "t string")
    got = {r.t: r for r in rows.select("t", c.root_pc("t").alias("root"), c.chord_intervals(c.parse_token("t")["rest"]).alias("i"), c.chord_bits("t").alias("b")).collect()}
    for token, root, intervals in GOLDEN:
        assert got[token].root == root, token
        assert got[token].i == c.mask(*intervals), token
        assert got[token].b.mask == c.mask(*((root + i) % 12 for i in intervals)), token


@pytest.mark.parametrize(
    ("token", "extra", "error"),
    [("C/E", set(), None), ("C/B", {11}, None), ("C/", set(), None), ("C/5", None, "Unknown note: 5"), ("C/G/B", None, "Unknown note: G/B"), ("C/H", None, "Unknown note: H")],
)
def test_bass(spark, token, extra, error):
    got = one(spark, c.chord_bits("t"), t=token)
    assert got.error == error
    assert got.mask == (None if error else c.mask(0, 4, 7, *extra))


def test_channels(spark):
    got = {t: one(spark, c.chord_3channel("t"), t=t) for t in ("Csus2", "C7", "C7#9", "C/E")}
    assert (got["Csus2"].core, got["Csus2"].ext, got["Csus2"].bass) == (c.mask(0, 2, 7), 0, 1)
    assert (got["C7"].core, got["C7"].ext) == (c.mask(0, 4, 7), c.mask(10))
    assert (got["C7#9"].core, got["C7#9"].ext) == (c.mask(0, 4, 7), c.mask(3, 10))
    assert got["C/E"].bass == c.mask(4)


@pytest.mark.parametrize(
    ("ngram", "key", "class_id", "exact"),
    [
        ("C F G", "3:110000001000100010000101000010000001", "H3_71538b04eaf320f0", "3_168891527e9414a8"),
        ("D G A", "3:110000001000100010000101000010000001", "H3_71538b04eaf320f0", "3_96c2f273c9cc55c1"),
        ("C/B F G", "3:110000001000100010000101000010000101", "H3_3ac3080166ac9239", "3_63cf717af6ac4da8"),
        ("G D Emin C", "4:101100000100000010100001000011000000001100000100", "H4_6acd8312eceec65f", "4_e25dbde20f086729"),
        ("C G Amin F", "4:101100000100000010100001000011000000001100000100", "H4_6acd8312eceec65f", "4_28faf7a3b94aa581"),
    ],
)
def test_keys_and_ids(spark, ngram, key, class_id, exact):
    g = F.split("g", " ")
    assert one(spark, c.first_root_normalized_key(g), g=ngram) == key
    assert one(spark, c.harmonic_id(c.first_root_normalized_key(g)), g=ngram) == class_id
    assert one(spark, c.exact_ngram_id(g), g=ngram) == exact
    assert exact == f"{len(ngram.split())}_" + hashlib.sha1(json.dumps(ngram.split(), separators=(",", ":")).encode()).hexdigest()[:16]


def test_transposition_invariance(spark):
    notes = ["C", "Cs", "D", "Eb", "E", "F", "Fs", "G", "Ab", "A", "Bb", "B"]
    rows = spark.createDataFrame([([notes[s] + "min7", notes[(s + 5) % 12] + "9", notes[(s + 7) % 12] + "/" + notes[s].replace("s", "#")],) for s in range(12)], "g array<string>")
    assert rows.select(c.first_root_normalized_key("g").alias("k")).distinct().count() == 1
    assert rows.select(c.canonical_transposition_key(c.ngram_matrix("g")).alias("k")).distinct().count() == 1


def test_key_round_trip(spark):
    key = "3:110000001000100010000101000010000001"
    assert one(spark, c.matrix_key(c.matrix_from_key("k")), k=key) == key
    for bad in ("3:01", "x:01", "3", "1:00000000000x", "0:", "", None):
        assert one(spark, c.matrix_from_key("k"), k=bad) is None
    other = "3:110000001000100010000101000010000101"
    assert one(spark, c.harmonic_key_l2("a", "b"), a=key, b=other) == 1.0
    assert one(spark, c.harmonic_key_l2("a", "b"), a=key, b="1:100010010000") is None


def test_song_text(spark):
    song = "<intro_1> C♯ Bb,F N.C. G <verse_1>  Csus4/D"
    assert one(spark, c.chord_tokens("s"), s=song) == ["C#", "Bb", "F", "G", "Csus4/D"]
    assert one(spark, c.chord_tokens("s"), s=None) == []
    assert one(spark, c.remove_sections("s"), s=song) == "C♯ Bb,F N.C. G Csus4/D"
    assert one(spark, c.n_sections_total("s"), s=song + "<verse_1>") == 3
    assert one(spark, c.n_sections_unique("s"), s=song + "<verse_1>") == 2
    assert one(spark, c.strip_root("s"), s="Csmin7/G Csus4") == "min7/G us4"
    assert one(spark, c.replace_slash_chords("s"), s="C/E G7/B  D") == "C G7 D"
    assert one(spark, c.remove_upper_extensions("s"), s="Cmaj7 Am7b5 Cs/F Dadd9 N.C. E13") == "C Amb5 Cs D N.C. E"
    assert one(spark, c.remove_upper_extensions("s", half_dim_to_dim=True), s="Am7b5 Amin7b5") == "Adim Adim"
    assert one(spark, c.chord_types_from_string("s"), s="C Dmin Emin x F7/A") == ["7", "maj", "min"]
    assert [m.mask for m in one(spark, c.song_matrix("s"), s="C/ F /x G")] == [145, 545, 2180]
    assert [m.core for m in one(spark, c.song_tensor("s"), s="C x F")] == [145, 545]


@pytest.mark.parametrize(("label", "family", "kind"), [("C G C G", "C G loop", "loop"), ("C C C", "C loop", "loop"), ("C F C", "C F loop", "loop"), ("C F G", "C F G", "phrase"), ("C G Amin F", "C G Amin", "phrase"), ("C", "C", "phrase")])
def test_families(spark, label, family, kind):
    got = one(spark, c.progression_family("l"), l=label)
    assert (got.family, got.kind) == (family, kind)


def test_metadata(spark):
    assert one(spark, c.release_year("d"), d="1994-05-01") == 1994
    assert one(spark, c.release_year("d"), d="nan") is None
    assert one(spark, c.decade_value("e", "d"), e="1990.0", d="2001") == 1990
    assert one(spark, c.decade_value("e", "d"), e=None, d="1987") == 1980
    assert one(spark, c.clean_value("v"), v=" NaN ") is None
    assert one(spark, c.genre_tags("v"), v="'pop' 'soft rock'") == ["pop", "soft rock"]
    assert one(spark, c.genre_tags("v"), v="rock, blues") == ["rock", "blues"]
    assert one(spark, c.genre_tags("v"), v="nan") == []
    assert one(spark, c.short_label("e", "i"), e="C F G", i="H3_71538b04eaf320f0") == "C F G (71538b)"


def test_windows(spark):
    assert one(spark, F.size(c.ngram_windows("t", 3)), t=["C", "D"]) == 0
    assert one(spark, c.ngram_windows("t", 2), t=["C", "D", "E"]) == [["C", "D"], ["D", "E"]]
    with pytest.raises(ValueError):
        c.ngram_windows("t", 0)
