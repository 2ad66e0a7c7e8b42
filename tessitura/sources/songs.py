"""Readers and writers of song corpora, and the chord corpus that tests derive from text documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions import chords

#: The raw song file: one row per song.
RAW = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("chords", "release_date", "genres", "decade", "rock_genre", "artist_id", "main_genre", "spotify_song_id", "spotify_artist_id")]
)


def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Song CSV with a header and quoted multi-line fields; ``columns`` and ``limit`` reach the scan."""
    raw = spark.read.schema(RAW).csv(path, header=True, multiLine=True, escape='"')
    raw = raw.select(*columns) if columns else raw
    return raw.limit(limit) if limit is not None else raw


def missing_columns(df: DataFrame, required: set[str]) -> set[str]:
    return required - set(df.columns)


def canonical_songs(raw: DataFrame) -> DataFrame:
    """The raw columns with chords_nosections, release_date as a timestamp and decade as an integer."""
    return raw.withColumns(
        {
            "chords_nosections": chords.remove_sections("chords"),
            "release_date": F.try_to_timestamp("release_date").cast("timestamp_ntz"),
            "decade": chords.decade_value("decade", "release_date"),
        }
    )


def song_metadata(raw: DataFrame) -> DataFrame:
    """Typed metadata of each song; the decade has no fallback here."""
    return raw.select(
        "id",
        "release_date",
        F.substring("release_date", 1, 4).try_cast("int").alias("release_year"),
        F.round(F.col("decade").try_cast("double")).cast("int").alias("decade"),
        *(chords.clean_value(c).alias(c) for c in ("main_genre", "rock_genre", "genres", "artist_id", "spotify_song_id", "spotify_artist_id")),
    )


def songs_from_raw(raw: DataFrame) -> DataFrame:
    """The engine's song table of a raw file."""
    return raw.select(
        F.col("id").alias("song_id"),
        chords.clean_value("artist_id").alias("artist_id"),
        chords.clean_value("main_genre").alias("main_genre"),
        chords.clean_value("rock_genre").alias("rock_genre"),
        chords.decade_value("decade", "release_date").alias("decade"),
        chords.clean_value("release_date").alias("release_date"),
        chords.clean_value("genres").alias("genres"),
        chords.clean_value("spotify_song_id").alias("track_id"),
        chords.chord_tokens("chords").alias("tokens"),
    )


#: The chord alphabet of the derived corpus, by bucket.
ALPHABET = "C G D A E F Amin Emin Dmin Bmin Bb Fs Csmin Bdim Eaug Dsus4 Asus2 G7 Fmaj7 Cadd9 C/Bb E9 Adim7 Gmin7".split()
#: In the dirty variant the last chord cannot be read.
UNREADABLE = "G/H"


def _chords_of(texts: pa.Array, alphabet: pa.Array) -> pa.ListArray:
    """The chords of each text's words; a batch's distinct words are hashed once."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, pa.scalar("", words.type)).to_numpy(zero_copy_only=False)  # blanks at the ends of a text leave empty words
    row = np.repeat(np.arange(len(sizes)), sizes)[real]
    coded = words.filter(pa.array(real)).dictionary_encode()
    bucket = np.array([hashlib.md5(w).digest()[0] % len(alphabet) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int32)
    chord = alphabet.take(pa.array(bucket[coded.indices.to_numpy()]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))), pa.int32()), chord)


def songs_from_documents(docs: DataFrame, dirty: bool = False) -> DataFrame:
    """Each white-space separated word of a document becomes the chord that the first byte of its MD5 picks."""
    alphabet, keep = [*ALPHABET[:-1], UNREADABLE] if dirty else ALPHABET, ("doc_id", "source", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _chords_of(batch.column(len(keep)), pa.array(alphabet, pa.string()))], names=[*keep, "tokens"])

    schema = ", ".join([*(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep), "tokens array<string>"])
    year = F.lit(1950) + 10 * (F.col("doc_id") % 8) + F.col("doc_id") % 10
    return docs.select(*keep, "text").mapInArrow(run, schema).select(
        F.col("doc_id").alias("song_id"),
        F.col("source").alias("artist_id"),
        F.col("lang").alias("main_genre"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("rock "), (F.col("doc_id") % 4).cast("string"))).alias("rock_genre"),
        (F.lit(1950) + 10 * (F.col("doc_id") % 8)).cast("int").alias("decade"),
        F.concat(year.cast("string"), F.lit("-01-01")).alias("release_date"),
        F.concat(F.lit("'"), F.col("lang"), F.lit("' '"), F.col("source"), F.lit("'")).alias("genres"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("t"), (F.col("doc_id") % 700).cast("string"))).alias("track_id"),
        "tokens",
    )


# --- sinks -------------------------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").partitionBy(*partition_by).parquet(path)


def write_report_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """A report as CSV files, one for each partition of ``df``, each with a header."""
    df.write.mode("overwrite").csv(path, header=True, compression="gzip" if gzip else "none")


def upsert(current: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key; a fresh row wins a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.struct(version, "_new")).alias("row"))
    return latest.select("row.*").drop("_new")


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, NaN and infinities as null."""
    safe = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))
