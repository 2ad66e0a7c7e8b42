"""Incremental ingest, an extension: new songs stream in, their window counts are appended and summed on reading.

Counts are sums, so every micro-batch appends its own and a retried batch overwrites its folder: results count each song once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators.ngrams import NS, Words, dictionary_of, packed, token_rows, windows


def stream_counts(songs: DataFrame, out_dir: str, checkpoint: str, ns=NS):
    """Start a query over streaming ``songs`` (song_id, tokens) that writes (n, ngram, hkey, cnt) per batch under ``out_dir``."""

    def save(batch: DataFrame, number: int) -> None:
        words = dictionary_of(batch)
        counts = windows(packed(token_rows(batch, words)), Words(words), ns).groupBy("n", "ngram", "hkey").agg(F.count("*").alias("cnt"))
        counts.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return songs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir).groupBy("n", "ngram", "hkey").agg(F.sum("cnt").alias("cnt"))
