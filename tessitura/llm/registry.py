"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import blocks, e8dedup, fim, kkshard, knlm, langid, lexsearch, minhash, packing, piecebpe, quality, records, shared, textquality


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, ranges and checksums of every document's record, read back from the files."""
    manifest = records.write(shared.documents(spark, sf_dir), shared.shared_dir(spark, "records"), vocabulary("byte_bpe_50k.json"), "byte", end_id=0)
    return records.read(manifest, digests=True)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; languages of the held-out fold are never seen."""
    docs = shared.documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences."""
    return packing.pack(shared.documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), "word", end_id=1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the production policy's verdict of every document."""
    book = quality.ledger(shared.documents(spark, sf_dir))
    return quality.verdicts(book).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
hot AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hot) GROUP BY rid),
trimmed AS (SELECT rid, list_transform(ls, lambda l: regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS tl FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(ls) AS n_lines,
        len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
        len(list_filter(tl, lambda l: suffix(l, '...') OR suffix(l, '…'))) AS n_ellipsis_lines,
        len(list_filter(tl, lambda l: starts_with(l, '- ') OR starts_with(l, '* ') OR starts_with(l, '• '))) AS n_bullet_lines,
        coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0) AS longest_word,
        len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
        length(t) - length(replace(t, '!', '')) AS n_exclaims
      FROM w JOIN trimmed USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, ((n_words < 50)::INT
        + 2 * (100 * n_repeat_words > 50 * n_words)::INT
        + 4 * (n_words > 1000000)::INT
        + 8 * coalesce(word_chars / nullif(n_words, 0) < 2, false)::INT
        + 16 * coalesce(word_chars / nullif(n_words, 0) > 20, false)::INT
        + 32 * coalesce(n_symbols / nullif(n_words, 0) > 0.1, false)::INT
        + 64 * coalesce(n_dup_lines / nullif(n_lines, 0) > 0.5, false)::INT
        + 128 * coalesce(n_letter_words / nullif(n_words, 0) < 0.5, false)::INT
        + 256 * coalesce(n_ellipsis_lines / nullif(n_lines, 0) > 0.5, false)::INT
        + 512 * coalesce(n_bullet_lines / nullif(n_lines, 0) > 0.9, false)::INT
        + 1024 * (longest_word > 2000)::INT
        + 2048 * coalesce(n_upper_words / nullif(n_words, 0) > 0.5, false)::INT
        + 4096 * coalesce(n_exclaims / nullif(n_words, 0) > 0.5, false)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 8187) = 0 AS kept, fail_bits FROM b
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy does by itself, from the stored ledger."""
    return quality.ablations(shared.staged(quality.ledger(shared.documents(spark, sf_dir)), "ledger"))


ABLATIONS_SQL = f"""{QUALITY_SQL[: QUALITY_SQL.rindex("SELECT doc_id, n_words")].rstrip()},
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('short_words', 8), ('long_words', 16), ('symbols', 32), ('duplicate_lines', 64), ('no_letters', 128), ('ellipses', 256),
    ('bullets', 512), ('endless_word', 1024), ('upper_case', 2048), ('exclaims', 4096)) v(rule, bit)),
j AS (SELECT fail_bits & 8187 AS bits FROM b)
SELECT rule, count(*) FILTER (bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (bits = bit)::BIGINT AS n_failed_alone, count(*) FILTER (bits & ~bit = 0)::BIGINT AS n_kept_without FROM r, j GROUP BY rule
"""


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return e8dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and verdict of every document."""
    return minhash.near_duplicates(shared.documents(spark, sf_dir))


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model log probabilities of every document; the held-out fold is never counted."""
    docs = shared.documents(spark, sf_dir).withColumn("held_out", langid.held_out(folds=7))
    model = knlm.train(docs.where(~F.col("held_out")), shared.shared_dir(spark, "lm"))
    return knlm.score(docs, model, keep=("doc_id", "held_out"))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return blocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of near equal bytes."""
    return kkshard.shard_by_bytes(shared.documents(spark, sf_dir), 8)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces and of the text decoded from them."""
    return piecebpe.encode_documents(shared.documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexsearch.search(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


LEXICAL_SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT rid, doc_id, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM s),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) x GROUP BY rid, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, g),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * n * n_docs) // n_terms) AS m FROM s, g),
q AS (SELECT irow, item_id, term, count(*)::BIGINT AS c FROM (SELECT irow, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS irow, item_id, text FROM benchmark) b) y GROUP BY irow, item_id, term),
r AS (SELECT irow, item_id, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY irow, item_id, rid, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY irow ORDER BY score DESC, doc_id NULLS LAST, rid))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY irow ORDER BY score DESC, doc_id NULLS LAST, rid) <= 20
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document; labels of the held-out fold are never seen."""
    fold = langid.held_out(folds=3, fold=1)
    docs = shared.documents(spark, sf_dir).withColumn("held_out", fold)
    model = textquality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold))
    return textquality.score(docs, model, keep=("doc_id", "held_out"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-the-middle form and of the text rebuilt from it."""
    return fim.digests(shared.documents(spark, sf_dir))


#: By positions in the text instead of lists of units.
FILL_IN_MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR regexp_matches(x, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT doc_id, x, n, form, least(c1, c2) AS a, greatest(c1, c2) - least(c1, c2) AS m FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || substring(x, 1, a) || '<S>' || substring(x, a + m + 1) || '<M>' || substring(x, a + 1, m)
        ELSE '<S>' || substring(x, a + m + 1) || '<P>' || substring(x, 1, a) || '<M>' || substring(x, a + 1, m) END) AS output_sha256,
    sha256(x) AS restored_sha256 FROM f
"""


def queries():
    return {k: f for k, f in globals().items() if k[:2] == "op" and callable(f)} | {"quality_ablations": quality_ablations}


def oracle_sql():
    return {"op4_quality": QUALITY_SQL, "quality_ablations": ABLATIONS_SQL, "op11_lexical_search": LEXICAL_SEARCH_SQL, "op13_fill_in_middle": FILL_IN_MIDDLE_SQL}
