"""Every registered query by its name: columns, types, folds and rows."""

import duckdb
import pytest

from tessitura.llm import registry

COLUMNS = {
    "op1_token_records": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op2_language": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op3_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op4_quality": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op5_embeddings": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op6_minhash": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op7_perplexity": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op8_pages": "page_id:bigint url:string text:string n_chars:bigint",
    "op9_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op10_pieces": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op11_lexical_search": "item_id:bigint rank:int doc_id:bigint score:bigint",
    "op12_quality_classifier": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op13_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
    "quality_ablations": "rule:string n_failed:bigint n_failed_alone:bigint n_kept_without:bigint",
}
TABLE = {"op5_embeddings": "embeddings", "op8_pages": "pages"}
KEY = {"op5_embeddings": "vec_id", "op8_pages": "page_id"}


def test_all_are_here():
    assert set(registry.queries()) == set(COLUMNS) and all(f.__doc__ for f in registry.queries().values())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, corpus_dir, name):
    df = registry.queries()[name](spark, corpus_dir)
    types = {f"{a}:{b}" for a, b in df.dtypes}
    assert set(COLUMNS[name].split()) <= types
    if name in ("op11_lexical_search", "quality_ablations"):
        return
    key = KEY.get(name, "doc_id")
    whole = spark.read.parquet(f"{corpus_dir}/{TABLE.get(name, 'documents')}.parquet").select(key)
    got = df.select(key)
    assert whole.exceptAll(got.distinct() if name == "op3_packing" else got).isEmpty() and (name == "op3_packing" or got.count() == whole.count())


@pytest.mark.parametrize(("name", "folds", "fold"), [("op2_language", 4, 2), ("op7_perplexity", 7, 2), ("op12_quality_classifier", 3, 1)])
def test_folds(spark, corpus_dir, name, folds, fold):
    rows = registry.queries()[name](spark, corpus_dir).select("doc_id", "held_out").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows) and len({r.held_out for r in rows}) == 2


def test_ablations_against_sql(spark, corpus_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{corpus_dir}/documents.parquet'")
    df = registry.queries()["quality_ablations"](spark, corpus_dir)
    found = con.execute(registry.oracle_sql()["quality_ablations"])
    assert [c[0] for c in found.description] == df.columns and sorted(map(tuple, df.collect())) == sorted(found.fetchall())
