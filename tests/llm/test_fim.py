"""Fill-in-the-middle against a plain version and exact round trips."""

import hashlib

import duckdb

from tessitura.llm import fim, registry
from tests.llm.conftest import CASES

ODD = ["<P>", "a<S>b", "x<M>", "\x00", "a\x00b\r\n c", "é́🦙漢字" * 50, "<P", "'; --", "\U0010ffff", "ab" * 40_000, "\n\n\n"]


def plain_version(doc_id, text, fim_percent=90, spm_percent=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return len(text), "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < spm_percent
    return len(text), "spm" if spm else "psm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_forms_and_round_trip(spark, docs, empty):
    rows = [(i, t) for i, t, _ in CASES] + [(i, t) for k, t in enumerate(ODD) for i in range(100 + 20 * k, 120 + 20 * k)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    want = [(i, *plain_version(i, t)) for i, t in rows]
    out = fim.transform(made)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fim.restore(out).collect()
    assert sorted((tuple(r) for r in back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    digests = sorted((tuple(r) for r in fim.digests(made).collect()), key=key)
    assert digests == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True)), key=key)
    assert fim.digests(docs).count() == len(CASES)
    assert fim.transform(empty).isEmpty() and fim.digests(empty).isEmpty()


def test_rules(spark):
    made = spark.createDataFrame([(i, f"text {i} [m]" if i % 5 == 0 else f"it's {i}") for i in range(200)], "doc_id long, text string")
    rules = fim.Rules("[p]", "['s]", "[m]", fim_percent=100, spm_percent=100)
    out = {r.doc_id: r for r in fim.transform(made, rules).collect()}
    assert all(r.form == ("plain" if i % 5 == 0 else "spm") for i, r in out.items())
    back = {r.doc_id: r.text for r in fim.restore(fim.transform(made, rules), rules).collect()}
    assert back == {r.doc_id: r.text for r in made.collect()}


def test_query_against_sql(spark, corpus_dir):
    df = registry.queries()["op13_fill_in_middle"](spark, corpus_dir)
    assert df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{corpus_dir}/documents.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(registry.oracle_sql()["op13_fill_in_middle"]).fetchall())
