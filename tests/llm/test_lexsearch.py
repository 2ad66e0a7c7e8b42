"""Ranked search against a plain version that scores every document, and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessitura.llm import lexsearch, registry
from tests.llm.conftest import CASES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, bag), n in zip(bags, sizes, strict=True):
            score = 0
            for t in plain_terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_terms():
    for text in ["Ab-c_D é1\x00x\x7fy\x85z w ÀÉ漢 🦙a b", "", None, "\x1c", "İI"]:
        assert [t.decode() for t in lexsearch.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("shard_docs", [7, 1000])
def test_search_by_brute_force(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(lexsearch, "SHARD_DOCS", shard_docs)
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [(r.randrange(-50, 400) if r.random() < 0.95 else None, " ".join(r.choices(words, k=r.choice([1, 3, 10, 60])))) for _ in range(700)]
    docs += docs[:40] + [(1000 + i, "same words w1 w2") for i in range(60)] + [(5, None), (6, ""), (7, "--"), (8, "w1 " * 5000)]
    items = [(i % 30, " ".join(r.choices(words, k=r.choice([1, 2, 8, 40])))) for i in range(35)] + [(90, None), (91, "unknown"), (92, "W1 w1, w2 SAME"), (None, "w3")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    assert ordered(lexsearch.search(d, i).collect()) == ordered(plain_search(docs, items))
    monkeypatch.setattr(lexsearch, "BLOCK_BYTES", 600)
    assert ordered(lexsearch.search(d, i, k=3).collect()) == ordered(plain_search(docs, items, 3))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexsearch, "PIECE", 64)
    docs = [(1, "alpha beta " * 100), (2, "alpha"), (3, "x" * 500 + " beta " + "y" * 300), (4, "gamma " + "delta" * 200)]
    items = [(0, "beta alpha gamma")]
    got = lexsearch.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ordered(got.collect()) == plain_search(docs, items)


def test_pruning_skips_documents():
    """Documents of a weak list alone are never gathered, and the result is that of the full sum."""
    rng = np.random.default_rng(2)
    n = 2000
    rare = np.sort(rng.choice(n, 40, replace=False))
    lists = lexsearch.Lists(np.arange(n), np.zeros(n, bool), np.concatenate((np.arange(n), rare)), np.concatenate((rng.integers(1, 10, n), rng.integers(100, 200, 40))), {0: (0, n), 1: (n, n + 40)}, {0: 9, 1: 199}, {0: 9, 1: 150})
    found, score = lexsearch.max_score(lists, [(0, 1), (1, 1)], 10)
    assert set(found) <= set(rare.tolist()) and len(found) < 40
    full = np.zeros(n, int)
    full[lists.doc[:n]] += lists.score[:n]
    full[rare] += lists.score[n:]
    assert sorted(score.tolist(), reverse=True)[:10] == sorted(full.tolist(), reverse=True)[:10]
    assert (full[found] == score).all()


def test_long_lengths_stay_exact():
    size = np.array([1, 10**9])
    assert lexsearch.length_factors(size, 3 * 10**10, 10**13).tolist() == [75 + 25 * 3 * 10**10 * n // 10**13 for n in (1, 10**9)]


def test_cases(docs, empty, spark):
    items = spark.createDataFrame([(1, "the CAT x", 1), (1, "chat", 2), (2, "漢字🦙 word", 3)], "item_id long, text string, rank int")
    want = plain_search([(i, t) for i, t, _ in CASES], [(r.item_id, r.text) for r in items.collect()])
    found = lexsearch.search(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and ordered(found.collect()) == ordered(want)
    assert lexsearch.search(empty, items).isEmpty() and lexsearch.search(docs, items.where("false")).isEmpty()


def test_query_against_sql(spark, corpus_dir):
    df = registry.queries()["op11_lexical_search"](spark, corpus_dir)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{corpus_dir}/{t}.parquet'")
    rows = sorted(map(tuple, df.collect()))
    assert len(rows) > 100 and rows == sorted(con.execute(registry.oracle_sql()["op11_lexical_search"]).fetchall())
