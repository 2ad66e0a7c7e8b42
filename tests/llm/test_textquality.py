"""The quality classifier: token, context and pooling counts by brute force, gradients, calibration, held-out accuracy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import langid, registry
from tessitura.llm import textquality as q
from tests.llm.conftest import CASES

TEXTS = ["The cat, THE Cat!!", "", "a1b2  c3\n\n-- x", "Straße ÉÉ 漢字 🦙", " \t", "w" * 200 + " " + "w" * 199 + "v"]


def plain_tokens(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x09\x0b-\x0d\x20]", text.encode())


def test_tokens_are_runs():
    slot, shape, n = q.tokens(TEXTS)
    want = [plain_tokens(t) for t in TEXTS]
    assert n.tolist() == [len(x) for x in want]
    flat = [x.lower() for w in want for x in w]
    same = {}
    for s, x in zip(slot.tolist(), flat, strict=True):
        assert same.setdefault(x, s) == s
    assert len(set(same.values())) == len(same)  # no collision among these few
    assert slot.min() >= 0 and slot.max() < q.SLOTS and shape.min() >= q.SLOTS and shape.max() < q.SLOTS + q.SHAPES
    alone = [q.tokens([x.decode("utf-8")])[0][0] for w in want for x in w]
    assert alone == slot.tolist()
    assert [len(x) for x in q.tokens(["", None or ""])] == [0, 0, 2]


def test_contexts_by_brute_force(spark):
    texts = TEXTS * 3 + [f"word{i} and word{i % 3}\nagain" for i in range(40)] + [None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    at, sign = q.index_vectors()
    want = np.zeros((q.SLOTS + q.SHAPES, q.DIM + 1), np.int64)
    for t in texts:
        slot, shape, _ = q.tokens([t or ""])
        for rows in (slot, shape):
            for i, r in enumerate(rows):
                want[r, q.DIM] += 1
                for j in range(max(0, i - q.WINDOW), min(len(slot), i + q.WINDOW + 1)):
                    if i != j:
                        for k in range(q.NONZERO):
                            want[r, at[slot[j], k]] += sign[slot[j], k]
    got = q.count_contexts(docs)
    assert (got == want).all()
    vectors = q.word_vectors(got)
    together = q.pooled(TEXTS, vectors)
    for row, t in zip(together, TEXTS, strict=True):
        assert np.allclose(row, q.pooled([t], vectors)[0], atol=1e-6)
        slot, shape, n = q.tokens([t])
        if n[0]:
            assert np.allclose(row[: q.DIM], vectors[slot].mean(axis=0), atol=1e-6) and np.allclose(row[q.DIM : 2 * q.DIM], vectors[shape].mean(axis=0), atol=1e-6)
            assert np.isclose(row[-1], len(set(slot.tolist())) / n[0])
        else:
            assert not row.any()


def test_network_and_temperature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(1500) < 0.1)).astype(float)  # not linear, a tenth of the labels wrong
    w1, b1, w2, b2 = q.fit_network(x[:1000], y[:1000], hidden=16, epochs=80)
    z = np.tanh(x[1000:] @ w1 + b1) @ w2 + b2
    assert ((z > 0) == y[1000:]).mean() > 0.8
    t = q.calibrated(6 * z, y[1000:])
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 4000))
    assert abs(np.log(t) - np.log(grid[np.argmin([q._loss(6 * z / g, y[1000:]) for g in grid])])) < 0.01
    assert q.calibrated(np.empty(0), np.empty(0)) == 1.0


def test_held_out_accuracy(spark, corpus_dir):
    rows = registry.queries()["op12_quality_classifier"](spark, corpus_dir)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{corpus_dir}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{corpus_dir}/documents.parquet").count()
    assert rows.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> CAST(score >= 0.5 AS INT)").isEmpty()
    judged = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(judged) > 15 and sum(r.predicted == r.quality for r in judged) >= 0.9 * len(judged)
    assert {r.held_out for r in rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()} == {True}


@pytest.fixture
def marks(spark):
    return spark.createDataFrame([(1, 1, "x"), (2, 0, "y"), (2, 1, "z"), (6, 0, None), (7, None, ""), (None, 1, ""), (99, 1, ""), (8, 1, ""), (11, 1, "")], "doc_id long, quality int, text string")


def test_cases(docs, empty, marks):
    model = q.train(docs, marks)
    rows = q.score(docs, model, ("doc_id", "lang", "score")).collect()
    assert len(rows) == len(CASES)
    assert len({r[3] for r in rows if r.doc_id in (1, 2)}) == 1  # equal texts, equal scores
    assert q.score(empty, model).isEmpty()
    assert (q.train(docs, marks).score(TEXTS) == model.score(TEXTS)).all()
    nothing = q.train(empty, marks)
    assert nothing.score(["a", ""]).tolist() == [0.5, 0.5]
    one_kind = q.train(docs, marks.where("quality = 1"))
    assert len(set(one_kind.score(["a", "b c"]).tolist())) == 1 and one_kind.score(["a"])[0] > 0.5
    few = q.train(docs, marks, max_rows=2)
    assert 0 <= few.score(["a"])[0] <= 1


def test_labels_of_the_other_fold_are_not_seen(spark, corpus):
    labels = spark.createDataFrame([(r.doc_id, r.doc_id % 2) for r in corpus.collect()], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(langid.held_out(folds=3, fold=1), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (q.train(corpus, x.where(~langid.held_out(folds=3, fold=1))) for x in (labels, other))
    assert (a.score(TEXTS) == b.score(TEXTS)).all()
