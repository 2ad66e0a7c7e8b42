import pytest

pytest.importorskip("tessitura.llm")

#: Every case that an operator must take: nulls, empty and very long texts, ties, repeated rows.
CASES = [
    (1, "The cat sat on the mat and the dog lay by the door of the old house today.", "en"),
    (2, "The cat sat on the mat and the dog lay by the door of the old house today.", "en"),
    (2, "The cat sat on the mat and the dog lay by the door of the old house today.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \n\t ", "fr"),
    (None, "Le chat est sur le tapis et le chien dort devant la porte de la vieille maison.", "fr"),
    (None, None, None),
    (6, "word " * 30_000, "en"),
    (7, "x" * 5_000, None),
    (8, "Le chat est sur le tapis et le chien dort devant la porte de la vieille maison.", "fr"),
    (9, "12 34 !!", "en"),
    (10, "a  b c d\x1ce\n\nf 漢字🦙 Σ ÉÉ ́x ▁ ▁▁y", "de"),
    (11, "Der Hund und die Katze sind nicht in dem Haus, weil sie auf der Straße sind.", "de"),
]


@pytest.fixture
def docs(spark):
    """The cases with columns whose names clash with the operators' own."""
    rows = [(*c, i, "x", 0.5, True, i) for i, c in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, key string, score double, kept boolean, t int").repartition(3)


@pytest.fixture
def empty(docs):
    return docs.where("false")


@pytest.fixture
def corpus(spark):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture
def corpus_dir(corpus):
    return "/root/testdata/sf0.001"
