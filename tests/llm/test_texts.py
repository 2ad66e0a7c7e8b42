"""Language ID, quality rules, the language model and page extraction."""

import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.llm import blocks, knlm, langid, quality, registry, shared
from tests.llm.conftest import CASES


def test_language_held_out_accuracy(corpus):
    docs = corpus.withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("NOT held_out"))
    rows = langid.predict(docs, model).where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_counts_are_naive_bayes(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("abc abd", "x"), ("zzz zy", "y"), ("abz", "y"), (None, "x"), ("q", None)])], "doc_id long, text string, lang string")
    model = langid.train(docs, alpha=0.5, dim=1 << 10)
    counts = {lang: sum((np.bincount(langid.features(t, 1 << 10), minlength=1 << 10) for t in ts), np.zeros(1 << 10)) for lang, ts in {"x": ["abc abd"], "y": ["zzz zy", "abz"]}.items()}
    for k, lang in enumerate("xy"):
        want = np.log((counts[lang] + 0.5) / (counts[lang].sum() + 0.5 * (1 << 10)))
        assert np.allclose(model.weights[:, k], want)
    assert np.allclose(model.prior, np.log([1 / 3, 2 / 3]))


def test_language_cases(docs, empty):
    model = langid.train(docs)
    rows = {(r.doc_id, r.text): r for r in langid.predict(docs, model).collect()}
    for doc_id, text, _ in CASES:
        r = rows[(doc_id, text)]
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters), text
        assert (r.score == 0) == (not letters)
    assert langid.predict(docs, model).columns[:-2] == [c for c in docs.columns if c != "score"]
    assert langid.accept(docs, model).columns == docs.columns
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).isEmpty()


def test_language_batches_score_like_single_texts(docs):
    model = langid.train(docs)
    texts = [t for _, t, _ in CASES] + ["", None, "!", "über das"]
    together = model.predict(texts)
    assert together == [model.predict([t])[0] for t in texts]
    for t, (lang, score) in zip(texts, together, strict=True):
        found = langid.features(t) if t else ()
        if not len(found):
            assert (lang, score) == ("und", 0.0)
            continue
        logs = sum(model.weights[f] for f in found.tolist()) / (1 + len(found) / model.calm) + model.prior
        p = np.exp(logs - logs.max())
        assert lang == model.languages[int(np.argmax(p))] and abs(score - p.max() / p.sum()) < 1e-6


def test_language_of_letters_beyond_the_first_planes(spark):
    docs = spark.createDataFrame([(1, chr(0x20000) * 5 + chr(0x2A6D0), "zh"), (2, "plain words here", "en"), (3, chr(0x1F600), "en"), (4, chr(0x30000) + chr(0x10FFFF), "zh")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert (rows[1].lang_pred, rows[2].lang_pred, rows[3].lang_pred, rows[4].lang_pred) == ("zh", "en", "und", "zh")


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


@given(st.text(alphabet="ab \n\t\x1c#é", max_size=60))
def test_measures(text):
    found = dict(zip(quality.MEASURES, quality.measure(text), strict=True))
    assert tuple(found[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(text)


def test_quality_ledger(docs, empty, corpus):
    book = shared.staged(quality.ledger(corpus), "ledger")
    for r in quality.verdicts(book).collect():
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and not (base and r.kept)
        assert r.kept == (r.fail_bits & quality.mask_of(quality.POLICIES["v2"]) == 0)
    bits = [r.fail_bits for r in book.collect()]
    names, mask = quality.POLICIES["v2"], quality.mask_of(quality.POLICIES["v2"])
    for r in quality.ablations(book).collect():
        bit = quality.mask_of([r.rule])
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_failed_alone == sum(b & mask == bit for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)
    assert quality.ablations(book).count() == len(names)
    by_row = {(r.doc_id, r.key): r for r in quality.ledger(docs, keep=("doc_id", "key", "t", "score")).collect()}
    assert quality.ledger(docs).count() == len(CASES) and by_row
    assert quality.ledger(empty).isEmpty() and quality.ablations(quality.ledger(empty)).where("n_failed > 0").isEmpty()


def test_clean_documents_pass(corpus, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.verdicts(quality.ledger(corpus)).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in rows) + 1


def brute_model(training):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    pairs, words = Counter(), Counter()
    for t in map(tokens, training):
        words.update(t)
        pairs.update(zip([b"\ns", *t[:-1]], t, strict=True))
    lower = Counter(w for _, w in pairs)
    many = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, e = (0.0, *knlm.discounts(many(pairs))), (0.0, *knlm.discounts(many(lower)))
    n, v, low_total = sum(words.values()), len(words), sum(lower.values())
    total, mass = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        mass[a] += d[min(c, 3)]
    low_mass = sum(e[min(c, 3)] for c in lower.values())

    def low(w):
        return (max(lower[w] - e[min(lower[w], 3)], 0) + low_mass / (v + 1)) / low_total if low_total else 1 / (v + 1)

    def p(a, w):
        c = pairs[(a, w)]
        return (max(c - d[min(c, 3)], 0) + mass[a] * low(w)) / total[a] if total[a] else low(w)

    def score(text):
        t = tokens(text)
        return len(t), sum(words[w] > 0 for w in t), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(a, w)) for a, w in zip([b"\ns", *t[:-1]], t, strict=True))

    return score, p, words


def test_language_model(spark, docs, empty, corpus, monkeypatch):
    for table, flush in ((corpus, 2_000_000), (docs, 40)):
        monkeypatch.setattr(knlm, "FLUSH_TOKENS", flush)
        rows = table.select("doc_id", "text").withColumn("held", langid.held_out(folds=7))
        model = knlm.train(rows.where("NOT held"), shared.shared_dir(spark, "lm"))
        score, p, words = brute_model([r.text for r in rows.where("NOT held").collect()])
        for r in knlm.score(rows, model, keep=("doc_id", "text")).collect():
            n, known, train, base, found = score(r.text)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(found, rel=1e-9)
    nothing = knlm.train(empty, shared.shared_dir(spark, "lm"))
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in knlm.score(docs, nothing).collect()} == {(0, 0, 0.0, 0.0)}
    assert knlm.score(empty, nothing).isEmpty()


def test_model_beats_the_base_on_held_out_texts(spark, corpus):
    rows = registry.op7_perplexity(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_large_counts_and_discounts():
    packed = knlm._packed(np.array([1, 255, 300, 254], np.uint64))
    assert packed["count"].tolist() == [1, 255, 255, 254] and packed["at"].tolist() == [1, 2] and packed["large"].tolist() == [255, 300]
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [0, 5, 1, 0], [10, 4, 2, 1]):
        assert all(0 <= d <= k for k, d in enumerate(knlm.discounts(n), 1))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div><!-- <p>comment</p> -->
<article class="post"><h1>A title</h1><p>First &amp; <b>bold</b>
 text that is part of the article and of the page.<p>Second unclosed<br>line</p><div class="ad-slot">Buy this</div><form><p>Your mail</p></form>
<p>Short.</p><section id="comments"><p>I think that this is a comment of a reader and not of the article.</p></section></article>
<aside>More</aside><footer>&copy; 2020</footer></body>"""


def test_page():
    assert blocks.main_text(PAGE) == "A title\nFirst & bold text that is part of the article and of the page.\nSecond unclosed\nline\nShort."


def test_page_without_an_article():
    good = "The cat sat on the mat and it was the best of all the mats that there were in the house of the old man. " * 3
    links = "".join(f"<p><a href='/{i}'>Link number {i} to something else</a></p>" for i in range(4))
    page = f"<body>{links}<h2>Heading</h2><p>{good}</p><p>It is.</p><p>{good}</p><p><a href='/x'>more and more of it</a></p><p>Imprint</p></body>"
    assert blocks.main_text(page) == f"Heading\n{good.strip()}\nIt is.\n{good.strip()}"


RUSSIAN = "Кошка сидела на окне и смотрела во двор, где дети играли в мяч и громко смеялись до самого вечера. " * 4


@pytest.mark.parametrize("opening", ["<div class='no-sidebar'>", "<div class='menu-closed page'>", "<form id='aspnetForm'>"])
def test_furniture_around_an_article_does_not_hide_it(opening):
    closing = opening[:5].replace("<", "</").strip() + ">"
    assert blocks.main_text(f"<body><nav>Home</nav>{opening}<article><p>The text of it.</p><form>Mail</form></article>{closing}<footer>End</footer></body>") == "The text of it."
    assert blocks.main_text(f"<body>{opening}<div class='user-comments'><article><p>I think so.</p></article></div>{closing}</body>") == ""


def test_a_language_without_stop_words():
    assert blocks.main_text(f"<body><p><a href='/'>Главная</a></p><div><p>{RUSSIAN}</p></div></body>") == RUSSIAN.strip()


def test_readers_feedback_is_no_text():
    page = "<body><article><p>The text of it.</p></article><div class='user-feedback'><article><p>I think so.</p></article></div></body>"
    assert blocks.main_text(page) == "The text of it."


def test_quotes_in_tags():
    assert blocks.main_text("<article><p class=\"x>One</p><p>Two <a href=it's>three</a> and more of it</p></article>") == "One\nTwo three and more of it"


def test_unclosed_tags_take_linear_time():
    start = time.perf_counter()
    blocks.main_text("<article>" + "<b>" * 20000 + "text" + "</i>" * 20000 + "</article>")
    assert time.perf_counter() - start < 1


@given(st.text(alphabet="<>/abp\"'= &;!-\n", max_size=80))
def test_any_markup_is_read(page):
    text = blocks.main_text(page)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and "\n\n" not in text


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", "<p>" + "a < b & c " * 2000, "z")], "page_id long, url string, html string, text string")
    found = blocks.extract(rows).collect()
    assert [r.page_id for r in found] == [1, 1, None, 2, 3] and found[2].text == "" and found[2].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in found)
    assert blocks.extract(rows.where("false")).isEmpty()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r, p in zip(sorted(blocks.extract(pages).collect()), sorted(pages.collect()), strict=True):
        article = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1)>", article)]
        assert r.text == "\n".join(filter(None, want))
