"""Quality rules as a bitmask ledger.

``ledger`` reads each text once, evaluates every rule and keeps the measurements and one bit per failed rule. Policies are versioned
sets of rules: ``verdicts`` applies one to a ledger without looking at a text again, and ``ablations`` counts by bitwise aggregation
what each rule of a policy rejects, rejects alone, and what dropping it would bring back.

Words are runs of anything but the ASCII characters tab, line feed, vertical tab, form feed, return and space. Lines are cut at line
feeds. Nulls: a null text has no words and no lines; a null id is kept. Equal rows are judged one by one. An empty table gives an
empty ledger. The ledger carries the columns of its input named in ``keep``; measurements replace input columns of the same name. There are no ties. A very long text is measured whole, in a slice of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_ellipsis_lines", "n_bullet_lines", "longest_word", "n_upper_words", "n_exclaims")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, shared.SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = duplicates = ellipses = bullets = 0
    seen: set[bytes] = set()
    for line in data.split(b"\n"):
        if body := line.strip(shared.SPACES):
            lines += 1
            duplicates += line in seen
            seen.add(line)
            ellipses += body.endswith((b"...", "…".encode()))
            bullets += body.startswith((b"- ", b"* ", "• ".encode()))
    letters = sum(map(_has_letter, words))
    return n, chars, symbols, lines, duplicates, repeated(words), letters, ellipses, bullets, max(map(len, words), default=0), sum(map(bytes.isupper, words)), data.count(b"!")


def _has_letter(word: bytes) -> bool:
    return word.isalpha() or any(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in word)


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which occurs at least twice in the text."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(windows) == len(distinct := set(windows)):
        return 0
    if 2 * len(distinct) > len(windows):  # few repeats: count those alone
        first: set = set()
        again = {w for w in windows if w in first or first.add(w)}
    else:
        again = {w for w, c in Counter(windows).items() if c > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in again:
            covered += i + width - max(end, i)
            end = i + width
    return covered


def _ratio(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def rules() -> dict[str, Column]:
    """The rules in bit order; new ones go at the end, so that stored ledgers stay valid."""
    return {
        "few_words": F.col("n_words") < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "many_words": F.col("n_words") > 1_000_000,
        "short_words": F.try_divide(F.col("word_chars"), F.col("n_words")) < 2,
        "long_words": F.try_divide(F.col("word_chars"), F.col("n_words")) > 20,
        "symbols": _ratio("n_symbols", "n_words") > 0.1,
        "duplicate_lines": _ratio("n_dup_lines", "n_lines") > 0.5,
        "no_letters": _ratio("n_letter_words", "n_words") < 0.5,
        "ellipses": _ratio("n_ellipsis_lines", "n_lines") > 0.5,
        "bullets": _ratio("n_bullet_lines", "n_lines") > 0.9,
        "endless_word": F.col("longest_word") > 2000,
        "upper_case": _ratio("n_upper_words", "n_words") > 0.5,
        "exclaims": _ratio("n_exclaims", "n_words") > 0.5,
    }


BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "short_words", "long_words", "symbols", "duplicate_lines", "no_letters", "ellipses", "bullets", "endless_word", "upper_case", "exclaims"),
}
PRODUCTION = "v2"


def mask_of(names) -> int:
    bits = {name: 1 << k for k, name in enumerate(rules())}
    return sum(bits[name] for name in set(names))


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, every measurement and ``fail_bits``: bit k is set if rule k fails."""
    kept = [c for c in keep if c not in MEASURES]
    names = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col(f"`{text_col}`").cast("string").alias("t"))
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), *(f"{m} long" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.hold_nothing()
        for batch in shared.sliced(batches, "t"):
            found = [measure(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*names, *MEASURES])

    measured = rows.mapInArrow(run, schema)
    bits = [F.when(F.coalesce(failed, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(rules().values())]
    return measured.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), *MEASURES, reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long").alias("fail_bits"))


def failed(bits: Column, names) -> Column:
    return bits.bitwiseAND(F.lit(mask_of(names))) != 0


def verdicts(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    base = failed(F.col("fail_bits"), BASE)
    return book.withColumns({"base_failed": base, "kept": ~base & ~failed(F.col("fail_bits"), POLICIES[policy])})


def ablations(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """One row per rule of a policy: documents that it rejects, that it alone rejects, and that the policy without it keeps."""
    names = POLICIES[policy]
    judged = F.col("fail_bits").bitwiseAND(F.lit(mask_of(names)))
    groups = book.groupBy(judged.alias("bits")).count()
    bit = {name: mask_of([name]) for name in names}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in bit.items())))
    each = groups.select("bits", "count", rows.alias("r")).select("bits", "count", "r.rule", "r.bit")
    hit, others = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & ~others).alias("n_failed_alone"), total(~others).alias("n_kept_without"))
