"""Fill-in-the-middle transformation: DuckDB inside ``mapInArrow``.

Each Arrow batch is registered with a DuckDB connection of the task and rewritten by one SQL statement, whose result goes back to Spark
as Arrow: ``regexp_extract_all`` cuts a text into code points, ``list_slice`` and ``array_to_string`` make prefix, middle and suffix,
``sha256`` draws the cuts and the form. No row passes through Python, nothing is shuffled, and equal rows give equal results on every
attempt, so that lost executors do no harm.

The draws of a document are the 8-digit groups h1 to h4 of the hex SHA-256 of ``seed:id``. With n code points the prefix ends after the
smaller of h1 % (n + 1) and h2 % (n + 1) and the middle after the larger. A text stays plain if it is empty, holds one of the markers, or
if h3 % 100 >= ``fim_percent``; otherwise it becomes suffix first (``spm``) if h4 % 100 < ``spm_percent``, else prefix first (``psm``).

Nulls: a null text is an empty one, hence plain; a null id is hashed as no digits (``1:``). Rows with equal ids get equal draws, and
repeated rows are kept one by one; there are no ties. An empty table gives no row. Other columns are not read, so none can clash. A very
long text is cut whole: it takes some 40 bytes a code point in its task, and DuckDB's ``memory`` setting must allow that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared

PLAN = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
#: Bytes of text in one statement, unless a single text is longer.
SLICE = 2 << 20


@dataclass(frozen=True)
class Rules:
    """Markers and shares of the transformation; ``seed`` is hashed with the id."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    fim_percent: int = 90
    spm_percent: int = 20
    seed: int = 1


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(rules: Rules, source: str) -> str:
    """DuckDB SQL from (d, t) of ``source`` to d, n, form, prefix_chars, middle_chars and output."""
    p, s, m = map(_quoted, (rules.prefix, rules.suffix, rules.middle))
    draw = ", ".join(f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4))
    return f"""
    WITH units AS (SELECT d, coalesce(t, '') AS x, regexp_extract_all(coalesce(t, ''), '(?s).') AS u, sha256('{int(rules.seed)}:' || coalesce(d::VARCHAR, '')) AS h FROM {source}),
    drawn AS (SELECT d, x, u, len(u)::BIGINT AS n, {draw} FROM units),
    cut AS (SELECT d, x, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(x, {p}) OR contains(x, {s}) OR contains(x, {m}) OR h3 % 100 >= {int(rules.fim_percent)} THEN 'plain' WHEN h4 % 100 < {int(rules.spm_percent)} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    parts AS (SELECT d, x, n, a, b, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS pre,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS mid, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n), '') END AS suf FROM cut)
    SELECT d, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        CASE form WHEN 'plain' THEN x WHEN 'psm' THEN {p} || pre || {s} || suf || {m} || mid ELSE {s} || suf || {p} || pre || {m} || mid END AS output FROM parts"""


def restored_sql(rules: Rules) -> str:
    """DuckDB expression of the text from ``output`` and ``form`` alone; a transformed output holds each marker once."""
    p, s, m = map(_quoted, (rules.prefix, rules.suffix, rules.middle))
    between = lambda a, b: f"string_split(string_split(output, {a})[2], {b})[1]"
    middle = f"string_split(output, {m})[2]"
    return f"CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between(p, s)} || {middle} || {between(s, m)} ELSE {between(p, m)} || {middle} || {between(s, p)} END"


def _mapped(rows: DataFrame, text: str, sql: str, schema: str, memory: str) -> DataFrame:
    """The result of DuckDB ``sql`` over ``batch``, a slice of ``rows`` at a time; its columns are those of ``schema`` by place."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        shared.hold_nothing()
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""}) as con:
            for batch in shared.sliced(batches, text, rows=2048, size=SLICE):
                con.register("batch", pa.Table.from_batches([batch]))
                found = con.execute(sql).to_arrow_table().rename_columns(names)
                con.unregister("batch")
                yield from found.to_batches()

    return rows.mapInArrow(run, schema)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))


def transform(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", memory: str = "2GB") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every row."""
    return _mapped(_rows(docs, id_col, text_col), "t", transform_sql(rules, "batch"), f"{PLAN}, output string", memory)


def restore(rows: DataFrame, rules: Rules = Rules(), memory: str = "2GB") -> DataFrame:
    """doc_id and the exact text of rows with doc_id, form and output."""
    return _mapped(rows.select("doc_id", "form", "output"), "output", f"SELECT doc_id, {restored_sql(rules)} FROM batch", "doc_id long, text string", memory)


def digests(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", memory: str = "2GB") -> DataFrame:
    """Like :func:`transform`, with the SHA-256 of the output and of the text restored from it instead of the output itself."""
    sql = f"SELECT d, n, form, prefix_chars, middle_chars, sha256(output), sha256({restored_sql(rules)}) FROM ({transform_sql(rules, 'batch')}) made"
    return _mapped(_rows(docs, id_col, text_col), "t", sql, f"{PLAN}, output_sha256 string, restored_sha256 string", memory)
