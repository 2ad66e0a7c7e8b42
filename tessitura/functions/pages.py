"""Attributes of meta elements of web pages as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named character references that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "eacute": "é"}


def decoded(text) -> Column:
    """Text with numeric and the common named character references decoded once; others stay as they are."""

    def part(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});", 1)
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        digits = F.lpad(F.when(name.rlike("^#[xX]"), F.substring(name, F.lit(3), F.length(name))).otherwise(F.hex(F.substring(name, F.lit(2), F.length(name)).try_cast("long"))), 8, "0")
        valid = name.startswith("#") & (F.upper(digits) <= "0010FFFF") & ~F.upper(digits).between("0000D800", "0000DFFF") & (digits != "00000000")
        found = F.when(valid, F.decode(F.unhex(digits), "UTF-32"))
        for key, value in NAMED.items():
            found = F.when(name == key, F.lit(value)).otherwise(found)
        return F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), p))

    parts = F.split(text, "&")
    return F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), part)), "")


def meta_tags(html) -> Column:
    """The meta elements of a page; a ``>`` inside quotes does not end one."""
    html = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(html, F.lit(r"""(?i)<meta(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*+>"""), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not, whatever its case; null without it."""
    pattern = rf"""(?i)[\s/"']{re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = [F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]
    return F.when(tag.rlike(pattern), F.concat(*found))


def html_meta(html, name: str, value: str) -> Column:
    """The trimmed, decoded content of the first meta element whose attribute ``name`` is ``value`` (any case) and whose content is not
    empty, in whatever order they stand; null without one."""
    content = lambda t: F.when(F.lower(attribute(t, name)) == value.lower(), F.nullif(F.trim(decoded(attribute(t, "content"))), F.lit("")))
    return F.get(F.filter(F.transform(meta_tags(html), content), lambda x: x.isNotNull()), F.lit(0))
