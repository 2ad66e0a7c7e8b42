"""Main text of web pages by two-pass block rules.

A page is read once as tags and text. Text falls into blocks at block-level tags; what lies in elements that never hold an article's
text (scripts, styles, forms, menus, footers, asides, hidden parts and elements whose role, class or id names an advert, a notice, a
comment thread and the like) is no text. Characters that are references are decoded, white space inside a block becomes one space.

First pass: every block is decided by its length, link density and density of stop words: bad (links or boilerplate), good, near
good, or short and undecided. Second pass: near-good and short blocks take the label of the nearest decided neighbours in page order;
between neighbours that disagree, a near-good block is good and a short one follows the nearer of the two. The content element
(article, main or the role main), where a page has one, bounds the text: blocks outside it are bad and undecided ones inside it that
have no decided neighbour are good. A page with no text by these rules is read again, and a content element then counts although a form
or an element whose names make it furniture (but not hidden, and no readers' comments) lies around it. Where the stop words of no list
occur, length and link density decide alone.

Nulls: a null or empty page has no text. Unclosed, misnested and truncated markup is read as far as it goes. Equal rows are read one
by one; an empty table gives an empty result; columns named in ``keep`` are carried, others are not read. There are no ties. A very long page is read whole in linear time, in a slice of its own.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import shared

#: Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form button select option fieldset dialog menu svg canvas object audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of a class, id or role that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar toolbar widget related recommended recommendations comment comments commentlist disqus reply replies discussion feedback pagination pager search toc tags "
    "complementary contentinfo search form alertdialog".split()
)
#: Those of them that name readers' words.
READERS = frozenset("comment comments commentlist disqus reply replies".split())
HEADERS = frozenset("header site-header page-header top-header".split())
#: Frequent words of the languages that pages come in.
STOP_WORDS = frozenset(
    "the of and to in is was for that it with on as are by this be at or from an not have he she they his her but which you we had were has their been will would there what all if can more when who so no "
    "der die das und ist von den mit zu für auf im ein eine einer nicht sich als auch es an dem des werden aus er hat dass sie nach bei wird einen oder sind noch wie einem über so zum haben nur war "
    "le la les de des du et un une est en que qui dans pour pas au sur ne se par ce il elle avec son sa ses plus ont cette mais ou aux comme leur nous vous être "
    "el los las y del por con para una su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos ".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
#: A name starts after a delimiter and is taken whole, so that a long run without "=" is read once.
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]++)")
_NAMES = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")
_WIDE = re.compile("[\u2e80-\U0010ffff]")
_WORD = re.compile(r"[^\W\d_]+")

BAD, SHORT, NEAR, GOOD = "bad", "short", "near", "good"


@dataclass
class Block:
    text: str
    linked: int = 0  # characters inside links
    heading: bool = False
    inside: bool = False  # in the content element
    label: str = ""
    place: int = 0  # among all blocks of the page, skipped ones included


def width(text: str) -> int:
    """Characters, those of scripts that need few of them for a sentence three times."""
    return len(text) if text.isascii() or not _WIDE.search(text) else len(text) + 2 * len(_WIDE.findall(text))


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: lengths in characters, densities as shares."""

    short: int = 70
    long: int = 200
    links: float = 0.33
    inner_links: float = 0.5
    stop_low: float = 0.08
    stop_high: float = 0.16
    unlisted: float = 0.02  # below this share of stop words in its longer blocks a page is in a language without a list


def _furniture(attributes: str) -> str:
    """How an element's names put it out of the text: ``hard`` (hidden, or readers' comments), ``soft`` (other furniture) or not at all."""
    hidden = soft = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            # Only a name's own words count: "leading-article" is no advert, "ad-slot" is one.
            for token in value.split():
                words = _NAMES.findall(token)
                if words and not READERS.isdisjoint((words[0], words[-1])):
                    return "hard"
                soft = soft or token in HEADERS or bool(words) and (words[0] in FURNITURE or words[-1] in FURNITURE)
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        elif name == "aria-hidden" and value == "true":
            hidden = True
    if hidden or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return "hard"
    return "soft" if soft else ""


#: Readings of a page. STRICT leaves out forms and elements that only their names make furniture; LENIENT reads a content element inside
#: them; OPEN reads them whole. Hidden elements, readers' comments and elements such as nav are in none.
STRICT, LENIENT, OPEN = range(3)


@dataclass
class Segments:
    """A page read once: its blocks as (place, heading, inside, parts), a part being (first reading that has it, text, in a link)."""

    rows: list[tuple[int, bool, bool, list[tuple[int, str, bool]]]]
    found: list[bool]  # whether a reading has a content element
    named: bool = False  # whether readings differ

    def size(self, reading: int) -> int:
        """Characters that a reading has at most."""
        return sum(len(x[1]) for _, _, _, parts in self.rows for x in parts if x[0] <= reading)

    def blocks(self, reading: int) -> list[Block]:
        out = []
        for place, heading, inside, parts in self.rows:
            held = [x for x in parts if x[0] <= reading] if self.named else parts
            text = _SPACE.sub(" ", "".join(x[1] for x in held)).strip()
            if text:
                out.append(Block(text, sum(len(x[1].strip()) for x in held if x[2]), heading, inside, place=place))
        return out


def segment(page: str) -> Segments:
    """The blocks of a page outside its furniture."""
    rows: list[tuple[int, bool, bool, list[tuple[int, str, bool]]]] = []
    parts: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, str, bool, int]] = []  # open elements: name, skipped, content, soft elements since the content around it
    opened: Counter[str] = Counter()
    hard = soft = deep = content = anchors = 0  # deep: soft elements inside the innermost content element
    heading = named = False
    found = [False] * 3
    place = 0
    unclosed: set[str] = set()  # names without an end tag from here on

    def close() -> None:
        nonlocal place, parts
        place += 1
        if parts:
            rows.append((place, heading, content > 0, parts))
            parts = []

    def say(text: str) -> None:
        if text and not hard:
            parts.append((STRICT if not soft else LENIENT if not deep else OPEN, html.unescape(text) if "&" in text else text, anchors > 0))

    def leave() -> str:
        nonlocal hard, soft, deep, content, anchors
        name, skip, inner, before = stack.pop()
        opened[name] -= 1
        hard -= skip == "hard"
        soft -= skip == "soft"
        deep = before
        content -= inner
        anchors -= name == "a"
        return name

    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            say(page[at:])
            break
        m = _TAG.match(page, tag)
        if m is None:  # a bare "<" is text
            say(page[at : tag + 1])
            at = tag + 1
            continue
        if tag > at:
            say(page[at:tag])
        at = m.end()
        if m[1] is not None:
            say(m[1].replace("&", "&amp;"))
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name in BLOCKS:
                close()
            if name in HEADINGS:
                heading = False
            while opened[name] and leave() != name:
                pass
        else:
            if name in RAW:
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                if end is None:
                    unclosed.add(name)
                if name != "title" or end:
                    at = end.end() if end else size
                continue
            if name in BLOCKS:
                close()
                for depth in range(len(stack) - 1, -1, -1) if any(opened[x] for x in CLOSES.get(name, ())) else ():
                    if stack[depth][0] in CLOSES[name]:
                        while len(stack) > depth:
                            leave()
                        break
                    if stack[depth][0] in ("article", "body", "div", "section", "table", "ul", "ol", "nav", "main"):
                        break
            if name in VOID:
                continue
            if name in HEADINGS:
                heading = True
            inner = name in ("article", "main") or "main" in m[4] and re.search(r"role\s*=\s*[\"']?main\b", m[4]) is not None
            skip = _furniture(m[4]) if m[4] and name not in ("html", "body") else ""
            if skip != "hard" and (name in SKIPPED or name == "header" and not content):
                skip = "soft" if name == "form" else "hard"
            named = named or skip == "soft"
            if name == "body":
                while stack and stack[-1][0] == "head":
                    leave()
            if not m[4].endswith("/") or name in BLOCKS:
                stack.append((name, skip, inner, deep))
                opened[name] += 1
                hard += skip == "hard"
                soft += skip == "soft"
                deep = 0 if inner and not skip else deep + (skip == "soft")
                content += inner
                anchors += name == "a"
                if inner and not hard:
                    for reading, out in enumerate((soft, deep, 0)):
                        found[reading] = found[reading] or not out
    close()
    return Segments(rows, found, named)


def first_pass(block: Block, rules: Rules, listed: bool = True) -> str:
    """The label of a block by itself; by length and links alone where the page's language has no stop words here (``listed``)."""
    n = width(block.text)
    if block.linked / len(block.text) > (rules.inner_links if block.inside else rules.links):
        return BAD
    if "©" in block.text[:40] and not block.inside:
        return BAD
    if n < rules.short:
        return SHORT
    if not listed and not block.inside:
        return GOOD if n > rules.long else NEAR
    words, stops = _stops(block.text)
    stops /= max(1, words)
    if stops >= rules.stop_high:
        return GOOD if n > rules.long else NEAR
    if stops >= rules.stop_low or block.inside:
        return NEAR
    return BAD


@functools.lru_cache(4096)
def _stops(text: str) -> tuple[int, int]:
    """A block's words, and how many of them are stop words; passes and readings of a page ask for the same blocks."""
    words = _WORD.findall(text.lower())
    return len(words), sum(map(STOP_WORDS.__contains__, words))


def second_pass(blocks: list[Block], bounded: bool) -> None:
    """Labels for near-good and short blocks from the nearest decided neighbours."""
    n = len(blocks)
    decided = [b.label in (GOOD, BAD) for b in blocks]
    before: list[int] = []
    last = -1
    for i in range(n):
        before.append(last)
        last = i if decided[i] else last
    after = [0] * n
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if decided[i] else last
    labels = [b.label for b in blocks]
    for i, b in enumerate(blocks):
        if decided[i]:
            continue
        left = labels[before[i]] if before[i] >= 0 else None
        right = labels[after[i]] if after[i] < n else None
        if left is None and right is None:
            b.label = GOOD if bounded or labels[i] == NEAR else BAD
        elif labels[i] == NEAR and (left is None or right is None):
            b.label = GOOD  # one bad neighbour does not outweigh a block that is nearly good by itself
        elif left == right or left is None or right is None:
            b.label = left or right
        elif labels[i] == NEAR:
            b.label = GOOD
        elif b.heading:
            b.label = right
        else:
            b.label = left if i - before[i] <= after[i] - i else right


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The article of a page: its good blocks in page order, one line each.

    Names alone decide nothing for good. Where forms or named furniture were left out, the page is read again with the content elements
    inside them: if that finds more than twice the text, the blocks of both readings are joined (a teaser inside a widget does not). Where the result is still less than a third of what the
    block rules find with all of them read, these are joined too."""
    if not page:
        return ""
    read = segment(page)
    found = _chosen(read, STRICT, rules)
    if read.named:
        for reading, share in ((LENIENT, 2), (OPEN, 3)):
            if read.size(reading) <= share * _size(found):
                continue  # it has no more text than that at all
            more = _chosen(read, reading, rules)
            if _size(more) > share * _size(found):
                found = {**more, **found}
    return "\n".join(found[k] for k in sorted(found))


def _size(found: dict[int, str]) -> int:
    return sum(map(len, found.values()))


def _chosen(read: Segments, reading: int, rules: Rules) -> dict[int, str]:
    """The good blocks of a reading by their place."""
    blocks, bounded = read.blocks(reading), read.found[reading]
    if bounded:
        blocks = [b for b in blocks if b.inside]
    counts = [_stops(b.text) for b in blocks if width(b.text) >= rules.short and b.linked <= rules.links * len(b.text)]
    listed = sum(s for _, s in counts) >= rules.unlisted * sum(w for w, _ in counts)
    for b in blocks:
        b.label = first_pass(b, rules, listed)
    second_pass(blocks, bounded)
    return {b.place: b.text for b in blocks if b.label == GOOD}


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), rules: Rules = Rules()) -> DataFrame:
    """The columns ``keep``, text and n_chars (its code points) of every page."""
    inner = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), F.col(f"`{html_col}`").cast("string").alias("h"))
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in inner), "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, "h"):
            texts = [main_text(h, rules) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*inner, "text", "n_chars"])

    return rows.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)), "text", "n_chars")
