"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; containers that a page marks as something else than its article
(menus, forms, adverts and so on) leave an empty line. The lengths of the lines are summed over sliding windows of
WINDOW lines. The text surges where a window's sum first exceeds the threshold and dives where the next windows hold
nothing; what lies between is kept, links too. Link texts have no length, and a window must hold SURGE characters, or as
many as the page's densest. Tags decide in one way only: a marked container is cut out in stripping, so its lines count
nothing. An article or main element keeps nothing by itself; it only ends what was left open before it, and headers and
articles inside it are told from the page's own.

Defined results: null or empty html gives an empty text; repeated pages give repeated rows; an empty table gives no
rows; extra columns are ignored; short text in no element at all gives an empty text. Unclosed and wrongly nested
elements end with the article, the main part or the body; an unclosed comment or script reaches to the page's end; text
after a "<" that no ">" follows is text. A page of any length takes one pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.common import table

WINDOW = 3
SURGE = 80

#: Elements whose content is no text, up to their end tag.
RAW = frozenset("script style noscript template svg iframe object textarea title math canvas audio video select".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: A tag's rest: quotes hide a ">".
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: After so many tags whose quotes never close, quotes hide nothing any more on that page.
UNCLOSED = 8
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never the article's text.
OTHER = frozenset("head nav aside footer form button dialog menu search".split())
#: Words in a class, an id or a role that mark a container as no part of the article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner billboard "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar complementary widget widgets toolbar topbar masthead "
    "footer contentinfo colophon copyright cookie cookies consent gdpr notice notices notification alert alertdialog dialog popup modal overlay disclaimer "
    "newsletter subscribe subscription signup login search searchbox form comment comments commentlist reply replies respond discussion disqus "
    "share sharing social related recommended recommendations teaser skip".split()
)
HEADER_MARKS = frozenset(["header"])
UNMARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())


def _marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether the start tag opens a container that is no part of the article."""
    if name in OTHER or (name == "header" and not inside):
        return True
    if not attributes or name in UNMARKED and not (name == "article" and inside):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key in ("class", "id", "role"):
            words = set(WORD.findall(CAMEL.sub(" ", value).lower()))
            if words & MARKS or (words & HEADER_MARKS and not inside):
                return True
    return False


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(first, end, name, closes, attributes) of what is no text: tags, and with an empty name comments, declarations and
    elements without text. One pass: what was not found from one place on is not looked for again from a later one."""
    at, n, unclosed = 0, len(page), 0
    ends: dict[str, re.Pattern] = {}
    missing: set[str] = set()  # raw elements that no end tag follows
    no_comment_end = False

    def plain_end(i: int) -> int:
        return page.find(">", i) + 1

    while (at := page.find("<", at)) >= 0:
        first = at
        if page.startswith("<!--", at):
            end = 0 if no_comment_end else page.find("--", at + 4)
            while end > 0 and not page.startswith((">", "!>"), end + 2):
                end = page.find("--", end + 1)
            no_comment_end = no_comment_end or end <= 0
            at = n if end <= 0 else page.index(">", end) + 1
            yield first, at, "", False, ""
        elif page.startswith(("<!", "<?"), at):
            end = plain_end(at)
            if not end:
                return  # no tag ends from here on
            at = end
            yield first, at, "", False, ""
        elif m := NAME.match(page, at + 1):
            rest = REST.match(page, m.end()) if unclosed < UNCLOSED else None
            end = rest.end() if rest else plain_end(m.end())
            unclosed += rest is None
            if not end:
                return
            name, closes, attributes, at = m[2].lower(), m[1] == "/", page[m.end() : end - 1], end
            if name not in RAW or closes or attributes.endswith("/"):
                yield first, at, name, closes, attributes
                continue
            found = None
            if name not in missing:
                if name not in ends:
                    ends[name] = re.compile(f"</{name}\\s*+>", re.IGNORECASE)
                found = ends[name].search(page, at)
            if found is None:
                missing.add(name)
            at = found.end() if found else n
            yield first, at, "", False, ""
        else:
            at += 1


def lines(page: str) -> list[tuple[str, int]]:
    """The page's lines as (text, length outside links); empty where something was cut out."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = 0
    skip: list = []  # name and open elements of that name of the container being skipped
    inside = anchors = 0
    begun = False  # an article or main part has begun
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, max(0, len(text) - linked)))
            parts.clear()
        linked = 0

    def gap() -> None:
        if out and out[-1][0]:
            out.append(("", 0))

    for first, end, name, closes, attributes in tokens(page):
        if first > at and not skip:
            text = page[at:first]
            parts.append(text)
            if anchors:
                linked += len(text)
        at = end
        if not name:
            continue
        edge = name in ("article", "main")
        if skip and skip[0] == "p" and name in BLOCKS and (name != "p" or not closes):
            skip = []  # any block ends a paragraph
        if skip:
            if edge and not closes and not begun and skip[0] not in ("article", "main"):
                skip = []  # what was left open before the article
            elif name in ("body", "html") or (closes and edge and inside and skip[0] != name):
                skip = []
            elif name == skip[0]:
                skip[1] += -1 if closes else not attributes.endswith("/")
                if skip[1] <= 0:
                    skip = []
                continue
            else:
                continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            anchors = max(0, anchors - 1) if closes else 1
        if closes:
            if edge:
                inside = max(0, inside - 1)
                if not inside:
                    gap()
            continue
        if name not in VOID and _marked(name, attributes, inside > 0):
            if name in BLOCKS or name in OTHER:
                gap()
            if not attributes.endswith("/"):
                skip = [name, 1]
        elif edge:
            gap()
            inside += 1
            begun = True
    if at < len(page) and not skip:
        parts.append(page[at:])
    flush()
    return out


def _between(weights: list[int], least: int) -> list[bool]:
    """Which lines lie between a surge and its dive; short lines up to a window before the surge belong to it."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    kept = [False] * n
    i = 0
    while i < n:
        if weights[i] and sums[i] >= least:  # surge
            j = i
            while j < n and sums[j]:
                j += 1
            first, k = i, i - 1
            while k >= 0 and not kept[k] and first - k <= WINDOW:
                if weights[k]:
                    first = k
                k -= 1
            kept[first:j] = [True] * (j - first)
            i = j
        i += 1
    return kept


def main_text(page: str | None) -> str:
    """The text between surge and dive points, blocks joined by a blank line."""
    rows = lines(page or "")
    weights = [size for _, size in rows]
    # A page of short blocks surges where it is densest. Text without any element has no blocks to compare.
    most = max((sum(weights[i : i + WINDOW]) for i in range(len(rows))), default=0)
    blocks = any(name for _, _, name, _, _ in tokens(page or ""))
    kept = _between(weights, min(SURGE, most) if blocks else SURGE)
    return "\n\n".join(text for (text, _), inside in zip(rows, kept, strict=True) if text and inside)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row's html."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(task, SCHEMA)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLE: dict[str, str] = {}
