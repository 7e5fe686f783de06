"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block.  Lines inside menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments count as empty, and link text adds nothing to a line's length.  Lengths are
summed over sliding windows of ``WINDOW`` lines; a region starts where the sum surges above ``SURGE`` and ends at the
dive, where a whole window is empty.  All regions are kept.

A name (class, id or role) stands for one of these only if all of its words do, or say nothing but place and shape
(``site-header``, ``ad-box-2``; not ``share-price`` or ``menu-of-the-day``).  Paragraphs, headings and quotations of a
marked article are never left out by name unless it is an advert's.

Where a page marks articles, lines outside them count nothing, if the distribution bears the marks out: if their own lines
surge, or are half of the page's text.  Otherwise (a marked teaser, say) the marks are passed over.  A marked article into
which a region reaches is kept whole, others go.  Without marks, text that lies in the same element as the regions, or in an
element between them and the body, is kept with them, however short and far off it is.  If no window of a page surges,
every line with text counts.

Defined cases: null and empty html give ''; cut-off pages, unclosed elements and pages without a text line are read as
far as they go; pages of any length are read whole; repeated rows give repeated results; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import texts

WINDOW = 3
SURGE = 80
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # a quote opens a value only behind "="; one that is never closed is a plain character
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE_TAGS = frozenset("head nav footer aside form menu dialog button select option object canvas video audio header".split())
_OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody option".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement adbox adsense banner promo promotion "
    "sponsor sponsored notice notices cookie cookies consent gdpr popup modal overlay form search login signup newsletter subscribe "
    "comment comments commentlist disqus replies reply share sharing social related recommended breadcrumb breadcrumbs pagination pager "
    "toolbar widget copyright complementary contentinfo alert skip".split()
)
_PLAIN_WORDS = frozenset(
    "site page global main primary secondary top bottom left right upper lower fixed sticky mobile desktop inner outer list box bar block "
    "container wrap wrapper section area zone slot unit row col column group panel content body text title items item links link buttons "
    "button icons icon input field user reader readers google posts post articles stories story thread".split()
)
_ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement adbox adsense sponsor sponsored promo promotion".split())
_ROOT_WORDS = frozenset("comment comments ad ads advert advertisement sponsored related reply".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre q figure figcaption dl dt dd".split())
_ROOTS = frozenset("html body article main".split())


def _is_noise(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _NOISE_TAGS:
        return not (tag == "header" and inside)
    if tag in ("html", "body"):
        return False
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        low = value.lower()
        if name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and re.search(r"display\s*:\s*none", low):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                found = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", one).lower()))
                if found <= _NOISE_WORDS | _PLAIN_WORDS:
                    words |= found & _NOISE_WORDS
    if tag in _ROOTS:
        return bool(words & _ROOT_WORDS)
    if inside:
        words.discard("header")
        if tag in _PROSE:
            words &= _ADVERT_WORDS
    return bool(words)


class Line(NamedTuple):
    text: str
    length: int  # without links
    noise: bool
    element: int  # number of the marked element that it is in, -1: none
    article: bool  # whether that is an article
    path: tuple[int, ...]  # numbers of the elements round it, but for html and body


def lines_of(page: str) -> list[Line]:
    """Lines in page order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, bool, int]] = []  # tag, noise, marked element, article, number (0: html and body)
    pieces: list[str] = []
    linked, links, marked, at, numbered = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            _, noise, element, article, _ = stack[-1] if stack else ("", False, -1, False, 0)
            out.append(Line(text, max(0, len(text) - linked), noise, element, article, tuple(x[4] for x in stack if x[4])))
        pieces.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        flush()
        del stack[k:]
        links = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            pieces.append(text)
            if links:
                linked += len(text)
        at = m.end()
        if m[3] is None:
            continue
        tag, ending = m[3].lower(), bool(m[2])
        if tag == "br" or tag == "hr":
            flush()
        elif tag in _VOID:
            continue
        elif ending:
            if tag == "a":
                links = 0
            if tag not in _INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "main") and tag in _INLINE | _OPEN_ENDED:
                    break
        else:
            if tag == "a":
                links = 1
            block = tag not in _INLINE
            if block:
                flush()
                while stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
                if stack and stack[-1][0] == tag and tag in _OPEN_ENDED:
                    close(len(stack) - 1)
            noise, element, article = stack[-1][1:4] if stack else (False, -1, False)
            own = _is_noise(tag, m[4] or "", element >= 0)
            if tag in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", m[4] or ""):
                if not (own or noise) and not article:
                    element, article, marked = marked, tag == "article", marked + 1
            if own and not noise and not block:
                flush()
            if own or block and tag not in _OPEN_ENDED:
                numbered += 1
                stack.append((tag, noise or own, element, article, 0 if tag in ("html", "body") else numbered))
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    return out


def regions(lengths: list[int], threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) of each region: the sum over a window rises above the threshold, until a whole window is empty."""
    n = len(lengths)
    sums = np.convolve(np.array([*lengths, *[0] * (window - 1)]), np.ones(window, int), "valid") if n else np.empty(0)
    out, start = [], None
    for i in range(n):
        if start is None and sums[i] > threshold and lengths[i] > 0:
            start = i
        if start is not None and sums[i] == 0:
            out.append((start, i))
            start = None
    return out + ([(start, n)] if start is not None else [])


def weighed(lines: list[Line]) -> tuple[list[int], frozenset[int]]:
    """The lines' lengths in the distribution, and the marked elements that it bears out."""
    plain = [0 if x.noise else x.length for x in lines]
    articles = any(x.article and not x.noise for x in lines)
    marked = frozenset(x.element for x in lines if x.element >= 0 and not x.noise and (x.article or not articles))
    inside = [n if x.element in marked else 0 for x, n in zip(lines, plain, strict=True)]
    if not marked or not (regions(inside, SURGE) or 2 * sum(inside) >= sum(plain)):
        return plain, frozenset()
    return inside, marked


def main_text(page: str | None) -> str:
    lines = lines_of(page) if page else []
    lengths, marked = weighed(lines)
    found = regions(lengths, SURGE) or regions([0 if x.noise else len(x.text) for x in lines], 0)
    keep = {i for first, dive in found for i in range(first, dive) if not lines[i].noise and (not marked or lines[i].element in marked)}
    if marked:
        whole = {lines[i].element for i in keep}
        keep = {i for i, x in enumerate(lines) if x.element in whole and not x.noise}
    elif keep:
        paths = [lines[i].path for i in keep]
        shared = next((k for k in range(min(map(len, paths)), 0, -1) if len({x[:k] for x in paths}) == 1), 0)
        near, owners = paths[0][:shared], set(paths)
        keep |= {i for i, x in enumerate(lines) if x.length and not x.noise and (x.path[:shared] == near if shared else x.path in owners)}
    return " ".join(lines[i].text for i in sorted(keep))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """``pages`` with the main text in ``out_col``, in place of a column of that name."""
    source = pages.drop(out_col) if out_col != html_col else pages
    names = source.columns
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                done = pa.array([main_text(p) for p in texts(part.column(at))], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, done], names=[*names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{fields}, `{out_col}` string")
