"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. A block's features are its own word count and link density,
those of its two neighbours, and where it stands (inside an element that names furniture, inside one
that names content, heading or not). A small decision tree, grown here from the labelled blocks in
``EXAMPLES``, tells content from furniture.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import prepare

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text.
SKIPPED_TAGS = frozenset(
    "script style noscript template textarea select option button svg math canvas object iframe head title datalist form label".split()
)
#: Their content ends at their own end tag only, whatever stands inside.
RAW_TAGS = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"])
FURNITURE_TAGS = frozenset("nav header footer aside menu dialog search address".split())
CONTENT_TAGS = frozenset(["article", "main"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: End tags that may close an article, a body, a main part or a table from inside.
CLOSING_TAGS = frozenset("html body article main div section".split())
#: Elements beyond which an end tag of another kind closes nothing.
BOUNDS = frozenset("article body main table".split())
INLINE_TAGS = frozenset("abbr b cite code em font i mark q s small span strong sub sup time u".split())
#: Words in a class, id or role that name furniture, and those that name content.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promoted recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe "
    "subscription tags toolbar widget widgets complementary contentinfo search alert".split()
)
#: Words in a name that make it tell of the layout: no-sidebar, has-sidebar.
LAYOUT_WORDS = frozenset("has with no without".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "content", "heading")
#: words, link density, the same of the block before and of the block after (0, 0 at the ends), furniture, content, heading; keep
EXAMPLES = [
    # inside an element that names content
    (9, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1, 1), (60, 0.0, 9, 0.0, 45, 0.0, 0, 1, 0, 1), (1, 0.0, 45, 0.0, 70, 0.0, 0, 1, 0, 1),
    (2, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1), (3, 0.0, 80, 0.0, 9, 0.0, 0, 1, 0, 1), (140, 0.02, 20, 0.0, 0, 0.0, 0, 1, 0, 1),
    (30, 0.4, 50, 0.0, 40, 0.0, 0, 1, 0, 1), (1, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 1), (12, 0.0, 1, 1.0, 3, 0.0, 0, 1, 1, 1),
    (5, 1.0, 30, 0.0, 40, 0.0, 0, 1, 0, 1), (2, 1.0, 60, 0.0, 12, 0.0, 0, 1, 0, 1), (300, 0.0, 2, 0.0, 8, 0.0, 0, 1, 0, 1),
    (9, 0.0, 1, 1.0, 1, 0.0, 0, 1, 1, 1), (1, 0.0, 1, 1.0, 1, 0.0, 0, 1, 0, 1), (4, 0.0, 1, 1.0, 0, 0.0, 0, 1, 0, 1),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1), (1, 1.0, 3, 1.0, 1, 1.0, 0, 1, 0, 1), (3, 1.0, 40, 0.0, 0, 0.0, 0, 1, 0, 1),
    (2, 0.0, 2, 1.0, 1, 1.0, 0, 1, 0, 1), (12, 0.9, 9, 1.0, 1, 0.0, 0, 1, 0, 1), (6, 0.5, 1, 1.0, 1, 1.0, 0, 1, 1, 1),
    (4, 0.0, 3, 1.0, 0, 0.0, 0, 1, 0, 1), (30, 0.0, 9, 0.9, 0, 0.0, 0, 1, 0, 1), (2, 0.0, 60, 1.0, 0, 0.0, 0, 1, 0, 1),
    # inside an element that names furniture, in content or out of it
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (10, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (40, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0),
    (70, 0.0, 50, 0.0, 60, 0.0, 1, 0, 0, 0), (25, 0.1, 30, 0.0, 40, 0.0, 1, 1, 0, 0), (60, 0.0, 45, 0.0, 30, 0.0, 1, 1, 0, 0),
    (4, 0.0, 20, 0.0, 30, 0.0, 1, 1, 1, 0), (3, 0.0, 1, 1.0, 5, 0.5, 1, 0, 1, 0), (120, 0.0, 3, 0.0, 2, 0.0, 1, 0, 0, 0),
    (2, 1.0, 40, 0.0, 2, 1.0, 1, 1, 0, 0), (6, 0.3, 8, 0.0, 0, 0.0, 1, 0, 0, 0), (15, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0),
    # no element names it: text
    (60, 0.0, 9, 0.0, 50, 0.0, 0, 0, 0, 1), (45, 0.05, 60, 0.0, 30, 0.1, 0, 0, 0, 1), (20, 0.0, 70, 0.0, 80, 0.0, 0, 0, 0, 1),
    (4, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1), (120, 0.1, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (80, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (25, 0.2, 40, 0.0, 35, 0.0, 0, 0, 0, 1), (18, 0.0, 25, 0.0, 2, 1.0, 0, 0, 0, 1), (10, 0.0, 1, 1.0, 55, 0.0, 0, 0, 1, 1),
    (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (1, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (2, 0.0, 3, 0.0, 4, 0.0, 0, 0, 0, 1),
    (6, 0.0, 3, 1.0, 45, 0.0, 0, 0, 1, 1), (7, 0.0, 65, 0.0, 40, 0.0, 0, 0, 1, 1), (3, 0.0, 30, 0.0, 90, 0.0, 0, 0, 0, 1),
    # no element names it: furniture
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0), (5, 0.8, 60, 0.0, 4, 1.0, 0, 0, 0, 0),
    (12, 0.9, 10, 1.0, 11, 0.9, 0, 0, 0, 0), (30, 0.8, 50, 0.0, 20, 0.9, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (6, 0.5, 4, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 2, 1.0, 0, 0, 0, 0),
    (8, 1.0, 70, 0.0, 50, 0.0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1, 0), (5, 0.0, 4, 1.0, 6, 1.0, 0, 0, 1, 0),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A decision tree by Gini impurity: (feature, threshold, low side, high side) or a label."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < t
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best[0] == np.inf:
        return int(y.mean() >= 0.5)
    low = x[:, best[1]] < best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    table = np.array(EXAMPLES, dtype=np.float64)
    return grow(table[:, :-1], table[:, -1])


def decide(node, features) -> bool:
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] < node[1] else node[3]
    return bool(node)


#: A comment, a declaration, or a tag; quoted attribute values may hold any character.
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.DOTALL
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"\shidden(?:[\s=]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_ENDS = {t: re.compile(rf"</{t}(?![a-zA-Z0-9])", re.IGNORECASE) for t in RAW_TAGS}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in furniture, in content, heading) of every text block, in page order."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked = link_words = 0
    #: open elements: (tag, furniture, content, skipped)
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    #: how many of each tag are open, outside the first ``BOUNDS`` element and then inside each of them
    opened = [Counter()]

    def put(tag: str, *marks: bool) -> None:
        stack.append((tag, *marks))
        if tag in BOUNDS:
            opened.append(Counter())
        opened[-1][tag] += 1

    def drop() -> str:
        tag = stack.pop()[0]
        opened[-1][tag] -= 1
        if tag in BOUNDS:
            opened.pop()
        return tag

    def text(raw: str) -> None:
        nonlocal link_words
        if raw and not stack[-1][3]:
            raw = unescape(raw)
            parts.append(raw)
            if linked:
                link_words += len(raw.split())

    def close() -> None:
        nonlocal link_words
        if parts and (words := "".join(parts).split()):
            _, furniture, content, _ = stack[-1]
            heading = any(t[0] in _HEADINGS for t in stack[-3:])
            out.append((" ".join(words), len(words), min(link_words, len(words)), furniture, content, heading))
        parts.clear()
        link_words = 0

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m.end() == m.start():
                break
            continue
        if not m[4]:  # a tag without an end: a stray quote or the page breaks off
            stop = page.find(">", m.start())
            at = end if stop < 0 else stop + 1
        if m[1]:
            if tag == "a":
                linked = max(0, linked - 1)
            if tag in BLOCK_TAGS:
                close()
            if opened[-1][tag] or tag in CLOSING_TAGS and any(s[tag] for s in opened):
                while drop() != tag:
                    pass
            continue  # a stray end tag closes nothing; which it is, the counts tell at once
        if tag == "br":
            text(" ")
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                close()
            continue
        if tag == "a":
            linked += 1
            continue
        if tag in BLOCK_TAGS:
            close()
            if stack[-1][0] in ("p", *_HEADINGS) or tag in ("li", "td", "th", "tr", "dd", "dt") and stack[-1][0] == tag:
                drop()  # these end where the next block begins
        _, furniture, content, skipped = stack[-1]
        names = set()
        if m[3]:
            for a in _NAMES.findall(m[3]):
                for name in "".join(a).lower().split():
                    words = set(_WORDS.findall(name))
                    if words & LAYOUT_WORDS:
                        words -= FURNITURE_WORDS  # has-sidebar says what stands beside
                    if content or words & CONTENT_WORDS:
                        words.discard("header")  # entry-header is the article's own
                    names |= words
        named = bool(names & FURNITURE_WORDS)
        if furniture and (tag == "main" or tag == "article" and not content and not named):
            furniture = any(e[0] in FURNITURE_TAGS for e in stack)  # a class of a wrapper says nothing about these
        content = content or tag in CONTENT_TAGS or bool(names & CONTENT_WORDS and not named)
        own = tag in FURNITURE_TAGS and not (tag == "header" and content)
        own = own or named and tag not in ("html", "body", "article", "main")
        hidden = bool(m[3]) and _HIDDEN.search(m[3])
        if tag == "svg" and m[3].rstrip().endswith("/"):
            text(" ")
            continue
        if tag in RAW_TAGS:
            stop = _ENDS[tag].search(page, at)
            if stop is None and tag in ("svg", "noscript"):
                continue  # never closed: what follows is still the page
            if stop is None:
                break
            at = stop.start()
            if tag not in BLOCK_TAGS:
                text(" ")
            put(tag, furniture, content, True)
            continue
        if not m[3].rstrip().endswith("/") or tag in BLOCK_TAGS:
            if tag in INLINE_TAGS and not (own or hidden):
                continue  # plain inline marks say nothing about the block
            put(tag, furniture or own, content, skipped or tag in SKIPPED_TAGS or bool(hidden))
    close()
    return out


def main_text(page: str | None, node=None) -> str:
    """The page's content blocks, joined by an empty line."""
    if not page:
        return ""
    node = tree() if node is None else node
    found = blocks(page)
    kept = []
    for k, (text, words, link_words, furniture, content, heading) in enumerate(found):
        before, after = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
        features = (
            words, link_words / words, before[1] if before else 0, before[2] / before[1] if before else 0.0,
            after[1] if after else 0, after[2] / after[1] if after else 0.0, furniture, content, heading,
        )
        if decide(node, features):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``id_col``, ``url_col``, text (empty if none) and n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined
    by two line feeds in page order. A null or empty page has the empty text. Repeated rows and null ids
    are kept as they are; other columns are left out. Whole pages are read, whatever their length.
    """
    prepare(pages.sparkSession)
    node = tree()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [main_text(p, node) for p in b["html"]]
            b["n_chars"] = [len(t) for t in b["text"]]
            yield b[["id", "url", "text", "n_chars"]]

    kind = dict(pages.dtypes)[id_col]
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = source.mapInPandas(texts, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
