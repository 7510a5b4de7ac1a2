"""Main text of web pages as the best-scoring contiguous region.

A page is read once into text nodes and tags. Words score by where they stand, tags cost; a
linear scan finds the contiguous region with the highest sum; of equal ones that which ends
first, and of those that which starts last. The weights are log odds counted on pages that label
their own content with an ``article`` or ``main`` element: how often words in a context, and tags
of a name, are inside and outside of it. A weight that few pages support is drawn to its default.
Counting uses a sample of about ``LABELLED_PAGES`` pages, chosen by a hash of the row. The labels
are used for nothing else: every page is cut by its scores.

Elements that are never part of an article (navigation, forms, scripts, adverts, notices,
reader comments and the like, by element or by the words of class, id and role) cost by the word
and are left out of the text wherever they stand.

Defined results: a null or empty page has an empty text; markup that is not closed ends with its
parent; a "<" that no tag follows, or whose tag never ends, is text; the time of a page is in
proportion to its length, broken or not; repeated pages are extracted each; null ids and urls pass through; other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundex.llm.common import map_rows

LABELLED_PAGES = 5_000
PRIOR_PAGES = 10
WORD_SCORE, TAG_SCORE = 1.0, -0.5

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_WHITE = re.compile(r"\s+")

RAW = frozenset("script style textarea template noscript svg math iframe object canvas title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head nav footer aside form menu button select option label input dialog fieldset datalist audio video map".split()
) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
CONTENT = frozenset(("article", "main"))
# With the sets above, the element names that have weights of their own; all others share one.
BLOCKS = frozenset(
    "html body header section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre "
    "blockquote figure figcaption address details summary center hgroup picture ruby rt rp iframe article main".split()
)
# Elements that words of their class cannot exclude.
WHOLE = CONTENT | {"html", "body"}
EXCLUDED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead cookie cookies consent gdpr notice "
    "alert popup modal overlay subscribe subscription newsletter signup login paywall comment comments disqus reply "
    "replies respond related recommended recommendations share sharing social pagination pager toolbar skip hidden".split()
)
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
# The only words that exclude an article that stands inside other content.
NESTED = frozenset("ad advert advertisement comment comments promo related reply sponsored".split())
# A word before that turns an excluded one into a layout hint.
_HINTS = frozenset("has with no without is not".split())


def _excluded(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_content):
        return True
    if not attributes or (tag in WHOLE and not (tag == "article" and in_content)):
        return False
    listed = NESTED if tag == "article" else EXCLUDED
    for name, *values in _MARK.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in EXCLUDED_ROLES:
            return True
        if name in ("class", "id"):
            for part in value.split():
                words = _PART.findall(part)
                if any(w in listed and (k == 0 or words[k - 1] not in _HINTS) for k, w in enumerate(words)):
                    return True
    return False


class _Tags:
    """Finds the items of a page, in time in proportion to its length.

    Where an attribute's quote or a tag never ends, every place on the way is remembered, so that no
    later tag goes the same way to the end again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.endless = page, page.rfind(">"), set()
        self.clear = range(0)

    def stop(self, at: int) -> int:
        """Place of the next ">" or quote; there is one up to the last ">"."""
        if at not in self.clear:
            self.clear = range(at, _STOP.search(self.page, at).start() + 1)
        return self.clear[-1]

    def tag_end(self, at: int) -> int:
        """Place of the ">" that ends a tag whose name ends at ``at``, or -1."""
        page, way = self.page, []
        while at <= self.last:
            at = self.stop(at)
            if at in self.endless:
                break
            if page[at] == ">":
                return at
            way.append(at)
            close = page.find(page[at], at + 1)
            if close < 0:
                break
            at = close + 1
        self.endless.update(way)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next item; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                return start, close + 3 if close >= 0 else len(page), "", "", ""
            if start > self.last:
                # No tag ends any more; a comment may still begin.
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", "", ""
            name = _NAME.match(page, start)
            end = self.tag_end(name.end()) if name else -1
            if end >= 0:
                return start, end + 1, name[1], name[2], page[name.end() : end]
            at = start + 1
        return None


def nodes(page: str) -> Iterator[tuple[str, str, bool, bool, bool]]:
    """(kind, name or text, excluded, inside a labelled content element, in a link) in page order.

    ``kind`` is "text" or "tag"; a text's name is the nearest block element around it.
    """
    stack: list[tuple[str, bool, bool]] = []  # element, excluded, content
    opened: Counter[str] = Counter()
    tags, at, size = _Tags(page), 0, len(page)

    def cut(depth: int) -> None:
        opened.subtract(element for element, *_ in stack[depth:])
        del stack[depth:]

    def state() -> tuple[bool, bool, bool]:
        excluded, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        return excluded, content, any(e[0] == "a" for e in stack[-4:])

    while at < size:
        found = tags.next(at)
        end = found[0] if found else size
        if end > at:
            yield ("text", page[at:end], *state())
        if not found:
            return
        _, at, slash, tag, attributes = found
        tag = tag.lower()
        if not tag:
            continue
        if slash:
            if opened[tag] > 0:
                cut(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] == tag))
            yield ("tag", tag, *state())
            continue
        excluded, content, _ = state()
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and opened[tag] > 0:
            # These end at the next one of their kind, where nothing but inline elements is open.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    cut(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
            excluded, content, _ = state()
        excluded = excluded or _excluded(tag, attributes, content)
        content = content or tag in CONTENT or "articlebody" in attributes.lower()
        if tag in RAW:
            closing = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = closing.end() if closing else size
            yield ("tag", tag, excluded, content, False)
            continue
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, excluded, content))
            opened[tag] += 1
        yield ("tag", tag, excluded, content, False)


def _known(name: str) -> str:
    return name if name in BLOCKS or name in INLINE or name in NEVER or name in VOID else "other"


def _features(page: str) -> Iterator[tuple[str, str, int, bool]]:
    """(feature, raw text, words, inside content) of each node; a tag has no words."""
    block = "body"
    for kind, name, excluded, content, linked in nodes(page):
        if kind == "tag":
            if name not in INLINE:
                block = name
            yield f"tag:{_known(name)}", name, 0, content
        else:
            n = len(name.split())
            where = "excluded" if excluded else "link" if linked else _known(block)
            yield f"word:{where}", name, n, content


def weights(pages: DataFrame, labelled_pages: int = LABELLED_PAGES) -> dict[str, float]:
    """Score of a word by context and of a tag by name.

    Counts are summed by Spark; the table has at most two rows per name that has a weight of its own.
    """
    total = pages.count()
    share = min(1.0, labelled_pages / max(total, 1))
    chosen = F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = pages.filter(chosen & F.lower("html").rlike("<(article|main)[\\s>]")).select("html")

    def make():
        def count(page):
            sums: dict[str, list[int]] = {}
            for feature, _, n, content in _features(page):
                sums.setdefault(feature, [0, 0])[not content] += n or 1
            return [(f, i, o) for f, (i, o) in sums.items()]

        return count

    counts = (
        map_rows(sample, make, "feature string, inside long, outside long")
        .groupBy("feature")
        .agg(F.count("*").alias("pages"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .collect()
    )
    found: dict[str, float] = {}
    for row in counts:
        odds = math.log((row["inside"] + 1) / (row["outside"] + 1))
        if row["feature"].startswith("word:"):
            weight, default = max(-3.0, min(3.0, odds)), WORD_SCORE
        else:
            # A tag always costs: little where it is part of the content, much where it is not.
            weight, default = -min(8.0, math.log1p(math.exp(-odds)) + 0.1), TAG_SCORE
        found[row["feature"]] = (row["pages"] * weight + PRIOR_PAGES * default) / (row["pages"] + PRIOR_PAGES)
    found["word:excluded"] = -1.0
    return found


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """(start, stop) of the contiguous run with the highest sum above zero; (0, 0) if there is none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract(page: str | None, scores: dict[str, float]) -> str:
    """The text of the best region, block by block."""
    if not page:
        return ""
    items = list(_features(page))
    start, stop = best_region(
        scores.get(feature, TAG_SCORE) if feature.startswith("tag:") else n * scores.get(feature, WORD_SCORE)
        for feature, _, n, _ in items
    )
    return _text(items[start:stop])


def _text(items: list[tuple[str, str, int, bool]]) -> str:
    blocks, part = [], []

    def close() -> None:
        text = _WHITE.sub(" ", "".join(part)).strip()
        if text:
            blocks.append(text)
        part.clear()

    for feature, raw, _, _ in items:
        if feature.startswith("tag:"):
            if raw not in INLINE:
                close()
        elif feature != "word:excluded":
            part.append(html.unescape(raw))
    close()
    return " ".join(blocks)


def main_texts(pages: DataFrame, scores: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; the weights are counted on ``pages`` unless given."""
    scores = weights(pages) if scores is None else scores
    held = pages.sparkSession.sparkContext.broadcast(scores)
    schema = pages.select("page_id", "url").schema

    def make():
        def row(page_id, url, page):
            text = extract(page, held.value)
            return [(page_id, url, text, len(text))]

        return row

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return map_rows(pages.select("page_id", "url", "html"), make, f"{types}, text string, n_chars long", batch_rows=1024)
