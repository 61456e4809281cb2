"""HTML extraction by two passes of block rules.

Pass one decides each block alone by its length, the density of stop words and the
density of links. Pass two gives the blocks that stayed open, most of them short,
the label of the nearest decided neighbours. Which words are stop words is counted
over all pages, since the languages of a crawl aren't known beforehand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
#: What a tag holds up to its end or its next quote.
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
#: Elements whose text is never shown, those outside an article, and those that end a block.
UNSEEN = frozenset("script style noscript template head title iframe object svg canvas audio video select textarea button".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that mark a container outside the article where they are a whole class, id or role.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar sidenav footer masthead commentlist "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe subscription share sharing social related recommended comment comments disqus reply replies "
    "respond popup modal overlay search login signup pagination pager widget widgets toolbar contentinfo complementary dialog alert tags".split()
)
#: Parts that may follow such a word: an ad-slot or a share-buttons-top is boilerplate, an ad-hoc or a social-history is not.
LAYOUT = frozenset(
    "area articles bar block body box button buttons container content count feed footer form header heading icons inner item items left link links list module news outer panel "
    "posts right row section slot stories text thread title top bottom unit widget widgets wrap wrapper".split()
)
#: Of those words, the ones that articles have boxes of too: full paragraphs inside an article stay.
DOUBTFUL = frozenset("alert complementary dialog notice notices overlay promo recommended related search tags".split())
#: Parts before the last one that make it count as the page's own: a site-header, but not an entry-header.
PAGE_PARTS = frozenset("site page global top bottom main left right primary secondary reader user cookie privacy social post article blog".split())
LAST_PARTS = frozenset("nav navigation menu sidebar footer comments responses banner notice popup modal ads share".split())
PAGE_HEADERS = frozenset("header site-header page-header global-header top-header main-header".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset("html body article main".split())
MARKUP = re.compile(r"<[^<>]*>")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")


@dataclass
class Block:
    """One block of a page: its text, how much of it is linked, and where it stands."""

    text: str
    linked: int
    inside: bool
    outside: bool
    heading: bool
    doubtful: bool = False


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass."""

    long: int = 70
    short: int = 25
    link_density: float = 0.33
    stop_low: float = 0.08
    stop_high: float = 0.15
    #: Share of a page's text from which a container isn't taken for boilerplate by its name alone.
    most: float = 0.8


def tags_of(html: str) -> Iterator[tuple[int, int]]:
    """(start, end) of comments, declarations and tags, each character looked at a few times at most.

    A quote that is never closed ends quoting for the rest of the page; what has no end is text, or for a comment the rest of the page.
    """
    at, quotes, next_end = 0, True, html.find(">")
    while (lo := html.find("<", at)) >= 0:
        if 0 <= next_end < lo:
            next_end = html.find(">", lo)
        if next_end < 0 and not html.startswith(("<!--", "<![CDATA["), lo):
            return
        if html.startswith("<!--", lo) or html.startswith("<![CDATA[", lo):
            close = "-->" if html.startswith("<!--", lo) else "]]>"
            end = html.find(close, lo + 4)
            at = len(html) if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), lo):
            at = next_end + 1
        elif NAME.match(html, lo):
            at = UNQUOTED.match(html, lo).end() if quotes else next_end
            while quotes and html[at : at + 1] != ">":
                close = html.find(html[at], at + 1) if at < len(html) else -1
                if close < 0:
                    quotes, at = False, next_end
                else:
                    at = UNQUOTED.match(html, close + 1).end()
            at += 1
        else:
            at = lo + 1
            continue
        yield lo, at


def boiler_words(tag: str) -> set[str]:
    """The words of a tag's class, id and role that mark it as no part of an article."""
    found = set()
    for _, value in ATTRIBUTE.findall(tag):
        for token in value.strip("\"'").lower().split():
            parts = re.split("[-_]+", token)
            if token in PAGE_HEADERS:
                found.add(token)
            elif parts[0] in BOILER and all(x in LAYOUT or x in BOILER or x.isdigit() for x in parts[1:]):
                found.add(parts[0])
            elif parts[-1] in LAST_PARTS and all(x in PAGE_PARTS for x in parts[:-1]):
                found.add(parts[-1])
    return found


def blocks_of(html: str | None, rules: Rules = Rules()) -> list[Block]:
    """Blocks of a page in order. Tolerates missing and crossed end tags; the time is linear in the page's length."""
    html = html or ""
    low = html.lower() if html.isascii() else "".join(c.lower() if c.isascii() else c for c in html)
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, text unseen, outside the article, number of the container that is named so
    named: list[list] = []  # first and last block, articles and main headings before and after, for readers
    open_of: Counter[str] = Counter()
    parts: list[str] = []
    linked = unseen = outside = homes = headings = 0

    def end() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            found.append(Block(text, linked, open_of["article"] + open_of["main"] > 0, outside > 0, headings > 0))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(unescape(raw) if "&" in raw else raw)
        if open_of["a"]:
            linked += len(SPACE.sub(" ", parts[-1]))

    def drop(name: str) -> None:
        nonlocal unseen, outside, headings
        while True:
            last, hidden, off, number = stack.pop()
            open_of[last] -= 1
            unseen -= hidden
            outside -= off
            headings -= last in HEADINGS
            if number >= 0:
                named[number][1], named[number][3] = len(found), homes
            if last == name:
                return

    at = skip = 0
    for lo, hi in tags_of(html):
        if lo < skip:
            continue
        if lo > at and not unseen:
            add(html[at:lo])
        at = hi
        if html[lo + 1] in "!?":
            continue
        name, closing = NAME.match(html, lo)[1].lower(), html[lo + 1] == "/"
        if name in BLOCKS and parts:
            end()
        if closing:
            if open_of[name]:
                drop(name)
        elif name not in VOID and html[hi - 2] != "/":
            if name == "p" and open_of["p"]:  # a paragraph ends the one before
                drop("p")
            words = boiler_words(html[lo:hi]) if "=" in html[lo:hi] and name not in ROOTS else set()
            off = name in OUTSIDE and not (name == "header" and open_of["article"] > 0)
            number = -1
            if words or name == "form":
                number = len(named)
                named.append([len(found), None, homes, None, bool(words & READERS), bool(words) and words <= DOUBTFUL and open_of["article"] + open_of["main"] > 0])
            homes += name in ("article", "main", "h1")
            headings += name in HEADINGS
            stack.append((name, name in UNSEEN, off, number))
            open_of[name] += 1
            unseen += name in UNSEEN
            outside += off
            if name in ("script", "style"):  # their text isn't markup
                close = low.find(f"</{name}", at)
                at = (low.find(">", close) + 1 if close >= 0 else 0) or len(html)
                skip = at
                drop(name)
    if not unseen and at < len(html):
        add(html[at:])
    end()
    sizes = [0]
    for b in found:
        sizes.append(sizes[-1] + len(b.text))
    marks, doubts = [0] * (len(found) + 1), [0] * (len(found) + 1)
    for first, last, before, after, readers, doubtful in named:
        last, after = len(found) if last is None else last, homes if after is None else after
        # A name alone doesn't make boilerplate of what holds the article, its heading or nearly all text.
        if after == before and (readers or sizes[last] - sizes[first] <= rules.most * sizes[-1]):
            kind = doubts if doubtful else marks
            kind[first] += 1
            kind[last] -= 1
    for b, off, doubt in zip(found, accumulate(marks), accumulate(doubts)):
        b.outside, b.doubtful = b.outside or off > 0, doubt > 0
    return found


def classify(block: Block, stop_words: frozenset[str], rules: Rules) -> str:
    """First pass: good, bad, near or open; the last two are left to the neighbours."""
    if block.outside:
        return "bad"
    n = len(block.text)
    if block.linked > rules.link_density * n:
        # Short links of an article are its own, a long one that is all link is a teaser.
        return "near" if block.heading or block.inside and not block.doubtful and n < rules.long else "bad"
    words = WORD.findall(block.text.lower())
    density = sum(w in stop_words for w in words) / max(1, len(words))
    if n >= rules.long and density >= rules.stop_high:
        return "good"
    if block.doubtful:
        return "bad"
    if n >= rules.long and density < rules.stop_low and not block.inside and not block.heading:
        return "bad"
    if n >= rules.short and density >= rules.stop_low or block.heading:
        return "near"
    return "open"


def keep(blocks: list[Block], stop_words: frozenset[str], rules: Rules = Rules()) -> list[bool]:
    """Second pass: a block that is still open takes the label of its nearest decided neighbours.

    Neighbours are decided by density or links and stand in the same region: where an
    article or main element holds at least half of the text that isn't boilerplate, it is
    the only region that is kept. The same label on both sides is taken; between two labels a block
    that came near to good is kept, another follows the nearer one, or the good one at
    equal distance. Without a decided neighbour a block is kept: the page or its article has only such ones.
    """
    labels = [classify(b, stop_words, rules) for b in blocks]
    size = lambda where: sum(len(b.text) for b, x in zip(blocks, labels) if x != "bad" and where(b))
    home = 2 * size(lambda b: b.inside) >= size(lambda b: True) > 0
    region = [not b.outside and (b.inside or not home) for b in blocks]

    def nearest(order: Iterable[int]) -> dict[int, int]:
        found, last = {}, None
        for i in order:
            if last is not None:
                found[i] = last
            if region[i] and labels[i] in ("good", "bad"):
                last = i
        return found

    before, after = nearest(range(len(blocks))), nearest(reversed(range(len(blocks))))
    out = []
    for i, x in enumerate(labels):
        if not region[i] or x in ("good", "bad"):
            out.append(region[i] and x == "good")
            continue
        sides = sorted((abs(j - i), labels[j] != "good") for j in (before.get(i), after.get(i)) if j is not None)
        mixed = len(sides) == 2 and sides[0][1] != sides[1][1]
        out.append(not sides or (x == "near" if mixed and x == "near" else not sides[0][1]))
    return out


def extract_text(html: str | None, stop_words: frozenset[str] = frozenset()) -> str:
    """Kept blocks in page order, joined by an empty line."""
    blocks = blocks_of(html)
    return "\n\n".join(b.text for b, x in zip(blocks, keep(blocks, stop_words)) if x)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct words of each page's text: what a stop word is depends on how many pages have it."""
    for pages in batches:
        counts: Counter[str] = Counter()
        for html in pages:
            counts.update(set(MARKUP.sub(" ", html or "").lower().split()))
        total = [f"{n} {w}" for w, n in counts.items()]
        yield pd.Series([total, *[[]] * (len(pages) - 1)] if len(pages) else [], dtype=object)


def corpus_stop_words(pages: DataFrame, html_col: str = "html", max_words: int = 400, max_length: int = 6) -> frozenset[str]:
    """The ``max_words`` short words that most pages have, counted over all pages.

    Each batch counts its own pages before the shuffle. Only the chosen words reach
    the driver. No pages give no words.
    """
    counted = pages.select(F.explode(_words(F.col(html_col))).alias("x")).select(F.split("x", " ")[1].alias("word"), F.split("x", " ")[0].cast("long").alias("n"))
    top = counted.where(F.length("word") <= max_length).where(~F.col("word").rlike(r"[^\p{L}]")).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(max_words)
    return frozenset(r.word for r in top.collect())


def extract_pages(pages: DataFrame, html_col: str = "html", keep_cols: tuple[str, ...] = ("page_id", "url"), max_words: int = 400) -> DataFrame:
    """``keep_cols`` and text string: the article of every page, read from the whole html.

    Null and empty html give an empty text. Unclosed tags, quotes and comments cost no more than closed ones. Repeated pages give repeated results. Columns
    besides ``keep_cols`` aren't read. An empty table gives no rows.
    """
    stop_words = corpus_stop_words(pages, html_col, max_words)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([extract_text(x, stop_words) for x in htmls], dtype=object)

    return pages.select(*keep_cols, run(F.col(html_col)).alias("text"))
